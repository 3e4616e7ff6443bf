"""Column functions that clean text, build keys and read values out of free text.

Character classes in patterns are spelled out (no look-around), so that they mean the same in Java and
RE2 regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that leave a rule unset, fractions by glyph, units in inches, common font names.
UNSET_WORDS = ("", "ignore", "na", "n/a", "n.a.", "n.a", "not checked", "not check", "none", "-", "—")
FRACTIONS = {"½": 0.5, "¼": 0.25, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 0.125, "⅜": 0.375, "⅝": 0.625}
UNITS = {"cm": 1 / 2.54, "mm": 1 / 25.4, "pt": 1 / 72, "point": 1 / 72, "points": 1 / 72}
FONTS = (
    "Times New Roman", "Arial Black", "Arial Narrow", "Arial", "Book Antiqua", "Bookman Old Style", "Calibri", "Cambria", "Candara", "Century Gothic",
    "Century Schoolbook", "Century", "Comic Sans MS", "Consolas", "Constantia", "Corbel", "Courier New", "Franklin Gothic Medium", "Garamond", "Georgia", "Helvetica",
    "Impact", "Lucida Console", "Lucida Sans Unicode", "Microsoft Sans Serif", "Palatino Linotype", "Rockwell", "Segoe UI", "Tahoma", "Trebuchet MS", "Verdana",
)
# Parts of the names of fonts of signs.
SIGN_FONTS = ("emoji", "symbol", "wingdings", "webdings", "marlett", "dingbat", "barcode", "barracode", "icon", "mt extra", "mtextra", "ms outlook", "msoutlook")


def squash(text: Column) -> Column:
    """White space runs to one space, trimmed; null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def clean_text(text: Column) -> Column:
    """Curly quotes to straight ones, white space squashed."""
    return squash(F.translate(text, "‘’‚‛“”„‟", "''''\"\"\"\""))


def parse_compliant(text: Column) -> Column:
    """1 for yes words, 0 for no words; anything else is an error."""
    low = F.lower(F.trim(text))
    return (
        F.when(low.isin("1", "true", "yes", "y", "compliant"), 1)
        .when(low.isin("0", "false", "no", "n", "noncompliant", "non-compliant"), 0)
        .otherwise(F.raise_error(F.concat(F.lit("not a yes or no: "), F.coalesce(text, F.lit("null")))).cast("int"))
    )


def title_key(title: Column) -> Column:
    """Titles that differ in case, extension or separators share a key."""
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\.(pdf|docx)$", ""), "[ \\t\\r\\n_–—−-]+", " "))


def name_key(name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "_"), "^_|_$", "")
    return F.when(slug == "", "unnamed").otherwise(slug)


def username_key(name: Column) -> Column:
    return F.replace(F.replace(F.lower(F.trim(name)), F.lit("%"), F.lit("%25")), F.lit("."), F.lit("%2E"))


def phone_key(phone: Column) -> Column:
    return F.regexp_replace(F.coalesce(phone, F.lit("")), "[^0-9]", "")


def digest_key(text: Column) -> Column:
    """URL-safe base64 of the SHA-256, without padding."""
    return F.translate(F.base64(F.unhex(F.sha2(text, 256))), "+/=", "-_")


def email_error(email: Column) -> Column:
    value = F.trim(F.coalesce(email, F.lit("")))
    good = value.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & (F.length(value) <= 254)
    return F.when(value == "", "required").when(~good, "invalid")


def username_error(name: Column) -> Column:
    value = F.trim(F.coalesce(name, F.lit("")))
    return F.when(value == "", "required").when(~value.rlike("^[A-Za-z0-9_.]{3,20}$"), "invalid")


def password_error(password: Column) -> Column:
    value = F.coalesce(password, F.lit(""))
    return F.when(F.length(value) < 8, "too short").when(~value.rlike("[A-Za-z]"), "no letter").when(~value.rlike("[0-9]"), "no digit")


def phone_error(phone: Column) -> Column:
    value = F.trim(F.coalesce(phone, F.lit("")))
    return F.when(value == "", None).when(~value.rlike("^[0-9]+$"), "digits only").when(F.length(value) != 11, "length").when(~value.startswith("09"), "prefix")


def rule_unset(value: Column) -> Column:
    """Blank, ignored and not-applicable texts; "0" and "false" are settings."""
    return value.isNull() | F.lower(squash(value)).isin(*UNSET_WORDS)


def font_key(font: Column) -> Column:
    """Comparison key of a font: without subset prefix, punctuation and PostScript suffixes."""
    bare = F.regexp_replace(F.lower(F.element_at(F.split(font, r"\+"), -1)), "[^a-z0-9]", "")
    return F.replace(F.replace(bare, F.lit("psmt"), F.lit("")), F.lit("mt"), F.lit(""))


def font_display(font: Column) -> Column:
    """The family's usual name where the key begins with one, else the name without its prefix."""
    key, out = font_key(font), None
    for name in FONTS:
        own = "".join(c for c in name.lower() if c.isalnum())
        out = F.when(key.startswith(own), name) if out is None else out.when(key.startswith(own), name)
    return out.otherwise(squash(F.element_at(F.split(font, r"\+"), -1)))


def is_decorative(font: Column) -> Column:
    return F.coalesce(F.lower(font).rlike("|".join(SIGN_FONTS)), F.lit(False))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found.try_cast("double"))


def parse_length_inches(text: Column) -> Column:
    """A length in a guide ("1 1/2 in", "2.54 cm", "25mm", "36 pt", "½", "one and a half") in inches, 0 to 5. Beside
    tabs a stated length counts ("1 inch (one tab)"), else each tab is half an inch ("two tabs", "3 tabs", "tab")."""
    t = F.replace(F.lower(F.trim(text)), F.lit(","), F.lit("."))
    mixed = (r"([0-9]+)\s+([0-9]+)\s*/\s*([0-9]+)\s*([a-z]*)", r"([0-9]+)\s*/\s*([0-9]+)\s*([a-z]*)")
    glyph = "".join(FRACTIONS)
    glyphs = rf"([0-9]*)\s*([{glyph}])\s*([a-z]*)"
    plain = r"([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)"
    worded = r"\b(half|one|two|three)( and a half)?\b\s*([a-z]*)"
    of = F.create_map(*[x for k, v in FRACTIONS.items() for x in (F.lit(k), F.lit(v))])
    word = F.create_map(*[x for k, v in {"half": 0.5, "one": 1.0, "two": 2.0, "three": 3.0}.items() for x in (F.lit(k), F.lit(v))])
    unit = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))])
    g = lambda p, i: F.regexp_extract(t, p, i)
    n = lambda p, i: _number(t, p, i)
    amount = (
        F.when(t.rlike(mixed[0]), n(mixed[0], 1) + n(mixed[0], 2) / n(mixed[0], 3))
        .when(t.rlike(glyphs), F.coalesce(n(glyphs, 1), F.lit(0.0)) + F.try_element_at(of, g(glyphs, 2)))
        .when(t.rlike(mixed[1]), n(mixed[1], 1) / n(mixed[1], 2))
        .when(t.rlike(plain), n(plain, 1))
        .when(t.rlike(worded), F.try_element_at(word, g(worded, 1)) + F.when(g(worded, 2) != "", 0.5).otherwise(0.0))
    )
    name = (
        F.when(t.rlike(mixed[0]), g(mixed[0], 4)).when(t.rlike(glyphs), g(glyphs, 3)).when(t.rlike(mixed[1]), g(mixed[1], 3)).when(t.rlike(plain), g(plain, 2)).otherwise(g(worded, 3))
    )
    inches = F.bround(amount * F.coalesce(F.try_element_at(unit, name), F.lit(1.0)), 4)
    parts, measure = mixed[1], r"([0-9]+(?:\.[0-9]+)?)\s*(?:(inch(?:es)?|in|cm|mm|pt)\b|\"|″)"
    stated = F.when(t.rlike(parts), n(parts, 1) / n(parts, 2)).when(t.rlike(measure), n(measure, 1) * F.coalesce(F.try_element_at(unit, g(measure, 2)), F.lit(1.0))).when(t.rlike(r"half[\s-]?inch"), 0.5)
    count = g(r"\b(one|two|[0-9]+)\s*tabs?\b", 1)
    tabs = F.when(count == "one", 1.0).when(count == "two", 2.0).otherwise(count.try_cast("double"))
    in_tabs = F.coalesce(F.bround(stated, 4), F.when(tabs >= 1, 0.5 * tabs), F.when(t.rlike(r"\btab\b"), 0.5))
    return F.when(t.rlike(r"\btabs?\b"), in_tabs).when(inches.between(0.0, 5.0), inches)


def parse_line_spacing(text: Column) -> Column:
    """A spacing as a multiple from 0.8 to 3; exact points are no multiple."""
    t = F.replace(F.lower(F.trim(text)), F.lit(","), F.lit("."))
    number = _number(t, r"([0-9]+(?:\.[0-9]+)?)")
    return (
        F.when(t.rlike(r"\bdouble\b"), 2.0).when(t.rlike(r"\bsingle\b"), 1.0).when(t.rlike(r"one[\s-]+and[\s-]+a[\s-]+half|1\s*½"), 1.5)
        .when(t.rlike(r"[0-9]\s*(pt|points?)\b"), None).when(number.between(0.8, 3.0), number)
    )


def parse_alignment(text: Column) -> Column:
    t = F.lower(squash(text))
    return F.when(t.rlike(r"justif|\bfull\b|\bboth\b"), "justify").when(t.rlike("cent(er|re)"), "center").when(t.rlike(r"\bright\b"), "right").when(t.rlike(r"\bleft\b"), "left")


def parse_paper_size(text: Column) -> Column:
    """struct(name, width, height): named sizes first, else a pair of at least five inches each."""
    t = F.upper(squash(text))
    w, h = (_number(t, r"([0-9]+(?:\.[0-9]+)?)\s*(?:INCHES|IN|\")?\s*[X×]\s*([0-9]+(?:\.[0-9]+)?)", i) for i in (1, 2))
    legal = t.rlike(r"\bLEGAL\b") | ((w == 8.5) & (h == 14))
    a4 = t.rlike(r"\bA4\b") | t.rlike(r"8\.27|210\s*[X×]\s*297")
    letter = t.rlike(r"\bLETTER\b|\bSHORT\s*BOND\b") | ((w == 8.5) & (h == 11))
    fits = (w >= 5) & (h >= 5)
    pick = lambda *v: F.when(legal, v[0]).when(a4, v[1]).when(letter, v[2]).when(fits, v[3])
    return F.struct(pick("LEGAL", "A4", "LETTER", F.lit(None)).alias("name"), pick(8.5, 8.27, 8.5, w).alias("width"), pick(14.0, 11.69, 11.0, h).alias("height"))


def parse_indent_inches(text: Column) -> Column:
    """A first-line indent: unset wordings give none; tabs are half an inch each, never inches, unless a length is stated."""
    return F.when(~rule_unset(text), parse_length_inches(text))


def page_position(text: Column) -> Column:
    """struct(vertical, horizontal, label, no_numbers) of a page-number position."""
    t, unset = F.lower(squash(text)), rule_unset(text)
    up = F.when(~unset & t.rlike(r"\b(top|upper|header)\b"), "top").when(~unset & t.rlike(r"\b(bottom|lower|footer)\b"), "bottom")
    side = F.when(~unset & t.rlike(r"\bleft\b"), "left").when(~unset & t.rlike(r"\bright\b"), "right").when(~unset & t.rlike(r"\b(cent(er|re|ered|red)|middle)\b"), "center")
    none = ~unset & t.rlike(r"\b(no|without) page numbers?\b|\bpage numbers? not required\b|\bdo not (use|include|put|require) page numbers?\b")
    return F.struct(
        up.alias("vertical"), side.alias("horizontal"), F.when(none, "No page numbers").when(up.isNotNull() & side.isNotNull(), F.concat_ws(" ", F.initcap(up), side)).alias("label"), none.alias("no_numbers")
    )


def pagination_options(text: Column) -> Column:
    """struct(first_page, title_page, preliminary, body, markers) of pagination wording."""
    t, set_ = F.lower(squash(text)), ~rule_unset(text)
    hide = t.rlike(r"\b(no|not|without|hidden|hide|suppress[a-z]*|omit[a-z]*|none)\b")
    show = t.rlike(r"\b(shown|show|numbered|visible|display[a-z]*)\b")
    first = F.when(set_ & t.rlike(r"\b(bottom|lower|footer)\b") & t.rlike("cent(er|re)|middle"), "bottom_center").when(set_ & hide, "hidden").when(set_ & (show | t.rlike(r"\bsame\b")), "same")
    title = F.when(set_ & t.rlike("not (be )?counted|uncounted|(does|do) not count|excluded"), "hidden_not_counted").when(set_ & hide, "hidden_counted").when(set_ & show, "shown")
    front = F.when(set_ & t.rlike(r"roman|\bi ?, ?ii\b"), "roman").when(set_ & t.rlike(r"arabic|\b1 ?, ?2\b"), "arabic")
    body = F.when(set_ & t.rlike(r"restart|re-start|(start|begin)s? (again )?(at|with|from) (1|one)\b"), "restart").when(set_ & t.rlike("continu"), "continuous")
    kinds = {
        "chapter_roman": r"chapter (i\b|ii\b|roman)", "chapter_arabic": r"chapter (1\b|2\b|arabic)", "back_matter": "reference|bibliograph|append",
        "preliminary": "prelim|abstract|acknowledg|table of contents|dedication",
    }
    markers = F.filter(F.array(*[F.when(t.rlike(p), k) for k, p in kinds.items()]), lambda x: x.isNotNull())
    return F.struct(first.alias("first_page"), title.alias("title_page"), front.alias("preliminary"), body.alias("body"), markers.alias("markers"))


def alignment_overrides(text: Column) -> Column:
    """"Page 3: justify" lines as a map from 1-based page to alignment; the last of a page wins."""
    lines = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\n;]+"), lambda x: x.contains("page"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"page[_ ]*([0-9]+)", 1).try_cast("int").alias("page"), parse_alignment(F.regexp_extract(x, r"[0-9]+\s*[:=-]\s*(.*)$", 1)).alias("align")))
    good = F.filter(pairs, lambda p: p["page"].isNotNull() & p["align"].isNotNull() & (p["page"] >= 1))
    return F.aggregate(good, F.expr("cast(map() as map<int,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["page"]), F.map_from_arrays(F.array(p["page"]), F.array(p["align"]))))


def spacing_landscape_options(text: Column) -> Column:
    t = F.lower(squash(text))
    spaces = F.when(t.rlike(r"(two|2)( \(2\))? spaces? after|double[- ]space after"), "two").when(t.rlike(r"(one|1|single)( \(1\))? spaces? after|single[- ]space after"), "one")
    wide = F.when(t.rlike("landscape") & t.rlike(r"\b(not|no|never)\b"), "not_allowed").when(t.rlike("landscape") & t.rlike("table|figure"), "tables_figures").when(t.rlike("landscape"), "allowed")
    return F.struct(spaces.alias("word_spacing"), wide.alias("landscape"))


def heading_style_from_text(text: Column) -> Column:
    """struct(bold, italic, letter_case, alignment); null where the wording says nothing."""
    t = F.lower(squash(text))
    flag = lambda name, no: F.when(t.rlike(no), False).when(t.rlike(rf"\b{name}"), True)
    case = F.when(t.rlike("all[- ]?caps|upper[- ]?case|capital letters"), "upper").when(t.rlike("title[- ]?case|initial caps"), "title").when(t.rlike("sentence[- ]?case|lower[- ]?case"), "sentence")
    return F.struct(flag("bold", r"\bnot bold|\bno bold|\bnon-?bold").alias("bold"), flag("italic", r"\bnot italic|\bno italic").alias("italic"), case.alias("letter_case"), parse_alignment(t).alias("alignment"))


# Roman numerals, thousands to ones.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
PAGE_TOKEN = r"^(?i:page\s+)?[-–—]?\s*([0-9]+|(?i:[ivxlcdm]{1,7}))\s*[-–—]?(?:\s*(?:(?i:of)|/)\s*[0-9]+)?$"
PAGE_DIGITS = 4  # of the number of a page among other lines
ROMAN_SHAPE = r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"


def roman_value(token: Column) -> Column:
    """A letter counts against the total where a larger one follows."""
    digits = F.transform(F.split(F.lower(token), ""), lambda c: F.element_at(F.create_map(*[x for v, k in ROMAN if len(k) == 1 for x in (F.lit(k), F.lit(v))]), c))
    step = F.aggregate(F.reverse(digits), F.struct(F.lit(0).alias("total"), F.lit(0).alias("after")), lambda a, d: F.struct((a["total"] + F.when(d < a["after"], -d).otherwise(d)).alias("total"), d.alias("after")))
    return step["total"]


def page_token(text: Column, digits: int | None = None) -> Column:
    """struct(value, style) of a printed page number such as "7", "iv", "Page 3 of 10" or "- 12 -", up to the greatest
    64-bit one. For lines of any sort, ``digits`` is the most that a number of a page may have."""
    pattern = PAGE_TOKEN if digits is None else PAGE_TOKEN.replace("[0-9]+", f"[0-9]{{1,{digits}}}")
    token = F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), pattern, 1)
    arabic = token.rlike("^[0-9]+$")
    roman = (token != "") & F.lower(token).rlike(ROMAN_SHAPE)
    style = F.when(arabic, "arabic").when(roman, F.when(token == F.lower(token), "roman_lower").when(token == F.upper(token), "roman_upper").otherwise("other"))
    return F.struct(F.when(arabic, token.try_cast("long")).when(roman, roman_value(token)).alias("value"), style.alias("style"))


def format_page_value(value: Column, style: Column) -> Column:
    """The printed form of a page number in a style."""
    step = F.array(*[F.struct(F.lit(amount).alias("amount"), F.lit(letters).alias("letters")) for amount, letters in ROMAN])
    begin = F.struct(F.lit("").alias("out"), value.cast("int").alias("rest"))

    def add(a, s):
        times = F.floor(a["rest"] / s["amount"]).cast("int")
        return F.struct(F.concat(a["out"], F.repeat(s["letters"], times)).alias("out"), (a["rest"] - times * s["amount"]).alias("rest"))

    out = F.aggregate(step, begin, add)["out"]
    roman = F.when(style == "roman_upper", F.upper(out)).otherwise(out)
    return F.when(style.isin("roman_lower", "roman_upper") & (value > 0), roman).otherwise(value.cast("string"))


def color_channels(packed: Column) -> Column:
    return F.array(F.shiftright(packed, 16).bitwiseAND(255), F.shiftright(packed, 8).bitwiseAND(255), packed.bitwiseAND(255))


def mostly_black(pieces: Column) -> Column:
    """False when over half the visible characters have a channel above 0x50. ``pieces``: array of (text, color)."""
    size = lambda p: F.length(F.regexp_replace(p["text"], r"\s", ""))
    total = F.aggregate(pieces, F.lit(0), lambda a, p: a + size(p))
    bright = F.aggregate(pieces, F.lit(0), lambda a, p: a + F.when(F.exists(color_channels(p["color"]), lambda c: c > 0x50), size(p)).otherwise(0))
    return F.when(total > 0, 2 * bright <= total)


def text_shape(text: Column) -> Column:
    """struct(all_caps, title_case): every letter upper-case; every longer word begins upper-case."""
    letters = F.regexp_replace(text, "[^A-Za-z]", "")
    words = F.regexp_extract_all(text, F.lit("([A-Za-z]{4,})"), F.lit(1))
    return F.struct(((letters != "") & (letters == F.upper(letters))).alias("all_caps"), ((F.size(words) > 0) & F.forall(words, lambda w: F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1)))).alias("title_case"))


def flatten_guide_text(text: Column) -> Column:
    """One line of guide text: hyphen breaks joined, bullets and breaks to spaces, colons closed up."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"([A-Za-z])-[ \t]*\n[ \t]*([a-z])", "$1$2")
    return squash(F.regexp_replace(F.regexp_replace(joined, "[•▪◦●\\n\\r\\t]+", " "), r"\s+:", ":"))


# Headings that a manuscript should have.
HEADINGS = ("introduction", "method", "result", "discussion", "conclusion", "reference")


def manuscript_quick_score(title: Column, abstract: Column, text: Column) -> Column:
    """struct(score, flags, passed): deductions from 100 for short parts and missing sections."""
    blob = F.lower(F.concat_ws("\n", title, abstract, text))
    missing = F.filter(F.array(*[F.lit(h) for h in HEADINGS]), lambda h: ~blob.contains(h))
    words = F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))
    bad = [(F.length(F.trim(title)) < 8, "title", F.lit(15)), (F.length(F.trim(abstract)) < 80, "abstract", F.lit(20)), (F.size(missing) > 0, "sections", F.least(F.lit(40), 8 * F.size(missing))), (words < 200, "length", F.lit(15))]
    score = F.greatest(F.lit(0), F.lit(100) - sum((F.when(b, n).otherwise(0) for b, _, n in bad), F.lit(0)))
    flags = F.filter(F.array(*[F.when(b, f) for b, f, _ in bad]), lambda f: f.isNotNull())
    return F.struct(score.alias("score"), flags.alias("flags"), (score >= 60).alias("passed"))


# Verbs that make a line on a table or figure a sentence.
CAPTION_VERBS = (
    "presents?|shows?|illustrates?|depicts?|displays?|contains?|lists?|summarizes?|provides?|describes?|indicates?|demonstrates?|reveals?|highlights?|outlines?|"
    "compares?|reports?|includes?|gives?|explains?|discusses?|examines?|introduces?|represents?|defines?|details?|covers?|follows?|appears?|refers?|corresponds?"
)


def caption_prose(text: Column) -> Column:
    """A line on a table or figure that is a sentence, not a caption."""
    raw = squash(text)
    rest = F.trim(F.regexp_extract(raw, r"^(?i:table|figure|fig\.?) [0-9]+(?:\.[0-9]+)*\s*[:.–-]?\s*(.*)$", 1))
    verb = rest.rlike(rf"^(?i:{CAPTION_VERBS})\b")
    words = F.size(F.split(rest, " "))
    long = (words >= 12) | ((F.length(rest) >= 80) & rest.rlike(r",|^.{8}.*\."))
    return (rest != "") & (verb | long | (rest.rlike("^[a-z]") & (words >= 6)))
