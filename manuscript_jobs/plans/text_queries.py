"""Queries on column functions: texts are made from the tables' rows by position in short lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _sql_list(values) -> str:
    quote = lambda v: "NULL" if v is None else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "[" + ", ".join(map(quote, values)) + "]"


def _picked(values, index: str) -> str:
    return f"{_sql_list(values)}[{index} % {len(values)} + 1]"


@query("clean_text", "SELECT doc_id, md5(trim(regexp_replace(translate('“ ' || text || ' ’', '“’', '\"''), '\\s+', ' ', 'g'))) AS cleaned FROM documents".replace("'\"''", "'\"'''"))
def clean_text(t):
    return t.documents.select("doc_id", F.md5(T.clean_text(F.concat(F.lit("“ "), "text", F.lit(" ’")))).alias("cleaned"))


_YES = ("yes", " TRUE", "1", "compliant", "no", "False ", "0", "Non-Compliant")


@query("parse_compliant", f"SELECT l_orderkey, l_linenumber, l_partkey, {_picked((1, 1, 1, 1, 0, 0, 0, 0), 'l_partkey')} AS ok FROM lineitem")
def parse_compliant(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", T.parse_compliant(_pick(_YES, F.col("l_partkey"))).alias("ok"))


@query("title_key", "SELECT version_id, 'thesis ' || (version_id % 3)::VARCHAR || CASE WHEN version_id % 2 = 0 THEN '' ELSE ' draft' END AS title_key FROM versions")
def title_key(t):
    return t.versions.select("version_id", T.title_key(F.col("title")).alias("title_key"))


@query("name_key", "SELECT p_partkey, replace(p_name, ' ', '_') AS k, 'brand_' || substr(p_brand, 7) AS b, CASE WHEN p_partkey % 7 = 0 THEN 'unnamed' ELSE 'x' END AS e FROM part")
def name_key(t):
    e = F.when(F.col("p_partkey") % 7 == 0, " -- ").otherwise("_X_")
    return t.part.select("p_partkey", *[T.name_key(c).alias(a) for c, a in ((F.initcap("p_name"), "k"), (F.col("p_brand"), "b"), (e, "e"))])


@query(
    "identity_keys",
    """SELECT c_custkey, 'customer#' || substr(c_name, 10) || '%2Ea%25' AS username_key, '09' || lpad(c_custkey::VARCHAR, 9, '0') AS phone_key,
       rtrim(translate(to_base64(from_hex(sha256(lower(c_name) || '@x.org'))), '+/', '-_'), '=') AS email_key FROM customer""",
)
def identity_keys(t):
    phone = F.concat(F.lit("(09) "), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return t.customer.select(
        "c_custkey", T.username_key(F.concat(F.lit(" "), "c_name", F.lit(".A% "))).alias("username_key"), T.phone_key(phone).alias("phone_key"),
        T.digest_key(F.concat(F.lower("c_name"), F.lit("@x.org"))).alias("email_key"),
    )


_EMAILS, _USERS = ("a@b.co", " ", "a@b", "two words@x.org", None), ("good_name", "no", "bad name", "", "a.b")
_PASS, _PHONES = ("short1", "longenough", "12345678", "longenough1"), ("09123456789", "0912", "x", "", "19123456789")


@query(
    "field_errors",
    f"""SELECT c_custkey, {_picked((None, 'required', 'invalid', 'invalid', 'required'), 'c_custkey')} AS email, {_picked((None, 'invalid', 'invalid', 'required', None), 'c_custkey')} AS username,
        {_picked(('too short', 'no digit', 'no letter', None), 'c_custkey')} AS password, {_picked((None, 'length', 'digits only', None, 'prefix'), 'c_custkey')} AS phone FROM customer""",
)
def field_errors(t):
    k = F.col("c_custkey")
    return t.customer.select(
        "c_custkey", T.email_error(_pick(_EMAILS, k)).alias("email"), T.username_error(_pick(_USERS, k)).alias("username"),
        T.password_error(_pick(_PASS, k)).alias("password"), T.phone_error(_pick(_PHONES, k)).alias("phone"),
    )


_FONTS = ("ABCDEF+TimesNewRomanPSMT", "ArialMT", "Calibri-Bold", "Wingdings 3", "Comic Sans")


@query(
    "font_key",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {_picked(('timesnewroman', 'arial', 'calibribold', 'wingdings3', 'comicsans'), 'l_partkey')} AS font_key,
        {_picked(('Times New Roman', 'Arial', 'Calibri', 'Wingdings 3', 'Comic Sans'), 'l_partkey')} AS display, l_partkey % 5 = 3 AS decorative FROM lineitem""",
)
def font_key(t):
    f = _pick(_FONTS, F.col("l_partkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", T.font_key(f).alias("font_key"), T.font_display(f).alias("display"), T.is_decorative(f).alias("decorative"))


@query(
    "parse_length_inches",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN v <= 5 THEN v END, 4) AS inches FROM (SELECT *, CASE l_partkey % 7 WHEN 0 THEN l_quantity / 2.54 WHEN 1 THEN l_quantity / 25.4
       WHEN 2 THEN l_quantity / 72 WHEN 3 THEN 1 + l_suppkey % 4 / 4.0 WHEN 4 THEN 1.5 WHEN 5 THEN l_quantity WHEN 6 THEN 0.5 * (l_suppkey % 3 + 1) END AS v FROM lineitem)""",
)
def parse_length_inches(t):
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_partkey") % 7
    s = (F.col("l_suppkey") % 4).cast("string")
    text = (
        F.when(k == 0, F.concat(q, F.lit(" cm"))).when(k == 1, F.concat(q, F.lit("mm"))).when(k == 2, F.concat(q, F.lit(" points"))).when(k == 3, F.concat(F.lit("1 "), s, F.lit("/4 inches")))
        .when(k == 4, F.when(F.col("l_suppkey") % 2 == 0, "One and a half inches").otherwise("1½\"")).when(k == 5, F.concat(q, F.lit(",00"))).otherwise(F.concat((F.col("l_suppkey") % 3 + 1).cast("string"), F.lit(" tabs")))
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", T.parse_length_inches(text).alias("inches"))


_SPACINGS = ("Double-spaced", "single", "one and a half", "1.15 lines", "12 pt", "9", None, "2,5")


@query("parse_line_spacing", f"SELECT l_orderkey, l_linenumber, l_partkey, {_picked((2.0, 1.0, 1.5, 1.15, None, None, None, 2.5), 'l_partkey')}::DOUBLE AS spacing FROM lineitem")
def parse_line_spacing(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", T.parse_line_spacing(_pick(_SPACINGS, F.col("l_partkey"))).alias("spacing"))


_ALIGN = ("Justified", "fully  both sides", "Centre of page", "flush right", "Left", "leftover", "")


@query("parse_alignment", f"SELECT l_orderkey, l_linenumber, l_partkey, {_picked(('justify', 'justify', 'center', 'right', 'left', None, None), 'l_partkey')} AS alignment FROM lineitem")
def parse_alignment(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", T.parse_alignment(_pick(_ALIGN, F.col("l_partkey"))).alias("alignment"))


_PAPER = ("Use A4 paper", "8.5 x 11 inches", "8.5\" x 14\"", "short bond", "7 x 10", "2 x 3", "Legal")


@query(
    "parse_paper_size",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {_picked(('A4', 'LETTER', 'LEGAL', 'LETTER', None, None, 'LEGAL'), 'l_partkey')} AS name,
        {_picked((8.27, 8.5, 8.5, 8.5, 7.0, None, 8.5), 'l_partkey')}::DOUBLE AS width, {_picked((11.69, 11.0, 14.0, 11.0, 10.0, None, 14.0), 'l_partkey')}::DOUBLE AS height FROM lineitem""",
)
def parse_paper_size(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", T.parse_paper_size(_pick(_PAPER, F.col("l_partkey"))).alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "p.*")


@query(
    "parse_indent_inches",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN 0.5 * (l_suppkey % 4 + 1) WHEN 1 THEN round((l_suppkey % 10) / 2.54::DOUBLE, 3) WHEN 2 THEN round((l_suppkey % 10) / 2.54::DOUBLE, 3)
       WHEN 3 THEN 1.0 WHEN 4 THEN 0.5 END AS indent FROM lineitem""",
)
def parse_indent_inches(t):
    n = lambda m, d: (F.col("l_suppkey") % m + d).cast("string")
    k = F.col("l_partkey") % 6
    text = (
        F.when(k == 0, F.concat(n(4, 1), F.lit(" tab"))).when(k == 1, F.concat(n(10, 0), F.lit("cm"))).when(k == 2, F.concat(n(10, 0), F.lit(" cm (one tab)")))
        .when(k == 3, "two tabs").when(k == 4, "by the tab key, half-inch").otherwise("N/A")
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(T.parse_indent_inches(text), 3).alias("indent"))


_POS = ("Upper right corner", "bottom centre of the footer", "N/A", "no page numbers", "left margin", "Header, middle")


@query(
    "page_position",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {_picked(('top', 'bottom', None, None, None, 'top'), 'l_partkey')} AS vertical, {_picked(('right', 'center', None, None, 'left', 'center'), 'l_partkey')} AS horizontal,
        {_picked(('Top right', 'Bottom center', None, 'No page numbers', None, 'Top center'), 'l_partkey')} AS label, l_partkey % 6 = 3 AS no_numbers FROM lineitem""",
)
def page_position(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", T.page_position(_pick(_POS, F.col("l_partkey"))).alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "p.*")


_PAGING = ("hidden, not counted; roman i, ii", "Shown; chapter 1 restarts at 1", "ignore", "bottom center, Arabic, continuous; abstract and references", "omitted on chapter I")


@query(
    "pagination_options",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {_picked(('hidden', 'same', None, 'bottom_center', 'hidden'), 'l_partkey')} AS first_page,
        {_picked(('hidden_not_counted', 'shown', None, None, 'hidden_counted'), 'l_partkey')} AS title_page,
        {_picked(('roman', None, None, 'arabic', None), 'l_partkey')} AS preliminary, {_picked((None, 'restart', None, 'continuous', None), 'l_partkey')} AS body,
        {_picked(('', 'chapter_arabic', '', 'back_matter,preliminary', 'chapter_roman'), 'l_partkey')} AS markers FROM lineitem""",
)
def pagination_options(t):
    o = T.pagination_options(_pick(_PAGING, F.col("l_partkey")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", o.alias("o")).select("l_orderkey", "l_linenumber", "l_partkey", "o.first_page", "o.title_page", "o.preliminary", "o.body", F.concat_ws(",", "o.markers").alias("markers"))


@query(
    "alignment_overrides",
    """SELECT l_orderkey, l_linenumber, l_partkey, '{' || (l_suppkey % 9 + 1)::VARCHAR || ':center,20:' || CASE WHEN l_partkey % 2 = 0 THEN 'left' ELSE 'justify' END || '}' AS pages FROM lineitem""",
)
def alignment_overrides(t):
    text = F.concat(
        F.lit("Page "), (F.col("l_suppkey") % 9 + 1).cast("string"), F.lit(": centered\npage_20 = right\nnothing here\nPage 20: "), F.when(F.col("l_partkey") % 2 == 0, "Left").otherwise("justified")
    )
    m = T.alignment_overrides(text)
    shown = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"])), ","), F.lit("}"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", shown.alias("pages"))


_OPTS = ("Two (2) spaces after a period", "one space after periods; landscape for tables", "no landscape pages", "Landscape allowed", "nothing")


@query(
    "spacing_landscape_options",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {_picked(('two', 'one', None, None, None), 'l_partkey')} AS word_spacing, {_picked((None, 'tables_figures', 'not_allowed', 'allowed', None), 'l_partkey')} AS landscape FROM lineitem""",
)
def spacing_landscape_options(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", T.spacing_landscape_options(_pick(_OPTS, F.col("l_partkey"))).alias("o")).select("l_orderkey", "l_linenumber", "l_partkey", "o.*")


_HEADS = ("Bold, ALL CAPS, centered", "not bold; italic, flush left", "Title case", "sentence-case bold italics")


@query(
    "heading_style_from_text",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, [true, false, NULL, true][l_partkey % 4 + 1] AS bold, [NULL, true, NULL, true][l_partkey % 4 + 1] AS italic,
        {_picked(('upper', None, 'title', 'sentence'), 'l_partkey')} AS letter_case, {_picked(('center', 'left', None, None), 'l_partkey')} AS alignment FROM lineitem""",
)
def heading_style_from_text(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", T.heading_style_from_text(_pick(_HEADS, F.col("l_partkey"))).alias("o")).select("l_orderkey", "l_linenumber", "l_partkey", "o.*")


_UNSET = ("IGNORE", "0", None, " n/a ", "false", "-", "Arial", "Not  checked")


@query("rule_unset", "SELECT l_orderkey, l_linenumber, l_partkey, [true, false, true, true, false, true, false, true][l_partkey % 8 + 1] AS unset FROM lineitem")
def rule_unset(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", T.rule_unset(_pick(_UNSET, F.col("l_partkey"))).alias("unset"))


@query(
    "page_token",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 5 WHEN 4 THEN NULL WHEN 3 THEN 14 ELSE l_suppkey END AS value,
       ['arabic', 'arabic', 'arabic', 'roman_lower', NULL][l_partkey % 5 + 1] AS style FROM lineitem""",
)
def page_token(t):
    n, k = F.col("l_suppkey").cast("string"), F.col("l_partkey") % 5
    text = F.when(k == 0, n).when(k == 1, F.concat(F.lit("Page "), n, F.lit(" of 999"))).when(k == 2, F.concat(F.lit("- "), n, F.lit(" -"))).when(k == 3, "xiv").otherwise("iix pages")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", T.page_token(text).alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("p.value").cast("long").alias("value"), "p.style")


_ONES = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
_TENS = ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc")
_HUND = ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm")


@query(
    "format_page_value",
    f"""SELECT p_partkey, v AS value, {_sql_list(_HUND)}[v // 100 + 1] || {_sql_list(_TENS)}[v // 10 % 10 + 1] || {_sql_list(_ONES)}[v % 10 + 1] AS printed, v AS back
        FROM (SELECT p_partkey, p_partkey % 899 + 1 AS v FROM part)""",
)
def format_page_value(t):
    v = t.part.select("p_partkey", (F.col("p_partkey") % 899 + 1).alias("value"))
    v = v.withColumn("printed", T.format_page_value(F.col("value"), F.lit("roman_lower")))
    return v.withColumn("back", T.roman_value(F.col("printed")).cast("long"))


@query(
    "color_channels",
    """SELECT p_partkey, c // 65536 AS r, c // 256 % 256 AS g, c % 256 AS b, NOT greatest(c // 65536, c // 256 % 256, c % 256) > 80 AS black
       FROM (SELECT p_partkey, p_partkey * 7919 % 16777216 AS c FROM part)""",
)
def color_channels(t):
    c = (F.col("p_partkey") * 7919 % 16777216).cast("int")
    pieces = F.array(F.struct(F.lit("abc d").alias("text"), c.alias("color")), F.struct(F.lit("xy").alias("text"), F.lit(0).alias("color")))
    ch = T.color_channels(c)
    return t.part.select("p_partkey", *[ch[i].cast("long").alias(n) for i, n in enumerate("rgb")], T.mostly_black(pieces).alias("black"))


@query(
    "text_shape",
    """SELECT doc_id, n, regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '[a-z]') AS all_caps,
       regexp_matches(text, '[A-Za-z]{4,}') AND NOT regexp_matches(text, '(^|[^A-Za-z])[a-z][A-Za-z]{3,}') AS title_case FROM units""",
)
def text_shape(t):
    return t.units.select("doc_id", "n", T.text_shape(F.col("text")).alias("s")).select("doc_id", "n", "s.*")


@query(
    "flatten_guide_text",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[•\n\r\t]+', ' ', 'g'), '\s+:', ':', 'g'), '\s+', ' ', 'g'))) AS flat FROM documents""",
)
def flatten_guide_text(t):
    return t.documents.select("doc_id", F.md5(T.flatten_guide_text(F.col("text"))).alias("flat"))


@query(
    "manuscript_quick_score",
    r"""WITH a AS (SELECT doc_id, source, text, len(list_filter(['introduction', 'method', 'result', 'discussion', 'conclusion', 'reference'], lambda h: NOT contains(lower(source || chr(10) || left(text, 100) || chr(10) || text), h))) AS missing,
                  len(regexp_extract_all(text, '[^ \n\t\r\f\v]+')) AS words FROM documents)
       SELECT doc_id, greatest(0, 100 - 15 - CASE WHEN length(trim(left(text, 100))) < 80 THEN 20 ELSE 0 END - least(40, 8 * missing) - CASE WHEN words < 200 THEN 15 ELSE 0 END) AS score,
              1 + (length(trim(left(text, 100))) < 80)::INT + (missing > 0)::INT + (words < 200)::INT AS n_flags FROM a""",
)
def manuscript_quick_score(t):
    s = T.manuscript_quick_score(F.col("source"), F.substring("text", 1, 100), F.col("text"))
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", "s.score", F.size("s.flags").alias("n_flags"))


_CAPS = ("Table 3 presents the results", "Figure 2. Mean values", "Table 4", "figure 7 the line goes on and on here", "Table 9. short title", "Fig. 1: Shows it")


@query("caption_prose_filter", "SELECT l_orderkey, l_linenumber, l_partkey, [true, false, false, true, false, true][l_partkey % 6 + 1] AS prose FROM lineitem")
def caption_prose_filter(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", T.caption_prose(_pick(_CAPS, F.col("l_partkey"))).alias("prose"))
