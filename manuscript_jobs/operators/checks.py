"""Compliance checks: units against rules.

Each check gives one row per unit with ``category`` and ``ok`` (the observations) and what was wrong, from
which ``findings_of`` takes the failures. A category without a set rule gives no rows at all. Rules come
as a small keyed table (one row per document or guide) joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CAPTION_VERBS, PAGE_DIGITS, font_key, page_token, parse_alignment, rule_unset
from .layout import BACK_MATTER, CHAPTER, PAGE, PRELIMINARY, REFERENCE_HEADER, by_doc, by_page

# The tolerance of a size in points, and the spacings in use.
SIZE_TOLERANCE = 0.75
STANDARD_SPACINGS = (1.0, 1.15, 1.5, 2.0, 2.5, 3.0)


def findings_of(checked: DataFrame) -> DataFrame:
    """Failures as findings: (scan_id, category, issue_type, severity, page, line, excerpt)."""
    return checked.where("not ok").select(
        F.col("doc_id").alias("scan_id"), "category", F.explode("problems").alias("p"), (F.col("page_index") + 1).alias("page"), (F.col("line_index") + 1).alias("line"), F.substring("text", 1, 80).alias("excerpt")
    ).select("scan_id", "category", "p.issue_type", "p.severity", "page", "line", "excerpt")


def _problems(*tests: tuple[Column, str, str]) -> Column:
    each = [F.when(bad, F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"))) for bad, kind, severity in tests]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def _checked(units: DataFrame, category: str, *tests: tuple[Column, str, str]) -> DataFrame:
    out = units.withColumn("problems", _problems(*tests))
    return out.select("doc_id", "n", "page_index", "line_index", "text", F.lit(category).alias("category"), (F.size("problems") == 0).alias("ok"), "problems")


def check_fonts(units: DataFrame, rules: DataFrame) -> DataFrame:
    """Family (either name within the other), size within 0.75 points of the body size, black ink.
    Rules: (doc_id, families, body_size, black); a document with none of them is not scored."""
    used, tests = _font_tests("bright" in units.columns)
    return _checked(units.join(rules, "doc_id").where(used), "Fonts", *tests)


def _font_tests(bright_known: bool) -> tuple[Column, list]:
    used = (F.trim("text") != "") & ((F.size("families") > 0) | F.col("body_size").isNotNull() | F.coalesce("black", F.lit(False)))
    key = font_key(F.col("font"))
    listed = F.transform("families", font_key)
    family = (F.size("families") > 0) & ~F.exists(listed, lambda f: key.contains(f) | f.contains(key))
    size = F.coalesce(F.abs(F.col("size") - F.col("body_size")) > SIZE_TOLERANCE, F.lit(False))
    bright = F.coalesce(F.col("black") & F.col("bright"), F.lit(False)) if bright_known else F.lit(False)
    return used, [(bright, "font_color", "minor"), (family, "font_family", "critical"), (size, "font_size", "critical")]


def check_heading_styles(units: DataFrame, rules: DataFrame) -> DataFrame:
    """Consecutive lines of one heading role are a group: bold by share of characters (60 %), alignment.
    Rules: (role, bold, alignment)."""
    heads = units.where(F.col("role").startswith("heading")).withColumn("_gap", F.coalesce(F.col("n") - F.lag("n").over(by_doc()) > 1, F.lit(True)) | F.coalesce(F.col("role") != F.lag("role").over(by_doc()), F.lit(True)))
    island = F.sum(F.col("_gap").cast("int")).over(by_doc())
    groups = heads.withColumn("island", island).groupBy("doc_id", "role", "island").agg(
        F.min("n").alias("n"), F.count("*").alias("lines"), F.min_by("page_index", "n").alias("page_index"), F.min_by("line_index", "n").alias("line_index"), F.min_by("text", "n").alias("text"),
        (F.sum(F.when(F.col("face") == "bold", F.length("text")).otherwise(0)) / F.greatest(F.sum(F.length("text")), F.lit(1))).alias("bold_share"), F.min_by("alignment", "n").alias("alignment"),
    )
    j = groups.join(F.broadcast(rules.select("role", F.col("bold").alias("_b"), F.col("alignment").alias("_a"))), "role")  # a row per heading level
    weight = F.coalesce(F.col("_b") != (F.col("bold_share") >= 0.6), F.lit(False))
    side = F.coalesce(F.col("_a") != F.col("alignment"), F.lit(False))
    return _checked(j, "Fonts", (weight, "heading_bold", "moderate"), (side, "heading_alignment", "moderate"))


def check_paper(pages: DataFrame, wide_pages: DataFrame, width: float, height: float, tolerance: float = 0.15) -> DataFrame:
    """Findings only: page size within the tolerance either way round; landscape only on table or figure pages."""
    near = lambda a, b: F.abs(a - b) <= tolerance
    w, h = F.col("width"), F.col("height")
    size = ~((near(w, width) & near(h, height)) | (near(w, height) & near(h, width)))
    allowed = pages.join(wide_pages.select(*PAGE).distinct().withColumn("_allowed", F.lit(True)), list(PAGE), "left")
    turned = (w > h) & F.col("_allowed").isNull()
    return allowed.withColumn("problems", _problems((size, "paper_size", "critical"), (turned, "page_orientation", "moderate"))).select(*PAGE, F.explode("problems").alias("p")).select(*PAGE, "p.issue_type", "p.severity")


def check_margins(margins: DataFrame, rules: dict[str, float], gutter: float = 0.0, tolerance: float = 0.15) -> DataFrame:
    """One unit per page and side; only margins that are too small fail, by how much (0.2, 0.45 inches)."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), (F.col(s) / 72).alias("actual"), F.lit(r + (gutter if s == "left" else 0)).alias("wanted")) for s, r in rules.items()])
    own = margins.select(*PAGE, F.inline(sides)).withColumn("short", F.col("wanted") - F.col("actual"))
    severity = F.when(F.col("short") > 0.45, "critical").when(F.col("short") > 0.2, "moderate").otherwise("minor")
    bad = F.col("short") > tolerance
    return own.select(*PAGE, "side", (~bad).alias("ok"), F.when(bad, severity).alias("severity"))


def modal_indent(paragraphs: DataFrame) -> DataFrame:
    from .layout import weighted_mode

    return weighted_mode(paragraphs, ["doc_id"], F.col("indent"), F.lit(1), F.col("n"), "modal")


def check_indent_docx(units: DataFrame, rule: float, skip: DataFrame, tolerance: float = 0.12) -> DataFrame:
    """First-line indents relative to the document's usual body indent less the rule; glossary lines are left
    out. The first line of each ``paragraph`` is judged."""
    opens = F.min("n").over(Window.partitionBy("doc_id", "paragraph"))
    first = units.withColumn("_opens", opens).where((F.col("n") == F.col("_opens")) & (F.length("text") >= 20)).join(skip, ["doc_id", "n"], "left_anti")
    j = first.join(modal_indent(first), "doc_id")
    base = F.when(F.abs(F.col("modal") - rule) <= tolerance, 0.0).otherwise(F.col("modal") - rule)
    return _checked(j, "Indentation", (F.abs(F.col("indent") - F.when(base > 0, base).otherwise(0.0) - rule) > tolerance, "first_line_indent", "moderate"))


def glossary_section_lines(units: DataFrame, heading: str = r"^(?i:definition of terms|table)\b") -> DataFrame:
    """Body lines between a glossary heading and the next heading."""
    value = F.trim("text")
    any_head = F.col("role").isin("heading1", "heading2", "heading_other", "table", "figure")
    mark = F.when(value.rlike(heading), F.lit(True)).when(any_head, F.lit(False))
    inside = F.last(mark, True).over(by_doc().rowsBetween(Window.unboundedPreceding, 0))
    return units.withColumn("_in", inside).where(F.col("_in") & (F.col("role") == "body")).select("doc_id", "n")


def check_indent_pdf(paragraphs: DataFrame, rule: float = 0.5) -> DataFrame:
    """First-line indents measured on pages: within 0.12 inches of the rule passes. Where 55 % of a document's
    measured paragraphs share one indent that passes, those within 0.12 of it pass too. Within 0.25 of the rule, or
    without a second line to measure against, is uncertain and counts as passed; the rest fails."""
    own = paragraphs.withColumn("indent", F.round((F.col("first_x") - F.col("left_x")) / 72, 2))
    counts = own.where("lines > 1").groupBy("doc_id", "indent").agg(F.count("*").alias("c"))
    mode = counts.groupBy("doc_id").agg(F.max_by("indent", F.struct("c", -F.col("indent"))).alias("mode"), (F.max("c") / F.sum("c")).alias("share"))
    j = own.join(mode, "doc_id", "left")
    apart = lambda a, b: F.round(F.abs(a - b), 4)
    off, usual = apart(F.col("indent"), rule), (F.col("share") >= 0.55) & (apart(F.col("mode"), rule) <= 0.12) & (apart(F.col("indent"), F.col("mode")) <= 0.12)
    verdict = F.when(F.col("lines") == 1, F.when(off <= 0.12, "pass").otherwise("uncertain")).when((off <= 0.12) | F.coalesce(usual, F.lit(False)), "pass").when(off <= 0.25, "uncertain").otherwise("fail")
    return j.select(*PAGE, "paragraph", "indent", verdict.alias("verdict"), (verdict != "fail").alias("ok"))


def spacing_matches(actual: Column, expected: Column) -> Column:
    """A measured multiple is the required one: within 0.12; or on the same standard multiple; or a little
    above it (three tenths at most) and clear of the next standard."""
    spacings = F.array(*[F.lit(s) for s in STANDARD_SPACINGS])
    nearest = F.array_min(F.transform(spacings, lambda s: F.struct(F.round(F.abs(s - actual), 6).alias("d"), s.alias("s"))))["s"]
    higher = F.coalesce(F.array_min(F.filter(spacings, lambda s: s > expected + 0.05)), expected + 1)
    above = (actual > expected) & (actual <= higher - 0.12) & ((actual - expected) / F.greatest(expected, F.lit(0.5)) <= 0.3)
    return (F.abs(actual - expected) <= 0.12) | ((F.abs(actual - nearest) <= 0.16) & (F.abs(nearest - expected) <= 0.05)) | above


def pdf_spacing(gap: Column, font: Column, box: Column) -> Column:
    """The multiple nearest a standard one among gap / (1.15 em), gap / em and gap / box height."""
    font = F.greatest(font, F.lit(6.0))
    ratios = F.array(gap / (font * 1.15), gap / font, F.when(box >= 6, gap / F.greatest(box, font * 0.85)))
    spacings = F.array(*[F.lit(s) for s in STANDARD_SPACINGS])
    scored = F.transform(F.filter(ratios, lambda r: r.between(0.6, 3.2)), lambda r: F.struct(F.array_min(F.transform(spacings, lambda s: F.round(F.abs(s - r), 9))).alias("d"), r.alias("r")))
    return F.round(F.array_min(scored)["r"], 2)


def check_spacing(lines: DataFrame, allowed: list[float]) -> DataFrame:
    """Spacing of each line that has another below it in its paragraph, against any allowed value.
    ``actual`` is the measured multiple. (doc_id, paragraph, n, ...)"""
    below = F.lead("n").over(Window.partitionBy("doc_id", "paragraph").orderBy("n"))
    pairs = lines.withColumn("_below", below).where("_below is not null and actual is not null")
    good = spacing_matches(F.col("actual"), F.lit(allowed[0]))
    for value in allowed[1:]:
        good = good | spacing_matches(F.col("actual"), F.lit(value))
    return _checked(pairs, "Spacing", (~good, "line_spacing", "moderate"))


def _sentence_gaps(spaces: int) -> tuple[Column, str]:
    text = F.regexp_replace("text", r"\b(Dr|Mr|Mrs|Ms|St|vs|etc|Fig|No)\. +", "$1_")
    return text, r"[.!?]  +[A-Z]" if spaces == 1 else r"[.!?] [A-Z]"


def check_word_spacing(units: DataFrame, spaces: int = 1) -> DataFrame:
    """The first place in a paragraph where a sentence end is followed by another number of spaces than the rule's;
    abbreviations don't end sentences."""
    text, wrong = _sentence_gaps(spaces)
    at = F.length(F.regexp_extract(text, rf"^(?s:(.*?)){wrong}", 1))
    hit = text.rlike(wrong)
    return units.select("doc_id", "n", (~hit).alias("ok"), F.when(hit, at).alias("offset"))


def check_alignment(units: DataFrame, rules: DataFrame, least: int = 40) -> DataFrame:
    """Body lines of at least ``least`` characters that aren't their paragraph's last; a page's override beats the
    rule, and lines of single-line paragraphs may read left for justify.
    Units: + paragraph; rules: (doc_id, alignment, overrides map)."""
    w = Window.partitionBy("doc_id", "paragraph")
    last = F.lead("n").over(w.orderBy("n")).isNull()
    own = units.withColumn("_size", F.count("*").over(w)).withColumn("_last", last)
    j = own.where((~F.col("_last") | (F.col("_size") == 1)) & (F.length("text") >= least)).join(rules.select("doc_id", F.col("alignment").alias("_rule"), "overrides"), "doc_id")
    wanted = F.coalesce(F.try_element_at("overrides", (F.col("page_index") + 1).cast("int")), F.when(~rule_unset(F.col("_rule")), parse_alignment(F.col("_rule"))))
    good = (F.col("alignment") == wanted) | ((wanted == "justify") & (F.col("alignment") == "left") & (F.col("_size") == 1))
    return _checked(j.withColumn("_w", wanted).where("_w is not null"), "Alignment", (~good, "alignment", "moderate"))


def check_page_numbers(pages: DataFrame, marks: DataFrame, starts: DataFrame, vertical: str, horizontal: str, chapter_hidden: bool = True) -> DataFrame:
    """Per page: number missing, in another place, or shown on a page where it must not be."""
    openers = starts.where("kind = 'chapter'").select(*PAGE, F.lit(True).alias("_opener"))
    j = pages.select(*PAGE).distinct().join(marks, list(PAGE), "left").join(openers, list(PAGE), "left")
    hidden = (F.col("page_index") == 0) | (F.coalesce("_opener", F.lit(False)) & F.lit(chapter_hidden))
    shown = F.col("value").isNotNull()
    issue = F.when(hidden & shown, "page_number_shown").when(~hidden & ~shown, "page_number_missing").when(~hidden & ((F.col("vertical") != vertical) | (F.col("horizontal") != horizontal)), "page_number_position")
    return j.select(*PAGE, issue.alias("issue_type"), issue.isNull().alias("ok"))


def hidden_chapter_inference(marks: DataFrame) -> DataFrame:
    """Pages without a number between a higher one before and a lower one after open a hidden chapter."""
    w = Window.partitionBy("doc_id").orderBy("page_index")
    before, after = F.lag("value").over(w), F.lead("value").over(w)
    return marks.withColumn("_b", before).withColumn("_a", after).where("value is null and _b is not null and _a is not null and _a < _b").select(*PAGE)


def check_page_sequence(marks: DataFrame) -> DataFrame:
    """Each number should follow the one before it in its block (roman front, arabic body); a 1 restarts.
    (doc_id, page_index, value, style)."""
    block = F.when(F.col("style") == "arabic", "body").otherwise("front")
    own = marks.withColumn("block", block)
    w = Window.partitionBy("doc_id", "block").orderBy("page_index")
    expected = F.lag("value").over(w) + F.col("page_index") - F.lag("page_index").over(w)
    return own.withColumn("expected", expected).select(*PAGE, "block", "value", "expected", (F.col("expected").isNull() | (F.col("value") == F.col("expected")) | (F.col("value") == 1)).alias("ok"))


def check_caption_form(captions: DataFrame, upper: bool = False, title_needed: bool = True) -> DataFrame:
    """Caption lines against what the rule's wording asks for: a title, its case, the full word Figure."""
    return _checked(captions, "Captions", *_caption_tests(upper, title_needed))


def _caption_tests(upper: bool, title_needed: bool) -> list:
    value = F.trim("text")
    rest = F.trim(F.regexp_extract(value, r"^(?i:table|figure|fig\.?)\s+[0-9.]+\s*[:.–-]?\s*(.*)$", 1))
    return [
        ((rest == "") & F.lit(title_needed), "caption_title_missing", "moderate"), (F.lit(upper) & (rest != F.upper(rest)), "caption_case", "minor"),
        (value.rlike("^(?i:fig\\.)"), "caption_prefix", "minor"),
    ]


def caption_prose_lines(units: DataFrame) -> DataFrame:
    value = F.trim("text")
    return units.where(value.rlike(rf"^(?i:table|figure)\s+[0-9]+\s*[:.–-]?\s*(?i:{CAPTION_VERBS})\b")).select("doc_id", "n")


def check_object_placement(units: DataFrame, near: int = 8) -> DataFrame:
    """Runs of object lines (``object`` is not null) and their nearest captions before and after: an as-of match by
    the last and next caption of the document in reading order, at most ``near`` lines away. Tables want theirs
    above, figures below."""
    w = Window.partitionBy("doc_id").orderBy("n")
    cap = F.when(F.col("role").isin("table", "figure"), F.col("n"))
    own = units.withColumn("before", F.last(cap, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first(cap, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    runs = own.where("object is not null")
    start = F.coalesce((F.col("n") - F.lag("n").over(w) > 1) | (F.col("object") != F.lag("object").over(w)), F.lit(True))
    runs = runs.withColumn("_s", start.cast("int")).withColumn("cluster", F.sum("_s").over(w))
    out = runs.groupBy("doc_id", "cluster", "object").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.min_by("before", "n").alias("before"), F.max_by("after", "n").alias("after"))
    up, down = F.col("first") - F.col("before"), F.col("after") - F.col("last")
    above, below = F.coalesce(up <= near, F.lit(False)), F.coalesce(down <= near, F.lit(False))
    issue = F.when(~above & ~below, "caption_missing").when((F.col("object") == "table") & ~above, "caption_side").when((F.col("object") == "figure") & ~below, "caption_side")
    return out.select("doc_id", "cluster", "object", "first", "last", issue.alias("issue_type"))


# In-text citation markers by family and the families a style allows.
NUMERIC = r"\[[0-9]+(\s*[-,]\s*[0-9]+)*\]"
AUTHOR_YEAR = r"\([A-Z][A-Za-z'’-]+(\s+(et al\.|&\s+[A-Z][A-Za-z'’-]+))?,?\s+[0-9]{4}[a-z]?(,\s*p+\.\s*[0-9]+)?\)"
AUTHOR_PAGE = r"\(([A-Z][a-z]{3,}(\s+and\s+[A-Z][a-z]{3,})?\s+[0-9]{1,3}|[A-Z][a-z]{2}\s+[0-9]{2,3})\)"
ALLOWED = {"APA": ("author_year",), "MLA": ("author_page",), "IEEE": ("numeric",), "VANCOUVER": ("numeric",), "HARVARD": ("author_year",), "TURABIAN": ("author_year", "numeric")}


def _marker_families() -> Column:
    return F.filter(F.array(*[F.when(F.col("text").rlike(p), f) for p, f in ((NUMERIC, "numeric"), (AUTHOR_YEAR, "author_year"), (AUTHOR_PAGE, "author_page"))]), lambda x: x.isNotNull())


def _allowed_families() -> Column:
    allowed = F.lit(None)
    for style, families in ALLOWED.items():
        allowed = F.when(F.upper("style") == style, F.array(*[F.lit(f) for f in families])).otherwise(allowed)
    return allowed


def check_citation_markers(units: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines with markers against the families the document's style allows; table cells and documents without any
    marker and reference head give nothing. Rules: (doc_id, style)."""
    has, allowed = _marker_families(), _allowed_families()
    marked = units.where(F.coalesce(F.col("role") != "toc", F.lit(True))).withColumn("families", has).where(F.size("families") > 0)
    j = marked.join(rules, "doc_id").withColumn("_a", allowed).where("_a is not null")
    return _checked(j, "Citations", (F.size(F.array_except("families", "_a")) > 0, "citation_style", "moderate"))


def reference_entries(units: DataFrame) -> DataFrame:
    """Lines from a reference head to the next heading, joined into entries; an entry opens where a surname and
    initial stand first."""
    head = F.trim("text").rlike(REFERENCE_HEADER)
    other = F.col("role").isin("heading1", "heading2", "heading_other") & ~head
    inside = F.last(F.when(head, F.lit(1)).when(other, F.lit(0)), True).over(by_doc().rowsBetween(Window.unboundedPreceding, 0))
    lines = units.withColumn("_in", inside).withColumn("_head", head).where("_in = 1 and not _head").where(F.trim("text") != "")
    opens = F.col("text").rlike(r"^[A-Z][A-Za-z'’-]+, [A-Z]\.")
    numbered = lines.withColumn("_o", opens.cast("int")).withColumn("entry", F.sum("_o").over(by_doc())).where("entry > 0")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: F.trim(x["text"]))
    return numbered.groupBy("doc_id", "entry").agg(F.min("n").alias("n"), F.count("*").alias("lines"), F.concat_ws(" ", parts).alias("text"))


def check_reference_style(entries: DataFrame, rules: DataFrame, pinned: DataFrame) -> DataFrame:
    """The style an entry's year shows (in brackets after the author: APA; at the end: MLA) against the rule's; lines
    with an earlier finding are left out."""
    shape = F.when(F.col("text").rlike(r"^[^(]{1,80}\([0-9]{4}[a-z]?\)"), "APA").when(F.col("text").rlike(r"[0-9]{4}\.?$"), "MLA")
    j = entries.join(pinned, ["doc_id", "n"], "left_anti").join(rules, "doc_id").withColumn("shape", shape).where("shape is not null")
    return j.select("doc_id", "entry", "shape", "style", (F.col("shape") == F.upper("style")).alias("ok"))


def check_citation_style_ml(predicted: DataFrame, rules: DataFrame, pinned: DataFrame, least: float = 0.62) -> DataFrame:
    """Classified markers (doc_id, n, style, confidence) of enough confidence that differ from the rule's style."""
    j = predicted.where(F.col("confidence") >= least).join(pinned, ["doc_id", "n"], "left_anti").join(rules.withColumnRenamed("style", "wanted"), "doc_id")
    return j.select("doc_id", "n", F.col("style").alias("found"), "wanted", (F.col("style") == F.upper("wanted")).alias("ok"))


#: Rules that a scan applies to every document; those of single documents come in its table of rules.
SCAN = {
    "headings": {"heading1": (True, "center"), "heading2": (True, None)}, "margins": {"left": 1.5, "right": 1.0, "top": 1.0, "bottom": 1.0},
    "indent": 0.5, "spacings": (2.0,), "spaces": 1, "number": ("top", "right"), "caption_upper": False,
}


def run_scan(units: DataFrame, rules: DataFrame, scan: dict = SCAN, width: int = 612, height: int = 792) -> tuple[DataFrame, DataFrame]:
    """(observations, findings) of all ten checks of whole documents: fonts, headings, margins, indentation, line and
    word spacing, alignment, page numbers, captions and citation markers.

    Units: one row a line with its formatting, role, box and paragraph; rules: one row a document (families,
    body_size, black, alignment, overrides, style); documents without one are not scanned. Units meet their rules
    by document once; every window after that lies within a document, so nothing is shuffled again before the
    checks are told line by line. Margins, page numbers and headings are told on the first line of their page or group.
    """
    doc, page, whole = by_doc(), by_page(), Window.partitionBy("doc_id")
    of_page, of_para = Window.partitionBy(*PAGE), Window.partitionBy("doc_id", "paragraph")
    text, full, role = F.trim("text"), F.trim("text") != "", F.col("role")
    top, bottom, center = F.col("y0"), height - F.col("y1"), (F.col("x0") + F.col("x1")) / 2
    token = page_token(F.col("text"), PAGE_DIGITS)
    mark = F.struct(token["value"].cast("int").alias("value"), F.when(top <= bottom, "top").otherwise("bottom").alias("vertical"), F.when(center < 204, "left").when(center > 408, "right").otherwise("center").alias("horizontal"))
    kind = F.when(text.rlike(CHAPTER), "chapter").when(text.rlike(BACK_MATTER), "back_matter").when(text.rlike(PRELIMINARY), "preliminary")
    heads = role.startswith("heading")
    glossary = F.when(text.rlike(r"^(?i:definition of terms|table)\b"), True).when(role.isin("heading1", "heading2", "heading_other", "table", "figure"), False)
    so_far = doc.rowsBetween(Window.unboundedPreceding, 0)
    u = units.join(rules.withColumnRenamed("alignment", "alignment_rule"), "doc_id").withColumns({
        "_page_first": F.col("n") == F.min("n").over(of_page), "_full_first": F.col("n") == F.min(F.when(full, F.col("n"))).over(of_page),
        "_left": F.min(F.when(full, F.col("x0"))).over(of_page), "_right": width - F.max(F.when(full, F.col("x1"))).over(of_page),
        "_top": F.min(F.when(full, F.col("y0"))).over(of_page), "_bottom": height - F.max(F.when(full, F.col("y1"))).over(of_page),
        "_mark": F.min(F.when(token["value"].isNotNull() & (F.least(top, bottom) <= 0.15 * height), F.struct(F.least(top, bottom).alias("d"), F.col("n"), mark.alias("m")))).over(of_page)["m"],
        "_at": F.sum(full.cast("int")).over(page), "_below": F.lead("n").over(of_para.orderBy("n")), "_lines": F.count("*").over(of_para),
        "_opens": F.col("n") == F.min("n").over(of_para), "_glossary": F.coalesce(F.last(glossary, True).over(so_far) & (role == "body"), F.lit(False)),
        "_group": heads & ~F.coalesce((F.lag("role").over(doc) == role) & (F.lag("n").over(doc) == F.col("n") - 1), F.lit(False)),
    })
    u = u.withColumns({
        "_start": F.min(F.when(full & (F.col("_at") <= 6) & kind.isNotNull(), F.struct("n", kind.alias("kind"), F.lower(text).alias("title")))).over(of_page),
        "_island": F.sum(F.col("_group").cast("int")).over(doc), "_judged": F.col("_opens") & (F.length("text") >= 20) & ~F.col("_glossary"), "_heads": heads,
    })
    same, island = Window.partitionBy("doc_id", "indent"), Window.partitionBy("doc_id", "_island", "_heads")
    u = u.withColumns({
        "_before": F.last(F.when(F.col("_page_first"), F.col("_start.title")), True).over(doc.rowsBetween(Window.unboundedPreceding, -1)),
        "_votes": F.when(F.col("_judged"), F.struct(F.sum(F.col("_judged").cast("int")).over(same), -F.min(F.when(F.col("_judged"), F.col("n"))).over(same), F.col("indent").alias("indent"))),
        "_bold": F.sum(F.when(F.col("face") == "bold", F.length("text")).otherwise(0)).over(island) / F.greatest(F.sum(F.length("text")).over(island), F.lit(1)),
    }).withColumn("_modal", F.max("_votes").over(whole)["indent"])

    def told(category: str, when: Column, *tests) -> Column:
        return F.when(when, F.struct(F.lit(category).alias("category"), _problems(*tests).alias("problems")))

    checks = [told("Fonts", _font_tests(False)[0], *_font_tests(False)[1])]
    for name, (bold, side) in scan["headings"].items():
        tests = [(F.lit(bold) != (F.col("_bold") >= 0.6), "heading_bold", "moderate")] if bold is not None else []
        tests += [(F.col("alignment") != side, "heading_alignment", "moderate")] if side is not None else []
        checks.append(told("Fonts", F.col("_group") & (role == name), *tests))
    for side, wanted in scan["margins"].items():
        short = wanted - F.col(f"_{side}") / 72
        tests = [((short > low) & (short <= high), f"margin_{side}", severity) for low, high, severity in ((0.15, 0.2, "minor"), (0.2, 0.45, "moderate"), (0.45, 1e9, "critical"))]
        checks.append(told("Margins", F.col("_full_first"), *tests))
    rule = scan["indent"]
    base = F.greatest(F.when(F.abs(F.col("_modal") - rule) <= 0.12, 0.0).otherwise(F.col("_modal") - rule), F.lit(0.0))
    checks.append(told("Indentation", F.col("_judged"), (F.abs(F.col("indent") - base - rule) > 0.12, "first_line_indent", "moderate")))
    good = F.lit(False)
    for value in scan["spacings"]:
        good = good | spacing_matches(F.col("line_spacing"), F.lit(value))
    checks.append(told("Spacing", F.col("_below").isNotNull() & F.col("line_spacing").isNotNull(), (~good, "line_spacing", "moderate")))
    gaps, wrong = _sentence_gaps(scan["spaces"])
    checks.append(told("Spacing", F.lit(True), (gaps.rlike(wrong), "word_spacing", "minor")))
    wanted = F.coalesce(F.try_element_at("overrides", (F.col("page_index") + 1).cast("int")), F.when(~rule_unset(F.col("alignment_rule")), parse_alignment(F.col("alignment_rule"))))
    single = (wanted == "justify") & (F.col("alignment") == "left") & (F.col("_lines") == 1)
    lines = (F.col("_below").isNotNull() | (F.col("_lines") == 1)) & (F.length("text") >= 40) & wanted.isNotNull()
    checks.append(told("Alignment", lines, (~((F.col("alignment") == wanted) | single), "alignment", "moderate")))
    opener = F.coalesce((F.col("_start.kind") == "chapter") & F.coalesce(F.col("_before") != F.col("_start.title"), F.lit(True)), F.lit(False))
    hidden, shown = (F.col("page_index") == 0) | opener, F.col("_mark").isNotNull()
    elsewhere = (F.col("_mark.vertical") != scan["number"][0]) | (F.col("_mark.horizontal") != scan["number"][1])
    tests = ((hidden & shown, "page_number_shown", "moderate"), (~hidden & ~shown, "page_number_missing", "moderate"), (~hidden & shown & elsewhere, "page_number_position", "moderate"))
    checks.append(told("Pagination", F.col("_page_first"), *tests))
    checks.append(told("Captions", role.isin("table", "figure"), *_caption_tests(scan["caption_upper"], True)))
    families, allowed = _marker_families(), _allowed_families()
    checks.append(told("Citations", (role != "toc") & (F.size(families) > 0) & allowed.isNotNull(), (F.size(F.array_except(families, allowed)) > 0, "citation_style", "moderate")))
    each = u.select("doc_id", "page_index", "line_index", "text", F.explode(F.array_compact(F.array(*checks))).alias("c"))
    each = each.select("doc_id", "page_index", "line_index", "text", "c.category", "c.problems", (F.size("c.problems") == 0).alias("ok"))
    return each.select(F.col("doc_id").alias("scan_id"), "category", "ok"), findings_of(each)
