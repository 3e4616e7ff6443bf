"""Queries on format guides: each document's text under sentences chosen by its id."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import guides as G
from . import fixtures
from .registry import query
from .text_queries import _pick, _sql_list

PAPER = ("Paper size: A4.", "Use 8.5 x 11 inches bond paper, portrait.", "Legal paper in landscape is not allowed.", "")
SPACING = ("The text must be double-spaced.", "Line spacing: 1.5 lines.", "Use single spacing and an indent of 0.5 inch.", "")
MARGIN = ("Margins: 1 inch on all sides.", "Left margin: 1.5 inches; right margin: 1 inch.", "Margins of 2.54 cm on all sides. Later use margins of 1.5 inches on all sides.", "")
ALIGN = ("Justify the text.", "Align text flush left.", "", "Page 2: centered")
FONT = ("Font: Times New Roman, 12 pt.", "Use Arial 11 or 12 pt.", "Use Arial, size 11 pt; headings in Calibri 14 pt.", "")
PAGING = ("Page numbers: upper right.", "There are no page numbers.", "Numbers at the bottom center; roman numerals for preliminary pages.", "")
CITE = ("Follow the APA style.", "Citation style: MLA.", "IEEE style references.", "")
HEAD = ("Heading 1: bold, ALL CAPS, centered. Heading 2: italic, left.", "", "Tables and figures stand on one page.", "Insert the seal here.")
PARTS = (PAPER, SPACING, MARGIN, ALIGN, FONT, PAGING, CITE, HEAD)


STEP = (1, 2, 3, 5, 7, 11, 13, 17)


def _index(i: int):
    return F.expr(f"doc_id div {STEP[i]}")


def _at(i: int) -> str:
    return f"(guide_id // {STEP[i]}) % 4"


def view_guides(t):
    said = F.concat_ws("\n", *[_pick(p, _index(i)) for i, p in enumerate(PARTS)])
    return G.with_flat(t.documents.select(F.col("doc_id").alias("guide_id"), F.concat(said, F.lit("\n"), F.col("text")).alias("text")))


fixtures.view_guides = view_guides
fixtures.SQL["gids"] = "SELECT doc_id AS guide_id, text AS tail FROM documents"
fixtures.SQL["guides"] = (
    "SELECT guide_id, " + " || chr(10) || ".join(f"{_sql_list(p)}[{_at(i)} + 1]" for i, p in enumerate(PARTS)) + " || chr(10) || tail AS text FROM gids"
)


def _of(i: int, values) -> str:
    return f"{_sql_list(values)}[{_at(i)} + 1]"


_SENT = r"""SELECT guide_id, at, trim(regexp_replace(s, '\s+', ' ', 'g')) AS sentence FROM (SELECT guide_id, unnest(p) AS s, unnest(range(len(p))) AS at FROM (
        SELECT guide_id, string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '[\n\r]+') AS p FROM guides))
    WHERE length(trim(regexp_replace(s, '\s+', ' ', 'g'))) BETWEEN 8 AND 400"""
fixtures.SQL["sentences"] = _SENT


@query("guide_sentences", "SELECT guide_id, at, sentence FROM sentences")
def guide_sentences(t):
    return G.guide_sentences(t.guides)


@query("label_value", f"SELECT guide_id, {_of(0, ('A4', None, None, None))} AS paper_size, {_of(1, (None, '1.5 lines', None, None))} AS line_spacing, {_of(4, ('Times New Roman, 12 pt', None, None, None))} AS font FROM gids")
def label_value(t):
    x = F.col("flat")
    return t.guides.select("guide_id", G.label_value(x, "paper size").alias("paper_size"), G.label_value(x, "line spacing").alias("line_spacing"), G.label_value(x, "font").alias("font"))


@query("extract_paper", f"SELECT guide_id, {_of(0, ('A4', 'LETTER', 'LEGAL', None))} AS paper, {_of(0, (None, 'portrait', 'landscape', None))} AS orientation FROM gids")
def extract_paper(t):
    return t.guides.select("guide_id", G.extract_paper(F.col("flat"), F.col("clauses")).alias("p")).select("guide_id", "p.paper", "p.orientation")


@query("extract_spacing_indent", f"SELECT guide_id, {_of(1, (2.0, 1.5, 1.0, None))}::DOUBLE AS line_spacing, {_of(1, (None, None, 0.5, None))}::DOUBLE AS indent FROM gids")
def extract_spacing_indent(t):
    return t.guides.select("guide_id", G.extract_spacing_indent(F.col("flat"), F.col("clauses")).alias("p")).select("guide_id", "p.line_spacing", "p.indent")


_M = [f'{_of(2, v)}::DOUBLE AS "{s}"' for s, v in (("left", (1.0, 1.5, 1.5, None)), ("right", (1.0, 1.0, 1.5, None)), ("top", (1.0, None, 1.5, None)), ("bottom", (1.0, None, 1.5, None)))]
_SIDES = ("left", "right", "top", "bottom")


@query("extract_margins", f"SELECT guide_id, {', '.join(_M)} FROM gids")
def extract_margins(t):
    return t.guides.select("guide_id", G.extract_margins(F.col("flat")).alias("m")).select("guide_id", *[F.try_element_at("m", F.lit(s)).alias(s) for s in _SIDES])


@query(
    "margin_mentions",
    f"""SELECT guide_id, unnest(range(len(m))) AS at, unnest(m)::DOUBLE AS inches, unnest([NULL] || m[:len(m) - 1])::DOUBLE AS before
        FROM (SELECT guide_id, CASE {_at(2)} WHEN 0 THEN [1.0] WHEN 2 THEN [1.0, 1.5] ELSE [] END AS m FROM gids) WHERE len(m) > 0""",
)
def margin_mentions(t):
    return G.margin_mentions(t.guides)


@query("margin_conflicts", f"SELECT guide_id, 2 AS n_mentions, 1.5::DOUBLE AS chosen, 1.0::DOUBLE AS rejected FROM gids WHERE {_at(2)} = 2")
def margin_conflicts(t):
    return G.margin_conflicts(t.guides)


_E = [f'{_of(2, v)}::DOUBLE AS "{s}"' for s, v in (("left", (1.0, 1.5, 9.0, None)), ("right", (1.0, 1.0, 9.0, None)), ("top", (1.0, None, 9.0, None)), ("bottom", (1.0, None, 9.0, None)))]


@query("expand_margins", f"SELECT guide_id, {', '.join(_E)} FROM gids")
def expand_margins(t):
    m = G.extract_margins(F.col("flat"))
    only_all = F.when(F.size(G.uniform_mentions(F.col("flat"))) == 1, F.create_map(F.lit("all"), F.lit(1.0))).when(F.size(G.uniform_mentions(F.col("flat"))) == 2, F.create_map(F.lit("all"), F.lit(9.0))).otherwise(m)
    return G.expand_margins(t.guides.select("guide_id", only_all.alias("margins")))


@query("extract_alignment", f"SELECT guide_id, {_of(3, ('justify', 'left', None, None))} AS alignment, {_of(3, (None, None, None, 'center'))} AS page_2 FROM gids")
def extract_alignment(t):
    return t.guides.select("guide_id", G.extract_alignment(F.col("flat"), F.col("text")).alias("a")).select("guide_id", "a.alignment", F.try_element_at("a.overrides", F.lit(2)).alias("page_2"))


_FAMILIES = ("Times New Roman", "Arial", "Arial,Calibri", "")


@query("extract_fonts", f"SELECT guide_id, {_of(4, _FAMILIES)} AS families, {_of(4, (None, None, 14.0, None))}::DOUBLE AS heading_size FROM gids")
def extract_fonts(t):
    return t.guides.select("guide_id", G.extract_fonts(F.col("flat")).alias("f")).select("guide_id", F.concat_ws(",", "f.families").alias("families"), "f.heading_size")


@query("body_size_candidates", f"SELECT guide_id, {_of(4, (12, 12, 11, 0))} AS size FROM gids WHERE {_at(4)} < 3")
def body_size_candidates(t):
    return G.body_size_candidates(t.guides).where("rank = 1").select("guide_id", "size")


@query("ambiguous_values", f"SELECT guide_id, '11 or 12 pt' AS source FROM gids WHERE {_at(4)} = 1")
def ambiguous_values(t):
    return G.ambiguous_values(t.guides)


@query("extract_pagination", f"SELECT guide_id, {_of(5, ('Top right', 'No page numbers', 'Bottom center', None))} AS position, {_of(5, (None, None, 'roman', None))} AS preliminary FROM gids")
def extract_pagination(t):
    return t.guides.select("guide_id", G.extract_pagination(F.col("flat"), F.col("clauses")).alias("p")).select("guide_id", "p.position", "p.preliminary")


@query("extract_heading_styles", f"SELECT guide_id, {_of(7, ('upper', None, None, None))} AS case_1, {_of(7, ('left', None, None, None))} AS align_2 FROM gids")
def extract_heading_styles(t):
    m = G.extract_heading_styles(F.col("flat"))
    return t.guides.select("guide_id", F.try_element_at(m, F.lit(1))["letter_case"].alias("case_1"), F.try_element_at(m, F.lit(2))["alignment"].alias("align_2"))


@query("extract_layout_rules", f"SELECT guide_id, {_at(7)} = 2 AS has_tables FROM gids")
def extract_layout_rules(t):
    return t.guides.select("guide_id", G.extract_layout_rules(F.col("clauses"))["tables"].isNotNull().alias("has_tables"))


@query("extract_citation_style", f"SELECT guide_id, {_of(6, ('APA', 'MLA', 'IEEE', None))} AS style FROM gids")
def extract_citation_style(t):
    return t.guides.select("guide_id", G.extract_citation_style(F.col("flat")).alias("style"))


@query(
    "derive_rules",
    f"""SELECT guide_id, {_of(0, ("A4", "LETTER", "LEGAL", None))} AS paper, {_of(0, (None, "portrait", "landscape", None))} AS orientation, {_of(0, (None, None, "not_allowed", None))} AS landscape_pages,
        {_of(1, (2.0, 1.5, 1.0, None))}::DOUBLE AS line_spacing, {_of(1, (None, None, 0.5, None))}::DOUBLE AS indent, {", ".join(m.replace('AS "', 'AS "margin_') for m in _M)},
        {_of(3, ("justify", "left", None, None))} AS alignment, {_of(3, (None, None, None, "center"))} AS page_2, {_of(4, _FAMILIES)} AS families, {_of(4, (None, None, 14.0, None))}::DOUBLE AS heading_size,
        {_of(5, ("Top right", "No page numbers", "Bottom center", None))} AS position, {_of(5, (None, None, "roman", None))} AS preliminary, {_of(5, (False, True, False, None))}::BOOLEAN AS no_numbers,
        {_of(7, ("upper", None, None, None))} AS case_1, {_of(7, ("left", None, None, None))} AS align_2, CASE WHEN {_at(7)} = 2 THEN CASE WHEN {" AND ".join(f"{_at(i)} = 3" for i in (3, 4, 5, 6))} THEN 'Page 2: centered ' ELSE '' END || 'Tables and figures stand on one page' END AS tables,
        {_of(6, ("APA", "MLA", "IEEE", None))} AS citation_style FROM gids""",
)
def derive_rules(t):
    """Every structure of the rules, field by field."""
    r = G.derive_rules(t.guides)
    return r.select(
        "guide_id", "paper.paper", "paper.orientation", "paper.landscape_pages", "spacing.line_spacing", "spacing.indent", *[F.try_element_at("margins", F.lit(s)).alias(f"margin_{s}") for s in _SIDES],
        "alignment.alignment", F.try_element_at("alignment.overrides", F.lit(2)).alias("page_2"), F.concat_ws(",", "font.families").alias("families"), "font.heading_size",
        "pagination.position", "pagination.preliminary", "pagination.no_numbers", F.try_element_at("headings", F.lit(1))["letter_case"].alias("case_1"), F.try_element_at("headings", F.lit(2))["alignment"].alias("align_2"),
        "layout.tables", "citation_style",
    )


@query("merge_fill", f"SELECT guide_id, coalesce({_of(3, ('justify', 'left', None, None))}, 'center') AS alignment, {_of(4, ('Times New Roman,Georgia', 'Arial,Georgia', 'Arial,Calibri,Georgia', 'Georgia'))} AS families FROM gids")
def merge_fill(t):
    base = t.guides.select("guide_id", G.extract_alignment(F.col("flat"), F.col("text"))["alignment"].alias("alignment"), G.extract_fonts(F.col("flat"))["families"].alias("families"))
    extra = t.guides.select("guide_id", F.lit("center").alias("alignment"), F.array(F.lit("Georgia")).alias("families"))
    return G.merge_fill(base, extra, ["alignment"], ["families"]).withColumn("families", F.concat_ws(",", "families"))


_RAW = (("Double", "N/A", "1.5", "single", "9"), ("Justified", "left", "none", "centre", ""), ("1 inch", "2.54 cm", "9 in", "ignore", "0.75\""), ("12 pt", "99.5", "ignore", "11.5", "5"), ("apa", "Chicago", "MLA", "-", "ieee"))


@query(
    "normalize_rules",
    """SELECT p_partkey AS guide_id, [2.0, NULL, 1.5, 1.0, NULL][p_partkey % 5 + 1]::DOUBLE AS line_spacing, ['justify', 'left', NULL, 'center', NULL][p_partkey % 5 + 1] AS alignment, [1.0, 1.0, NULL, NULL, 0.75][p_partkey % 5 + 1]::DOUBLE AS margin,
       [12.0, NULL, NULL, 11.5, NULL][p_partkey % 5 + 1]::DOUBLE AS body_size, ['APA', NULL, 'MLA', NULL, 'IEEE'][p_partkey % 5 + 1] AS citation_style FROM part""",
)
def normalize_rules(t):
    names = ("line_spacing", "alignment", "margin", "body_size", "citation_style")
    raw = t.part.select(F.col("p_partkey").alias("guide_id"), *[_pick(v, F.col("p_partkey")).alias(n) for n, v in zip(names, _RAW)])
    return G.normalize_rules(raw)


_GW = "len(list_filter(['margin', 'spacing', 'font', 'paper', 'page number', 'heading', 'indent', 'style'], lambda w: contains(lower(text), w)))"


@query(
    "guide_or_manuscript",
    rf"SELECT guide_id, {_GW} AS guide_words, {_GW} + 1 AS sections_present, len(string_split_regex(trim(text, ' ' || chr(10)), '\s+')) AS words, CASE WHEN {_GW} = 0 THEN 'no_rules' ELSE 'guide' END AS verdict FROM guides",
)
def guide_or_manuscript(t):
    return G.guide_or_manuscript(t.guides.withColumn("text", F.btrim("text", F.lit(" \n"))))


_LACK = " UNION ALL ".join(f"SELECT guide_id, '{s}' AS section, 'missing_label' AS issue FROM guides WHERE NOT regexp_matches(lower(regexp_replace(text, chr(10), ' ', 'g')), '{p}')" for s, p in G.SCHEMA)
fixtures.SQL["lacking"] = _LACK


@query("validate_guide_schema", "SELECT * FROM lacking")
def validate_guide_schema(t):
    return G.validate_guide_schema(t.guides)


@query("filter_guide_issues", "SELECT guide_id, section, issue FROM lacking WHERE section <> 'Paper' AND NOT (guide_id % 2 = 0 AND section = 'Font')")
def filter_guide_issues(t):
    covered = t.guides.select("guide_id", F.lit("Paper").alias("section"))
    ignored = t.guides.where("guide_id % 2 = 0").select("guide_id", F.lit("Font").alias("section"))
    return G.filter_guide_issues(G.validate_guide_schema(t.guides), covered, ignored)


@query("apply_ignored_fields", f"SELECT guide_id, CASE WHEN guide_id % 3 <> 0 THEN {_of(3, ('justify', 'left', None, None))} END AS alignment, {_of(6, ('APA', 'MLA', 'IEEE', None))} AS citation_style FROM gids")
def apply_ignored_fields(t):
    rules = G.derive_rules(t.guides).select("guide_id", "alignment.alignment", "citation_style")
    ignored = t.guides.where("guide_id % 3 = 0").select("guide_id", F.lit("Alignment").alias("section"))
    return G.apply_ignored_fields(rules, ignored, {"alignment": "Alignment", "citation_style": "Citations"})


_FLAT = r"lower(regexp_replace(text, '\s+', ' ', 'g'))"
_KINDS = " UNION ALL ".join(f"SELECT guide_id, '{k}' AS kind FROM guides WHERE regexp_matches({_FLAT}, '{p}')" for k, p in G.ASSIST)


@query("harvest_assist_items", _KINDS)
def harvest_assist_items(t):
    return G.harvest_assist_items(t.guides).select("guide_id", "kind")


@query(
    "merge_assist_items",
    """WITH i AS (SELECT l_orderkey AS guide_id, l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10 AS at, l_suppkey % 5 AS id, l_partkey % 7 AS k, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 5 ORDER BY l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10) AS r FROM lineitem),
       j AS (SELECT *, row_number() OVER (PARTITION BY guide_id, k ORDER BY at) AS q FROM i WHERE r = 1)
       SELECT guide_id, row_number() OVER (PARTITION BY guide_id ORDER BY at) AS position, id, 'item_' || k::VARCHAR AS key FROM j WHERE q = 1""",
)
def merge_assist_items(t):
    at = F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10
    items = t.lineitem.select(F.col("l_orderkey").alias("guide_id"), at.alias("at"), (F.col("l_suppkey") % 5).alias("id"), F.concat(F.lit("Item: "), (F.col("l_partkey") % 7).cast("string")).alias("said"))
    return G.merge_assist_items(items)


_RULE = "regexp_matches(lower(text), 'must|should|use |margins?:|style')"
_TEMPLATE = "regexp_matches(lower(text), 'your name|insert|sample|template')"


@query("guide_kind", f"SELECT guide_id, CASE WHEN {_RULE} AND {_TEMPLATE} THEN 'hybrid' WHEN {_RULE} THEN 'explicit_rulebook' WHEN {_TEMPLATE} THEN 'template_as_guide' ELSE 'unknown' END AS kind FROM guides")
def guide_kind(t):
    return G.guide_kind(t.guides)


@query(
    "embodied_alignment",
    f"""SELECT g.guide_id, CASE WHEN a = 'left' AND top IS NOT NULL THEN top ELSE a END AS alignment FROM (SELECT guide_id, {_of(3, ("justify", "left", None, None))} AS a FROM gids) g
        LEFT JOIN (SELECT doc_id, max_by(alignment, (c, alignment)) AS top FROM (SELECT doc_id, alignment, count(*) AS c FROM units GROUP BY 1, 2) GROUP BY 1) u ON u.doc_id = g.guide_id""",
)
def embodied_alignment(t):
    rules = t.guides.select("guide_id", G.extract_alignment(F.col("flat"), F.col("text"))["alignment"].alias("alignment"))
    return G.embodied_alignment(t.units, rules)
