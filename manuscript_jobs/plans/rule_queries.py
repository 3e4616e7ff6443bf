"""Rules by the sentence model: each document's text under fourteen guide sentences of types, wordings and values told by
its id; the SQL knows the types and values that were put in and not the words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guides as G
from ..operators import rule_model as R
from . import fixtures
from .registry import query
from .text_queries import _sql_list

#: By rule type: four wordings, four values of "{}" in them, and the typed value of each.
WORDINGS = {
    "font_family": (("Use {} for the text of the paper", "The prescribed typeface is {}", "All text shall be set in {}", "The font must be {}"), ("Georgia", "Arial Narrow", "Times New Roman", "Book Antiqua"), None),
    "font_size": (("The body text is {} points in size", "Set the text in {} pt type", "A size of {} points is required for ordinary text", "Body type size: {} pt"), ("11", "12", "10.5", "13"), ("11pt", "12pt", "10.5pt", "13pt")),
    "font_size_heading1": (("Chapter titles are {} points in size", "Main titles use {} pt type", "Set every chapter title in {} points", "First-level titles: {} pt"), ("14", "16", "18", "15"), ("14pt", "16pt", "18pt", "15pt")),
    "font_size_heading2": (("Subheadings are {} points in size", "Side headings use {} pt type", "Set every subheading in {} points", "Second-level headings: {} pt"), ("12", "13", "14", "12.5"), ("12pt", "13pt", "14pt", "12.5pt")),
    "font_size_content": (("Table entries are {} points in size", "Notes and table content use {} pt type", "Set the content of notes in {} points", "Content of tables: {} pt"), ("8", "9", "10", "9.5"), ("8pt", "9pt", "10pt", "9.5pt")),
    "font_color": (("All print is {}", "Ink color: {}", "The letters must be {} on every page", "Print color is {} only"), ("black", "automatic", "plain black", "Black"), ("black (automatic)",) * 4),
    "line_spacing": (("Lines are {} spaced throughout", "Line spacing is {}", "Type the manuscript with {} line spacing", "Leave {} space between lines"), ("double", "single", "1.5", "one and a half"), ("double", "single", "1.5", "1.5")),
    "paragraph_indent": (("Indent each paragraph {}", "The first line of a paragraph is indented {}", "Paragraph indention is {}", "Begin paragraphs with an indent of {}"), ("0.5 inch", "one tab", "1 inch", "0.25 inch"), ("0.5 inch", "0.5 inch", "1 inch", "0.25 inch")),
    **{f"margin_{s}": ((f"The {s} margin is {{}}", f"Leave {{}} at the {s} edge as margin", f"Margin on the {s} side: {{}}", f"Keep a {s} margin of {{}}"), ("1.5 inches", "1 inch", "1.25 in", "2 inches"), ("1.5 inch", "1 inch", "1.25 inch", "2 inch")) for s in R.SIDES},
    "citation_style": (("Cite sources in {} style", "References follow the {} manual", "In-text citations use {} format", "The citation style is {}"), ("APA", "MLA", "IEEE", "apa"), ("APA", "MLA", "IEEE", "APA")),
    "paper_size": (("Print on {} sheets", "The size of paper is {}", "Submit copies on {} stock", "Sheets measure {}"), ("8.5 x 11 inches", "A4", "8.5 x 11", "a4"), ("8.5 x 11 inches", "A4", "8.5 x 11 inches", "A4")),
    "paper_orientation": (("Pages are in {} orientation", "Turn all pages to {}", "Orientation of sheets: {}", "The sheets lie in {} position"), ("portrait", "landscape", "Portrait", "Landscape"), ("portrait", "landscape", "portrait", "landscape")),
    "paper_substance": (("Paper of substance {} is needed", "Use substance {} stock", "The substance of sheets is {} grams", "Substance: {} gsm"), ("20", "24", "80", "100"), None),
    "pagination": (("Pages are numbered at the {}", "Number the pages in the {} corner", "Page numbering goes to the {}", "Every page bears its number at the {}"), ("top right", "bottom center", "bottom centre", "top  right"), ("top right", "bottom center", "bottom center", "top right")),
    "pagination_position": (("Position of page numbers: {}", "Place page numbers {}", "Page number position is {}", "The place of page numbers is {}"), ("top right", "bottom center", "bottom centre", "top right"), ("top right", "bottom center", "bottom center", "top right")),
    "pagination_first_page": (("Hide the number on the opening page of {}", "No number is printed on the opening page of {}", "The opening page of {} shows no number", "Suppress numbers on the opening page of {}"), ("a chapter", "every chapter", "each chapter", "any chapter"), ("hidden on first page of chapter",) * 4),
    "heading_style": (("Headings are typed {}", "Every heading is {}", "Heading style: {}", "Style all headings {}"), ("bold and centered", "in capital letters", "in italics", "flush left and bold"), (None,) * 4),
    "page_break": (("Each {} starts on a new page", "Begin every {} with a page break", "Insert a page break before each {}", "A new page opens every {}"), ("chapter", "appendix", "part", "section"), ("new page per chapter",) * 4),
    "table_layout": (("Tables are {} with a title above", "Every table is {} and titled at the top", "Keep each table {} under its title", "Table layout: {}, title above"), ("centered", "boxed", "ruled", "left aligned"), (None,) * 4),
    "table_figure_layout": (("Tables and figures are {} near their mention", "Place tables and figures {} after the text on them", "Both tables and figures stay {} in a chapter", "Tables with figures are {} by chapter"), ("numbered", "grouped", "placed", "inserted"), (None,) * 4),
    "figure_layout": (("Figures are {} with a caption below", "Every figure is {} and captioned at the bottom", "Keep each figure {} over its caption", "Figure layout: {}, caption below"), ("centered", "framed", "scaled", "sharp"), (None,) * 4),
}
SLOTS = 14
_TEXT = [w for k in R.RULE_TYPES for w in WORDINGS[k][0]]
_VALUE = [v for k in R.RULE_TYPES for v in WORDINGS[k][1]]
_TYPED = [v for k in R.RULE_TYPES for v in (WORDINGS[k][2] or WORDINGS[k][1])]
# Type, wording and value of a slot of a guide: the last three slots repeat the types of the first three.
_TYPE, _WORDING, _VAL = "(guide_id + 5 * (s % 11)) % 24", "(guide_id // 3 + s) % 4", "(guide_id // 7 + s) % 4"


def _div(sql: str):
    return F.expr(sql.replace("//", "div"))


def said(kind, wording, value):
    """The sentence of a type's wording with a value in it."""
    at = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (kind * 4 + i + 1).cast("int"))
    return F.concat(F.replace(at(_TEXT, wording), F.lit("{}"), at(_VALUE, value)), F.lit("."))


def view_rulebooks(t):
    one = lambda s: said(*[_div(x.replace("s ", f"{s} ").replace("+ s)", f"+ {s})")) for x in (_TYPE, _WORDING, _VAL)])
    g = t.documents.select(F.col("doc_id").alias("guide_id"), F.col("text").alias("tail"))
    return g.select("guide_id", F.concat_ws("\n", *[one(s) for s in range(SLOTS)], "tail").alias("text"))


def view_labelled_sentences(t):
    """Eight sentences a document, of types, wordings and values told by a running number, and the document's own
    sentences as ``other``."""
    n = F.col("doc_id")
    kind, wording, value = (F.col("m") % 24), F.expr("m div 24 % 4"), F.expr("m div 96 % 4")
    typed = t.documents.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: n * 8 + k)).alias("m")).select(said(kind, wording, value).alias("sentence"), F.element_at(F.array(*[F.lit(k) for k in R.RULE_TYPES]), (kind + 1).cast("int")).alias("rule_type"))
    prose = G.guide_sentences(t.documents.select(n.alias("guide_id"), "text").repartition("guide_id")).select("sentence", F.lit(R.OTHER).alias("rule_type"))
    return typed.union(prose)


fixtures.view_rulebooks = view_rulebooks
fixtures.view_labelled_sentences = view_labelled_sentences
fixtures.SQL["truth"] = f"""
    SELECT guide_id, s, {_sql_list(R.RULE_TYPES)}[({_TYPE}) + 1] AS kind, {_sql_list(_TYPED)}[({_TYPE}) * 4 + ({_VAL}) + 1] AS value,
           regexp_replace(replace({_sql_list(_TEXT)}[({_TYPE}) * 4 + ({_WORDING}) + 1], '{{}}', {_sql_list(_VALUE)}[({_TYPE}) * 4 + ({_VAL}) + 1]), ' +', ' ', 'g') || '.' AS said
    FROM (SELECT doc_id AS guide_id, unnest(range({SLOTS})) AS s FROM documents)"""


@query("rule_value", "SELECT guide_id, s AS slot, kind, value FROM truth")
def rule_value(t):
    """The typed values of every rulebook's set sentences."""
    s = F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("s")
    rows = t.documents.select(F.col("doc_id").alias("guide_id"), s)
    kind = F.element_at(F.array(*[F.lit(k) for k in R.RULE_TYPES]), (_div(_TYPE) + 1).cast("int"))
    rows = rows.select("guide_id", F.col("s").alias("slot"), kind.alias("kind"), said(*[_div(x) for x in (_TYPE, _WORDING, _VAL)]).alias("sentence"))
    return rows.select("guide_id", "slot", "kind", R.rule_value(F.col("sentence"), F.col("kind")).alias("value"))


_LAST = lambda kinds, what="value": f"max_by({what}, s) FILTER (WHERE kind IN {kinds} AND value IS NOT NULL)"
_IN = lambda *k: "(" + ", ".join(f"'{x}'" for x in k) + ")"
_LIST = lambda kinds, what="said", order="": f"array_to_string(list({what} ORDER BY s {order}) FILTER (WHERE kind IN {kinds} AND first), '|')"
_NUMBER = "TRY_CAST(regexp_extract(value, '[0-9.]+') AS DOUBLE)"


@query(
    "predicted_rules",
    f"""WITH said_once AS (SELECT *, row_number() OVER (PARTITION BY guide_id, CASE WHEN kind IN ('font_family', 'font_size') THEN kind || value ELSE CASE WHEN kind = 'table_figure_layout' THEN 'table_layout' ELSE kind END || said END ORDER BY s) = 1 AS first FROM truth)
        SELECT guide_id, {_LIST(_IN("font_family"), "value", "DESC")} AS families, {_LIST(_IN("font_size"), "replace(value, 'pt', '')")} AS sizes,
               {_LAST(_IN("font_size_heading1"), _NUMBER)} AS heading1_size, {_LAST(_IN("font_size_heading2"), _NUMBER)} AS heading2_size, {_LAST(_IN("font_size_content"), _NUMBER)} AS content_size,
               CASE WHEN bool_or(kind = 'font_color') THEN 'Black/Automatic' END AS color, {_LAST(_IN("line_spacing"), "CASE value WHEN 'double' THEN '2' WHEN 'single' THEN '1' ELSE '1.5' END")} AS spacing,
               {_LAST(_IN("paragraph_indent"))} AS indention, {", ".join(f"{_LAST(_IN('margin_' + s), _NUMBER)} AS margin_{s}" for s in R.SIDES)}, {_LAST(_IN("citation_style"))} AS citation_style,
               max(CASE WHEN kind = 'paper_size' AND value LIKE '8.5%' THEN 'LETTER' END) AS paper, {_LAST(_IN("paper_orientation"), "upper(left(value, 1)) || substr(value, 2)")} AS orientation,
               {_LAST(_IN("paper_substance"))} AS substance, {_LAST(_IN("pagination", "pagination_position"))} AS position, bool_or(kind = 'pagination_first_page') AS hidden,
               {_LIST(_IN("heading_style"))} AS headings, {_LIST(_IN("page_break"))} AS page_breaks, {_LIST(_IN("table_layout", "table_figure_layout"))} AS tables, {_LIST(_IN("figure_layout"))} AS figures
        FROM said_once GROUP BY guide_id""",
)
def predicted_rules(t):
    """Every sentence of every rulebook through the trained model, folded in order."""
    model = R.train_rule_model(t.labelled_sentences)
    r = R.predicted_rules(R.classified(model, G.guide_sentences(t.rulebooks.repartition("guide_id"))))
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, "|"))
    return r.select(
        "guide_id", listed("font.families").alias("families"), F.when(F.size("font.sizes_points") > 0, F.array_join(F.transform("font.sizes_points", R.plain_number), "|")).alias("sizes"),
        "font.heading1_size", "font.heading2_size", F.col("font.heading3_content_size").alias("content_size"), "font.color", "spacing", "indention",
        *[F.try_element_at("margins_inches", F.lit(s)).alias(f"margin_{s}") for s in R.SIDES], "citation_style", F.col("paper.name").alias("paper"), "paper.orientation", "paper.substance", "pagination.position",
        F.col("pagination.first_page_of_chapter").isNotNull().alias("hidden"), listed("heading_requirements").alias("headings"), listed("page_break_requirements").alias("page_breaks"),
        listed("table_layout_requirements").alias("tables"), listed("figure_layout_requirements").alias("figures"),
    )


# Styles with a compliant form and one with an issue; author, year, title, volume and number stand for themselves.
CITATIONS = (
    ("APA", "{author}, J. ({year}). {title}. Journal of Letters, {volume}(2), 11-19.", "{author}, J. {title}. Journal of Letters, {volume}(2), 11-19.", "The year is missing"),
    ("MLA", '{author}, Jane. "{title}." Journal of Letters, vol. {volume}, no. 2, {year}, pp. 11-19.', "{author}, Jane. {title}. Journal of Letters, vol. {volume}, no. 2, {year}, pp. 11-19.", "The title is not in quotation marks"),
    ("IEEE", '[{number}] J. {author}, "{title}," J. Lett., vol. {volume}, no. 2, pp. 11-19, {year}.', 'J. {author}, "{title}," J. Lett., vol. {volume}, no. 2, pp. 11-19, {year}.', "The number in brackets is missing"),
)


def view_citations(t):
    """A citation of every document by its own words: author and title from the text, year and volume from the id."""
    n, words = F.col("doc_id"), F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", " "), " ")
    forms = F.array(*[F.lit(f) for _, good, bad, _ in CITATIONS for f in (good, bad)])
    out = F.element_at(forms, (n % 3 * 2 + F.expr("doc_id div 3 % 2") + 1).cast("int"))
    values = {"author": F.initcap(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))), "title": F.array_join(F.slice(words, 2, 6), " "), "year": (1990 + n % 30).cast("string"), "volume": (n % 47 + 1).cast("string"), "number": (n % 83 + 1).cast("string")}
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % 3 + 1).cast("int"))
    return t.documents.select("doc_id", out.alias("text"), pick([c[0] for c in CITATIONS]).alias("style"), F.when(F.expr("doc_id div 3 % 2") == 1, pick([c[3] for c in CITATIONS])).alias("issue"))


fixtures.view_citations = view_citations


def _citation_models(t):
    """Models fitted on four fifths of the citations."""
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    return R.classify.train_citation_models(t.citations.where(~held)), t.citations.where(held)


@query("predict_citation_styles", f"SELECT doc_id, {_sql_list([c[0] for c in CITATIONS])}[doc_id % 3 + 1] AS style FROM documents")
def predict_citation_styles(t):
    """The style of every document's citation."""
    models, _ = _citation_models(t)
    return R.classify.predict_citations(models, t.citations.select("doc_id", "text")).select("doc_id", "style")


@query("citation_issue_report")
def citation_issue_report(t):
    """How well the issues of held-out citations are told, class by class."""
    models, held = _citation_models(t)
    pairs = R.classify.predict_citations(models, held.select("doc_id", "text", F.coalesce("issue", F.lit(R.classify.COMPLIANT)).alias("label")))
    return R.classify.classification_report(pairs.withColumn("told", F.coalesce("issue", F.lit(R.classify.COMPLIANT))), "label", "told")


@query("train_rule_model")
def train_rule_model(t):
    """The report of the sentence model on the fifth of the labelled sentences that it hasn't seen."""
    rows = t.labelled_sentences.where("sentence is not null").dropDuplicates(["sentence", "rule_type"])
    held = F.pmod(F.xxhash64("sentence"), F.lit(5)) == 0
    pairs = R.classified(R.train_rule_model(rows.where(~held)), rows.where(held))
    return R.classify.classification_report(pairs, "rule_type", "kind")
