"""Queries on layout reconstruction, from the lines of documents.

``marked`` gives a share of the lines the openings that running text lacks: captions, chapters, reference
heads, citation markers, contents lines, page numbers and empty lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import CAPTION_VERBS
from ..operators import layout as Y
from . import fixtures
from .registry import query

_KIND = "(doc_id * 7 + n * 5) % 24"


def view_marked(t):
    k, head, num = (F.col("doc_id") * 7 + F.col("n") * 5) % 24, F.col("text"), (F.col("n") % 9 + 1).cast("string")
    c = F.concat
    text = (
        F.when(k == 0, c(F.lit("Table "), num, F.lit(". "), head)).when(k == 1, c(F.lit("Figure "), num, F.lit(" shows the values of "), head)).when(k == 2, c(F.lit("CHAPTER "), F.repeat(F.lit("I"), (F.col("n") % 3 + 1).cast("int"))))
        .when(k == 3, "References").when(k == 4, c(head, F.lit(" ["), (F.col("n") % 50).cast("string"), F.lit("] and on."))).when(k == 5, c(head, F.lit(" (Smith, 2019) and on.")))
        .when(k == 6, c(head, F.lit(" (Garcia 12) and on."))).when(k == 7, c(head, F.lit(" ........ "), (F.col("n") % 90 + 1).cast("string"))).when(k == 8, "")
        .when(k == 9, (F.col("n") % 90 + 1).cast("string")).when(k == 10, c(F.lit("Smith, J. (20"), F.lpad((F.col("n") % 20).cast("string"), 2, "0"), F.lit("). "), head)).otherwise(F.col("text"))
    )
    return t.unit_boxes.withColumn("text", text)


fixtures.view_marked = view_marked
fixtures.SQL["marked"] = f"""
    SELECT * REPLACE (CASE {_KIND} WHEN 0 THEN 'Table ' || (n % 9 + 1)::VARCHAR || '. ' || text WHEN 1 THEN 'Figure ' || (n % 9 + 1)::VARCHAR || ' shows the values of ' || text
        WHEN 2 THEN 'CHAPTER ' || repeat('I', (n % 3 + 1)::INT) WHEN 3 THEN 'References' WHEN 4 THEN text || ' [' || (n % 50)::VARCHAR || '] and on.' WHEN 5 THEN text || ' (Smith, 2019) and on.'
        WHEN 6 THEN text || ' (Garcia 12) and on.' WHEN 7 THEN text || ' ........ ' || (n % 90 + 1)::VARCHAR WHEN 8 THEN '' WHEN 9 THEN (n % 90 + 1)::VARCHAR
        WHEN 10 THEN 'Smith, J. (20' || lpad((n % 20)::VARCHAR, 2, '0') || '). ' || text ELSE text END AS text) FROM unit_boxes"""
_RE = {"CHAPTER": r"^(?i:chapter\s+([0-9]+|[ivxlc]+))\b", "BACK": Y.BACK_MATTER, "PRE": Y.PRELIMINARY, "REF": Y.REFERENCE_HEADER, "FOLIO": Y.FOLIO, "CAPTION": Y.CAPTION, "BARE": Y.BARE_PAGE}
_TOC = f"""(trim(text) <> '' AND NOT ends_with(trim(text), '.') AND NOT ((regexp_matches(trim(text), '{_RE["CHAPTER"]}') OR regexp_matches(trim(text), '{_RE["BACK"]}') OR regexp_matches(trim(text), '{_RE["PRE"]}'))
    AND NOT regexp_matches(trim(text), '\\.{{2,}}|…')) AND regexp_matches(trim(text), '{_RE["FOLIO"]}') AND regexp_matches(trim(text), '\\S\\s+\\S'))"""
_REST = r"trim(regexp_extract(trim(regexp_replace(text, '\s+', ' ', 'g')), '^(?i:table|figure|fig\.?) [0-9]+(?:\.[0-9]+)*\s*[:.–-]?\s*(.*)$', 1))"
fixtures.SQL["prose_lines"] = rf"""
    SELECT * EXCLUDE (rest), rest <> '' AND (regexp_matches(rest, '^(?i:{CAPTION_VERBS})\b') OR len(string_split(rest, ' ')) >= 12 OR (length(rest) >= 80 AND regexp_matches(rest, ',|^.{{8}}.*\.'))
        OR (regexp_matches(rest, '^[a-z]') AND len(string_split(rest, ' ')) >= 6)) AS prose FROM (SELECT *, {_REST} AS rest FROM marked)"""
fixtures.SQL["roles"] = f"""
    SELECT * EXCLUDE (v), CASE WHEN v = '' THEN 'empty' WHEN regexp_matches(v, '{_RE["BARE"]}') THEN 'pagination' WHEN toc THEN 'toc'
        WHEN regexp_matches(v, '{_RE["CAPTION"]}') AND NOT prose THEN CASE WHEN lower(v) LIKE 'table%' THEN 'table' ELSE 'figure' END WHEN chapter THEN 'heading1'
        WHEN regexp_matches(v, '{_RE["REF"]}') OR regexp_matches(v, '{_RE["PRE"]}') OR regexp_matches(v, '{_RE["BACK"]}') THEN 'heading_other'
        WHEN face = 'bold' AND words <= 12 AND NOT regexp_matches(v, '[.,;]$') THEN CASE WHEN coalesce(seen, false) THEN 'heading2' ELSE 'heading_uncertain' END ELSE 'body' END AS role
    FROM (SELECT *, bool_or(chapter) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (
        SELECT *, trim(text) AS v, {_TOC} AS toc, regexp_matches(trim(text), '{_RE["CHAPTER"]}') AS chapter, len(string_split_regex(trim(text), '\\s+')) AS words FROM prose_lines))"""


def view_roles(t):
    return Y.annotate_roles(t.marked)


fixtures.view_roles = view_roles


@query("merge_rows")
def merge_rows(t):
    """Each line is cut in two boxes; rows must come together again (tests compare)."""
    b = t.unit_boxes.select("doc_id", "page_index", "n", "text", "x0", "x1", "y0", "y1")
    cut = F.floor((F.col("x0") + F.col("x1")) / 2)
    left = b.withColumn("text", F.substring("text", 1, 5)).withColumn("x1", cut)
    right = b.withColumn("text", F.expr("substring(text, 6)")).withColumn("x0", cut + F.when(F.col("n") % 7 == 0, 40).otherwise(2)).withColumn("y0", F.col("y0") + 1)
    return Y.merge_rows(left.unionByName(right))


@query(
    "pdf_units",
    """SELECT doc_id, page_index, source, x0, y0, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y0, x0, source, text) - 1 AS line_index FROM (
         SELECT doc_id, page_index, 'line' AS source, text, x0, y0 FROM unit_boxes UNION ALL SELECT doc_id, page_index, 'image', NULL, x0 + 5, y0 + 3 FROM unit_boxes WHERE n % 11 = 0)""",
)
def pdf_units(t):
    images = t.unit_boxes.where("n % 11 = 0").select("doc_id", "page_index", (F.col("x0") + 5).alias("x0"), (F.col("y0") + 3).alias("y0"))
    return Y.pdf_units(t.unit_boxes, images).select("doc_id", "page_index", "source", "x0", "y0", "line_index")


@query(
    "dominant_font",
    """WITH s AS (SELECT doc_id, n, 0 AS pos, left(text, 20) AS text, font, size FROM units UNION ALL SELECT doc_id, n, 1, substr(text, 21), CASE WHEN n % 5 = 0 THEN 'Symbol' ELSE 'Georgia' END, 10.0 FROM units),
       g AS (SELECT doc_id, n, font, size, sum(length(regexp_replace(text, '\\s', '', 'g')))::BIGINT AS weight, min(pos) AS first FROM s WHERE regexp_matches(text, '[A-Za-z0-9]') AND font <> 'Symbol' GROUP BY 1, 2, 3, 4)
       SELECT doc_id, n, font, size, weight FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY weight DESC, first) = 1""",
)
def dominant_font(t):
    a = t.units.select("doc_id", "n", F.lit(0).alias("at"), F.substring("text", 1, 20).alias("text"), "font", "size")
    b = t.units.select("doc_id", "n", F.lit(1).alias("at"), F.expr("substring(text, 21)").alias("text"), F.when(F.col("n") % 5 == 0, "Symbol").otherwise("Georgia").alias("font"), F.lit(10.0).alias("size"))
    return Y.dominant_font(a.unionByName(b))


_MODE = "(SELECT doc_id, v FROM (SELECT doc_id, {v} AS v, sum(length(text)) AS w, min(n) AS f FROM units GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, f) = 1)"
fixtures.SQL["body_stats"] = f"""
    SELECT a.doc_id, a.v AS body_size, b.v AS body_spacing, c.v AS body_font FROM {_MODE.format(v="size")} a JOIN {_MODE.format(v="line_spacing")} b ON a.doc_id = b.doc_id JOIN {_MODE.format(v="font")} c ON a.doc_id = c.doc_id"""


@query("document_body_stats", "SELECT * FROM body_stats")
def document_body_stats(t):
    return Y.document_body_stats(t.units)


@query("page_capacity", "SELECT doc_id, floor(648 / (body_size * 1.15::DOUBLE * body_spacing))::BIGINT AS lines_per_page, floor(468 / (body_size * 0.5::DOUBLE))::BIGINT AS chars_per_line FROM body_stats")
def page_capacity(t):
    return Y.page_capacity(Y.document_body_stats(t.units))


@query("soft_wrap")
def soft_wrap(t):
    return Y.soft_wrap(t.units).select("doc_id", "n", F.posexplode("lines").alias("line", "text"))


@query(
    "paginate_docx",
    """WITH b AS (SELECT doc_id, n, sum((n % 17 = 16)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM units), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY n) - 1 AS pos FROM b),
       s AS (SELECT doc_id, block, coalesce(sum(pages) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, block, (count(*) + 9) // 10 AS pages FROM p GROUP BY 1, 2))
       SELECT p.doc_id, n, (before + pos // 10)::BIGINT AS page, pos % 10 AS line FROM p JOIN s ON s.doc_id = p.doc_id AND s.block = p.block""",
)
def paginate_docx(t):
    return Y.paginate(t.units.withColumn("new_page", F.col("n") % 17 == 16), 10)


@query(
    "rebalance_pages",
    """WITH u AS (SELECT doc_id, n, n // 23 + n // 51 AS page_index FROM units), c AS (SELECT doc_id, page_index, count(*) AS lines FROM u GROUP BY 1, 2),
       m AS (SELECT doc_id, list_sort(list(lines))[len(list(lines)) // 2 + 1] AS usual FROM c WHERE lines <= 20 GROUP BY 1),
       e AS (SELECT c.*, coalesce(usual, 20) AS usual, CASE WHEN lines > 20 THEN ceil(lines::DOUBLE / coalesce(usual, 20))::BIGINT - 1 ELSE 0 END AS extra FROM c LEFT JOIN m USING (doc_id)),
       s AS (SELECT *, coalesce(sum(extra) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM e),
       o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY n) - 1 AS nth FROM u)
       SELECT o.doc_id, n, (o.page_index + shift + CASE WHEN extra > 0 THEN nth // usual ELSE 0 END)::BIGINT AS page FROM o JOIN s ON s.doc_id = o.doc_id AND s.page_index = o.page_index""",
)
def rebalance_pages(t):
    u = t.units.select("doc_id", "n", F.expr("n div 23 + n div 51").alias("page_index"))
    return Y.rebalance_pages(u, 20)


@query("page_fidelity", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pdf_source' WHEN count(*) > 6 THEN 'word_rendered' ELSE 'estimated' END AS fidelity FROM units GROUP BY 1")
def page_fidelity(t):
    return Y.page_fidelity(t.units.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "pdf").otherwise("docx").alias("format"), (F.col("n") > 5).cast("int").alias("rendered_breaks")))


_EDGE = """(SELECT {k}, CASE WHEN mode = 72 AND has_b THEN 72 WHEN mode = 108 AND has_a THEN 72 ELSE mode END AS "left", list_sort(rights)[floor(0.9::DOUBLE * (len(rights) - 1))::INT + 1] AS "right" FROM (
    SELECT {k}, CASE WHEN count(*) FILTER (WHERE x0 = 72) > count(*) FILTER (WHERE x0 = 108) OR (count(*) FILTER (WHERE x0 = 72) = count(*) FILTER (WHERE x0 = 108) AND min(n) FILTER (WHERE x0 = 72) < min(n) FILTER (WHERE x0 = 108)) THEN 72 ELSE 108 END AS mode,
           count(*) FILTER (WHERE x0 = 72) > 0 AS has_a, count(*) FILTER (WHERE x0 = 108) > 0 AS has_b, list(x1) AS rights FROM unit_boxes WHERE x1 - x0 >= 200 GROUP BY {k}) WHERE len(rights) >= 3)"""
fixtures.SQL["cols"] = f"""
    SELECT p.doc_id, p.page_index, coalesce(a."left", d."left", 72) AS "left", coalesce(a."right", d."right", 540) AS "right" FROM (SELECT DISTINCT doc_id, page_index FROM unit_boxes) p
    LEFT JOIN {_EDGE.format(k="doc_id, page_index")} a ON a.doc_id = p.doc_id AND a.page_index = p.page_index LEFT JOIN {_EDGE.format(k="doc_id")} d ON d.doc_id = p.doc_id"""


@query("text_columns", "SELECT * FROM cols")
def text_columns(t):
    return Y.text_columns(t.unit_boxes)


@query(
    "infer_alignment",
    """SELECT doc_id, n, CASE WHEN rg <= greatest(14, 0.045::DOUBLE * span) AND lg <= 0.25::DOUBLE * span THEN 'justify' WHEN abs(lg - rg) <= 14 AND least(lg, rg) > 20 THEN 'center' WHEN rg <= 6 THEN 'right' ELSE 'left' END AS alignment
       FROM (SELECT b.doc_id, n, x0 - "left" AS lg, "right" - x1 AS rg, greatest(1, "right" - "left") AS span FROM unit_boxes b JOIN cols c ON c.doc_id = b.doc_id AND c.page_index = b.page_index)""",
)
def infer_alignment(t):
    return Y.infer_alignment(t.unit_boxes, Y.text_columns(t.unit_boxes))


@query("mark_table_cells")
def mark_table_cells(t):
    return Y.mark_table_cells(t.unit_boxes.withColumn("seed", F.col("text").contains(" | ")))


@query(
    "mark_toc",
    f"""SELECT doc_id, n, toc, sum(toc::INT) OVER w >= 4 AND sum(toc::INT) OVER w >= 0.4 * count(*) FILTER (WHERE trim(text) <> '') OVER w AS toc_page FROM (SELECT *, {_TOC} AS toc FROM marked) WINDOW w AS (PARTITION BY doc_id, page_index)""",
)
def mark_toc(t):
    return Y.mark_toc(t.marked).select("doc_id", "n", "toc", "toc_page")


@query(
    "annotate_roles",
    """SELECT doc_id, n, role, last_value(CASE role WHEN 'heading1' THEN 1 WHEN 'heading2' THEN 2 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM roles""",
)
def annotate_roles(t):
    return t.roles.select("doc_id", "n", "role", "level")


@query(
    "section_title_confidence",
    """WITH a AS (SELECT doc_id, n, face, size, alignment, trim(text) AS v, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\\s+')) END AS words,
         length(trim(lag(text, 1, '') OVER w)) AS p, length(trim(lead(text, 1, '') OVER w)) AS f FROM marked WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY n)),
       b AS (SELECT doc_id, n, greatest(0, least(100, 30 * (face = 'bold')::INT + 15 * (words BETWEEN 1 AND 8)::INT + 20 * (size > 12)::INT + 10 * (alignment = 'center')::INT + 8 * regexp_matches(v, '^[A-Z]')::INT
         + 7 * (p = 0)::INT + 10 * (f > 60)::INT - 25 * regexp_matches(v, '[.,;:]$')::INT - 30 * (words > 14)::INT)) AS points FROM a)
       SELECT doc_id, n, points, points >= 32 AS title FROM b""",
)
def section_title_confidence(t):
    return Y.section_title_confidence(t.marked)


@query(
    "rank_headings_by_size",
    """SELECT doc_id, n, CASE WHEN r <= 4 THEN 'heading' || r::VARCHAR ELSE 'heading_uncertain' END AS role FROM (
         SELECT doc_id, n, dense_rank() OVER (PARTITION BY doc_id ORDER BY size + n % 5 DESC) + 1 AS r FROM units WHERE face = 'bold')""",
)
def rank_headings_by_size(t):
    return Y.rank_headings_by_size(t.units.where("face = 'bold'").withColumn("size", F.col("size") + F.col("n") % 5))


@query("propagate_paragraph_role", "SELECT doc_id, n, first_value(role) OVER (PARTITION BY doc_id, n // 4 ORDER BY n) AS role FROM roles")
def propagate_paragraph_role(t):
    return Y.propagate_paragraph_role(t.roles.withColumn("paragraph", F.expr("n div 4"))).select("doc_id", "n", "role")


@query(
    "mark_title_page",
    """SELECT doc_id, n, CASE WHEN page_index = 0 AND NOT bool_or(role IN ('heading1', 'heading2', 'toc', 'table', 'figure')) OVER (PARTITION BY doc_id, page_index) THEN 'title_page' ELSE role END AS role FROM roles""",
)
def mark_title_page(t):
    return Y.mark_title_page(t.roles).select("doc_id", "n", "role")


fixtures.SQL["paras"] = """
    WITH g AS (SELECT *, y0 + 9 * (n % 5 = 3)::INT - lag(y0 + 9 * (n % 5 = 3)::INT) OVER (PARTITION BY doc_id, page_index ORDER BY n) AS gap FROM unit_boxes),
    m AS (SELECT *, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL) OVER (PARTITION BY doc_id, page_index)) AS gaps FROM g)
    SELECT doc_id, n, sum((gap IS NULL OR x0 > 90 OR gap > 1.3::DOUBLE * gaps[len(gaps) // 2 + 1])::INT) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS paragraph FROM m"""


@query("prose_paragraphs", "SELECT * FROM paras")
def prose_paragraphs(t):
    return Y.prose_paragraphs(t.unit_boxes.withColumn("y0", F.col("y0") + F.when(F.col("n") % 5 == 3, 9).otherwise(0))).select("doc_id", "n", "paragraph")


fixtures.SQL["indents"] = """
    WITH s AS (SELECT *, lag(n) OVER w IS NULL OR lag(x1) OVER w < 540 - 46.8 OR y0 - lag(y0) OVER w > 22.4 OR x0 - lag(x0) OVER w > 9 AS st FROM unit_boxes WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY n)),
    p AS (SELECT *, sum(st::INT) OVER (PARTITION BY doc_id, page_index ORDER BY n)::BIGINT AS paragraph FROM s)
    SELECT doc_id, page_index, paragraph, count(*) AS lines, min_by(x0, n) AS first_x, min(x0) AS left_x, max(x1) AS right_x, min(n) AS n FROM p GROUP BY 1, 2, 3"""


@query("indent_paragraphs", "SELECT * FROM indents")
def indent_paragraphs(t):
    return Y.indent_paragraphs(t.unit_boxes)


fixtures.SQL["starts"] = f"""
    WITH c AS (SELECT doc_id, page_index, n, trim(text) AS v, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY n) AS pos FROM marked WHERE trim(text) <> ''),
    k AS (SELECT *, CASE WHEN regexp_matches(v, '{_RE["CHAPTER"]}') THEN 'chapter' WHEN regexp_matches(v, '{_RE["BACK"]}') THEN 'back_matter' WHEN regexp_matches(v, '{_RE["PRE"]}') THEN 'preliminary' END AS kind FROM c WHERE pos <= 6),
    f AS (SELECT doc_id, page_index, min_by(kind, n) AS kind, min_by(lower(v), n) AS title FROM k WHERE kind IS NOT NULL GROUP BY 1, 2)
    SELECT doc_id, page_index, kind FROM f QUALIFY coalesce(lag(title) OVER (PARTITION BY doc_id ORDER BY page_index) <> title, true)"""


@query("section_starts", "SELECT * FROM starts")
def section_starts(t):
    return Y.section_starts(t.marked)


fixtures.SQL["marks"] = """
    WITH c AS (SELECT doc_id, page_index, n, trim(text)::INT AS value, y0 AS top, 792 - y1 AS bottom, (x0 + x1) / 2.0 AS center FROM marked WHERE regexp_matches(trim(text), '^[0-9]{1,4}$'))
    SELECT doc_id, page_index, value, 'arabic' AS style, CASE WHEN top <= bottom THEN 'top' ELSE 'bottom' END AS vertical, CASE WHEN center < 204 THEN 'left' WHEN center > 408 THEN 'right' ELSE 'center' END AS horizontal
    FROM c WHERE least(top, bottom) <= 0.15 * 792 QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY least(top, bottom), n) = 1"""


@query("page_marks_pdf", "SELECT * FROM marks")
def page_marks_pdf(t):
    return Y.page_marks_pdf(t.marked)


@query(
    "page_marks_docx",
    """WITH p AS (SELECT DISTINCT doc_id, n // 5 AS page_index, CASE WHEN n // 5 % 4 = 2 THEN 1 END AS s FROM units)
       SELECT doc_id, page_index, coalesce(last_value(s IGNORE NULLS) OVER w + page_index - last_value(CASE WHEN s IS NOT NULL THEN page_index END IGNORE NULLS) OVER w, page_index + 1) AS number
       FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def page_marks_docx(t):
    pages = t.units.select("doc_id", F.expr("n div 5").alias("page_index")).distinct()
    return Y.page_marks_docx(pages.withColumn("section_start", F.when(F.col("page_index") % 4 == 2, 1)))


@query(
    "preview_pages",
    "SELECT doc_id, p AS page, md5(substr(text, (p * 2200 + 1)::BIGINT, 2200)) AS h FROM (SELECT doc_id, text, unnest(range(least(500, (length(text) + 2199) // 2200))) AS p FROM documents WHERE length(text) > 0)",
)
def preview_pages(t):
    return Y.preview_pages(t.documents).select("doc_id", "page", F.md5("text").alias("h"))


@query(
    "caption_snippets",
    f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS position, n, left(trim(text), 200) AS snippet FROM marked WHERE regexp_matches(text, '{_RE['CAPTION']}') QUALIFY position <= 40",
)
def caption_snippets(t):
    return Y.caption_snippets(t.marked)


fixtures.SQL["margins"] = """
    WITH p AS (SELECT doc_id, page_index, min(x0) AS "left", 612 - max(x1) AS "right", min(y0) AS top, 792 - max(y1) AS bottom, count(*) AS lines FROM unit_boxes WHERE trim(text) <> '' GROUP BY 1, 2),
    d AS (SELECT doc_id, list_sort(list(top))[least(2, count(*))] AS doc_top, list_sort(list(bottom))[least(2, count(*))] AS doc_bottom FROM p WHERE lines >= 10 GROUP BY 1)
    SELECT p.*, doc_top, doc_bottom FROM p LEFT JOIN d ON d.doc_id = p.doc_id"""


@query("page_body_margins", "SELECT * FROM margins")
def page_body_margins(t):
    return Y.page_body_margins(t.unit_boxes)
