"""Queries on compliance checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import CAPTION_VERBS
from ..operators import checks as C
from ..operators import issues as I
from ..operators import layout as Y
from ..operators import scoring as S
from . import fixtures
from .registry import query


def view_rules(t):
    """One row of rules per document, some of them unset."""
    d = F.col("doc_id")
    families = F.when(d % 7 == 0, F.array().cast("array<string>")).when(d % 3 == 0, F.array(F.lit("Arial"), F.lit("Times New Roman"))).otherwise(F.array(F.lit("TimesNewRomanPSMT")))
    return t.documents.select(
        "doc_id", families.alias("families"), F.when(d % 7 != 0, 12.0).alias("body_size"), F.lit(False).alias("black"),
        F.when(d % 5 == 0, "IGNORE").when(d % 5 == 1, "flush left").otherwise("Justified").alias("alignment"),
        F.create_map(F.lit(2), F.when(d % 4 == 0, "center").otherwise("justify")).alias("overrides"), F.when(d % 3 == 0, "APA").when(d % 3 == 1, "mla").otherwise("IEEE").alias("style"),
    )


fixtures.view_rules = view_rules
fixtures.SQL["f_check"] = """
    SELECT doc_id, n, page_index, line_index, text, CASE WHEN doc_id % 3 = 0 THEN font IN ('Arial', 'Times New Roman') ELSE font = 'Times New Roman' END AS family_ok, abs(size - 12) <= 0.75 AS size_ok
    FROM units WHERE trim(text) <> '' AND doc_id % 7 <> 0"""
fixtures.SQL["s_check"] = """
    SELECT doc_id, n, page_index, line_index, text, line_spacing = 2.0 AS ok FROM (SELECT *, lead(n) OVER (PARTITION BY doc_id, n // 4 ORDER BY n) AS below FROM units) WHERE below IS NOT NULL"""
fixtures.SQL["a_check"] = """
    SELECT doc_id, n, page_index, line_index, text, alignment = w OR (w = 'justify' AND alignment = 'left' AND k = 1) AS ok FROM (
      SELECT *, coalesce(CASE WHEN page_index = 1 THEN CASE WHEN doc_id % 4 = 0 THEN 'center' ELSE 'justify' END END, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'left' ELSE 'justify' END) AS w FROM (
        SELECT *, count(*) OVER (PARTITION BY doc_id, n // 4) AS k, lead(n) OVER (PARTITION BY doc_id, n // 4 ORDER BY n) IS NULL AS last FROM units)
      WHERE (NOT last OR k = 1) AND length(text) >= 40) WHERE w IS NOT NULL"""
for _name in ("f_check", "s_check", "a_check"):  # the scan runs on the lines with roles
    fixtures.SQL[f"scan_{_name}"] = fixtures.SQL[_name].replace("FROM units", "FROM roles")
fixtures.SQL["scan_rows"] = f"""
    SELECT doc_id, n, 'Fonts' AS category, CASE WHEN NOT family_ok THEN 'font_family' END AS a, 'critical' AS sa, CASE WHEN NOT size_ok THEN 'font_size' END AS b, 'critical' AS sb FROM scan_f_check
    UNION ALL SELECT doc_id, n, 'Fonts', CASE WHEN share < 0.6 THEN 'heading_bold' END, 'moderate', CASE WHEN role = 'heading1' AND al <> 'center' THEN 'heading_alignment' END, 'moderate' FROM (
      SELECT doc_id, role, min(n) AS n, sum(CASE WHEN face = 'bold' THEN length(text) ELSE 0 END) / greatest(sum(length(text)), 1)::DOUBLE AS share, min_by(alignment, n) AS al FROM (
        SELECT *, sum(g::INT) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM (SELECT *, coalesce(n - lag(n) OVER w > 1, true) OR coalesce(role <> lag(role) OVER w, true) AS g FROM roles WHERE role LIKE 'heading%' WINDOW w AS (PARTITION BY doc_id ORDER BY n)))
      GROUP BY doc_id, role, island) WHERE role IN ('heading1', 'heading2')
    UNION ALL SELECT doc_id, n, 'Margins', CASE WHEN short > 0.15 THEN 'margin_' || side END, CASE WHEN short > 0.45 THEN 'critical' WHEN short > 0.2 THEN 'moderate' ELSE 'minor' END, NULL, NULL FROM (
      SELECT doc_id, n, unnest(['left', 'right', 'top', 'bottom']) AS side, unnest([1.5 - l / 72.0::DOUBLE, 1.0 - r / 72.0::DOUBLE, 1.0 - t / 72.0::DOUBLE, 1.0 - b / 72.0::DOUBLE]) AS short FROM (
        SELECT doc_id, min(n) AS n, min(x0) AS l, 612 - max(x1) AS r, min(y0) AS t, 792 - max(y1) AS b FROM roles WHERE trim(text) <> '' GROUP BY doc_id, page_index))
    UNION ALL SELECT f.doc_id, f.n, 'Indentation', CASE WHEN abs(indent - greatest(CASE WHEN abs(modal - 0.5) <= 0.12 THEN 0 ELSE modal - 0.5 END, 0) - 0.5) > 0.12 THEN 'first_line_indent' END, 'moderate', NULL, NULL
      FROM scan_first f JOIN (SELECT doc_id, indent AS modal FROM scan_first GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(n)) = 1) m ON m.doc_id = f.doc_id
    UNION ALL SELECT doc_id, n, 'Spacing', CASE WHEN NOT ok THEN 'line_spacing' END, 'moderate', NULL, NULL FROM scan_s_check
    UNION ALL SELECT doc_id, n, 'Spacing', CASE WHEN regexp_matches(regexp_replace(text, '\\b(Dr|Mr|Mrs|Ms|St|vs|etc|Fig|No)\\. +', '\\1_', 'g'), '[.!?]  +[A-Z]') THEN 'word_spacing' END, 'minor', NULL, NULL FROM roles
    UNION ALL SELECT doc_id, n, 'Alignment', CASE WHEN NOT ok THEN 'alignment' END, 'moderate', NULL, NULL FROM scan_a_check
    UNION ALL SELECT p.doc_id, p.n, 'Pagination', CASE WHEN hid AND value IS NOT NULL THEN 'page_number_shown' WHEN NOT hid AND value IS NULL THEN 'page_number_missing' WHEN NOT hid AND (vertical <> 'top' OR horizontal <> 'right') THEN 'page_number_position' END, 'moderate', NULL, NULL
      FROM (SELECT q.doc_id, q.n, m.value, m.vertical, m.horizontal, q.page_index = 0 OR s.kind IS NOT NULL AS hid FROM (SELECT doc_id, page_index, min(n) AS n FROM roles GROUP BY 1, 2) q
            LEFT JOIN marks m ON m.doc_id = q.doc_id AND m.page_index = q.page_index LEFT JOIN (SELECT * FROM starts WHERE kind = 'chapter') s ON s.doc_id = q.doc_id AND s.page_index = q.page_index) p
    UNION ALL SELECT doc_id, n, 'Captions', CASE WHEN trim(regexp_extract(trim(text), '^(?i:table|figure|fig\\.?)\\s+[0-9.]+\\s*[:.–-]?\\s*(.*)$', 1)) = '' THEN 'caption_title_missing' END, 'moderate', CASE WHEN regexp_matches(trim(text), '^(?i:fig\\.)') THEN 'caption_prefix' END, 'minor' FROM roles WHERE role IN ('table', 'figure')
    UNION ALL SELECT doc_id, n, 'Citations', CASE WHEN NOT ok THEN 'citation_style' END, 'moderate', NULL, NULL FROM cites"""
fixtures.SQL["scan_first"] = "SELECT u.* FROM roles u ANTI JOIN glossary g ON g.doc_id = u.doc_id AND g.n = u.n WHERE u.n % 4 = 0 AND length(text) >= 20"
fixtures.SQL["scan_obs"] = "SELECT doc_id AS scan_id, category, a IS NULL AND b IS NULL AS ok FROM scan_rows"
fixtures.SQL["scan_find"] = """
    SELECT x.doc_id AS scan_id, category, issue_type, severity, page_index + 1 AS page, line_index + 1 AS line, left(text, 80) AS excerpt FROM (
      SELECT doc_id, n, category, a AS issue_type, sa AS severity FROM scan_rows WHERE a IS NOT NULL UNION ALL SELECT doc_id, n, category, b, sb FROM scan_rows WHERE b IS NOT NULL) x
    JOIN roles r ON r.doc_id = x.doc_id AND r.n = x.n"""


@query("check_fonts", "SELECT doc_id, n, family_ok AND size_ok AS ok, (NOT family_ok)::INT + (NOT size_ok)::INT AS n_problems FROM f_check")
def check_fonts(t):
    return C.check_fonts(t.units, t.rules).select("doc_id", "n", "ok", F.size("problems").alias("n_problems"))


@query("check_spacing", "SELECT doc_id, n, ok FROM s_check")
def check_spacing(t):
    lines = t.units.withColumn("paragraph", F.expr("n div 4")).withColumn("actual", F.col("line_spacing"))
    return C.check_spacing(lines, [2.0]).select("doc_id", "n", "ok")


@query(
    "pdf_line_spacing",
    """SELECT doc_id, n, round(g / 13.8::DOUBLE, 2) AS multiple FROM (SELECT doc_id, n, lead(y0) OVER (PARTITION BY doc_id, page_index ORDER BY n) - y0 AS g FROM unit_boxes) WHERE g IS NOT NULL""",
)
def pdf_line_spacing(t):
    """All rows have a pitch of 16 points at 12-point type: 1.16 single lines."""
    gap = F.lead("y0").over(Y.by_page()) - F.col("y0")
    return t.unit_boxes.withColumn("g", gap).where("g is not null").select("doc_id", "n", C.pdf_spacing(F.col("g").cast("double"), F.lit(12.0), F.lit(12.0)).alias("multiple"))


@query("check_alignment", "SELECT doc_id, n, ok FROM a_check")
def check_alignment(t):
    return C.check_alignment(t.units.withColumn("paragraph", F.expr("n div 4")), t.rules).select("doc_id", "n", "ok")


@query(
    "check_heading_styles",
    """WITH h AS (SELECT *, coalesce(n - lag(n) OVER w > 1, true) OR coalesce(role <> lag(role) OVER w, true) AS g FROM roles WHERE role LIKE 'heading%' WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
       i AS (SELECT *, sum(g::INT) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM h),
       s AS (SELECT doc_id, role, min(n) AS n, sum(CASE WHEN face = 'bold' THEN length(text) ELSE 0 END) / greatest(sum(length(text)), 1)::DOUBLE AS share, min_by(alignment, n) AS al FROM i GROUP BY doc_id, role, island)
       SELECT doc_id, role, n, CASE role WHEN 'heading1' THEN share >= 0.6 AND al = 'center' ELSE share >= 0.6 END AS ok FROM s WHERE role IN ('heading1', 'heading2')""",
)
def check_heading_styles(t):
    rules = t.spark.createDataFrame([("heading1", True, "center"), ("heading2", True, None)], "role string, bold boolean, alignment string")
    roles = t.roles
    return C.check_heading_styles(roles, rules).join(roles.select("doc_id", "n", "role"), ["doc_id", "n"]).select("doc_id", "role", "n", "ok")


@query(
    "check_paper",
    """WITH p AS (SELECT DISTINCT doc_id, page_index, CASE WHEN doc_id % 9 = 0 THEN 8.27 WHEN (doc_id + page_index) % 6 = 0 THEN 11.0 ELSE 8.5 END AS w, CASE WHEN doc_id % 9 = 0 THEN 11.69 WHEN (doc_id + page_index) % 6 = 0 THEN 8.5 ELSE 11.0 END AS h FROM units),
       x AS (SELECT DISTINCT doc_id, page_index FROM roles WHERE role IN ('table', 'figure'))
       SELECT doc_id, page_index, 'paper_size' AS issue_type, 'critical' AS severity FROM p WHERE doc_id % 9 = 0
       UNION ALL SELECT p.doc_id, p.page_index, 'page_orientation', 'moderate' FROM p ANTI JOIN x ON x.doc_id = p.doc_id AND x.page_index = p.page_index WHERE w > h""",
)
def check_paper(t):
    a4, turned = F.col("doc_id") % 9 == 0, (F.col("doc_id") + F.col("page_index")) % 6 == 0
    pages = t.units.select("doc_id", "page_index").distinct()
    pages = pages.withColumn("width", F.when(a4, 8.27).when(turned, 11.0).otherwise(8.5)).withColumn("height", F.when(a4, 11.69).when(turned, 8.5).otherwise(11.0))
    return C.check_paper(pages, t.roles.where("role in ('table', 'figure')"), 8.5, 11.0)


@query(
    "check_margins",
    """SELECT doc_id, page_index, side, short <= 0.15 AS ok, CASE WHEN short > 0.45 THEN 'critical' WHEN short > 0.2 THEN 'moderate' WHEN short > 0.15 THEN 'minor' END AS severity FROM (
         SELECT doc_id, page_index, unnest(['left', 'right', 'top', 'bottom']) AS side, unnest([1.5 - "left" / 72.0::DOUBLE, 1.0 - "right" / 72.0::DOUBLE, 1.0 - top / 72.0::DOUBLE, 1.0 - bottom / 72.0::DOUBLE]) AS short FROM margins)""",
)
def check_margins(t):
    return C.check_margins(Y.page_body_margins(t.unit_boxes), {"left": 1.0, "right": 1.0, "top": 1.0, "bottom": 1.0}, 0.5)


fixtures.SQL["glossary"] = """
    SELECT doc_id, n FROM (SELECT *, last_value(CASE WHEN regexp_matches(trim(text), '^(?i:definition of terms|table)\\b') THEN true WHEN role IN ('heading1', 'heading2', 'heading_other', 'table', 'figure') THEN false END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ins FROM roles) WHERE ins AND role = 'body'"""


@query("glossary_section_lines", "SELECT * FROM glossary")
def glossary_section_lines(t):
    return C.glossary_section_lines(t.roles)


@query(
    "check_indent_docx",
    """WITH f AS (SELECT u.* FROM units u ANTI JOIN glossary g ON g.doc_id = u.doc_id AND g.n = u.n WHERE u.n % 4 = 0 AND length(text) >= 20),
       m AS (SELECT doc_id, indent AS modal FROM f GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(n)) = 1)
       SELECT f.doc_id, f.n, abs(indent - greatest(CASE WHEN abs(modal - 0.5) <= 0.12 THEN 0 ELSE modal - 0.5 END, 0) - 0.5) <= 0.12 AS ok FROM f JOIN m ON m.doc_id = f.doc_id""",
)
def check_indent_docx(t):
    return C.check_indent_docx(t.units.withColumn("paragraph", F.expr("n div 4")), 0.5, C.glossary_section_lines(t.roles)).select("doc_id", "n", "ok")


@query(
    "check_indent_pdf",
    """WITH i AS (SELECT *, round((first_x + CASE WHEN doc_id % 2 = 0 THEN (doc_id + 5 * paragraph) % 4 * 8 ELSE 0 END - left_x) / 72.0::DOUBLE, 2) AS indent FROM indents),
       c AS (SELECT doc_id, indent, count(*) AS c FROM i WHERE lines > 1 GROUP BY 1, 2),
       m AS (SELECT doc_id, indent AS mode, c / sum(c) OVER (PARTITION BY doc_id)::DOUBLE AS share FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, indent) = 1),
       j AS (SELECT i.*, round(abs(indent - 0.5), 4) AS off, coalesce(share >= 0.55 AND round(abs(mode - 0.5), 4) <= 0.12 AND round(abs(indent - mode), 4) <= 0.12, false) AS usual FROM i LEFT JOIN m ON m.doc_id = i.doc_id),
       v AS (SELECT *, CASE WHEN off <= 0.12 OR (lines > 1 AND usual) THEN 'pass' WHEN lines = 1 OR off <= 0.25 THEN 'uncertain' ELSE 'fail' END AS verdict FROM j)
       SELECT doc_id, page_index, paragraph, indent, verdict, verdict <> 'fail' AS ok FROM v""",
)
def check_indent_pdf(t):
    """First lines of documents of even id are moved by 0 to 24 points."""
    moved = F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") + 5 * F.col("paragraph")) % 4 * 8).otherwise(0)
    return C.check_indent_pdf(Y.indent_paragraphs(t.unit_boxes).withColumn("first_x", F.col("first_x") + moved))


@query(
    "check_word_spacing",
    r"""SELECT doc_id, n, NOT regexp_matches(t, '[.!?] [A-Z]') AS ok, CASE WHEN regexp_matches(t, '[.!?] [A-Z]') THEN length(regexp_extract(t, '^(?s:(.*?))[.!?] [A-Z]', 1)) END AS offset
        FROM (SELECT doc_id, n, regexp_replace(text, '\b(Dr|Mr|Mrs|Ms|St|vs|etc|Fig|No)\. +', '\1_', 'g') AS t FROM units)""",
)
def check_word_spacing(t):
    return C.check_word_spacing(t.units, 2)


fixtures.SQL["page_list"] = "SELECT DISTINCT doc_id, page_index FROM marked"


@query(
    "check_page_numbers",
    """SELECT doc_id, page_index, issue_type, issue_type IS NULL AS ok FROM (
         SELECT p.doc_id, p.page_index, CASE WHEN hid AND value IS NOT NULL THEN 'page_number_shown' WHEN NOT hid AND value IS NULL THEN 'page_number_missing' WHEN NOT hid AND (vertical <> 'top' OR horizontal <> 'right') THEN 'page_number_position' END AS issue_type
         FROM (SELECT p.*, m.value, m.vertical, m.horizontal, p.page_index = 0 OR s.kind IS NOT NULL AS hid FROM page_list p LEFT JOIN marks m ON m.doc_id = p.doc_id AND m.page_index = p.page_index
               LEFT JOIN (SELECT * FROM starts WHERE kind = 'chapter') s ON s.doc_id = p.doc_id AND s.page_index = p.page_index) p)""",
)
def check_page_numbers(t):
    return C.check_page_numbers(t.marked, Y.page_marks_pdf(t.marked), Y.section_starts(t.marked), "top", "right")


@query(
    "hidden_chapter_inference",
    """SELECT doc_id, page_index FROM (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM (SELECT DISTINCT doc_id, n // 5 AS page_index, CASE WHEN n // 5 % 3 <> 1 THEN n // 5 * 5 % 7 + 1 END AS value FROM units)
       WINDOW w AS (PARTITION BY doc_id ORDER BY page_index)) WHERE value IS NULL AND a < b""",
)
def hidden_chapter_inference(t):
    """Pages of five lines, every third without a number."""
    page = F.expr("n div 5")
    pages = t.units.select("doc_id", page.alias("page_index"), F.when(page % 3 != 1, page * 5 % 7 + 1).alias("value")).distinct()
    return C.hidden_chapter_inference(pages)


@query(
    "check_page_sequence",
    """SELECT doc_id, page_index, 'body' AS block, value, expected, expected IS NULL OR value = expected OR value = 1 AS ok FROM (
         SELECT *, lag(value) OVER w + page_index - lag(page_index) OVER w AS expected FROM marks WINDOW w AS (PARTITION BY doc_id ORDER BY page_index))""",
)
def check_page_sequence(t):
    return C.check_page_sequence(Y.page_marks_pdf(t.marked))


@query(
    "check_caption_form",
    r"""SELECT doc_id, n, r <> '' AND r = upper(r) AS ok, (r = '')::INT + (r <> upper(r))::INT AS n_problems FROM (SELECT doc_id, n, trim(regexp_extract(trim(text), '^(?i:table|figure|fig\.?)\s+[0-9.]+\s*[:.–-]?\s*(.*)$', 1)) AS r FROM roles WHERE role IN ('table', 'figure'))""",
)
def check_caption_form(t):
    return C.check_caption_form(t.roles.where("role in ('table', 'figure')"), upper=True).select("doc_id", "n", "ok", F.size("problems").alias("n_problems"))


@query("caption_prose_lines", rf"SELECT doc_id, n FROM marked WHERE regexp_matches(trim(text), '^(?i:table|figure)\s+[0-9]+\s*[:.–-]?\s*(?i:{CAPTION_VERBS})\b')")
def caption_prose_lines(t):
    return C.caption_prose_lines(t.marked)


@query(
    "check_object_placement",
    """WITH o AS (SELECT doc_id, n, CASE WHEN n % 13 IN (4, 5) THEN 'table' WHEN n % 13 = 9 THEN 'figure' END AS object, CASE WHEN role IN ('table', 'figure') THEN n END AS c FROM roles),
       w AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, first_value(c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM o),
       s AS (SELECT *, coalesce(n - lag(n) OVER x > 1 OR object <> lag(object) OVER x, true) AS st FROM w WHERE object IS NOT NULL WINDOW x AS (PARTITION BY doc_id ORDER BY n)),
       k AS (SELECT *, sum(st::INT) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS cluster FROM s),
       g AS (SELECT doc_id, cluster, object, min(n) AS first, max(n) AS last, arg_min_null(b, n) AS b, arg_max_null(a, n) AS a FROM k GROUP BY 1, 2, 3),
       v AS (SELECT *, coalesce(first - b <= 8, false) AS up, coalesce(a - last <= 8, false) AS down FROM g)
       SELECT doc_id, cluster, object, first, last, CASE WHEN NOT up AND NOT down THEN 'caption_missing' WHEN object = 'table' AND NOT up THEN 'caption_side' WHEN object = 'figure' AND NOT down THEN 'caption_side' END AS issue_type FROM v""",
)
def check_object_placement(t):
    k = F.col("n") % 13
    return C.check_object_placement(t.roles.withColumn("object", F.when(k.isin(4, 5), "table").when(k == 9, "figure")))


fixtures.SQL["cites"] = f"""
    SELECT doc_id, n, CASE doc_id % 3 WHEN 0 THEN NOT (num OR page) WHEN 1 THEN NOT (num OR yr) ELSE NOT (yr OR page) END AS ok FROM (
      SELECT doc_id, n, regexp_matches(text, '{C.NUMERIC}') AS num, regexp_matches(text, '{C.AUTHOR_YEAR.replace("'", "''")}') AS yr, regexp_matches(text, '{C.AUTHOR_PAGE}') AS page FROM roles WHERE role <> 'toc') WHERE num OR yr OR page"""


@query("check_citation_markers", "SELECT doc_id, n, ok FROM cites")
def check_citation_markers(t):
    return C.check_citation_markers(t.roles, t.rules.select("doc_id", "style")).select("doc_id", "n", "ok")


fixtures.SQL["refs"] = r"""
    WITH a AS (SELECT doc_id, n, text, role, regexp_matches(trim(text), '^(?i:(?:list\s+of\s+)?(?:references|bibliography|works cited|literature cited))\b') AS head FROM roles),
    b AS (SELECT *, last_value(CASE WHEN head THEN 1 WHEN role IN ('heading1', 'heading2', 'heading_other') THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ins FROM a),
    c AS (SELECT *, sum(regexp_matches(text, '^[A-Z][A-Za-z''’-]+, [A-Z]\.')::INT) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS entry FROM b WHERE ins = 1 AND NOT head AND trim(text) <> '')
    SELECT doc_id, entry, min(n) AS n, count(*) AS lines, string_agg(trim(text), ' ' ORDER BY n) AS text FROM c WHERE entry > 0 GROUP BY 1, 2"""


@query("reference_entries", "SELECT doc_id, entry, n, lines, md5(text) AS h FROM refs")
def reference_entries(t):
    return C.reference_entries(t.roles).select("doc_id", "entry", "n", "lines", F.md5("text").alias("h"))


@query(
    "check_reference_style",
    r"""SELECT r.doc_id, entry, shape, CASE r.doc_id % 3 WHEN 0 THEN 'APA' WHEN 1 THEN 'mla' ELSE 'IEEE' END AS style, shape = CASE r.doc_id % 3 WHEN 0 THEN 'APA' WHEN 1 THEN 'MLA' ELSE 'IEEE' END AS ok FROM (
        SELECT *, CASE WHEN regexp_matches(text, '^[^(]{1,80}\([0-9]{4}[a-z]?\)') THEN 'APA' WHEN regexp_matches(text, '[0-9]{4}\.?$') THEN 'MLA' END AS shape FROM refs) r
        ANTI JOIN (SELECT doc_id, n FROM cites WHERE NOT ok) p ON p.doc_id = r.doc_id AND p.n = r.n WHERE shape IS NOT NULL""",
)
def check_reference_style(t):
    pinned = C.check_citation_markers(t.roles, t.rules.select("doc_id", "style")).where("not ok").select("doc_id", "n")
    return C.check_reference_style(C.reference_entries(t.roles), t.rules.select("doc_id", "style"), pinned)


@query(
    "check_citation_style_ml",
    """SELECT r.doc_id, r.n, ['APA', 'MLA', 'IEEE'][r.n % 3 + 1] AS found, CASE r.doc_id % 3 WHEN 0 THEN 'APA' WHEN 1 THEN 'mla' ELSE 'IEEE' END AS wanted, r.n % 3 = r.doc_id % 3 AS ok
       FROM (SELECT doc_id, n FROM marked WHERE (doc_id + n) % 10 >= 7) r ANTI JOIN (SELECT doc_id, n FROM cites WHERE NOT ok) p ON p.doc_id = r.doc_id AND p.n = r.n""",
)
def check_citation_style_ml(t):
    style = F.element_at(F.array(F.lit("APA"), F.lit("MLA"), F.lit("IEEE")), (F.col("n") % 3 + 1).cast("int"))
    predicted = t.marked.select("doc_id", "n", style.alias("style"), (((F.col("doc_id") + F.col("n")) % 10) / 10).alias("confidence"))
    pinned = C.check_citation_markers(t.roles, t.rules.select("doc_id", "style")).where("not ok").select("doc_id", "n")
    return C.check_citation_style_ml(predicted, t.rules.select("doc_id", "style"), pinned)


def view_scan_scores(t):
    observations, findings = C.run_scan(t.roles.withColumn("paragraph", F.expr("n div 4")), t.rules)
    stats = S.category_stats(observations)
    return S.category_entries(stats, I.collect_issues(findings))


fixtures.view_scan_scores = view_scan_scores
_SCAN = """
    WITH st AS (SELECT scan_id, category, count(*) AS checked, count(*) FILTER (WHERE ok) AS passed FROM scan_obs GROUP BY 1, 2),
    sc AS (SELECT scan_id, sum(checked)::BIGINT AS checked, sum(passed)::BIGINT AS passed, avg(100.0::DOUBLE * passed / checked) AS overall, min_by(category, (100.0::DOUBLE * passed / checked, category)) AS worst FROM st GROUP BY 1),
    oc AS (SELECT scan_id, count(DISTINCT (issue_type, page, line)) AS occurrences FROM scan_find GROUP BY 1)
    SELECT sc.scan_id, checked, passed, round(overall, 6) AS overall, CASE WHEN overall >= 80 THEN 'compliant' WHEN overall >= 50 THEN 'needs_revision' ELSE 'critical' END AS band, worst, coalesce(occurrences, 0) AS occurrences
    FROM sc LEFT JOIN oc ON oc.scan_id = sc.scan_id"""


@query("run_scan", _SCAN)
def run_scan(t):
    """The flagship: overall score, band and worst category of every document."""
    e = t.scan_scores.where("checked > 0")
    out = e.groupBy("scan_id").agg(
        F.sum("checked").alias("checked"), F.sum("passed").alias("passed"), F.avg("score").alias("overall"), F.min_by("category", F.struct("score", "category")).alias("worst"), F.sum("issue_occurrences").alias("occurrences")
    )
    return out.select("scan_id", "checked", "passed", F.round("overall", 6).alias("overall"), S.score_band(F.col("overall")).alias("band"), "worst", "occurrences")
