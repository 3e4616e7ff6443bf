"""Queries of the indentation of paragraphs on pages: rules, columns, tables, paragraphs and the check."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indentation as I
from . import fixtures, layout_queries  # noqa: F401  its views are used here
from .registry import query

_WORDINGS = ("0.5 inch", "one tab", "hanging indent of 1 inch", "IGNORE", "left indent 0.25 inch", None, "no indent")
_RULES = ("first_line", "first_line", "hanging", None, "left", "first_line", "none")
_INCHES = (0.5, 0.5, 1.0, None, 0.25, 0.5, 0.0)


def _pick(key, values):
    out = F.lit(None)
    for i, v in enumerate(values):
        out = F.when(key == i, F.lit(v)).otherwise(out)
    return out


def _case(key: str, values) -> str:
    said = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {said(v)}" for i, v in enumerate(values)) + " END"


def view_indent_lines(t):
    """Lines with roles, laid out on pages of one or two columns with first lines set in by document; every 97th line of
    a plain page stands beside the one before it."""
    two, n, doc = (F.col("doc_id") + F.col("page_index")) % 5 == 1, F.col("n"), F.col("doc_id")
    right, moved = two & (F.col("line_index") >= 20), ~two & (n % 97 == 50) & (F.col("line_index") > 0)
    inset = F.when(n % 4 == 0, F.when(doc % 3 == 0, 36).when(doc % 3 == 1, 72).when(n % 8 == 0, 36).otherwise(18)).otherwise(0)
    x0 = F.when(moved, 420).otherwise(F.when(right, 324).otherwise(72) + inset).cast("double")
    y0 = F.when(two, 72 + 32 * (F.col("line_index") % 20)).otherwise(72 + 16 * (F.col("line_index") - moved.cast("long"))).cast("double")
    room = F.when(moved, 120).otherwise(F.when(two, 230).otherwise(468) - inset)
    x1 = x0 + F.least(room, 5 * F.length("text"))
    return t.roles.select("doc_id", "page_index", "n", "text", "role", "size", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 12).alias("y1"))


def view_drawings(t):
    lines = t.indent_lines.where("n % 211 = 100")
    return lines.select("doc_id", "page_index", (F.col("x0") - 4).alias("x0"), (F.col("y0") - 4).alias("y0"), (F.col("x1") + 4).alias("x1"), (F.col("y1") + 36).alias("y1"))


def view_indent_rules(t):
    """A rule a document, one of seven wordings or a plain number."""
    v = F.col("doc_id") % 7
    inches, start = F.when(v == 5, 0.5), F.when(v == 5, 2)
    return t.documents.select("doc_id", I.indent_rule(_pick(v, _WORDINGS).cast("string"), inches, F.lit(None).cast("string"), F.lit(None).cast("double"), start).alias("rule"))


fixtures.view_indent_lines, fixtures.view_drawings, fixtures.view_indent_rules = view_indent_lines, view_drawings, view_indent_rules
fixtures.SQL["indent_lines"] = """
    SELECT doc_id, page_index, n, text, role, size, x0, y0, x0 + least(CASE WHEN moved THEN 120 WHEN two THEN 230 - inset ELSE 468 - inset END, 5 * length(text)) AS x1, y0 + 12 AS y1
    FROM (SELECT * EXCLUDE (x0, x1, y0, y1), CASE WHEN moved THEN 420 WHEN two AND line_index >= 20 THEN 324 + inset ELSE 72 + inset END::DOUBLE AS x0,
                 CASE WHEN two THEN 72 + 32 * (line_index % 20) ELSE 72 + 16 * (line_index - moved::INT) END::DOUBLE AS y0
          FROM (SELECT *, NOT two AND n % 97 = 50 AND line_index > 0 AS moved FROM (
              SELECT *, (doc_id + page_index) % 5 = 1 AS two, CASE WHEN n % 4 <> 0 THEN 0 WHEN doc_id % 3 = 0 THEN 36 WHEN doc_id % 3 = 1 THEN 72 WHEN n % 8 = 0 THEN 36 ELSE 18 END AS inset FROM roles)))"""
fixtures.SQL["drawings"] = "SELECT DISTINCT doc_id, page_index, x0 - 4 AS x0, y0 - 4 AS y0, x1 + 4 AS x1, y1 + 36 AS y1 FROM indent_lines WHERE n % 211 = 100"

_P = "doc_id, page_index"
_AREA = "(d.x1 - d.x0) * (d.y1 - d.y0)"
fixtures.SQL["table_seeds"] = f"""
    SELECT * EXCLUDE (beside, band, narrow), trim(text) <> '' AND (coalesce(role, '') = 'table' OR contains(text, chr(9)) OR length(text) - length(replace(text, '  ', '')) >= 6
        OR (narrow AND bool_or(beside) OVER (PARTITION BY {_P}, band, narrow))) AS s
    FROM (SELECT *, narrow AND coalesce(x0 >= lag(x1) OVER (PARTITION BY {_P}, band, narrow ORDER BY x0, n) - 2, false) AS beside
          FROM (SELECT *, round_even(y0 / 4, 0) AS band, x1 - x0 <= {I.NARROW_SHARE}::DOUBLE * 612 AND trim(text) <> '' AS narrow FROM indent_lines))"""
fixtures.SQL["table_grown0"] = f"""
    SELECT * EXCLUDE (s), s OR (doc_id, page_index, n) IN (SELECT (doc_id, page_index, n) FROM (
        SELECT l.doc_id, l.page_index, l.n, {_AREA} AS area, d.x1 - d.x0 AS across, count(*) OVER (PARTITION BY l.doc_id, l.page_index, d.x0, d.y0, d.x1, d.y1) AS held
        FROM indent_lines l JOIN drawings d ON d.doc_id = l.doc_id AND d.page_index = l.page_index AND l.x0 >= d.x0 - 6 AND l.x1 <= d.x1 + 6 AND l.y0 >= d.y0 - 6 AND l.y1 <= d.y1 + 6
        WHERE trim(l.text) <> '' AND {_AREA} < 0.55 * 612 * 792 AND d.x1 - d.x0 < 0.92 * 612) WHERE held > 1 OR (area < 0.35 * 612 * 792 AND across < 0.7 * 612)) AS s FROM table_seeds"""
for _i in range(I.GROW_ROUNDS):
    fixtures.SQL[f"table_grown{_i + 1}"] = f"""
    SELECT * EXCLUDE (s, head, foot, edge), s OR coalesce(edge AND x1 - x0 < 0.85 * 612 AND y1 >= head - 40 AND y0 <= foot + 40 AND trim(text) <> '', false) AS s
    FROM (SELECT *, min(y0) FILTER (WHERE s) OVER (PARTITION BY {_P}) AS head, max(y1) FILTER (WHERE s) OVER (PARTITION BY {_P}) AS foot,
                 bool_or(s) OVER (PARTITION BY {_P} ORDER BY x0 RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS edge FROM table_grown{_i})"""
_GROWN = f"table_grown{I.GROW_ROUNDS}"
fixtures.SQL["body_lines"] = rf"""
    SELECT * EXCLUDE (s, text, raw), raw AS text FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS raw FROM {_GROWN})
    WHERE raw <> '' AND NOT s AND coalesce(role, '') NOT IN ('pagination', 'header', 'footer') AND y0 > {I.EDGE_BAND} AND y1 < 792 - {I.EDGE_BAND}"""


def _blocks(source: str) -> str:
    return f"""
    SELECT * EXCLUDE (edge, c, seen, a, b, second, h0, h1, f0, f1), CASE WHEN coalesce(h0 IS NOT NULL AND h1 IS NOT NULL AND abs(a - b) >= {I.COLUMNS_APART} AND least(f0, f1) - greatest(h0, h1) > 20, false) AND second = (b > a) THEN 1 ELSE 0 END AS block
    FROM (SELECT *, min(y0) FILTER (WHERE NOT second) OVER w AS h0, max(y0) FILTER (WHERE NOT second) OVER w AS f0, min(y0) FILTER (WHERE second) OVER w AS h1, max(y0) FILTER (WHERE second) OVER w AS f1
      FROM (SELECT *, coalesce(abs(x0 - b) < abs(x0 - a), false) AS second
        FROM (SELECT *, first_value(edge) OVER (PARTITION BY {_P} ORDER BY (edge = a)::INT, c DESC, seen) AS b0, CASE WHEN b0 <> a THEN b0 END AS b
          FROM (SELECT *, first_value(edge) OVER (PARTITION BY {_P} ORDER BY c DESC, seen) AS a
            FROM (SELECT *, count(*) OVER (PARTITION BY {_P}, edge) AS c, min(place) OVER (PARTITION BY {_P}, edge) AS seen
              FROM (SELECT *, round_even(x0 / 4, 0) * 4 AS edge, row_number() OVER (PARTITION BY {_P} ORDER BY y0, x0, n) AS place FROM {source})))))
      WINDOW w AS (PARTITION BY {_P}))"""


fixtures.SQL["body_blocks"] = _blocks("body_lines")
_B, _LOUD = f"{_P}, block", "text = upper(text) AND text <> lower(text) AND len(string_split(text, ' ')) <= 10"
_LIST, _CAPTION, _MID = (p.replace("'", "''") for p in (I.LIST_ITEM, I.CAPTION, I.MID_SENTENCE))
_LOW, _HIGH = (f"{v}::DOUBLE" for v in I.BODY_EDGE)
fixtures.SQL["block_shapes"] = f"""
    SELECT * EXCLUDE (c, seen), first_value(lft) OVER (PARTITION BY {_B} ORDER BY c DESC, seen) AS most, max(c) OVER (PARTITION BY {_B}) AS top_c, c AS votes,
           CASE WHEN gap > 0 AND gap <= 1.6::DOUBLE * min(gap) FILTER (WHERE gap > 0) OVER (PARTITION BY {_B}) + 1 THEN gap END AS tight
    FROM (SELECT *, count(*) OVER (PARTITION BY {_B}, lft) AS c, min(place) OVER (PARTITION BY {_B}, lft) AS seen
      FROM (SELECT *, round_even(x0, 0) AS lft, y0 - lag(y0) OVER (PARTITION BY {_B} ORDER BY place) AS gap, regexp_matches(text, '{_LIST}') AS li,
                   starts_with(role, 'heading') OR (length(text) <= 80 AND (size >= 13 OR ({_LOUD}))) AS heading, max(x1) OVER (PARTITION BY {_B}) AS edge FROM body_blocks))"""
fixtures.SQL["block_starts"] = f"""
    SELECT * EXCLUDE (x), coalesce(x.first OR x.after_head OR (inward AND (x.room >= {I.SHORT_GAP} OR x.room <= {I.FULL_GAP} OR gap > {I.PARAGRAPH_GAP}::DOUBLE * pitch)), false) AS opens,
           coalesce(NOT inward AND (x.room >= {I.SHORT_GAP} OR gap > {I.FLUSH_GAP}::DOUBLE * pitch) AND NOT x.after_item AND NOT regexp_matches(text, '{_MID}'), false) AS might
    FROM (SELECT *, x0 - baseline >= {I.SET_IN} AS inward, {{'first': lag(n) OVER w IS NULL, 'after_head': lag(heading) OVER w, 'after_item': lag(li) OVER w, 'room': edge - lag(x1) OVER w}} AS x
      FROM (SELECT *, min(CASE WHEN votes = top_c OR abs(lft - most) BETWEEN {_LOW} AND {_HIGH} THEN lft END) OVER (PARTITION BY {_B}) AS baseline,
                   coalesce(max(CASE WHEN rank = gaps - gaps // 2 THEN tight END) OVER (PARTITION BY {_B}), 16) AS pitch
        FROM (SELECT *, row_number() OVER (PARTITION BY {_B} ORDER BY tight DESC NULLS LAST) AS rank, count(tight) OVER (PARTITION BY {_B}) AS gaps FROM block_shapes))
      WINDOW w AS (PARTITION BY {_B} ORDER BY place))"""
fixtures.SQL["indent_paras"] = f"""
    SELECT *, sum(starts::INT) OVER (PARTITION BY {_B} ORDER BY place)::BIGINT AS paragraph
    FROM (SELECT *, opens OR (might AND NOT coalesce(bool_or((opens OR might) AND li) OVER (PARTITION BY {_B}, run ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS starts
      FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY {_B} ORDER BY place) AS run FROM block_starts WHERE NOT heading))"""
fixtures.SQL["para_indents"] = f"""
    WITH v AS (SELECT *, count(*) FILTER (WHERE NOT starts) OVER (PARTITION BY {_B}, paragraph, lft) AS c, min(place) FILTER (WHERE NOT starts) OVER (PARTITION BY {_B}, paragraph, lft) AS seen FROM indent_paras),
    g AS (SELECT {_B}, paragraph, min_by(n, place) AS n, count(*) AS lines, min_by(text, place) AS text, min_by(x0, place) AS x0, min_by(y0, place) AS y0, min_by(x1, place) AS x1, min_by(y1, place) AS y1,
          bool_or(starts AND li) AS list_item, min(place) AS place, any_value(baseline) AS baseline, min(x0) AS lst, max(x1) AS mst, arg_max(lft, c * 1000000 - seen) FILTER (WHERE NOT starts) AS edge FROM v GROUP BY ALL),
    t AS (SELECT DISTINCT g.doc_id, g.page_index, g.n FROM g JOIN drawings d ON d.doc_id = g.doc_id AND d.page_index = g.page_index AND g.x1 >= d.x0 - 8 AND g.x0 <= d.x1 + 8 AND g.y1 >= d.y0 - 12 AND g.y0 <= d.y1 + 12)
    SELECT {_B}, paragraph, n, lines, text, list_item, round((x0 - CASE WHEN abs(edge - baseline) < {I.SET_IN} THEN baseline ELSE edge END) / 72, 3) AS first_line, round((lst - baseline) / 72, 3) AS "left", round((612 - mst) / 72, 3) AS "right",
           CASE WHEN baseline > 0.35::DOUBLE * 612 THEN 'far_right_column' WHEN regexp_matches(text, '{_CAPTION}') THEN 'caption' WHEN regexp_matches(text, '{I.LABEL}') AND lines = 1 THEN 'label_value' WHEN list_item THEN 'list'
                WHEN (doc_id, page_index, n) IN (SELECT (doc_id, page_index, n) FROM t) THEN 'beside_image' WHEN regexp_matches(text, '{I.REFERENCE}') AND length(text) < 120 THEN 'reference' WHEN page_index > 0 AND place = 1 THEN 'page_top' END AS skipped
    FROM g"""


@query("mark_indent_tables", f"SELECT doc_id, page_index, n, s AS in_table FROM {_GROWN}")
def mark_indent_tables(t):
    return I.mark_indent_tables(t.indent_lines, t.drawings).select("doc_id", "page_index", "n", "in_table")


@query("column_blocks", f"SELECT doc_id, page_index, n, place, block FROM ({_blocks('indent_lines')})")
def column_blocks(t):
    return I.column_blocks(t.indent_lines).select("doc_id", "page_index", "n", "place", "block")


@query("indented_paragraphs", "SELECT doc_id, page_index, n, block, paragraph, starts, list_item, baseline FROM (SELECT *, li AS list_item FROM indent_paras)")
def indented_paragraphs(t):
    return I.indented_paragraphs(t.indent_lines, t.drawings).select("doc_id", "page_index", "n", "block", "paragraph", "starts", "list_item", "baseline")


@query("page_indents", 'SELECT doc_id, page_index, block, paragraph, n, lines, skipped, first_line, "left", "right" FROM para_indents')
def page_indents(t):
    own = I.page_indents(I.indented_paragraphs(t.indent_lines, t.drawings), t.drawings)
    return own.select("doc_id", "page_index", "block", "paragraph", "n", "lines", "skipped", "first_line", "left", "right")


@query(
    "indent_rules",
    f"""SELECT doc_id, v.type AS indent_type, v.inches AS inches, 0.08::DOUBLE AS tolerance, CASE WHEN doc_id % 7 = 5 THEN 2 END::BIGINT AS start_page FROM (
        SELECT doc_id, {{'type': {_case("doc_id % 7", _RULES)}, 'inches': {_case("doc_id % 7", _INCHES)}}} AS v FROM documents) WHERE v.type IS NOT NULL""",
)
def indent_rules(t):
    return t.indent_rules.where("rule is not null").select("doc_id", F.col("rule.type").alias("indent_type"), "rule.inches", "rule.tolerance", "rule.start_page")


@query(
    "check_page_indents",
    f"""WITH j AS (SELECT *, {_case("doc_id % 7", _RULES)} AS kind, {_case("doc_id % 7", _INCHES)} AS wanted,
             CASE WHEN list_item THEN true WHEN regexp_matches(text, '^\\p{{Lu}}') THEN false END AS told FROM para_indents WHERE doc_id % 7 <> 3),
       s AS (SELECT * EXCLUDE (skipped), CASE WHEN told IS NULL AND coalesce(last_value(told IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_index, block, paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
             THEN 'list_continuation' WHEN doc_id % 7 = 5 AND page_index + 1 < 2 THEN 'before_start_page' ELSE skipped END AS skipped FROM j),
       m AS (SELECT *, CASE WHEN skipped IS NULL THEN CASE kind WHEN 'hanging' THEN -first_line WHEN 'left' THEN "left" ELSE first_line END END AS measured FROM s),
       c AS (SELECT doc_id, round(measured, 2) AS val, count(*) AS c FROM m WHERE measured IS NOT NULL GROUP BY 1, 2),
       u AS (SELECT doc_id, val, c >= {I.USUAL_SHARE}::DOUBLE * sum(c) OVER (PARTITION BY doc_id) AS clear FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, val) = 1),
       r AS (SELECT m.*, u.val, u.clear FROM m LEFT JOIN u ON u.doc_id = m.doc_id),
       w AS (SELECT *, CASE WHEN skipped IS NOT NULL THEN NULL WHEN measured IS NULL THEN 'uncertain'
             WHEN round(abs(measured - wanted), 4) <= 0.08 OR (clear AND round(abs(val - wanted), 4) <= 0.08 AND round(abs(measured - val), 4) <= 0.08) THEN 'pass'
             WHEN round(abs(measured - wanted), 4) <= 0.1 THEN 'uncertain' ELSE 'fail' END AS verdict FROM r)
       SELECT doc_id, page_index, block, paragraph, n, lines, array_to_string(string_split(text, ' ')[1:8], ' ') AS opening, kind AS indent_type, wanted AS expected, measured, skipped, verdict, verdict <> 'fail' AS ok FROM w""",
)
def check_page_indents(t):
    own = I.page_indents(I.indented_paragraphs(t.indent_lines, t.drawings), t.drawings)
    return I.check_page_indents(own, t.indent_rules)
