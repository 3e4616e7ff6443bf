"""Queries on labelled guides: a document's own lines, then eight sections of which each is whole, lacks its title, its
first label or that label's value, by the document's id; the SQL counts lines and knows the state of each section."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guide_schema as K
from ..operators import guides as G
from . import fixtures
from .guide_queries import _FAMILIES, _of
from .registry import query

STEP = (1, 2, 3, 5, 7, 11, 13, 17)
#: State of a section: 0 whole, 1 no title, 2 no label (or text), 3 a placeholder.
_STATE = [f"(guide_id // {s}) % 4" for s in STEP]


def _section_lines(section: str, state: int) -> tuple[str, ...]:
    title, fields = K.FIELDS[section]
    if state == 1:
        return ()
    if section in K.FREE:
        return (title, *{0: ("Number and title in bold, above.",), 2: (), 3: ("n/a",)}[state])
    lines = [f"{label}: some value" for _, label, _, _ in fields]
    return (f"{'ABCDEFGH'[list(K.FIELDS).index(section)]}. {title}:", *{0: lines, 2: lines[1:], 3: [f"{fields[0][1]}: N/A", *lines[1:]]}[state])


def view_guide_lines(t):
    texts = [F.element_at(F.array(*[F.array(*[F.lit(x) for x in _section_lines(s, v)]).cast("array<string>") for v in range(4)]), (F.expr(state.replace("//", "div").replace("guide_id", "doc_id")) + 1).cast("int")) for s, state in zip(K.FIELDS, _STATE)]
    lines = F.concat(F.split(F.coalesce("text", F.lit("")), "\n"), *texts)
    return t.documents.select(F.col("doc_id").alias("guide_id"), F.lit(1).alias("page"), F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line") + 1)


fixtures.view_guide_lines = view_guide_lines
_LEN = [f"[{', '.join(str(len(_section_lines(s, v))) for v in range(4))}][{state} + 1]" for s, state in zip(K.FIELDS, _STATE)]
_START = [" + ".join(["own", *_LEN[:i], "1"]) for i in range(8)]


def _gap(i: int, section: str) -> str:
    first = section if section in K.FREE else K.FIELDS[section][1][0][0]
    free, optional = section in K.FREE, first in K.OPTIONAL
    rest = f"WHEN 2 THEN {'NULL' if optional else repr('missing_value' if free else 'missing_label')} WHEN 3 THEN 'missing_value'"
    absent = "NULL" if section == "heading_styles" else "'missing_category'"
    place = f"CASE {_STATE[i]} WHEN 1 THEN 1 WHEN 2 THEN {_START[i]} ELSE {_START[i]} + {0 if free else 1} END"
    return f"SELECT guide_id, CASE {_STATE[i]} WHEN 1 THEN {absent} {rest} END AS code, '{section}' AS section, CASE WHEN {_STATE[i]} = 1 THEN '' ELSE '{first}' END AS field, 1 AS page, {place} AS line FROM owns"


fixtures.SQL["owns"] = "SELECT doc_id AS guide_id, len(string_split(coalesce(text, ''), chr(10))) AS own FROM documents"


@query("section_gaps", "SELECT * FROM (" + " UNION ALL ".join(_gap(i, s) for i, s in enumerate(K.FIELDS)) + ") WHERE code IS NOT NULL")
def section_gaps(t):
    return K.section_gaps(t.guide_lines)


@query(
    "without_ignored",
    f"""SELECT guide_id, CASE WHEN guide_id % 3 <> 1 THEN {_of(4, _FAMILIES)} END AS families, CASE WHEN guide_id % 3 <> 0 THEN {_of(2, (1.0, 1.5, 1.5, None))} END::DOUBLE AS "left",
        {_of(2, (1.0, 1.0, 1.5, None))}::DOUBLE AS "right", CASE WHEN guide_id % 3 <> 2 THEN {_of(6, ("APA", "MLA", "IEEE", None))} END AS citation_style FROM gids""",
)
def without_ignored(t):
    """Every guide's rules without a field, a whole section or a single rule that it ignores."""
    r = G.derive_rules(t.guides)
    rules = r.select("guide_id", F.struct(F.concat_ws(",", "font.families").alias("type")).alias("font"), F.col("margins").alias("margins_inches"), "citation_style")
    key = F.element_at(F.array(*[F.lit(k) for k in ("margins:left", "font", "citation_format:citation_style")]), (F.col("guide_id") % 3 + 1).cast("int"))
    out = K.without_ignored(rules, t.guides.select("guide_id", key.alias("key")))
    return out.select("guide_id", F.col("font.type").alias("families"), *[F.try_element_at("margins_inches", F.lit(s)).alias(s) for s in ("left", "right")], "citation_style")
