"""Queries on observations, findings and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import issues as I
from ..operators import scoring as S
from ..schemas import CATEGORIES
from . import fixtures
from .registry import query

_LIST = ", ".join(f"'{c}'" for c in CATEGORIES)
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END"
fixtures.SQL["dims"] = f"SELECT unnest([{_LIST}]) AS category, unnest(range(8)) AS position"
fixtures.SQL["stats"] = """
    SELECT s.scan_id, d.category, count(o.category) AS checked, count(*) FILTER (WHERE NOT o.ok) AS failed, count(o.category) > 0 AS applicable
    FROM (SELECT DISTINCT scan_id FROM observations) s CROSS JOIN dims d LEFT JOIN observations o ON o.scan_id = s.scan_id AND o.category = d.category
    GROUP BY s.scan_id, d.category"""
fixtures.SQL["once"] = f"""
    SELECT scan_id, issue_type, category, page, line, min({_RANK}) AS sev, min(excerpt) AS excerpt, lower(excerpt) AS k FROM findings
    GROUP BY scan_id, issue_type, category, page, line, lower(excerpt)"""
fixtures.SQL["issues"] = """
    SELECT scan_id, issue_type, min_by(category, (page, line, category, k)) AS category, ['critical', 'moderate', 'minor'][min(sev) + 1] AS severity, count(*) AS count
    FROM once GROUP BY scan_id, issue_type"""
fixtures.SQL["entries"] = """
    SELECT s.scan_id, s.category, CASE WHEN checked = 0 THEN 'not_applicable' WHEN failed > 0 THEN 'fail' ELSE 'pass' END AS status,
           checked, checked - failed AS passed, failed, CASE WHEN checked > 0 THEN 100.0::DOUBLE * (checked - failed) / checked END AS score,
           CASE WHEN sum(failed) OVER (PARTITION BY s.scan_id) > 0 THEN 100.0::DOUBLE * failed / sum(failed) OVER (PARTITION BY s.scan_id) END AS failed_share,
           coalesce(n, 0)::BIGINT AS issue_occurrences
    FROM stats s LEFT JOIN (SELECT scan_id, category, sum(count) AS n FROM issues GROUP BY 1, 2) i ON i.scan_id = s.scan_id AND i.category = s.category"""
fixtures.SQL["overall"] = """
    SELECT scan_id, sum(checked)::BIGINT AS checked, sum(passed)::BIGINT AS passed, sum(failed)::BIGINT AS failed, avg(score) AS overall, count(score) AS category_count,
           100.0::DOUBLE * sum(passed) / sum(checked) AS passed_pct, 100.0::DOUBLE * sum(failed) / sum(checked) AS failed_pct FROM entries GROUP BY scan_id"""


def view_stats(t):
    return S.category_stats(t.observations)


def view_issues(t):
    return I.collect_issues(t.findings)


def view_entries(t):
    return S.category_entries(t.stats, t.issues)


def view_overall(t):
    return S.overall_score(t.entries)


def view_scoring(t):
    return S.build_scoring(t.stats, t.issues)


for _f in (view_stats, view_issues, view_entries, view_overall, view_scoring):
    setattr(fixtures, _f.__name__, _f)

_r = lambda *cols: [F.round(c, 6).alias(c) for c in cols]


@query("category_stats", "SELECT * FROM stats")
def category_stats(t):
    return t.stats


@query(
    "collect_issues",
    "SELECT scan_id, issue_type, category, severity, count, (SELECT min(page) FROM once o WHERE o.scan_id = i.scan_id AND o.issue_type = i.issue_type) AS first_page FROM issues i",
)
def collect_issues(t):
    return t.issues.select("scan_id", "issue_type", "category", "severity", "count", F.array_min(F.transform("locations", lambda x: x["page"])).alias("first_page"))


@query("order_issues", f"SELECT scan_id, issue_type, severity, row_number() OVER (PARTITION BY scan_id ORDER BY {_RANK}, issue_type) AS position FROM issues")
def order_issues(t):
    return I.order_issues(t.issues).select("scan_id", "issue_type", "severity", "position")


@query(
    "drop_unset_heading_issues",
    """SELECT scan_id, kind AS issue_type, count FROM (SELECT *, CASE WHEN issue_type LIKE 'pagination%' THEN 'font_size_heading' || (scan_id % 4 + 1)::VARCHAR ELSE issue_type END AS kind FROM issues)
       WHERE kind NOT LIKE 'font_size_heading%' OR scan_id % 4 + 1 IN (1, 3)""",
)
def drop_unset_heading_issues(t):
    level = (F.col("scan_id") % 4 + 1).cast("int")
    named = t.issues.withColumn("issue_type", F.when(F.col("issue_type").startswith("pagination"), F.concat(F.lit("font_size_heading"), level.cast("string"))).otherwise(F.col("issue_type")))
    rules = t.lineitem.select(F.col("l_orderkey").alias("scan_id")).distinct().select("scan_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("level"))
    return I.drop_unset_heading_issues(named, rules).select("scan_id", "issue_type", "count")


@query("category_entries", "SELECT scan_id, category, status, checked, passed, failed, round(score, 6) AS score, round(failed_share, 6) AS failed_share, issue_occurrences FROM entries")
def category_entries(t):
    return t.entries.select("scan_id", "category", "status", "checked", "passed", "failed", *_r("score", "failed_share"), "issue_occurrences")


@query("overall_score", "SELECT scan_id, checked, passed, failed, round(overall, 6) AS overall, category_count, round(passed_pct, 6) AS passed_pct, round(failed_pct, 6) AS failed_pct FROM overall")
def overall_score(t):
    return t.overall.select("scan_id", "checked", "passed", "failed", *_r("overall"), "category_count", *_r("passed_pct", "failed_pct"))


@query(
    "occurrences_by_category",
    """SELECT scan_id, category, sum(count)::BIGINT AS occurrences, true AS has_units, round(100.0::DOUBLE * sum(count) / sum(sum(count)) OVER (PARTITION BY scan_id), 6) AS share
       FROM issues GROUP BY scan_id, category""",
)
def occurrences_by_category(t):
    return S.occurrences_by_category(t.issues).select("scan_id", "category", "occurrences", "has_units", *_r("share"))


@query(
    "occurrences_by_severity",
    """SELECT scan_id, severity, sum(count)::BIGINT AS occurrences, count(*) AS issue_types, round(100.0::DOUBLE * sum(count) / sum(sum(count)) OVER (PARTITION BY scan_id), 6) AS share
       FROM issues GROUP BY scan_id, severity""",
)
def occurrences_by_severity(t):
    return S.occurrences_by_severity(t.issues).select("scan_id", "severity", "occurrences", "issue_types", *_r("share"))


@query(
    "build_scoring",
    """SELECT o.scan_id, checked, passed, failed, round(overall, 6) AS overall, coalesce(n, 0)::BIGINT AS total_occurrences, coalesce(k, 0)::BIGINT AS issue_types, 8 AS n_categories, worst
       FROM overall o LEFT JOIN (SELECT scan_id, sum(count) AS n, count(*) AS k FROM issues GROUP BY 1) i USING (scan_id)
       LEFT JOIN (SELECT scan_id, min_by(category, (coalesce(score, 101), position)) AS worst FROM entries JOIN dims USING (category) GROUP BY 1) w USING (scan_id)""",
)
def build_scoring(t):
    ranked = F.array_sort(F.transform("categories", lambda c: F.struct(F.coalesce(c["score"]["value"], F.lit(101.0)).alias("s"), c["position"].alias("p"), c["category"].alias("c"))))
    return t.scoring.select(
        "scan_id", "checked", "passed", "failed", *_r("overall"), "total_occurrences", "issue_types", F.size("categories").alias("n_categories"), ranked[0]["c"].alias("worst")
    )


@query(
    "build_sections",
    """SELECT scan_id, category AS section, round(score, 6) AS formatting_score, status, checked AS units_checked, passed AS units_passed, failed AS units_failed,
       issue_occurrences AS issue_count FROM entries""",
)
def build_sections(t):
    return S.build_sections(t.scoring).withColumn("formatting_score", F.round("formatting_score", 6))


@query("validate_scoring", "SELECT DISTINCT scan_id, true AS ok, 0 AS n_errors FROM observations")
def validate_scoring(t):
    return S.validate_scoring(t.scoring).select("scan_id", "ok", "n_errors")


_SHARES = """
    WITH f AS (SELECT scan_id, category, failed, position, round(failed_share * 10, 9) AS scaled FROM entries JOIN dims USING (category) WHERE failed > 0),
    g AS (SELECT *, floor(scaled) AS low, round(scaled - floor(scaled), 9) AS rest FROM f),
    h AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY rest DESC, position) AS r, 1000 - sum(low) OVER (PARTITION BY scan_id) AS left_over FROM g)"""


@query("round_shares", f"{_SHARES} SELECT scan_id, category, (low + CASE WHEN r <= left_over THEN 1 ELSE 0 END) / 10 AS rounded FROM h")
def round_shares(t):
    failing = t.entries.where("failed > 0").withColumn("at", F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")))
    return S.round_shares(failing, "scan_id", "failed_share", "at").select("scan_id", "category", "rounded")


@query(
    "cluster_rows",
    f"""{_SHARES} SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY failed DESC, position) AS rank, category, failed,
        (low + CASE WHEN r <= left_over THEN 1 ELSE 0 END) / 10 AS rounded FROM h""",
)
def cluster_rows(t):
    return S.cluster_rows(t.entries)


fixtures.SQL["cards_in"] = """
    SELECT scan_id, category, CASE WHEN scan_id % 4 <> 0 THEN checked END AS units_checked, CASE WHEN scan_id % 3 <> 0 THEN passed END AS units_passed,
           CASE WHEN scan_id % 4 = 1 THEN failed END AS units_failed, coalesce(score, 75.0) AS score, issue_occurrences AS issue_count FROM entries"""
fixtures.SQL["cards_out"] = """
    SELECT *, CASE WHEN total > 0 THEN 100.0::DOUBLE * (total - non_compliant) / total ELSE score END AS display_score, total - non_compliant AS compliant FROM (
      SELECT *, least(total, greatest(non0, 0)) AS non_compliant FROM (
        SELECT *, CASE WHEN rec THEN least(found, issue_count) ELSE coalesce(CASE WHEN units_checked IS NOT NULL AND units_passed IS NOT NULL THEN units_checked - least(units_passed, units_checked)
                    WHEN units_checked IS NOT NULL AND units_failed IS NOT NULL THEN least(units_failed, units_checked) ELSE units_failed END,
                    CASE WHEN total > 0 THEN floor(total * (100 - score) / 100 + 0.5)::BIGINT END) END AS non0 FROM (
          SELECT *, CASE WHEN rec THEN found ELSE coalesce(units_checked, units_passed + units_failed) END AS total FROM (
            SELECT *, coalesce(units_checked, units_passed + units_failed) IS NULL AND issue_count > 0 AND score < 100 AS rec,
                   greatest(issue_count, CASE WHEN score < 100 THEN floor(issue_count / ((100 - score) / 100) + 0.5)::BIGINT ELSE 0 END) AS found FROM cards_in))))"""


def view_cards(t):
    cards = t.entries.select(
        "scan_id", "category", F.when(F.col("scan_id") % 4 != 0, F.col("checked")).alias("units_checked"), F.when(F.col("scan_id") % 3 != 0, F.col("passed")).alias("units_passed"),
        F.when(F.col("scan_id") % 4 == 1, F.col("failed")).alias("units_failed"), F.coalesce("score", F.lit(75.0)).alias("score"), F.col("issue_occurrences").alias("issue_count"),
    )
    return S.resolve_unit_counts(cards)


fixtures.view_cards = view_cards


@query("resolve_unit_counts", "SELECT scan_id, category, total, compliant, non_compliant, round(display_score, 6) AS display_score FROM cards_out")
def resolve_unit_counts(t):
    return t.cards.select("scan_id", "category", "total", "compliant", "non_compliant", *_r("display_score"))


@query(
    "reconcile_header",
    """SELECT scan_id, coalesce(t, checked)::BIGINT AS total, CASE WHEN t IS NOT NULL THEN least(t, greatest(n, 0)) ELSE failed END::BIGINT AS non_compliant,
       (coalesce(t, checked) - CASE WHEN t IS NOT NULL THEN least(t, greatest(n, 0)) ELSE failed END)::BIGINT AS compliant
       FROM overall LEFT JOIN (SELECT scan_id, sum(total) AS t, sum(non_compliant) AS n FROM cards_out GROUP BY 1) USING (scan_id)""",
)
def reconcile_header(t):
    return S.reconcile_header(t.cards, t.overall)


@query(
    "active_categories",
    """SELECT scan_id, category, failed FROM entries WHERE (scan_id % 3 = 0 AND category IN ('Fonts', 'Spacing', 'Margins')) OR (scan_id % 3 = 1 AND category = 'Citations')""",
)
def active_categories(t):
    """Rules by scan modulo three: some set, some blank or ignored."""
    rows = t.entries.select("scan_id", "category", "failed")
    given = F.when(F.col("scan_id") % 3 == 0, F.array(*[F.struct(F.lit(c).alias("category"), F.lit(v).alias("value")) for c, v in (("Fonts", "Arial"), ("Line Spacing", "2"), ("Margins", "0"), ("Captions", "N/A"))]))
    given = given.when(F.col("scan_id") % 3 == 1, F.array(*[F.struct(F.lit(c).alias("category"), F.lit(v).alias("value")) for c, v in (("Citations", "APA"), ("Fonts", " Ignore "))]))
    rules = t.entries.select("scan_id").distinct().select("scan_id", F.inline(given))
    return S.active_categories(rules, rows, "scan_id")


@query(
    "dedupe_locations",
    """SELECT scan_id, issue_type, count(DISTINCT (page, line, excerpt)) AS shown, count(*) - count(DISTINCT (page, line, excerpt)) AS hidden, min(page) AS first_page FROM once GROUP BY 1, 2""",
)
def dedupe_locations(t):
    return I.dedupe_locations(t.issues)


fixtures.SQL["issue_cards_sql"] = f"""
    SELECT scan_id, issue_type, category, severity, page, line, excerpt, row_number() OVER (PARTITION BY scan_id ORDER BY page, line, {_RANK}, issue_type, excerpt) AS card
    FROM (SELECT DISTINCT i.scan_id, i.issue_type, i.category, i.severity, o.page, o.line, o.excerpt FROM issues i JOIN once o ON o.scan_id = i.scan_id AND o.issue_type = i.issue_type)"""


@query("issue_cards", "SELECT * FROM issue_cards_sql")
def issue_cards(t):
    return I.issue_cards(t.issues)


@query(
    "issue_page_blocks",
    f"""SELECT scan_id, page, count(*) AS cards, ['critical', 'moderate', 'minor'][min({_RANK}) + 1] AS worst, count(*) FILTER (WHERE severity = 'critical') AS critical,
        count(*) FILTER (WHERE severity = 'moderate') AS moderate, count(*) FILTER (WHERE severity = 'minor') AS minor
        FROM issue_cards_sql GROUP BY GROUPING SETS ((scan_id, page), (scan_id))""",
)
def issue_page_blocks(t):
    return I.issue_page_blocks(I.issue_cards(t.issues))


@query(
    "merge_severity_review",
    f"""SELECT scan_id, issue_type, severity AS rule_severity, CASE WHEN new IN ('critical', 'moderate', 'minor')
          AND abs({_RANK} - CASE new WHEN 'critical' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END) <= 1 THEN new ELSE severity END AS severity,
        CASE WHEN new IS NOT NULL THEN 'Check heading ' || (scan_id % 3)::VARCHAR END AS wording
        FROM (SELECT *, CASE scan_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'minor' WHEN 2 THEN 'moderate' WHEN 3 THEN 'severe' END AS new FROM issues)""",
)
def merge_severity_review(t):
    k = F.col("scan_id") % 5
    new = F.when(k == 0, "critical").when(k == 1, "minor").when(k == 2, "moderate").when(k == 3, "severe")
    reviews = t.issues.where(k < 4).select("scan_id", "issue_type", new.alias("severity"), F.concat(F.lit("Check heading "), (F.col("scan_id") % 3).cast("string")).alias("wording"))
    return I.merge_severity_review(t.issues, reviews).select("scan_id", "issue_type", "rule_severity", "severity", "wording")


@query(
    "scan_result_view",
    f"""SELECT scan_id, round(overall, 6) AS overall, CASE WHEN overall >= 80 THEN 'compliant' WHEN overall >= 50 THEN 'needs_revision' ELSE 'critical' END AS band,
        coalesce(k, 0) AS issue_types, coalesce(n, 0)::BIGINT AS occurrences, max_page, worst FROM overall
        LEFT JOIN (SELECT scan_id, count(*) AS k, sum(count) AS n, ['critical', 'moderate', 'minor'][min({_RANK}) + 1] AS worst FROM issues GROUP BY 1) USING (scan_id)
        LEFT JOIN (SELECT scan_id, max(page) AS max_page FROM once GROUP BY 1) USING (scan_id)""",
)
def scan_result_view(t):
    return I.scan_result_view(t.overall, t.issues).withColumn("overall", F.round("overall", 6))


@query(
    "pagination_section_fix",
    """SELECT scan_id, category AS section, status, issue_occurrences AS issue_count,
       round(CASE WHEN category = 'Pagination' AND issue_occurrences = 0 AND status = 'pass' THEN 100.0 ELSE score END, 6) AS formatting_score FROM entries""",
)
def pagination_section_fix(t):
    return I.pagination_section_fix(S.build_sections(t.scoring).withColumn("issue_count", F.col("issue_count") + 0), t.issues).withColumn("formatting_score", F.round("formatting_score", 6))


@query("score_band", "SELECT scan_id, CASE WHEN overall >= 80 THEN 'compliant' WHEN overall >= 50 THEN 'needs_revision' WHEN overall IS NULL THEN 'not_evaluated' ELSE 'critical' END AS band FROM overall")
def score_band(t):
    return t.overall.select("scan_id", S.score_band(F.col("overall")).alias("band"))


@query(
    "normalize_bbox",
    """SELECT doc_id, n, round(greatest(0, least(1, x0 / 612.0::DOUBLE)), 6) AS x, round(greatest(0, least(1, y0 / 792.0::DOUBLE)), 6) AS y,
       round(greatest(0, least(1, (x1 - x0) / 612.0::DOUBLE)), 6) AS w, round(greatest(0, least(1, (y1 - y0) / 792.0::DOUBLE)), 6) AS h FROM unit_boxes""",
)
def normalize_bbox(t):
    box = I.normalize_bbox(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.lit(0.0), F.lit(792.0))
    return t.unit_boxes.select("doc_id", "n", box.alias("b")).select("doc_id", "n", *[F.round(f"b.{c}", 6).alias(c) for c in "xywh"])


@query(
    "normalize_location",
    """SELECT scan_id, page + 1 AS page_no, CASE WHEN category <> 'Pagination' THEN line + 1 END AS line_no, CASE WHEN category <> 'Pagination' THEN excerpt END AS shown, issue_type FROM findings""",
)
def normalize_location(t):
    f = t.findings.withColumnRenamed("page", "page_index").withColumnRenamed("line", "line_index").withColumnRenamed("excerpt", "text")
    return I.normalize_location(f).select("scan_id", "page_no", "line_no", "shown", "issue_type")


_KINDS = ("font_family", "wrong_heading", "paper_size", "indent_first", "line_spacing", "text_align", "page_number_gap", "figure_missing", "citation_style", "misc")
_OF = ("Fonts", "Fonts", "Margins", "Indentation", "Line Spacing", "Alignment", "Pagination", "Captions", "Citations", "Other")


@query(
    "issue_category",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN 'Line Spacing' WHEN l_linenumber = 2 THEN 'Fonts' ELSE [{", ".join(f"'{x}'" for x in _OF)}][l_partkey % 10 + 1] END AS category
        FROM lineitem""",
)
def issue_category(t):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("l_partkey") % 10 + 1).cast("int"))
    section = F.when(F.col("l_linenumber") == 1, " spacing ").when(F.col("l_linenumber") == 2, "fonts").when(F.col("l_linenumber") == 3, "")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", I.issue_category(section, kind).alias("category"))
