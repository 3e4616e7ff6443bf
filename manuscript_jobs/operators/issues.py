"""Findings grouped into issues, and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SEVERITIES
from .scoring import severity_rank

MAX_LOCATIONS = 20_000


def _severity(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def collect_issues(findings: DataFrame, most: int = MAX_LOCATIONS) -> DataFrame:
    """(scan_id, issue_type, category, severity, count, locations).

    An occurrence is one (page, line, category, first 80 characters of the excerpt) of an issue type; the
    severity is the worst of all. Occurrences past ``most`` are counted but not kept: they are cut off
    before anything is collected.
    """
    key = F.lower(F.substring(F.trim(F.regexp_replace("excerpt", r"\s+", " ")), 1, 80))
    once = findings.withColumn("_key", key).groupBy("scan_id", "issue_type", "category", "page", "line", "_key").agg(
        F.min(severity_rank(F.col("severity"))).alias("_rank"), F.min("excerpt").alias("excerpt")
    )
    order = Window.partitionBy("scan_id", "issue_type").orderBy("page", "line", "category", "_key")
    ranked = once.withColumn("_nth", F.row_number().over(order))
    kept = F.when(F.col("_nth") <= most, F.struct("page", "line", "excerpt"))
    return ranked.groupBy("scan_id", "issue_type").agg(
        F.min_by("category", "_nth").alias("category"),
        _severity(F.min("_rank")).alias("severity"),
        F.count("*").alias("count"),
        F.sort_array(F.collect_list(kept)).alias("locations"),
    )


def order_issues(issues: DataFrame) -> DataFrame:
    """Adds ``position``: within a scan by severity, then type."""
    order = Window.partitionBy("scan_id").orderBy(severity_rank(F.col("severity")), "issue_type")
    return issues.withColumn("position", F.row_number().over(order))


def drop_unset_heading_issues(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """Leaves out heading-size issues of levels without a size rule. ``rules``: (scan_id, level)."""
    level = F.regexp_extract("issue_type", r"^font_size_heading(\d)$", 1)
    marked = issues.withColumn("level", F.when(level != "", level.cast("int")))
    plain = marked.where("level is null")
    return plain.unionByName(marked.where("level is not null").join(rules, ["scan_id", "level"], "left_semi")).drop("level")


def dedupe_locations(issues: DataFrame) -> DataFrame:
    """First location by (type, page, line, excerpt); ``hidden`` is what the count has beyond them."""
    loc = issues.select("scan_id", "issue_type", "severity", "count", F.posexplode_outer("locations").alias("at", "location"))
    first = Window.partitionBy("scan_id", "issue_type", "location.page", "location.line", "location.excerpt").orderBy("at")
    kept = loc.withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    return kept.groupBy("scan_id", "issue_type").agg(
        F.count("location").alias("shown"), (F.max("count") - F.count("location")).alias("hidden"), F.min("location.page").alias("first_page")
    )


def issue_cards(issues: DataFrame) -> DataFrame:
    """One card per location, numbered in a scan by page, line and severity; nulls last."""
    cards = issues.select("scan_id", "issue_type", "category", "severity", F.explode_outer("locations").alias("l")).select(
        "scan_id", "issue_type", "category", "severity", F.col("l.page").alias("page"), F.col("l.line").alias("line"), F.col("l.excerpt").alias("excerpt")
    ).distinct()
    order = Window.partitionBy("scan_id").orderBy(
        F.col("page").asc_nulls_last(), F.col("line").asc_nulls_last(), severity_rank(F.col("severity")), "issue_type", "excerpt"
    )
    return cards.withColumn("card", F.row_number().over(order))


def issue_page_blocks(cards: DataFrame) -> DataFrame:
    """Cards per page with the worst severity and counts by severity, and the scan's totals (page null)."""
    counts = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES]
    return cards.rollup("scan_id", "page").agg(F.count("*").alias("cards"), _severity(F.min(severity_rank(F.col("severity")))).alias("worst"), *counts).where("scan_id is not null")


def merge_severity_review(issues: DataFrame, reviews: DataFrame) -> DataFrame:
    """A review may move a severity by one step; wording that names another heading level is refused."""
    r = reviews.select("scan_id", "issue_type", F.col("severity").alias("_new"), F.col("wording").alias("_wording"))
    own, new = severity_rank(F.col("severity")), severity_rank(F.col("_new"))
    near = F.col("_new").isin(*SEVERITIES) & (F.abs(own - new) <= 1)
    level = F.regexp_extract("issue_type", r"heading(\d)", 1)
    named = F.regexp_extract_all(F.lower("_wording"), F.lit(r"heading ?(\d)"), F.lit(1))
    other = (level != "") & (F.size(F.array_except(named, F.array(level))) > 0)
    return issues.join(r, ["scan_id", "issue_type"], "left").select(
        *[c for c in issues.columns if c != "severity"],
        F.col("severity").alias("rule_severity"),
        F.when(near, F.col("_new")).otherwise(F.col("severity")).alias("severity"),
        F.when(F.col("_wording").isNotNull() & ~other, F.col("_wording")).alias("wording"),
    )


def scan_result_view(scans: DataFrame, issues: DataFrame) -> DataFrame:
    """Display row of a scan: score and band, issue and occurrence counts, last page with an issue."""
    from .scoring import score_band

    own = issues.groupBy("scan_id").agg(
        F.count("*").alias("issue_types"), F.sum("count").alias("occurrences"),
        F.max(F.array_max(F.transform("locations", lambda x: x["page"]))).alias("max_page"), _severity(F.min(severity_rank(F.col("severity")))).alias("worst"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return scans.join(own, "scan_id", "left").select(
        "scan_id", "overall", score_band(F.col("overall")).alias("band"), zero("issue_types"), zero("occurrences"), "max_page", "worst"
    )


def pagination_section_fix(sections: DataFrame, issues: DataFrame) -> DataFrame:
    """A stored Pagination section takes its count from the pagination issues; a clean pass scores 100."""
    own = issues.where("category = 'Pagination'").groupBy("scan_id").agg(F.sum("count").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    page = F.col("section") == "Pagination"
    return sections.join(own, "scan_id", "left").select(
        "scan_id", "section", "status", F.when(page, n).otherwise(F.col("issue_count")).alias("issue_count"),
        F.when(page & (n == 0) & (F.col("status") == "pass"), 100.0).otherwise(F.col("formatting_score")).alias("formatting_score"),
    )


def normalize_bbox(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> Column:
    """Points to page fractions within 0..1; what is no larger than 1.5 are fractions already."""
    w, h = F.when(w > 0, w).otherwise(612.0), F.when(h > 0, h).otherwise(792.0)
    points = F.greatest(*[F.abs(v) for v in (x0, y0, x1, y1)]) > 1.5
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    part = lambda v, whole, name: F.when(points, clamp(v / whole)).otherwise(v.cast("double")).alias(name)
    return F.struct(part(x0, w, "x"), part(y0, h, "y"), part(x1 - x0, w, "w"), part(y1 - y0, h, "h"))


def normalize_location(df: DataFrame) -> DataFrame:
    """0-based indices to 1-based page and line; pagination findings keep their page alone."""
    page_only = F.col("category") == "Pagination"
    return df.select(
        "*", (F.coalesce("page_index", F.lit(0)) + 1).alias("page_no"),
        F.when(~page_only, F.coalesce("line_index", F.lit(0)) + 1).alias("line_no"), F.when(~page_only, F.col("text")).alias("shown"),
    )


def issue_category(section: Column, issue_type: Column) -> Column:
    """Category of a finding: its section, else what its type names, else Other."""
    kind = F.lower(F.coalesce(issue_type, F.lit("")))
    has = lambda *names: F.reduce(F.array(*[kind.contains(n) for n in names]), F.lit(False), lambda a, b: a | b)
    guessed = (
        F.when(kind.startswith("font") | has("heading"), "Fonts").when(has("margin", "paper", "orientation"), "Margins").when(has("indent"), "Indentation")
        .when(has("spacing"), "Line Spacing").when(has("align"), "Alignment").when(has("pagination", "page_number", "page_token"), "Pagination")
        .when(has("caption") | kind.startswith("table_") | kind.startswith("figure_"), "Captions").when(has("citation"), "Citations").otherwise("Other")
    )
    given = F.trim(F.coalesce(section, F.lit("")))
    return F.when(F.lower(given) == "spacing", "Line Spacing").when(given != "", F.initcap(given)).otherwise(guessed)
