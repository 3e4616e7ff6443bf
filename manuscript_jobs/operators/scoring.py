"""Unit counters, category entries, scores and their checks.

Percentages are plain doubles at full precision; a share of nothing is null, never 0 or 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CATEGORIES, SEVERITIES


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, 100.0 * part / whole)


def severity_rank(severity: Column) -> Column:
    """0 for the worst; unknown severities count as the least."""
    out = F.lit(len(SEVERITIES) - 1)
    for i, name in enumerate(SEVERITIES):
        out = F.when(F.lower(severity) == name, i).otherwise(out)
    return out


def category_stats(observations: DataFrame) -> DataFrame:
    """(scan_id, category, checked, failed, applicable), with a row for each of the eight categories.

    The counters of a scan are summed before the one shuffle; absent categories come from the
    dimension, so no scan is joined with it.
    """
    sums = []
    for c in CATEGORIES:
        own = F.col("category") == c
        sums += [F.count(F.when(own, 1)).alias(f"_c_{c}"), F.count(F.when(own & ~F.col("ok"), 1)).alias(f"_f_{c}")]
    row = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"_c_{c}").alias("checked"), F.col(f"_f_{c}").alias("failed")) for c in CATEGORIES])
    wide = observations.groupBy("scan_id").agg(*sums)
    return wide.select("scan_id", F.inline(row)).withColumn("applicable", F.col("checked") > 0)


def category_entries(stats: DataFrame, issues: DataFrame) -> DataFrame:
    """Status, score, failed share and occurrences of each category of a scan."""
    counts = issues.groupBy("scan_id", "category").agg(F.sum("count").alias("issue_occurrences"))
    total = F.sum("failed").over(Window.partitionBy("scan_id"))
    status = F.when(F.col("checked") == 0, F.when(F.col("applicable"), "not_evaluated").otherwise("not_applicable")).otherwise(
        F.when(F.col("failed") > 0, "fail").otherwise("pass")
    )
    return stats.withColumn("total_failed", total).join(counts, ["scan_id", "category"], "left").select(
        "scan_id", "category", status.alias("status"), "checked", (F.col("checked") - F.col("failed")).alias("passed"), "failed",
        percent(F.col("checked") - F.col("failed"), F.col("checked")).alias("score"),
        percent(F.col("failed"), F.col("total_failed")).alias("failed_share"),
        F.coalesce("issue_occurrences", F.lit(0)).alias("issue_occurrences"),
    )


def overall_score(entries: DataFrame) -> DataFrame:
    """Unit totals and the unweighted mean score over categories with checked units."""
    return entries.groupBy("scan_id").agg(
        F.sum("checked").alias("checked"),
        F.sum("passed").alias("passed"),
        F.sum("failed").alias("failed"),
        F.avg(F.when(F.col("checked") > 0, F.col("score"))).alias("overall"),
        F.count(F.when(F.col("checked") > 0, 1)).alias("category_count"),
    ).select("*", percent(F.col("passed"), F.col("checked")).alias("passed_pct"), percent(F.col("failed"), F.col("checked")).alias("failed_pct"))


def occurrences_by_category(issues: DataFrame) -> DataFrame:
    """Occurrences and share per (scan, category), extra categories included."""
    own = issues.groupBy("scan_id", "category").agg(F.sum("count").alias("occurrences"))
    total = F.sum("occurrences").over(Window.partitionBy("scan_id"))
    return own.select(
        "scan_id", "category", "occurrences", F.col("category").isin(*CATEGORIES).alias("has_units"), percent(F.col("occurrences"), total).alias("share")
    )


def occurrences_by_severity(issues: DataFrame) -> DataFrame:
    """Occurrences, issue types and share per (scan, severity); unknown severities are minor."""
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    known = issues.withColumn("severity", F.element_at(names, severity_rank(F.col("severity")) + 1))
    own = known.groupBy("scan_id", "severity").agg(F.sum("count").alias("occurrences"), F.count("*").alias("issue_types"))
    total = F.sum("occurrences").over(Window.partitionBy("scan_id"))
    return own.select("scan_id", "severity", "occurrences", "issue_types", percent(F.col("occurrences"), total).alias("share"))


def build_scoring(stats: DataFrame, issues: DataFrame) -> DataFrame:
    """The whole payload of a scan: unit totals, overall, category and severity structs."""
    entries = category_entries(stats, issues)
    metric = lambda v, n, d: F.struct(v.alias("value"), n.alias("numerator"), d.alias("denominator"))
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    cats = entries.groupBy("scan_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    order.alias("position"), "category", "status", "checked", "passed", "failed", "issue_occurrences",
                    metric(F.col("score"), F.col("passed"), F.col("checked")).alias("score"), F.col("failed_share"),
                )
            )
        ).alias("categories")
    )
    sev = occurrences_by_severity(issues)
    sev = sev.groupBy("scan_id").agg(
        F.sum("occurrences").alias("total_occurrences"),
        F.sum("issue_types").alias("issue_types"),
        F.sort_array(F.collect_list(F.struct("severity", "occurrences", "issue_types", "share"))).alias("by_severity"),
    )
    return overall_score(entries).join(cats, "scan_id").join(sev, "scan_id", "left").withColumns(
        {"total_occurrences": F.coalesce("total_occurrences", F.lit(0)), "issue_types": F.coalesce("issue_types", F.lit(0))}
    )


def build_sections(scoring: DataFrame) -> DataFrame:
    """One breakdown row per category, from the payload alone."""
    c = "c"
    return scoring.select("scan_id", F.explode("categories").alias(c)).select(
        "scan_id", F.col("c.category").alias("section"), F.col("c.score.value").alias("formatting_score"), "c.status",
        F.col("c.checked").alias("units_checked"), F.col("c.passed").alias("units_passed"), F.col("c.failed").alias("units_failed"),
        F.col("c.issue_occurrences").alias("issue_count"),
    )


def validate_scoring(scoring: DataFrame) -> DataFrame:
    """(scan_id, ok, errors): the sums, fractions and null rules every payload must hold."""
    cats = F.col("categories")
    total = lambda f: F.aggregate(cats, F.lit(0).cast("long"), lambda a, c: a + c[f])
    shares = F.aggregate(cats, F.lit(0.0), lambda a, c: a + F.coalesce(c["failed_share"], F.lit(0.0)))
    measured = F.filter(cats, lambda c: c["checked"] > 0)
    mean = F.aggregate(measured, F.lit(0.0), lambda a, c: a + c["score"]["value"]) / F.size(measured)
    near = lambda a, b, eps: F.abs(a - b) <= eps
    tests = [
        (F.col("checked") != F.col("passed") + F.col("failed"), "units do not add up"),
        *[(total(k) != F.col(k), f"category {k} do not add up") for k in ("checked", "passed", "failed")],
        (F.exists(cats, lambda c: c["checked"] != c["passed"] + c["failed"]), "a category does not add up"),
        (F.exists(cats, lambda c: (c["checked"] == 0) & c["score"]["value"].isNotNull()), "a score of nothing"),
        (F.exists(cats, lambda c: (c["checked"] > 0) & ~near(c["score"]["value"], 100.0 * c["passed"] / c["checked"], 1e-9)), "a score is not its fraction"),
        (F.exists(cats, lambda c: (c["checked"] == 0) & c["status"].isin("pass", "fail")), "a status without units"),
        ((F.col("checked") > 0) & ~near(F.col("passed_pct") + F.col("failed_pct"), F.lit(100.0), 1e-6), "percentages do not add to 100"),
        ((F.col("failed") > 0) & ~near(shares, F.lit(100.0), 1e-6), "failed shares do not add to 100"),
        (F.col("overall").isNull() != (F.size(measured) == 0), "overall must be null exactly without categories"),
        (~F.coalesce(F.col("overall").between(0.0, 100.0), F.lit(True)), "overall is outside 0..100"),
        (F.coalesce(~near(F.col("overall"), mean, 1e-9), F.lit(False)), "overall is not the mean"),
        (
            F.coalesce(F.aggregate("by_severity", F.lit(0).cast("long"), lambda a, s: a + s["occurrences"]), F.lit(0)) != F.col("total_occurrences"),
            "occurrences by severity do not add up",
        ),
    ]
    errors = F.filter(F.array(*[F.when(bad, text) for bad, text in tests]), lambda e: e.isNotNull())
    return scoring.select("scan_id", (F.size(errors) == 0).alias("ok"), F.size(errors).alias("n_errors"), errors.alias("errors"))


def round_shares(df: DataFrame, group: str, value: str, position: str, digits: int = 1) -> DataFrame:
    """Adds ``rounded``: shares of one whole rounded by largest remainder so that they show exactly 100.

    Values that sum to more than half a point from 100 are rounded each for itself. Ties go to the first
    position. Arithmetic is on whole units of the last digit.
    """
    factor = 10**digits
    w = Window.partitionBy(group)
    scaled = F.round(F.col(value) * factor, 9)
    low = F.floor(scaled)
    rest = F.when(F.col(value).isNull(), -1.0).otherwise(F.round(scaled - low, 9))
    rank = F.row_number().over(w.orderBy(F.desc("_rest"), position))
    left = F.lit(100 * factor) - F.sum("_low").over(w)
    whole = F.abs(F.sum(value).over(w) - 100) <= 0.5
    step = df.withColumn("_low", low).withColumn("_rest", rest).withColumn("_rank", rank)
    fit = F.col("_low") + F.when((F.col("_rank") <= left) & (F.col("_rest") >= 0), 1).otherwise(0)
    return step.withColumn("rounded", F.when(whole, fit).otherwise(F.floor(scaled + 0.5)) / factor).drop("_low", "_rest", "_rank")


def resolve_unit_counts(df: DataFrame) -> DataFrame:
    """Adds total, compliant and non_compliant from any two of units_checked, units_passed, units_failed;
    rows without counts recover a total from score and issue_count; display_score is compliant / total."""
    t, p, f = (F.greatest(F.col(c), F.lit(0)) for c in ("units_checked", "units_passed", "units_failed"))
    t, p, f = (F.when(F.col(c).isNotNull(), x) for c, x in zip(("units_checked", "units_passed", "units_failed"), (t, p, f)))
    base_total = F.coalesce(t, p + f)
    bad = F.when(t.isNotNull() & p.isNotNull(), t - F.least(p, t)).when(t.isNotNull() & f.isNotNull(), F.least(f, t)).otherwise(f)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score")))
    issues = F.greatest(F.coalesce("issue_count", F.lit(0)), F.lit(0))
    recover = base_total.isNull() & (issues > 0) & (score < 100)
    found = F.greatest(issues, F.floor(issues / ((100 - score) / 100) + 0.5))
    total = F.when(recover, found).otherwise(base_total)
    non = F.when(recover, F.least(found, issues)).otherwise(F.coalesce(bad, F.when(total > 0, F.floor(total * (100 - score) / 100 + 0.5))))
    return df.withColumn("total", total).withColumn("non_compliant", F.least(total, F.greatest(non, F.lit(0)))).select(
        "*", (F.col("total") - F.col("non_compliant")).alias("compliant"),
        F.coalesce(percent(F.col("total") - F.col("non_compliant"), F.col("total")), F.col("score")).alias("display_score"),
    )


def reconcile_header(sections: DataFrame, scans: DataFrame) -> DataFrame:
    """Header totals: the sum of the category cards where any has units, else the scan's own."""
    cards = sections.groupBy("scan_id").agg(F.sum("total").alias("_t"), F.sum("non_compliant").alias("_n"))
    joined = scans.join(cards, "scan_id", "left")
    use = F.col("_t").isNotNull()
    total = F.when(use, F.col("_t")).otherwise(F.col("checked"))
    non = F.when(use, F.least(F.col("_t"), F.greatest(F.col("_n"), F.lit(0)))).otherwise(F.col("failed"))
    return joined.select("scan_id", total.alias("total"), non.alias("non_compliant"), (total - non).alias("compliant"))


def active_categories(rules: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of categories for which the rules row has a set rule. ``rules``: (key, category, value)."""
    from ..functions.text import rule_unset

    active = rules.where(~rule_unset(F.col("value"))).select(key, F.when(F.col("category") == "Line Spacing", "Spacing").otherwise(F.col("category")).alias("category"))
    return rows.join(active.distinct(), [key, "category"], "left_semi")


def score_band(score: Column) -> Column:
    return F.when(score.isNull() | F.isnan(score), "not_evaluated").when(score >= 80, "compliant").when(score >= 50, "needs_revision").otherwise("critical")


def cluster_rows(entries: DataFrame) -> DataFrame:
    """Failing categories of a scan by failed share, largest first, with shares that show 100."""
    failing = entries.where("failed > 0").withColumn("_at", F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")))
    rounded = round_shares(failing, "scan_id", "failed_share", "_at")
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("failed"), "_at"))
    return rounded.withColumn("rank", rank).select("scan_id", "rank", "category", "failed", "rounded")
