"""Plans: billing periods, usage windows, payments and who may scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_in_order

# Scans a plan allows, prices in pesos by plan and period, hours that billing days are ahead of UTC.
LIMITS = {"free": 3, "premium": 50, "pro": 75}
PRICES = {("premium", "monthly"): 949, ("premium", "annual"): 10439, ("pro", "monthly"): 1499, ("pro", "annual"): 16489}
ZONE = "+08:00"
DAY = 86_400


def add_months(at: Column, months: Column, zone: str = ZONE) -> Column:
    """The same local time so many months later; days past the month's end fall on its last."""
    local = F.from_utc_timestamp(at, zone)
    day = F.add_months(F.to_date(local), months)
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + F.unix_seconds(local) - F.unix_seconds(F.to_date(local).cast("timestamp"))), zone)


def billing_period_end(at: Column, period: Column) -> Column:
    return add_months(at, F.when(period == "annual", 12).otherwise(1))


def usage_window(tier: Column, now: Column, anchor: Column, coverage: Column) -> Column:
    """struct(begin, end): free plans by calendar month, premium by months from the anchor, pro by weeks
    from the anchor, cut where the paid time ends."""
    month = F.date_trunc("month", now)
    n = F.floor(F.months_between(now, anchor, False)).cast("int")
    n = n + F.when(add_months(anchor, n + 1) <= now, 1).when(add_months(anchor, n) > now, -1).otherwise(0)
    weeks = F.greatest(F.lit(0), F.floor((F.unix_seconds(now) - F.unix_seconds(anchor)) / (7 * DAY)))
    week = F.timestamp_seconds(F.unix_seconds(anchor) + weeks * 7 * DAY)
    week_end = F.timestamp_seconds(F.unix_seconds(week) + 7 * DAY)
    begin = F.when(tier == "pro", week).when(tier == "premium", add_months(anchor, n)).otherwise(month)
    end = F.when(tier == "pro", F.when(coverage <= week, week).otherwise(F.least(week_end, coverage))).when(tier == "premium", add_months(anchor, n + 1))
    return F.struct(begin.alias("begin"), end.otherwise(F.add_months(month, 1).cast("timestamp")).alias("end"))


def reset_usage(subs: DataFrame) -> DataFrame:
    """Counters start anew where the window has passed or begins elsewhere than stored.
    (owner, tier, now, anchor, coverage, period_start, period_end, used)."""
    w = usage_window(F.col("tier"), F.col("now"), F.col("anchor"), F.col("coverage"))
    fresh = (F.col("period_end") <= F.col("now")) | (F.col("w.begin") != F.col("period_start"))
    return subs.withColumn("w", w).select(
        "owner", "tier", F.col("w.begin").alias("period_start"), F.col("w.end").alias("period_end"), F.when(F.coalesce(fresh, F.lit(True)), 0).otherwise(F.col("used")).alias("used")
    )


def payment_dedupe(payments: DataFrame) -> DataFrame:
    """Payments in time order, without those that share a payment or checkout id with a counted one.

    A skipped payment does not add its ids, so this is a fold over an owner's payments, whose state is the ids
    counted so far, not a matter of components. (owner, at, seq, payment_id, checkout_id)."""

    def step(seen, row):
        keys = {(c, row[c]) for c in ("payment_id", "checkout_id") if row[c] is not None}
        if keys & seen:
            return seen, []
        return seen | keys, [(row["owner"], row["seq"])]

    rows = payments.select("owner", "at", "seq", "payment_id", "checkout_id")
    return fold_in_order(rows, ["owner"], ["at", "seq"], "owner long, seq long", set, step)


def coverage_end(subs: DataFrame, payments: DataFrame) -> DataFrame:
    """Paid-through time: as stored, but flat 30- or 365-day ends become calendar ones; where none is stored,
    the latest end of any payment. (owner, renews_at) and (owner, at, billing_period)."""
    paid = payments.groupBy("owner").agg(F.max(billing_period_end(F.col("at"), F.col("billing_period"))).alias("best"), F.max_by("billing_period", "at").alias("period"), F.max("at").alias("last"))
    flat = F.unix_seconds("last") + F.when(F.col("period") == "annual", 365 * DAY).otherwise(30 * DAY)
    end = F.when(F.abs(F.unix_seconds("renews_at") - flat) <= 1, billing_period_end(F.col("last"), F.col("period"))).otherwise(F.coalesce("renews_at", "best"))
    return subs.join(paid, "owner", "left").select("owner", end.alias("coverage_end"))


def plan_limit(tier: Column) -> Column:
    return F.when(tier == "pro", LIMITS["pro"]).when(tier == "premium", LIMITS["premium"]).otherwise(LIMITS["free"])


def subscription_snapshot(subs: DataFrame, coverage: DataFrame) -> DataFrame:
    """The tier in force (paid tiers end with their paid time and start afresh), limit, used and remaining."""
    joined = subs.join(coverage, "owner", "left")
    open_ = F.coalesce(F.col("coverage_end") >= F.col("now"), F.lit(False))
    paid = F.col("tier").isin("premium", "pro")
    tier = F.when(paid & open_, F.col("tier")).otherwise("free")
    used = F.when(paid & ~open_, 0).when(tier == "free", F.least(F.col("used"), F.lit(LIMITS["free"]))).otherwise(F.col("used"))
    return joined.select("owner", tier.alias("tier"), plan_limit(tier).alias("limit"), used.alias("used"), F.greatest(plan_limit(tier) - used, F.lit(0)).alias("remaining"))


def scan_eligibility(requests: DataFrame, snapshot: DataFrame, scans: DataFrame, now: Column, stale_s: int = 1800) -> DataFrame:
    """ok or a typed refusal per request (owner, request_id, is_current, citation_style). Running scans of the last
    half hour count as used."""
    live = scans.where((F.col("status") == "running") & (F.unix_seconds(now) - F.unix_seconds("started_at") < stale_s) & (F.unix_seconds(now) >= F.unix_seconds("started_at")))
    in_flight = live.groupBy("owner").agg(F.count("*").alias("n"))
    free = F.col("tier") == "free"
    verdict = (
        F.when(free & ~F.col("is_current"), "old version").when(free & (F.upper("citation_style") != "APA"), "citation style")
        .when(F.col("used") + F.coalesce("n", F.lit(0)) >= F.col("limit"), "limit").otherwise("ok")
    )
    return requests.join(snapshot, "owner").join(in_flight, "owner", "left").select("owner", "request_id", "tier", verdict.alias("verdict"))


def plan_price(tier: Column, period: Column) -> Column:
    out = F.lit(0)
    for (t, p), price in PRICES.items():
        out = F.when((tier == t) & (period == p), price).otherwise(out)
    return out
