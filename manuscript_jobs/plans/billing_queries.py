"""Queries on plans and payments, from customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import billing as B
from . import fixtures
from .registry import query

_NOW = "1999-03-31 20:30:00"
_at = lambda: F.lit(_NOW).cast("timestamp")
_LOCAL = "INTERVAL 8 HOUR"
fixtures.SQL["pay"] = """
    SELECT o_custkey AS owner, o_orderkey AS seq, o_orderdate + to_seconds(o_orderkey % 86400) AS at, CASE WHEN o_orderkey % 2 = 0 THEN 'annual' ELSE 'monthly' END AS billing_period,
           CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey // 4 % 5 END AS payment_id, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey // 7 % 5 END AS checkout_id, floor(o_totalprice * 100)::BIGINT AS amount FROM orders"""


def view_payments(t):
    at = F.timestamp_seconds(F.unix_seconds("o_orderdate") + F.col("o_orderkey") % 86400)
    return t.orders.select(
        F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("seq"), at.alias("at"), F.when(F.col("o_orderkey") % 2 == 0, "annual").otherwise("monthly").alias("billing_period"),
        F.when(F.col("o_orderkey") % 3 > 0, F.expr("o_orderkey div 4 % 5")).alias("payment_id"), F.when(F.col("o_orderkey") % 3 < 2, F.expr("o_orderkey div 7 % 5")).alias("checkout_id"),
        F.floor(F.col("o_totalprice") * 100).alias("amount"),
    )


fixtures.view_payments = view_payments


@query("billing_period_end", f"SELECT seq, at, at + {_LOCAL} + CASE WHEN billing_period = 'annual' THEN INTERVAL 12 MONTH ELSE INTERVAL 1 MONTH END - {_LOCAL} AS ends FROM pay")
def billing_period_end(t):
    return t.payments.select("seq", "at", B.billing_period_end(F.col("at"), F.col("billing_period")).alias("ends"))


fixtures.SQL["win"] = f"""
    SELECT owner, tier, CASE tier WHEN 'free' THEN TIMESTAMP '1999-03-01' WHEN 'premium' THEN anchor + {_LOCAL} + to_months(m::INT) - {_LOCAL} ELSE anchor + to_days((7 * (date_diff('second', anchor, TIMESTAMP '{_NOW}') // 604800))::INT) END AS begin,
           CASE tier WHEN 'free' THEN TIMESTAMP '1999-04-01' WHEN 'premium' THEN anchor + {_LOCAL} + to_months(m::INT + 1) - {_LOCAL}
                ELSE greatest(anchor + to_days((7 * (date_diff('second', anchor, TIMESTAMP '{_NOW}') // 604800))::INT), least(anchor + to_days((7 * (date_diff('second', anchor, TIMESTAMP '{_NOW}') // 604800) + 7)::INT), cover)) END AS "end", used
    FROM (SELECT *, list_max(list_filter(range(0, 400), lambda i: anchor + {_LOCAL} + to_months(i::INT) - {_LOCAL} <= TIMESTAMP '{_NOW}')) AS m, TIMESTAMP '1999-04-02' + to_days((owner % 9)::INT - 4) AS cover
          FROM subscriptions WHERE anchor <= TIMESTAMP '{_NOW}')"""


def _subs(t):
    cover = F.timestamp_seconds(F.unix_seconds(F.lit("1999-04-02").cast("timestamp")) + (F.col("owner") % 9 - 4) * B.DAY)
    return t.subscriptions.where(F.col("anchor") <= _at()).select("owner", "tier", "used", "anchor", _at().alias("now"), cover.alias("coverage"))


@query("usage_window", 'SELECT owner, tier, begin, "end" FROM win')
def usage_window(t):
    w = B.usage_window(F.col("tier"), F.col("now"), F.col("anchor"), F.col("coverage"))
    return _subs(t).select("owner", "tier", w.alias("w")).select("owner", "tier", "w.begin", "w.end")


@query("reset_usage", 'SELECT owner, tier, begin AS period_start, "end" AS period_end, CASE WHEN owner % 2 = 0 AND owner % 3 <> 0 THEN used ELSE 0 END AS used FROM win')
def reset_usage(t):
    """Stored windows: the present one for even owners unless divisible by three, else a past one."""
    w = B.usage_window(F.col("tier"), F.col("now"), F.col("anchor"), F.col("coverage"))
    held = (F.col("owner") % 2 == 0) & (F.col("owner") % 3 != 0)
    past = F.lit("1990-01-01").cast("timestamp")
    subs = _subs(t).withColumn("w", w).withColumn("period_start", F.when(held, F.col("w.begin")).otherwise(past)).withColumn("period_end", F.when(held, F.lit("2100-01-01").cast("timestamp")).otherwise(past))
    return B.reset_usage(subs.drop("w"))


@query("payment_dedupe")
def payment_dedupe(t):
    """A fold in time order per owner; tests hold it against a plain loop."""
    return B.payment_dedupe(t.payments.select("owner", "at", "seq", "payment_id", "checkout_id"))


fixtures.SQL["cover"] = f"""
    WITH p AS (SELECT owner, max(at + {_LOCAL} + CASE WHEN billing_period = 'annual' THEN INTERVAL 12 MONTH ELSE INTERVAL 1 MONTH END - {_LOCAL}) AS best, max_by(billing_period, at) AS period, max(at) AS last FROM pay GROUP BY 1),
    s AS (SELECT owner, CASE owner % 3 WHEN 0 THEN last + CASE WHEN period = 'annual' THEN INTERVAL 365 DAY ELSE INTERVAL 30 DAY END WHEN 1 THEN TIMESTAMP '1999-05-05' END AS renews_at, best, period, last FROM p)
    SELECT owner, CASE WHEN owner % 3 = 0 THEN last + {_LOCAL} + CASE WHEN period = 'annual' THEN INTERVAL 12 MONTH ELSE INTERVAL 1 MONTH END - {_LOCAL} ELSE coalesce(renews_at, best) END AS coverage_end FROM s"""


def _coverage(t):
    last = t.payments.groupBy("owner").agg(F.max_by("billing_period", "at").alias("period"), F.max("at").alias("last"))
    flat = F.timestamp_seconds(F.unix_seconds("last") + F.when(F.col("period") == "annual", 365 * B.DAY).otherwise(30 * B.DAY))
    subs = last.select("owner", F.when(F.col("owner") % 3 == 0, flat).when(F.col("owner") % 3 == 1, F.lit("1999-05-05").cast("timestamp")).alias("renews_at"))
    return B.coverage_end(subs, t.payments)


@query("coverage_end", "SELECT * FROM cover")
def coverage_end(t):
    return _coverage(t)


fixtures.SQL["snap"] = f"""
    SELECT owner, t AS tier, CASE t WHEN 'pro' THEN 75 WHEN 'premium' THEN 50 ELSE 3 END AS "limit", u AS used, greatest(CASE t WHEN 'pro' THEN 75 WHEN 'premium' THEN 50 ELSE 3 END - u, 0) AS remaining
    FROM (SELECT owner, CASE WHEN tier <> 'free' AND open THEN tier ELSE 'free' END AS t, CASE WHEN tier <> 'free' AND NOT open THEN 0 WHEN tier = 'free' THEN least(used, 3) ELSE used END AS u
          FROM (SELECT s.*, coalesce(coverage_end >= TIMESTAMP '{_NOW}', false) AS open FROM subscriptions s LEFT JOIN cover c ON c.owner = s.owner))"""


def _snapshot(t):
    return B.subscription_snapshot(t.subscriptions.withColumn("now", _at()), _coverage(t))


@query("subscription_snapshot", "SELECT * FROM snap")
def subscription_snapshot(t):
    return _snapshot(t)


@query(
    "scan_eligibility",
    """SELECT r.owner, r.o AS request_id, s.tier, CASE WHEN s.tier = 'free' AND r.o % 4 = 0 THEN 'old version' WHEN s.tier = 'free' AND r.o % 4 = 1 THEN 'citation style'
          WHEN s.used + coalesce(n, 0) >= s."limit" THEN 'limit' ELSE 'ok' END AS verdict
       FROM (SELECT o_custkey AS owner, o_orderkey AS o FROM orders) r JOIN snap s ON s.owner = r.owner
       LEFT JOIN (SELECT owner, count(*) AS n FROM versions WHERE status = 'running' AND created_at <= TIMESTAMP '1998-08-01' AND created_at > TIMESTAMP '1998-07-01' GROUP BY 1) f ON f.owner = r.owner""",
)
def scan_eligibility(t):
    requests = t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("request_id"), (F.col("o_orderkey") % 4 != 0).alias("is_current"), F.when(F.col("o_orderkey") % 4 == 1, "mla").otherwise("apa").alias("citation_style"))
    scans = t.versions.select("owner", "status", F.col("created_at").alias("started_at"))
    return B.scan_eligibility(requests, _snapshot(t), scans, F.lit("1998-08-01").cast("timestamp"), 31 * B.DAY)


@query(
    "plan_price",
    """SELECT tier, s.billing_period, count(*) AS n_payments, (count(*) * CASE tier || s.billing_period WHEN 'premiummonthly' THEN 949 WHEN 'premiumannual' THEN 10439 WHEN 'promonthly' THEN 1499 WHEN 'proannual' THEN 16489 ELSE 0 END)::BIGINT AS listed,
       sum(amount // 100)::BIGINT AS pesos FROM pay p JOIN subscriptions s ON s.owner = p.owner GROUP BY 1, 2""",
)
def plan_price(t):
    subs = t.subscriptions.select("owner", "tier", "billing_period", B.plan_price(F.col("tier"), F.col("billing_period")).alias("price"))
    return t.payments.drop("billing_period").join(subs, "owner").groupBy("tier", "billing_period").agg(
        F.count("*").alias("n_payments"), F.sum("price").cast("long").alias("listed"), F.sum(F.expr("amount div 100")).alias("pesos")
    )
