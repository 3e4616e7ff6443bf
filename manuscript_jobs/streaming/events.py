"""Webhook, send, scan and metric events: the same columns for streams and for their batch twins.

Functions take any DataFrame, streaming or not; those that need state say so and come in two forms.
"""

from __future__ import annotations

import calendar
import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import fold_in_order

_META = "struct<uid:string,tier:string,billing_period:string,checkout_session_id:string,subscription_id:string>"
_RESOURCE = f"struct<id:string,attributes:struct<amount:bigint,status:string,payment_id:string,metadata:{_META}>>"
ENVELOPE = f"data struct<id:string,type:string,data:{_RESOURCE},attributes:struct<type:string,data:{_RESOURCE}>>"
TOLERANCE_S = 300
ZONE_S = 8 * 3600  # billing days are ahead of UTC

# What is done on which event; all others are logged.
ACTIONS = {
    "checkout_session.payment.paid": "activate", "link.payment.paid": "activate", "payment.paid": "activate", "subscription.activated": "activate",
    "subscription.invoice.paid": "renew", "payment.failed": "flag", "subscription.invoice.payment_failed": "flag", "subscription.past_due": "flag",
    "payment.refunded": "downgrade", "payment.refund.updated": "downgrade", "subscription.unpaid": "downgrade", "subscription.updated": "sync",
}
# By what the owner of an event without one is found, and the states of a refund that took place.
FOUND_BY = {
    "checkout": ("checkout_session.payment.paid", "payment.paid"),
    "subscription": ("subscription.invoice.paid", "subscription.invoice.payment_failed", "subscription.past_due", "subscription.unpaid", "subscription.updated"),
    "payment": ("payment.refunded", "payment.refund.updated"),
}
REFUNDED = ("succeeded", "refunded")


def parse_webhooks(bodies: DataFrame) -> DataFrame:
    """Both envelopes to (event_id, event_type, resource_id, owner, amount, status, tier, billing_period,
    checkout_id, subscription_id, payment_id), null where not given; other columns stay."""
    d = F.from_json("body", ENVELOPE)["data"]
    wrapped = d["type"] == "event"
    r = F.when(wrapped, d["attributes"]["data"]).otherwise(d["data"])
    rest = [c for c in bodies.columns if c != "body"]
    a = r["attributes"]
    meta = a["metadata"]
    return bodies.select(
        d["id"].alias("event_id"), F.when(wrapped, d["attributes"]["type"]).otherwise(d["type"]).alias("event_type"), r["id"].alias("resource_id"),
        meta["uid"].alias("owner"), a["amount"].alias("amount"), a["status"].alias("status"), meta["tier"].alias("tier"), meta["billing_period"].alias("billing_period"),
        meta["checkout_session_id"].alias("checkout_id"), meta["subscription_id"].alias("subscription_id"), a["payment_id"].alias("payment_id"), *rest,
    )


def signature_window(events: DataFrame, tolerance: int = TOLERANCE_S) -> DataFrame:
    """Events signed within the tolerance of their arrival; no or no numeric time is out."""
    parts = F.str_to_map(F.regexp_replace("signature", r"\s", ""), F.lit(","), F.lit("="))
    signed = F.try_element_at(parts, F.lit("t")).try_cast("bigint")
    return events.where(F.abs(F.unix_seconds("ts") - signed) <= tolerance)


def claim_events(deliveries: DataFrame, ok: str = "ok") -> DataFrame:
    """Adds ``verdict`` to deliveries (event_id, ts, ok, ...): ``done`` the first time handling an id went well,
    ``failed`` before, ``skipped`` ever after. Deliveries of one time go by their outcome, failures first. The stream's
    form is in ``stateful``. An id's deliveries are one window; only flags are carried along."""
    good = F.coalesce(F.col(ok), F.lit(False))
    before = F.max(good).over(Window.partitionBy("event_id").orderBy("ts", good).rowsBetween(Window.unboundedPreceding, -1))
    return deliveries.withColumn("verdict", F.when(before, "skipped").when(good, "done").otherwise("failed"))


def dedupe_events(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each event id once: within the watermark for streams, for all time in batch. Where events tell how their handling
    went, ``claim_events`` lets failed ones run again."""
    if events.isStreaming:
        return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    return events.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in events.columns if c != "event_id"]), "ts").alias("e")).select("event_id", "e.*")


def find_owners(events: DataFrame, known: DataFrame) -> DataFrame:
    """Events as parsed, with the owner, tier and billing period that ``known`` (kind, id, owner, tier,
    billing_period) has where an event has none: paid events by their checkout, invoices and states by their
    subscription. Refunds take the owner of the payment first. Of several rows of one id the largest counts.
    A stream may be joined to a static ``known``."""
    kind = F.lit(None).cast("string")
    for what, types in FOUND_BY.items():
        kind = F.when(F.col("event_type").isin(*types), what).otherwise(kind)
    bare = F.col("event_type").isin("subscription.unpaid", "subscription.updated")
    by = F.when(kind == "checkout", F.coalesce("checkout_id", "resource_id")).when(kind == "payment", F.coalesce("resource_id", "payment_id"))
    by = by.when(bare, F.coalesce("resource_id", "subscription_id")).otherwise(F.coalesce("subscription_id", "resource_id"))
    links = known.where("id is not null").groupBy(F.col("kind").alias("_kind"), F.col("id").alias("_id")).agg(F.max(F.struct("owner", "tier", "billing_period")).alias("_known"))
    joined = events.withColumns({"_by_kind": kind, "_by": by}).join(links, (F.col("_by_kind") == F.col("_kind")) & (F.col("_by") == F.col("_id")), "left")
    owner = F.when(kind == "payment", F.coalesce("_known.owner", "owner")).otherwise(F.coalesce("owner", "_known.owner"))
    plan = {c: F.coalesce(c, f"_known.{c}") for c in ("tier", "billing_period")}
    return joined.withColumns({"owner": owner, **plan}).select(*events.columns)


def route_events(events: DataFrame) -> DataFrame:
    """Adds ``action``. Events without an owner are only logged, and so are updates of a refund that did not
    take place (by ``status``, where the events have it)."""
    action = F.lit("log")
    for kind, what in ACTIONS.items():
        action = F.when(F.col("event_type") == kind, what).otherwise(action)
    status = F.lower("status") if "status" in events.columns else F.lit(None).cast("string")
    open_refund = (F.col("event_type") == "payment.refund.updated") & ~F.coalesce(status.isin(*REFUNDED), F.lit(False))
    return events.withColumn("action", F.when(F.col("owner").isNull() | open_refund, "log").otherwise(action))


_STATE = "tier string, paid string, since long, until long, flagged boolean"
_OUT = f"owner string, n_actions long, {_STATE}"
_FREE = ("free", None, 0, 0, False)


def _later(at: int, months: int) -> int:
    """The same local time so many months later, at most the month's last day."""
    local = datetime.datetime.fromtimestamp(at + ZONE_S, datetime.timezone.utc)
    year, month = divmod(local.year * 12 + local.month - 1 + months, 12)
    day = min(local.day, calendar.monthrange(year, month + 1)[1])
    return int(local.replace(year=year, month=month + 1, day=day).timestamp()) - ZONE_S


def _apply(state: tuple, row: dict) -> tuple:
    """(tier, last paid tier, term began, paid through, flagged) after one action. A payment for the plan in force
    extends what is still paid and keeps the term; another plan or a lapse begins a new term. A renewal that
    names no plan is for the last one paid."""
    tier, paid, since, until, flagged = state
    action, at = row["action"], int(row["at"])
    if action in ("activate", "renew"):
        asked = (row["tier"] or "").lower()
        plan = asked if asked in ("premium", "pro") else "premium" if action == "activate" else paid or "premium"
        months = 12 if (row["billing_period"] or "").lower() == "annual" else 1
        if tier == plan and until > at:
            return plan, plan, since, _later(until, months), False
        return plan, plan, at, _later(at, months), False
    if action == "downgrade":
        return "free", paid, 0, 0, False
    return tier, paid, since, until, flagged or action == "flag"


def _plans(actions: DataFrame, *more: str) -> DataFrame:
    """(owner, at, event_id, action, tier, billing_period) and ``more``; plan columns that are missing are null."""
    plan = [F.col(c) if c in actions.columns else F.lit(None).cast("string").alias(c) for c in ("tier", "billing_period")]
    return actions.select("owner", "at", "event_id", "action", *plan, *more)


def _lapsed(state: tuple, at: int) -> tuple:
    """A state as the clock leaves it: what is paid has ended by ``at``."""
    return ("free", state[1], 0, 0, state[4]) if state[0] != "free" and state[3] <= at else state


def apply_payment_actions(actions: DataFrame, as_of: int | None = None) -> DataFrame:
    """State of each owner after its actions in order of (at, event_id); with ``as_of``, those up to then, and plans whose
    coverage has ended by then are free. The stream's form is ``stateful.payment_states``."""

    def step(held, row):
        return (held[0] + 1, _apply(held[1] if as_of is None else _lapsed(held[1], row["at"]), row)), []

    def close(key, held):
        return [(*key, held[0], *(held[1] if as_of is None else _lapsed(held[1], as_of)))]

    rows = _plans(actions) if as_of is None else _plans(actions).where(F.col("at") <= as_of)
    return fold_in_order(rows, ["owner"], ["at", "event_id"], _OUT, lambda: (0, _FREE), step, close)


def rate_limit(sends: DataFrame, cooldown: int = 30, window: int = 3600, most: int = 5, most_reset: int = 10) -> DataFrame:
    """(owner, purpose, event_id, allowed, wait): a send is refused within the cooldown of the last accepted one or
    when the window holds ``most`` accepted. It depends on earlier decisions, so it is a fold by key whose state
    is the accepted sends of the window."""

    def step(accepted, row):
        at, cap = row["at"], most_reset if row["purpose"] == "reset_password" else most
        live = [a for a in accepted if at - a < window]
        wait = 0
        if live and at - live[-1] < cooldown:
            wait = cooldown - (at - live[-1])
        elif len(live) >= cap:
            wait = max(window - (at - live[-cap]), 1)
        if not wait:
            live.append(at)
        return live, [(row["owner"], row["purpose"], row["event_id"], wait == 0, wait)]

    rows = sends.select("owner", "purpose", "at", "event_id")
    return fold_in_order(rows, ["owner", "purpose"], ["at", "event_id"], "owner long, purpose string, event_id long, allowed boolean, wait long", list, step)


def scan_usage_counter(scans: DataFrame) -> DataFrame:
    """Finished scans once each, counted by owner and month."""
    return scans.where("status = 'done'").dropDuplicates(["scan_id"]).groupBy("owner", F.date_trunc("month", "at").alias("month")).agg(F.count("*").alias("used"))


def scan_progress(progress: DataFrame) -> DataFrame:
    """Latest stage per job; the first terminal stage is final. (job, at, stage, percent)."""
    terminal = F.col("stage").isin("done", "failed")
    first = F.min_by("stage", F.when(terminal, F.struct("at", "stage")))
    last = F.max_by(F.struct("stage", "percent"), F.struct("at", "percent", "stage"))
    return progress.groupBy("job").agg(first.alias("_end"), last.alias("_now")).select(
        "job", F.coalesce("_end", "_now.stage").alias("stage"), F.when(F.col("_end").isNotNull(), 100).otherwise(F.col("_now.percent")).alias("percent")
    )


def stale_scans(scans: DataFrame, now, limit_s: int = 1800, grace_s: int = 120) -> DataFrame:
    """Running scans: stale after half an hour; lost ones wait out their grace, then are queued once again."""
    age = F.unix_seconds(now) - F.unix_seconds("started_at")
    verdict = F.when(age > limit_s, "stale").when(F.col("lost") & (age <= grace_s), "wait").when(F.col("lost") & (F.col("requeues") == 0), "requeue").when(F.col("lost"), "failed").otherwise("running")
    return scans.where("status = 'running'").select("scan_id", verdict.alias("verdict"))


def download_windows(metrics: DataFrame, size: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Tumbling totals by metric; late data within the watermark counts."""
    m = metrics.withWatermark("ts", watermark) if metrics.isStreaming else metrics
    return m.groupBy("metric", F.window("ts", size).alias("w")).agg(F.sum("value").alias("total"), F.count("*").alias("n")).select("metric", F.col("w.start").alias("start"), "total", "n")


def merchant_log(events: DataFrame) -> DataFrame:
    """The latest event of each (type, resource): what an upsert keeps."""
    return events.groupBy("event_type", "resource_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


def run_available(stream: DataFrame, path: str, mode: str = "complete") -> int:
    """Runs a stream over what is there now, each batch to its own folder; returns the last batch's number."""
    last = [-1]

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{number}")
        last[0] = number

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return last[0]
