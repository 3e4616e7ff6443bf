"""Stateful stream operators: event ids that may be tried again, subscriptions whose coverage ends by the clock, and a
log that is merged bucket by bucket.

They keep their state in Spark's state store, so a restarted query goes on where its checkpoint ends. Each has a batch
twin in ``events`` with the same results.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import delete_path, path_exists
from . import events as E

DAY_MS = 86_400_000
BUCKETS = 256
_ACTION = ("at", "event_id", "action", "tier", "billing_period")


def claim_events(deliveries: DataFrame, ok: str = "ok", watermark: str = "1 day", ttl_ms: int = 30 * DAY_MS) -> DataFrame:
    """Adds ``verdict`` to a stream of deliveries (event_id, ts, ok, ...), ``ok`` telling whether handling it went well:
    ``done`` the first time it does, ``failed`` before, ``skipped`` ever after. An id that failed runs again, one that
    is done never does. State is a flag per id; it goes when the watermark is ``ttl_ms`` past its last delivery. A null
    outcome is a failure."""
    columns = deliveries.columns

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, last = (bool(state.get[0]) if state.exists else False), state.getCurrentWatermarkMs()
        for part in parts:  # in order of arrival, by time within a part
            good = part[ok].map(lambda x: x is not None and x == x and bool(x))
            part = part.assign(_good=good).sort_values(["ts", "_good"], kind="stable")
            verdicts, last = [], max(last, int(part["ts"].max().timestamp() * 1000))
            for good in part["_good"].tolist():
                verdicts.append("skipped" if done else "done" if good else "failed")
                done = done or good
            yield part[columns].assign(verdict=verdicts)
        state.update((done,))
        state.setTimeoutTimestamp(last + ttl_ms)

    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in deliveries.schema)}, verdict string"
    return deliveries.withWatermark("ts", watermark).groupBy("event_id").applyInPandasWithState(update, out, "done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def payment_states(actions: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """An owner's state whenever it changes, by actions (owner, at, event_id, action, tier, billing_period).

    Actions wait until the watermark has passed them and are then taken in order of (at, event_id), whichever batch
    brought them; later ones than the watermark are dropped. A timer stands at the next waiting action or the end of
    what is paid, so a plan ends without an event. State is what waits within the watermark, as JSON, and one
    row an owner; rows are taken part by part as they come."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else (0, *E._FREE, "[]")
        before, waiting = tuple(known[:-1]), json.loads(known[-1])
        if not state.hasTimedOut:
            for part in parts:
                rows = part[list(_ACTION)].astype(object)
                waiting += rows.where(rows.notna(), None).values.tolist()
        mark = state.getCurrentWatermarkMs()
        now = mark // 1000
        ready, later = [x for x in waiting if x[0] <= now], [x for x in waiting if x[0] > now]
        count, held = before[0], before[1:]
        for row in sorted(ready, key=lambda x: (x[0], x[1])):
            held = E._apply(E._lapsed(held, row[0]), dict(zip(_ACTION, row)))
            count += 1
        held = E._lapsed(held, now)
        state.update((count, *held, json.dumps(later)))
        due = [x[0] for x in later] + ([held[3]] if held[3] > now else [])
        if due:
            state.setTimeoutTimestamp(max(min(due) * 1000, mark + 1))
        if (count, *held) != before:
            yield pd.DataFrame([(key[0], count, *held)], columns=["owner", "n_actions", "tier", "paid", "since", "until", "flagged"])

    plans = E._plans(actions.withColumn("_ts", F.timestamp_seconds("at")), "_ts").withWatermark("_ts", watermark)
    return plans.groupBy("owner").applyInPandasWithState(update, E._OUT, f"n long, {E._STATE}, waiting string", "update", GroupStateTimeout.EventTimeTimeout)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("event_type", "resource_id"), F.lit(buckets)).cast("int").alias("bucket")


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """bucket -> the batch that wrote it last; a row a bucket at most."""
    if number < 0 or not path_exists(spark, f"{path}/manifest/{number}/_SUCCESS"):
        return {}
    return {r.bucket: r.batch for r in spark.read.parquet(f"{path}/manifest/{number}").collect()}


def read_log(spark: SparkSession, path: str, number: int, only: list[int] | None = None) -> DataFrame | None:
    """The log as batch ``number`` left it, or some buckets of it; None where that is nothing."""
    folders = [f"{path}/data/{batch}/bucket={b}" for b, batch in _manifest(spark, path, number).items() if only is None or b in only]
    return spark.read.parquet(*folders) if folders else None


def upsert_buckets(spark: SparkSession, path: str, buckets: int = BUCKETS):
    """A ``foreachBatch`` function that merges a batch into a log of the latest event of each (type, resource).

    Only the buckets that a batch touches are read and written, beside the old ones; a manifest of all buckets, put down
    last, makes them the log. A batch that is tried again reads the manifest before it and so writes what it wrote.
    Folders that neither this nor the former manifest names are deleted. Choose ``buckets`` so that one is some tens of
    MB of the log."""

    def merge(batch: DataFrame, number: int) -> None:
        fresh = E.merchant_log(batch).persist()
        try:
            touched = [r.bucket for r in fresh.select(_bucket(buckets)).distinct().collect()]  # at most ``buckets`` rows
            known = _manifest(spark, path, number - 1)
            if touched:
                old = read_log(spark, path, number - 1, touched)
                merged = fresh if old is None else E.merchant_log(fresh.unionByName(old))
                merged.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{number}")
            named = {**known, **{b: number for b in touched}}
            spark.createDataFrame(sorted(named.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{number}")
        finally:
            fresh.unpersist()
        for b, at in _manifest(spark, path, number - 2).items():
            if known.get(b) != at and named.get(b) != at:
                delete_path(spark, f"{path}/data/{at}/bucket={b}")
        delete_path(spark, f"{path}/manifest/{number - 3}")

    return merge
