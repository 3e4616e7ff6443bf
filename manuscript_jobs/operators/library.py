"""The manuscript library: versions, scans, names, deletions and what is shown of them.

Versions: (owner, manuscript_id, version_id, version_number, created_at, status, pending, score, title).
Windows are partitioned by manuscript or owner, never global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_key

BY_MANUSCRIPT = ("owner", "manuscript_id")


def manuscript_list(versions: DataFrame) -> DataFrame:
    """Per manuscript: its latest committed version, its number and the count of committed versions."""
    committed = versions.where("not pending")
    return committed.groupBy(*BY_MANUSCRIPT).agg(
        F.max_by("version_id", F.struct("version_number", "version_id")).alias("latest_version_id"),
        F.max("version_number").alias("latest_number"),
        F.count("*").alias("n_versions"),
        F.max("created_at").alias("updated_at"),
    )


def version_history(versions: DataFrame, current_only: bool = False) -> DataFrame:
    """Committed versions numbered from the newest; or only the current one."""
    newest = Window.partitionBy(*BY_MANUSCRIPT).orderBy(F.desc("version_number"), F.desc("version_id"))
    ranked = versions.where("not pending").withColumn("position", F.row_number().over(newest))
    return ranked.where("position = 1") if current_only else ranked


def prune_versions(versions: DataFrame, keep: int = 3) -> DataFrame:
    """Adds ``kept``: the newest committed versions of a manuscript, and all pending ones."""
    newest = Window.partitionBy(*BY_MANUSCRIPT, "pending").orderBy(F.desc("version_number"), F.desc("version_id"))
    return versions.withColumn("kept", F.col("pending") | (F.row_number().over(newest) <= keep))


def version_scan_state(scans: DataFrame) -> DataFrame:
    """Per version: running beats done; versions with neither have no row."""
    rank = F.when(F.col("status") == "running", 2).when(F.col("status") == "done", 1)
    state = scans.groupBy("owner", "manuscript_id", "version_id").agg(F.max(rank).alias("_r")).where("_r is not null")
    return state.withColumn("state", F.when(F.col("_r") == 2, "running").otherwise("done")).drop("_r")


def release_unscanned_versions(versions: DataFrame, states: DataFrame) -> DataFrame:
    """Per manuscript: versions left after those without a scan go, the current one and the counter.

    The counter falls to the highest number left only where all numbers above it were deleted."""
    kept = versions.join(states.select("version_id", "state"), "version_id", "left")
    return kept.groupBy(*BY_MANUSCRIPT).agg(
        F.count("state").alias("n_kept"),
        F.count(F.when(F.col("state").isNull(), 1)).alias("n_dropped"),
        F.count(F.when((F.col("state") == "done") & F.col("pending"), 1)).alias("n_committed"),
        F.max_by("version_id", F.when(F.col("state").isNotNull(), F.col("version_number"))).alias("current_version_id"),
        F.coalesce(F.max(F.when(F.col("state").isNotNull(), F.col("version_number"))), F.lit(0)).alias("counter"),
    )


def assign_version_numbers(uploads: DataFrame, versions: DataFrame) -> DataFrame:
    """Uploads (owner, upload_id, title) number on from the highest number of their (owner, title key)."""
    top = versions.groupBy("owner", title_key(F.col("title")).alias("key")).agg(F.max("version_number").alias("_top"))
    order = Window.partitionBy("owner", "key").orderBy("upload_id")
    own = uploads.withColumn("key", title_key(F.col("title"))).withColumn("_nth", F.row_number().over(order))
    return own.join(top, ["owner", "key"], "left").select("owner", "upload_id", "key", (F.coalesce("_top", F.lit(0)) + F.col("_nth")).alias("version_number"))


def dedupe_requests(uploads: DataFrame) -> DataFrame:
    """The first upload of each (owner, request key) answers all its replays."""
    return uploads.groupBy("owner", "request_key").agg(F.min_by("upload_id", F.struct("at", "upload_id")).alias("upload_id"), F.count("*").alias("n_requests"))


def unique_names(claims: DataFrame, key: str) -> DataFrame:
    """Adds ``granted``: the first claim of a key, by time and id."""
    first = Window.partitionBy(key).orderBy("at", "claim_id")
    return claims.withColumn("granted", F.row_number().over(first) == 1)


def cascade_delete(versions: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rows of deleted manuscripts: finished scans stay as history, running ones block the deletion, the
    rest go and leave a tombstone."""
    hit = versions.join(deletes.select(*BY_MANUSCRIPT).distinct(), list(BY_MANUSCRIPT), "left_semi")
    blocked = F.max(F.col("status") == "running").over(Window.partitionBy(*BY_MANUSCRIPT))
    action = F.when(F.col("_blocked"), "blocked").when(F.col("status") == "done", "history").otherwise("tombstone")
    return hit.withColumn("_blocked", blocked).select(*BY_MANUSCRIPT, "version_id", action.alias("action"))


def scan_summaries(versions: DataFrame, index: DataFrame) -> DataFrame:
    """Finished scans: those in the index as they are there, others read anew; stale index rows drop out."""
    done = versions.where("status = 'done'")
    known = index.join(done.select("version_id"), "version_id", "left_semi").select("version_id", "score", F.lit("index").alias("origin"))
    fresh = done.join(index.select("version_id"), "version_id", "left_anti").select("version_id", "score", F.lit("scan").alias("origin"))
    return known.unionByName(fresh).join(done.select("version_id", *BY_MANUSCRIPT, "created_at", title_key(F.col("title")).alias("title")), "version_id")


def merge_remote_scans(local: DataFrame, remote: DataFrame, deleted: DataFrame, dismissed: DataFrame) -> DataFrame:
    """A local library brought up to a server's summaries: deleted scans go, numbers are the server's,
    missing scans come in unless dismissed."""
    here = local.join(deleted.select("scan_id"), "scan_id", "left_anti").select("scan_id", F.col("version_number").alias("_own"), F.lit(1).alias("_here"))
    there = remote.join(deleted.select("scan_id"), "scan_id", "left_anti").select("scan_id", F.col("version_number").alias("_theirs"), F.lit(1).alias("_there"))
    both = here.join(there, "scan_id", "full_outer").join(dismissed.select("scan_id", F.lit(1).alias("_off")).distinct(), "scan_id", "left")
    change = F.when(F.col("_here").isNull(), "added").when((F.col("_theirs") > 0) & (F.col("_theirs") != F.col("_own")), "renumbered").otherwise("kept")
    number = F.when(F.col("_theirs") > 0, F.col("_theirs")).otherwise(F.col("_own"))
    return both.where("_here is not null or _off is null").select("scan_id", number.alias("version_number"), change.alias("change"))


def dedupe_manuscripts(versions: DataFrame) -> DataFrame:
    """Per (owner, title key): versions numbered upwards without gaps where numbers repeat, newest first."""
    key = title_key(F.col("title"))
    order = Window.partitionBy("owner", "key").orderBy("created_at", "version_id")
    own = versions.withColumn("key", key).withColumn("number", F.row_number().over(order))
    return own.groupBy("owner", "key").agg(
        F.count("*").alias("n_versions"), F.max_by("version_id", "number").alias("newest"), F.max("created_at").alias("updated_at"),
        F.transform(F.sort_array(F.collect_list(F.struct("number", "version_id")), asc=False), lambda x: x["version_id"]).alias("version_ids"),
    )


def library_dashboard(versions: DataFrame, month_of: Column, page: int = 1, size: int = 8) -> tuple[DataFrame, DataFrame]:
    """(totals by owner, the page of an owner's newest manuscripts)."""
    from .scoring import score_band

    latest = version_history(versions, True).withColumn("band", score_band(F.col("score")))
    totals = latest.groupBy("owner").agg(
        F.count("*").alias("total"), *[F.count(F.when(F.col("band") == b, 1)).alias(b) for b in ("compliant", "needs_revision", "critical")],
        F.count(F.when(F.date_trunc("month", "created_at") == month_of, 1)).alias("this_month"),
    )
    order = Window.partitionBy("owner").orderBy(F.desc("created_at"), "manuscript_id")
    paged = latest.withColumn("position", F.row_number().over(order)).where(F.col("position").between((page - 1) * size + 1, page * size))
    return totals, paged.select("owner", "position", "manuscript_id", "band")


def legacy_import(manuscripts: DataFrame, versions: DataFrame, sends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relational rows to keyed ones: the owner of a version comes from its manuscript (orphans drop), the
    counter is the highest number; sends are gathered per key, newest first."""
    owned = versions.drop("owner").join(manuscripts.select("manuscript_id", "owner"), "manuscript_id")
    counters = owned.groupBy("owner", "manuscript_id").agg(F.max("version_number").alias("counter"), F.count("*").alias("n_versions"))
    grouped = sends.groupBy("owner", "purpose").agg(F.sort_array(F.collect_list("at"), asc=False).alias("sends"))
    return counters, grouped


def scan_detail(scans: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A scan's row with artifact fields only where the row has none; a missing status is inferred."""
    a = artifacts.select("scan_id", F.col("score").alias("_score"), F.col("n_issues").alias("_n"))
    return scans.join(a, "scan_id", "left").select(
        "scan_id", F.coalesce("score", "_score").alias("score"), F.coalesce("n_issues", "_n").alias("n_issues"),
        F.coalesce("status", F.when(F.coalesce("score", "_score").isNotNull(), "done").otherwise("running")).alias("status"),
    )


def notification_feed(events: DataFrame, now: Column, most: int = 100) -> DataFrame:
    """Per owner the newest ``most`` distinct events with their day group; events: (owner, id, kind, at, read)."""
    once = events.groupBy("owner", "id").agg(F.min("kind").alias("kind"), F.min("at").alias("at"), F.max("read").alias("read"))
    newest = Window.partitionBy("owner").orderBy(F.desc("at"), "id")
    days = F.datediff(now, F.col("at"))
    group = F.when(days <= 0, "today").when(days == 1, "yesterday").otherwise("earlier")
    return once.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= most).withColumn("day_group", group)


def usage_report(metrics: DataFrame) -> DataFrame:
    """Per metric: total, peak hour and day (earliest on ties) and their shares of the total."""
    hours = metrics.groupBy("metric", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("value").alias("h"))
    days = hours.groupBy("metric", F.date_trunc("day", "hour").alias("day")).agg(F.sum("h").alias("d"), F.max_by("hour", F.struct("h", -F.unix_seconds("hour"))).alias("top"), F.max("h").alias("top_value"))
    out = days.groupBy("metric").agg(
        F.sum("d").alias("total"), F.max_by("day", F.struct("d", -F.unix_seconds("day"))).alias("peak_day"), F.max("d").alias("peak_day_value"),
        F.max_by("top", F.struct("top_value", -F.unix_seconds("top"))).alias("peak_hour"), F.max("top_value").alias("peak_hour_value"), F.count("*").alias("n_days"),
    )
    return out.withColumn("peak_share", F.round(100.0 * F.col("peak_day_value") / F.col("total"), 6))


def payload_size_report(versions: DataFrame, reads: int = 5) -> DataFrame:
    """Per owner: versions, mean and total stored bytes, and the download volume of reading each ``reads`` times."""
    return versions.groupBy("owner").agg(
        F.count("*").alias("n_versions"), F.sum("n_bytes").alias("stored"), F.round(F.avg("n_bytes"), 6).alias("mean_bytes"), (F.sum("n_bytes") * reads).alias("projected_reads")
    )
