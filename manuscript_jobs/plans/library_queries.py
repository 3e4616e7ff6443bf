"""Queries on the manuscript library, from orders, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library as L
from . import fixtures
from .registry import query

_TITLE = "'thesis ' || (version_id % 3)::VARCHAR || CASE WHEN version_id % 2 = 0 THEN '' ELSE ' draft' END"
fixtures.SQL["keyed"] = f"SELECT *, {_TITLE} AS key FROM versions"


@query(
    "manuscript_list",
    """SELECT owner, manuscript_id, max_by(version_id, version_number) AS latest_version_id, max(version_number) AS latest_number, count(*) AS n_versions, max(created_at) AS updated_at
       FROM versions WHERE NOT pending GROUP BY 1, 2""",
)
def manuscript_list(t):
    return L.manuscript_list(t.versions)


@query(
    "version_history",
    "SELECT owner, manuscript_id, version_id, version_number, row_number() OVER (PARTITION BY owner, manuscript_id ORDER BY version_number DESC) AS position FROM versions WHERE NOT pending",
)
def version_history(t):
    return L.version_history(t.versions).select("owner", "manuscript_id", "version_id", "version_number", "position")


@query(
    "prune_versions",
    "SELECT version_id, pending, pending OR row_number() OVER (PARTITION BY owner, manuscript_id, pending ORDER BY version_number DESC) <= 3 AS kept FROM versions",
)
def prune_versions(t):
    return L.prune_versions(t.versions).select("version_id", "pending", "kept")


@query("version_scan_state", "SELECT owner, manuscript_id, version_id, status AS state FROM versions WHERE status IN ('running', 'done')")
def version_scan_state(t):
    return L.version_scan_state(t.versions)


@query(
    "release_unscanned_versions",
    """SELECT owner, manuscript_id, count(*) FILTER (WHERE status <> 'failed') AS n_kept, count(*) FILTER (WHERE status = 'failed') AS n_dropped, count(*) FILTER (WHERE status = 'done' AND pending) AS n_committed,
       max_by(version_id, version_number) FILTER (WHERE status <> 'failed') AS current_version_id, coalesce(max(version_number) FILTER (WHERE status <> 'failed'), 0) AS counter FROM versions GROUP BY 1, 2""",
)
def release_unscanned_versions(t):
    return L.release_unscanned_versions(t.versions, L.version_scan_state(t.versions))


@query(
    "assign_version_numbers",
    """SELECT u.owner, u.version_id AS upload_id, u.key, coalesce(top, 0) + row_number() OVER (PARTITION BY u.owner, u.key ORDER BY u.version_id) AS version_number
       FROM keyed u LEFT JOIN (SELECT owner, key, max(version_number) AS top FROM keyed WHERE NOT pending GROUP BY 1, 2) k ON k.owner = u.owner AND k.key = u.key WHERE u.pending""",
)
def assign_version_numbers(t):
    uploads = t.versions.where("pending").select("owner", F.col("version_id").alias("upload_id"), "title")
    return L.assign_version_numbers(uploads, t.versions.where("not pending"))


@query(
    "dedupe_requests",
    "SELECT o_custkey AS owner, o_orderkey % 4 AS request_key, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS upload_id, count(*) AS n_requests FROM orders GROUP BY 1, 2",
)
def dedupe_requests(t):
    return L.dedupe_requests(t.orders.select(F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 4).alias("request_key"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("upload_id")))


@query("unique_names", "SELECT p_partkey AS claim_id, replace(p_name, ' ', '_') AS name_key, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) = 1 AS granted FROM part")
def unique_names(t):
    from ..functions.text import name_key

    claims = t.part.select(F.col("p_partkey").alias("claim_id"), name_key(F.col("p_name")).alias("name_key"), F.col("p_size").alias("at"))
    return L.unique_names(claims, "name_key").drop("at")


@query(
    "cascade_delete",
    """SELECT owner, manuscript_id, version_id, CASE WHEN bool_or(status = 'running') OVER (PARTITION BY owner, manuscript_id) THEN 'blocked' WHEN status = 'done' THEN 'history' ELSE 'tombstone' END AS action
       FROM versions WHERE owner % 10 = 3""",
)
def cascade_delete(t):
    deletes = t.customer.where("c_custkey % 10 = 3").join(t.versions.select("owner", "manuscript_id"), F.col("c_custkey") == F.col("owner")).select("owner", "manuscript_id")
    return L.cascade_delete(t.versions, deletes)


@query(
    "scan_summaries",
    """SELECT version_id, CASE WHEN version_id % 2 = 0 THEN score + 1000 ELSE score END AS score, CASE WHEN version_id % 2 = 0 THEN 'index' ELSE 'scan' END AS origin, owner, manuscript_id, created_at,
       key AS title FROM keyed WHERE status = 'done'""",
)
def scan_summaries(t):
    index = t.versions.where("version_id % 2 = 0").select("version_id", (F.col("score") + 1000).alias("score"))
    return L.scan_summaries(t.versions, index)


@query(
    "merge_remote_scans",
    """WITH l AS (SELECT version_id AS id, version_number AS own FROM versions WHERE version_id % 3 <> 0 AND version_id % 11 <> 0),
            r AS (SELECT version_id AS id, CASE WHEN version_id % 7 = 0 THEN version_number + 1 WHEN version_id % 13 = 0 THEN 0 ELSE version_number END AS theirs FROM versions WHERE status = 'done' AND version_id % 11 <> 0)
       SELECT id AS scan_id, CASE WHEN theirs > 0 THEN theirs ELSE own END AS version_number,
              CASE WHEN own IS NULL THEN 'added' WHEN theirs > 0 AND theirs <> own THEN 'renumbered' ELSE 'kept' END AS change
       FROM l FULL JOIN r USING (id) WHERE own IS NOT NULL OR id % 5 <> 0""",
)
def merge_remote_scans(t):
    v = t.versions.withColumnRenamed("version_id", "scan_id")
    number = F.when(F.col("scan_id") % 7 == 0, F.col("version_number") + 1).when(F.col("scan_id") % 13 == 0, 0).otherwise(F.col("version_number"))
    remote = v.where("status = 'done'").select("scan_id", number.alias("version_number"))
    return L.merge_remote_scans(v.where("scan_id % 3 <> 0").select("scan_id", "version_number"), remote, v.where("scan_id % 11 = 0"), v.where("scan_id % 5 = 0"))


@query(
    "dedupe_manuscripts",
    """SELECT owner, key, count(*) AS n_versions, max_by(version_id, (created_at, version_id)) AS newest, max(created_at) AS updated_at,
       string_agg(version_id::VARCHAR, ',' ORDER BY created_at DESC, version_id DESC) AS version_ids FROM keyed GROUP BY 1, 2""",
)
def dedupe_manuscripts(t):
    return L.dedupe_manuscripts(t.versions).withColumn("version_ids", F.array_join(F.transform("version_ids", lambda x: x.cast("string")), ","))


fixtures.SQL["latest"] = """
    SELECT *, CASE WHEN score >= 80 THEN 'compliant' WHEN score >= 50 THEN 'needs_revision' ELSE 'critical' END AS band FROM versions WHERE NOT pending
    QUALIFY row_number() OVER (PARTITION BY owner, manuscript_id ORDER BY version_number DESC) = 1"""


@query(
    "library_dashboard",
    """SELECT owner, count(*) AS total, count(*) FILTER (WHERE band = 'compliant') AS compliant, count(*) FILTER (WHERE band = 'needs_revision') AS needs_revision, count(*) FILTER (WHERE band = 'critical') AS critical,
       count(*) FILTER (WHERE date_trunc('month', created_at) = DATE '1998-08-01') AS this_month FROM latest GROUP BY 1""",
)
def library_dashboard(t):
    return L.library_dashboard(t.versions, F.lit("1998-08-01").cast("timestamp"))[0]


@query(
    "library_page",
    "SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, manuscript_id) AS position, manuscript_id, band FROM latest QUALIFY position <= 2",
)
def library_page(t):
    return L.library_dashboard(t.versions, F.lit("1998-08-01").cast("timestamp"), 1, 2)[1]


@query(
    "legacy_import",
    """SELECT c.c_custkey AS owner, manuscript_id, max(version_number) AS counter, count(*) AS n_versions FROM versions v JOIN customer c ON c.c_custkey = v.owner WHERE c.c_nationkey % 2 = 0 GROUP BY 1, 2""",
)
def legacy_import(t):
    some = t.customer.where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("owner"))
    manuscripts = t.versions.select("manuscript_id", "owner").distinct().join(some, "owner")
    return L.legacy_import(manuscripts, t.versions, t.sends)[0]


@query("legacy_sends", "SELECT owner, purpose, string_agg(at::VARCHAR, ',' ORDER BY at DESC) AS sends FROM sends GROUP BY 1, 2")
def legacy_sends(t):
    grouped = L.legacy_import(t.versions.select("manuscript_id", "owner"), t.versions, t.sends)[1]
    return grouped.withColumn("sends", F.array_join(F.transform("sends", lambda x: x.cast("string")), ","))


@query(
    "scan_detail",
    """SELECT version_id AS scan_id, CASE WHEN version_id % 4 = 3 THEN NULL WHEN version_id % 4 = 2 THEN n_bytes ELSE score END AS score, CASE WHEN version_id % 4 <> 3 THEN n_bytes END AS n_issues,
       CASE WHEN version_id % 3 = 0 THEN status WHEN version_id % 4 = 3 THEN 'running' ELSE 'done' END AS status FROM versions""",
)
def scan_detail(t):
    v = t.versions.withColumnRenamed("version_id", "scan_id")
    scans = v.select("scan_id", F.when(F.col("scan_id") % 4 < 2, F.col("score")).alias("score"), F.lit(None).cast("long").alias("n_issues"), F.when(F.col("scan_id") % 3 == 0, F.col("status")).alias("status"))
    return L.scan_detail(scans, v.where("scan_id % 4 <> 3").select("scan_id", F.col("n_bytes").alias("score"), F.col("n_bytes").alias("n_issues")))


@query(
    "notification_feed",
    """WITH e AS (SELECT user_id AS owner, event_type || (event_id // 2)::VARCHAR AS id, event_type AS kind, ts AS at, event_id % 3 = 0 AS read FROM events),
            o AS (SELECT owner, id, min(kind) AS kind, min(at) AS at, bool_or(read) AS read FROM e GROUP BY 1, 2)
       SELECT owner, id, kind, at, read, row_number() OVER (PARTITION BY owner ORDER BY at DESC, id) AS position,
              CASE WHEN date_diff('day', at::DATE, DATE '2024-01-20') <= 0 THEN 'today' WHEN date_diff('day', at::DATE, DATE '2024-01-20') = 1 THEN 'yesterday' ELSE 'earlier' END AS day_group
       FROM o QUALIFY position <= 20""",
)
def notification_feed(t):
    events = t.events.select(
        F.col("user_id").alias("owner"), F.concat("event_type", F.expr("event_id div 2").cast("string")).alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("at"),
        (F.col("event_id") % 3 == 0).alias("read"),
    )
    return L.notification_feed(events, F.lit("2024-01-20").cast("date"), 20)


@query(
    "usage_report",
    """WITH h AS (SELECT metric, date_trunc('hour', ts) AS hour, sum(value)::BIGINT AS h FROM metrics GROUP BY 1, 2), d AS (SELECT metric, date_trunc('day', hour) AS day, sum(h)::BIGINT AS d FROM h GROUP BY 1, 2)
       SELECT x.metric, total, peak_day::TIMESTAMP AS peak_day, peak_day_value, peak_hour, peak_hour_value, n_days, round(100.0::DOUBLE * peak_day_value / total, 6) AS peak_share
       FROM (SELECT metric, sum(d)::BIGINT AS total, max_by(day, (d, -epoch(day))) AS peak_day, max(d) AS peak_day_value, count(*) AS n_days FROM d GROUP BY 1) x
       JOIN (SELECT metric, max_by(hour, (h, -epoch(hour))) AS peak_hour, max(h) AS peak_hour_value FROM h GROUP BY 1) y ON x.metric = y.metric""",
)
def usage_report(t):
    return L.usage_report(t.metrics)


@query(
    "payload_size_report",
    "SELECT owner, count(*) AS n_versions, sum(n_bytes)::BIGINT AS stored, round(avg(n_bytes), 6) AS mean_bytes, sum(n_bytes)::BIGINT * 5 AS projected_reads FROM versions GROUP BY 1",
)
def payload_size_report(t):
    return L.payload_size_report(t.versions)
