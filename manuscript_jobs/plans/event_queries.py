"""Queries on webhooks, sends, scans and metrics; batch twins, and streams run over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as M
from ..operators import locate as X
from ..sources.shared import shared_path
from ..streaming import events as E
from ..streaming import stateful as S
from . import fixtures
from .registry import query


def view_parsed(t):
    return E.parse_webhooks(t.webhooks)


fixtures.view_parsed = view_parsed
_ACTION = "CASE event_type WHEN 'checkout_session.payment.paid' THEN 'activate' WHEN 'subscription.activated' THEN 'activate' WHEN 'payment.failed' THEN 'flag' WHEN 'subscription.updated' THEN 'sync' ELSE 'log' END"


@query("parse_webhooks", "SELECT event_id, event_type, resource_id, owner, amount, ts FROM hooks")
def parse_webhooks(t):
    return t.parsed.select("event_id", "event_type", "resource_id", "owner", "amount", "ts")


@query("signature_window", "SELECT event_id, event_type FROM hooks WHERE age <= 300")
def signature_window(t):
    return E.signature_window(t.parsed).select("event_id", "event_type")


@query("dedupe_events", "SELECT user_id || '-' || (ts::DATE)::VARCHAR AS event_id, min(ts) AS ts FROM hooks GROUP BY 1")
def dedupe_events(t):
    again = t.events.select(F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("event_id"), "ts")
    return E.dedupe_events(again)


@query(
    "claim_events",
    """WITH d AS (SELECT event_id AS delivery, owner || '-' || (ts::DATE)::VARCHAR AS event_id, ts, substr(event_id, 5)::BIGINT % 3 = 0 AS ok FROM hooks),
       b AS (SELECT *, coalesce(bool_or(ok) OVER (PARTITION BY event_id ORDER BY ts, ok, delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM d)
       SELECT event_id, verdict, count(*) AS n FROM (SELECT event_id, CASE WHEN before THEN 'skipped' WHEN ok THEN 'done' ELSE 'failed' END AS verdict FROM b) GROUP BY 1, 2""",
)
def claim_events(t):
    """Deliveries of an owner's day as tries of one event, of which every third goes well."""
    number = F.substring("event_id", 5, 20).cast("long")
    tries = t.parsed.select(F.concat_ws("-", "owner", F.to_date("ts").cast("string")).alias("event_id"), "ts", (number % 3 == 0).alias("ok"))
    return E.claim_events(tries).groupBy("event_id", "verdict").agg(F.count("*").alias("n"))


_LOG = "SELECT event_type, 'res_' || (user_id % 50)::VARCHAR AS resource_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1, 2"


@query("stream_merchant_log", _LOG)
def stream_merchant_log(t):
    """The log by a stream over the event files, merged bucket by bucket."""
    raw = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    events = t.spark.readStream.schema(raw).parquet(f"{t.sf_dir}/event*.parquet")
    log = events.select("event_type", F.concat(F.lit("res_"), (F.col("user_id") % 50).cast("string")).alias("resource_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    path = shared_path(t.spark, "merchant-log")
    merge, last = S.upsert_buckets(t.spark, path), [-1]

    def keep(batch, number):
        merge(batch, number)
        last[0] = number

    log.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return S.read_log(t.spark, path, last[0]).select("event_type", "resource_id", "event_id", "ts")


@query("payment_states")
def payment_states(t):
    """Subscriptions as they stand on a day: plans whose coverage has ended by then are free."""
    return E.apply_payment_actions(_actions(t.webhooks), as_of=1_706_745_600)


fixtures.SQL["bare"] = """
    SELECT event_id, event_type, CASE WHEN substr(event_id, 5)::BIGINT % 3 > 0 OR (substr(event_id, 5)::BIGINT % 2 = 0 AND event_type IN ('checkout_session.payment.paid', 'subscription.updated')) THEN owner END AS owner FROM hooks"""


@query("route_events", f"SELECT event_id, CASE WHEN owner IS NULL THEN 'log' ELSE {_ACTION} END AS action, owner FROM bare")
def route_events(t):
    """All events, of which every third names no owner; checkouts and subscriptions of even events are known."""
    number = F.substring("event_id", 5, 20).cast("long")
    kind = F.when(F.col("event_type") == "checkout_session.payment.paid", "checkout").when(F.col("event_type") == "subscription.updated", "subscription")
    known = t.parsed.where(number % 2 == 0).select(kind.alias("kind"), F.col("resource_id").alias("id"), "owner", "tier", "billing_period").where("kind is not null")
    bare = t.parsed.withColumn("owner", F.when(number % 3 != 0, F.col("owner")))
    return E.route_events(E.find_owners(bare, known)).select("event_id", "action", "owner")


def _actions(df):
    """Actions on plans told by the amount: the events name none."""
    tier = F.when(F.col("amount") % 2 == 0, "pro").when(F.col("amount") % 5 != 0, "premium")
    period = F.when(F.col("amount") % 3 == 0, "annual").otherwise("monthly")
    return E.route_events(E.parse_webhooks(df)).select("owner", F.unix_seconds("ts").alias("at"), "event_id", "action", tier.alias("tier"), period.alias("billing_period"))


@query("apply_payment_actions")
def apply_payment_actions(t):
    return E.apply_payment_actions(_actions(t.webhooks))


@query("otp_rate_limit")
def otp_rate_limit(t):
    return E.rate_limit(t.sends)


@query(
    "scan_usage_counter",
    "SELECT o_custkey AS owner, date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(DISTINCT o_orderkey) AS used FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2",
)
def scan_usage_counter(t):
    scans = t.versions.select(F.col("version_id").alias("scan_id"), "owner", "status", F.col("created_at").alias("at"))
    return E.scan_usage_counter(scans.unionByName(scans.where("scan_id % 5 = 0")))


@query(
    "scan_progress",
    """WITH p AS (SELECT l_orderkey AS job, l_shipdate AS tm, l_linenumber * 10 AS percent, CASE WHEN l_linenumber = 7 THEN 'done' WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN 'failed' ELSE 'stage_' || l_linenumber::VARCHAR END AS stage FROM lineitem)
       SELECT job, coalesce(arg_min(stage, (tm, stage)) FILTER (WHERE stage IN ('done', 'failed')), max_by(stage, (tm, percent, stage))) AS stage,
              CASE WHEN count(*) FILTER (WHERE stage IN ('done', 'failed')) > 0 THEN 100 ELSE max_by(percent, (tm, percent, stage)) END AS percent FROM p GROUP BY 1""",
)
def scan_progress(t):
    k = F.col("l_linenumber")
    stage = F.when(k == 7, "done").when((k == 6) & (F.col("l_returnflag") == "A"), "failed").otherwise(F.concat(F.lit("stage_"), k.cast("string")))
    return E.scan_progress(t.lineitem.select(F.col("l_orderkey").alias("job"), F.col("l_shipdate").alias("at"), stage.alias("stage"), (k * 10).alias("percent")))


@query(
    "stale_scans",
    """SELECT version_id AS scan_id, CASE WHEN age > 15552000 THEN 'stale' WHEN lost AND age <= 2592000 THEN 'wait' WHEN lost AND version_id % 2 = 0 THEN 'requeue' WHEN lost THEN 'failed' ELSE 'running' END AS verdict
       FROM (SELECT version_id, date_diff('second', created_at, TIMESTAMP '1998-08-01') AS age, version_id % 3 = 0 AS lost FROM versions WHERE status = 'running')""",
)
def stale_scans(t):
    scans = t.versions.select(F.col("version_id").alias("scan_id"), "status", F.col("created_at").alias("started_at"), (F.col("version_id") % 3 == 0).alias("lost"), (F.col("version_id") % 2).alias("requeues"))
    return E.stale_scans(scans, F.lit("1998-08-01").cast("timestamp"), 180 * 86_400, 30 * 86_400)


_HOURLY = "SELECT metric, date_trunc('hour', ts) AS start, sum(value)::BIGINT AS total, count(*) AS n FROM metrics GROUP BY 1, 2"


@query("download_windows", _HOURLY)
def download_windows(t):
    return E.download_windows(t.metrics)


@query("download_windows_daily", "SELECT metric, date_trunc('day', ts)::TIMESTAMP AS start, sum(value)::BIGINT AS total, count(*) AS n FROM metrics GROUP BY 1, 2")
def download_windows_daily(t):
    return E.download_windows(t.metrics, "1 day")


@query("stream_download_windows", _HOURLY)
def stream_download_windows(t):
    """The hourly windows as a stream over the event files, run over what is there."""
    raw = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    events = t.spark.readStream.schema(raw).parquet(f"{t.sf_dir}/event*.parquet")
    metrics = events.select(F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") * 1000).cast("long").alias("value"))
    path = shared_path(t.spark, "stream-windows")
    last = E.run_available(E.download_windows(metrics), path)
    return t.spark.read.parquet(f"{path}/out/{last}")


@query("merchant_log", "SELECT event_type, resource_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM (SELECT event_type, 'res_' || (user_id % 20)::VARCHAR AS resource_id, event_id, ts FROM hooks) GROUP BY 1, 2")
def merchant_log(t):
    shared = F.concat(F.lit("res_"), (F.substring("owner", 2, 20).cast("long") % 20).cast("string"))
    return E.merchant_log(t.parsed.withColumn("resource_id", shared))


_SPLIT = """SELECT doc_id, lang, CASE WHEN at < 0.7 THEN 0 WHEN at < 0.85 THEN 1 ELSE 2 END AS part FROM (
    SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5('split-1|' || doc_id::VARCHAR), doc_id) - 1) / (count(*) OVER (PARTITION BY lang))::DOUBLE AS at FROM documents)"""


@query("stratified_split", _SPLIT)
def stratified_split(t):
    return M.stratified_split(t.documents.select("doc_id", "lang"), "lang", "doc_id")


@query("balanced_weights", "SELECT doc_id, lang, round((SELECT count(*) FROM documents)::DOUBLE / ((SELECT count(DISTINCT lang) FROM documents) * count(*) OVER (PARTITION BY lang)), 6) AS weight FROM documents")
def balanced_weights(t):
    return M.balanced(t.documents.select("doc_id", "lang"), "lang").withColumn("weight", F.round("weight", 6))


@query("tfidf_features")
def tfidf_features(t):
    """Features of all documents: the count of hashed terms each holds."""
    rows = M.term_counts(t.documents.select("doc_id", "text").repartition("doc_id"), "text")
    model = M.Pipeline(stages=M.weighted_features()).fit(rows)
    weights = F.unwrap_udt("features")["values"]  # those of a sparse vector's indices alone
    return model.transform(rows).select("doc_id", F.size(F.filter(weights, lambda x: x != 0)).alias("terms"), F.round(F.aggregate(weights, F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


_WORDS = r"SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents"


@query(
    "ngram_terms",
    f"""SELECT doc_id, len(w) AS n_words, greatest(len(w) - 1, 0) AS n_pairs, greatest(len(w) - 2, 0) AS n_triples,
               coalesce(list_sum(list_transform(list_distinct(w), lambda x: length(x) + 1 + length(x) + greatest(length(x) - 1, 0))), 0)::BIGINT AS n_pieces FROM ({_WORDS})""",
)
def ngram_terms(t):
    terms = M.ngram_terms(t.documents.select("doc_id", "text"), "text")
    blanks = lambda n: F.size(F.filter("words", lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "))) == n))
    return terms.select("doc_id", blanks(0).alias("n_words"), blanks(1).alias("n_pairs"), blanks(2).alias("n_triples"), F.size("pieces").cast("long").alias("n_pieces"))


def _labelled(t):
    """Labelled documents: quality by text."""
    return t.documents.join(t.labels, "doc_id").select("doc_id", "text", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"))


def _model(t):
    """A model of the labelled documents, learnt from four fifths of them by hash."""
    rows = M.stratified_split(_labelled(t), "label", "doc_id", (0.8, 0.2))
    return M.train_classifier(rows.where("part = 0"), "text", "label"), rows


@query("train_classifier")
def train_classifier(t):
    """The report of a classifier on its held-out part."""
    model, rows = _model(t)
    return M.classification_report(M.predict(model, rows.where("part = 1"), "text"), "label", "predicted")


@query("predict_citations")
def predict_citations(t):
    model, _ = _model(t)
    return M.predict(model, _labelled(t).repartition("doc_id"), "text").select("doc_id", "label", "predicted", "confidence")


@query(
    "classification_report",
    """WITH p AS (SELECT lang AS label, CASE WHEN doc_id % 5 = 0 THEN 'en' ELSE lang END AS predicted FROM documents), c AS (SELECT DISTINCT label AS class FROM p UNION SELECT DISTINCT predicted FROM p),
       s AS (SELECT class, count(*) FILTER (WHERE label = class) AS support, count(*) FILTER (WHERE predicted = class) AS n_predicted, count(*) FILTER (WHERE label = class AND predicted = class) AS hits FROM c CROSS JOIN p GROUP BY 1)
       SELECT class, support, n_predicted, hits, round(hits / n_predicted::DOUBLE, 6) AS precision, round(hits / support::DOUBLE, 6) AS recall FROM s""",
)
def classification_report(t):
    pairs = t.documents.select(F.col("lang").alias("label"), F.when(F.col("doc_id") % 5 == 0, "en").otherwise(F.col("lang")).alias("predicted"))
    return M.classification_report(pairs, "label", "predicted").select("class", "support", "n_predicted", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


fixtures.SQL["excerpts"] = r"""
    SELECT doc_id, n AS excerpt_id, CASE WHEN n % 4 = 0 THEN page_index WHEN n % 4 = 1 THEN 99 END AS page_index, n % 2 = 0 AS paragraph_start, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM units"""
fixtures.SQL["needles"] = r"""
    SELECT doc_id, excerpt_id, page_index, unnest(k) AS needle, unnest(range(len(k))) AS rank FROM (
      SELECT *, list_filter(list_transform(list_filter(list_transform(l, lambda x, i: CASE WHEN list_position(l, x) = i THEN x END), lambda x: x IS NOT NULL), lambda x: x), lambda x: length(x) >= 2) AS k FROM (
        SELECT *, [t, trim(left(t, 40)), CASE WHEN NOT paragraph_start THEN trim(right(t, 40)) END, array_to_string(string_split(t, ' ')[1:3], ' ')] AS l FROM excerpts))"""


def view_excerpts(t):
    """Every line of a document as an excerpt, whole."""
    n = F.col("n") % 4
    return t.units.select("doc_id", F.col("n").alias("excerpt_id"), F.col("text").alias("excerpt"), F.when(n == 0, F.col("page_index")).when(n == 1, 99).alias("page_index"), (F.col("n") % 2 == 0).alias("paragraph_start"))


fixtures.view_excerpts = view_excerpts


@query("excerpt_needles", "SELECT doc_id, excerpt_id, rank, md5(needle) AS h FROM needles")
def excerpt_needles(t):
    return X.excerpt_needles(t.excerpts).select("doc_id", "excerpt_id", "rank", F.md5("needle").alias("h"))


@query(
    "locate_excerpts",
    r"""WITH p AS (SELECT doc_id, page_index AS at, lower(regexp_replace(string_agg(text, chr(10) ORDER BY n), '\s+', ' ', 'g')) AS text FROM units GROUP BY 1, 2),
        h AS (SELECT x.doc_id, x.excerpt_id, p.at, max(CASE WHEN contains(p.text, x.needle) THEN length(x.needle) ELSE 0 END) AS score, bool_or(x.page_index = p.at) AS named FROM needles x JOIN p ON p.doc_id = x.doc_id GROUP BY 1, 2, 3)
        SELECT doc_id, excerpt_id, coalesce(max(at) FILTER (WHERE named), max_by(at, (score, -at)) FILTER (WHERE score > 0)) AS page_index FROM h GROUP BY 1, 2""",
)
def locate_excerpts(t):
    pages = t.units.groupBy("doc_id", "page_index").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])).alias("text"))
    return X.locate_excerpts(t.excerpts, pages)
