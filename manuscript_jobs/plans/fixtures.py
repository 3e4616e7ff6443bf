"""Views that derive the library's inputs from the driver tables, in Spark and in SQL.

All derived columns are integer arithmetic or plain string functions, so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schemas import CATEGORIES

SQL: dict[str, str] = {}


def view_units(t):
    """One row per line of a document, with derived place and formatting."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    style = (F.col("doc_id") * 31 + F.col("n") * 7) % 10
    return lines.select(
        "doc_id",
        F.col("n").cast("long").alias("n"),
        "text",
        F.expr("n div 40").alias("page_index"),
        (F.col("n") % 40).cast("long").alias("line_index"),
        F.when(style == 8, "Arial").when(style == 9, "Calibri").otherwise("Times New Roman").alias("font"),
        F.when(style == 9, 11.0).otherwise(12.0).alias("size"),
        F.when((F.col("doc_id") + F.col("n")) % 6 == 0, 1.0).otherwise(2.0).alias("line_spacing"),
        F.when(F.col("n") % 9 == 0, "center").otherwise("justify").alias("alignment"),
        F.when((F.col("doc_id") + F.col("n")) % 5 == 0, 0.0).otherwise(0.5).alias("indent"),
        F.when(style == 7, "bold").when(style == 6, "italic").otherwise("plain").alias("face"),
    )


SQL["lines0"] = """
    SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents"""
SQL["units"] = """
    SELECT doc_id, n, text, n // 40 AS page_index, n % 40 AS line_index,
           CASE (doc_id * 31 + n * 7) % 10 WHEN 8 THEN 'Arial' WHEN 9 THEN 'Calibri' ELSE 'Times New Roman' END AS font,
           CASE WHEN (doc_id * 31 + n * 7) % 10 = 9 THEN 11.0::DOUBLE ELSE 12.0::DOUBLE END AS size,
           CASE WHEN (doc_id + n) % 6 = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS line_spacing,
           CASE WHEN n % 9 = 0 THEN 'center' ELSE 'justify' END AS alignment,
           CASE WHEN (doc_id + n) % 5 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS indent,
           CASE (doc_id * 31 + n * 7) % 10 WHEN 7 THEN 'bold' WHEN 6 THEN 'italic' ELSE 'plain' END AS face
    FROM lines0"""


def view_unit_boxes(t):
    """Units with a box on a page of 612 x 792 points."""
    x0 = F.when(F.col("n") % 4 == 0, 108).otherwise(72).cast("long")
    y0 = (F.lit(72) + 16 * F.col("line_index")).cast("long")
    return t.units.select(
        "*", x0.alias("x0"), y0.alias("y0"), (x0 + F.least(F.lit(468), 5 * F.length("text"))).cast("long").alias("x1"), (y0 + 12).cast("long").alias("y1")
    )


SQL["unit_boxes"] = """
    SELECT *, CASE WHEN n % 4 = 0 THEN 108 ELSE 72 END::BIGINT AS x0, (72 + 16 * line_index)::BIGINT AS y0,
           (CASE WHEN n % 4 = 0 THEN 108 ELSE 72 END + least(468, 5 * length(text)))::BIGINT AS x1, (84 + 16 * line_index)::BIGINT AS y1 FROM units"""


def view_observations(t):
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return t.lineitem.select(
        F.col("l_orderkey").alias("scan_id"), F.element_at(names, F.col("l_linenumber") % 8 + 1).alias("category"), (F.col("l_discount") <= 0.05).alias("ok")
    )


_NAMES = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
SQL["observations"] = f"SELECT l_orderkey AS scan_id, {_NAMES}[l_linenumber % 8 + 1] AS category, l_discount <= 0.05 AS ok FROM lineitem"


def view_findings(t):
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    category = F.element_at(names, F.col("l_linenumber") % 8 + 1)
    return t.lineitem.where("l_discount > 0.05").select(
        F.col("l_orderkey").alias("scan_id"),
        category.alias("category"),
        F.concat(F.lower(category), F.lit("_"), F.lower("l_linestatus")).alias("issue_type"),
        F.when(F.col("l_returnflag") == "A", "critical").when(F.col("l_returnflag") == "N", "moderate").otherwise("minor").alias("severity"),
        (F.col("l_partkey") % 50 + 1).alias("page"),
        (F.col("l_suppkey") % 40 + 1).alias("line"),
        F.concat(F.lit("Line "), (F.col("l_suppkey") % 7).cast("string")).alias("excerpt"),
    )


SQL["findings"] = f"""
    SELECT l_orderkey AS scan_id, {_NAMES}[l_linenumber % 8 + 1] AS category, lower({_NAMES}[l_linenumber % 8 + 1]) || '_' || lower(l_linestatus) AS issue_type,
           CASE l_returnflag WHEN 'A' THEN 'critical' WHEN 'N' THEN 'moderate' ELSE 'minor' END AS severity,
           l_partkey % 50 + 1 AS page, l_suppkey % 40 + 1 AS line, 'Line ' || (l_suppkey % 7)::VARCHAR AS excerpt
    FROM lineitem WHERE l_discount > 0.05"""


def view_versions(t):
    """Orders as uploaded versions: owner, manuscript, title, number, score and state."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey", F.col("o_orderkey") % 3).orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(
        F.col("o_custkey").alias("owner"),
        (F.col("o_custkey") * 10 + F.col("o_orderkey") % 3).alias("manuscript_id"),
        F.col("o_orderkey").alias("version_id"),
        F.row_number().over(w).cast("long").alias("version_number"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        (F.col("o_orderkey") % 5 == 0).alias("pending"),
        (F.floor(F.col("o_totalprice")).cast("long") % 101).alias("score"),
        F.concat(F.lit(" Thesis_"), (F.col("o_orderkey") % 3).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".PDF").otherwise(" - draft.docx")).alias("title"),
        (F.floor(F.col("o_totalprice")).cast("long") % 5000).alias("n_bytes"),
    )


SQL["versions"] = """
    SELECT o_custkey AS owner, o_custkey * 10 + o_orderkey % 3 AS manuscript_id, o_orderkey AS version_id,
           row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderdate, o_orderkey) AS version_number, o_orderdate AS created_at,
           CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderkey % 5 = 0 AS pending,
           floor(o_totalprice)::BIGINT % 101 AS score,
           ' Thesis_' || (o_orderkey % 3)::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN '.PDF' ELSE ' - draft.docx' END AS title,
           floor(o_totalprice)::BIGINT % 5000 AS n_bytes FROM orders"""


def view_subscriptions(t):
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("anchor"), F.max("o_orderdate").alias("seen"))
    tier = F.element_at(F.array(F.lit("free"), F.lit("premium"), F.lit("pro")), (F.col("c_custkey") % 3 + 1).cast("int"))
    period = F.when(F.col("c_custkey") % 2 == 0, "annual").otherwise("monthly")
    return t.customer.join(first, "c_custkey").select(
        F.col("c_custkey").alias("owner"), tier.alias("tier"), period.alias("billing_period"), "anchor", "seen", (F.col("c_custkey") % 90).alias("used")
    )


SQL["subscriptions"] = """
    SELECT c_custkey AS owner, ['free', 'premium', 'pro'][c_custkey % 3 + 1] AS tier, CASE WHEN c_custkey % 2 = 0 THEN 'annual' ELSE 'monthly' END AS billing_period,
           anchor, seen, c_custkey % 90 AS used
    FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS anchor, max(o_orderdate) AS seen FROM orders GROUP BY 1) ON o_custkey = c_custkey"""


_TYPES = {
    "purchase": "checkout_session.payment.paid", "error": "payment.failed", "signup": "subscription.activated",
    "view": "subscription.invoice.created", "click": "subscription.updated",
}


def view_webhooks(t):
    """Events as webhook bodies: the flat envelope for even ids, the wrapped one for odd ids."""
    kind = F.col("event_type")
    for k, v in _TYPES.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    owner, eid = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    resource = F.concat(F.lit('{"id":"res_'), eid, F.lit('","attributes":{"amount":'), F.floor(F.col("value") * 100).cast("string"), F.lit(',"metadata":{"uid":"u'), owner, F.lit('"}}}'))
    flat = F.concat(F.lit('{"data":{"id":"evt_'), eid, F.lit('","type":"'), kind, F.lit('","data":'), resource, F.lit("}}"))
    wrapped = F.concat(F.lit('{"data":{"id":"evt_'), eid, F.lit('","type":"event","attributes":{"type":"'), kind, F.lit('","data":'), resource, F.lit("}}}"))
    return t.events.select(
        F.when(F.col("event_id") % 2 == 0, flat).otherwise(wrapped).alias("body"),
        F.concat(F.lit("t="), (F.unix_seconds("ts") - F.col("event_id") % 400).cast("string"), F.lit(", te=x")).alias("signature"),
        "ts",
    )


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " ELSE event_type END"
SQL["hooks"] = f"""
    SELECT 'evt_' || event_id::VARCHAR AS event_id, {_CASE} AS event_type, 'res_' || event_id::VARCHAR AS resource_id, 'u' || user_id::VARCHAR AS owner,
           floor(value * 100)::BIGINT AS amount, ts, event_id % 400 AS age, user_id FROM events"""


def view_sends(t):
    return t.events.select(
        F.col("user_id").alias("owner"),
        F.when(F.col("event_id") % 2 == 0, "verify_email").otherwise("reset_password").alias("purpose"),
        F.unix_seconds("ts").alias("at"),
        "event_id",
    )


SQL["sends"] = "SELECT user_id AS owner, CASE WHEN event_id % 2 = 0 THEN 'verify_email' ELSE 'reset_password' END AS purpose, floor(epoch(ts))::BIGINT AS at, event_id FROM events"


def view_metrics(t):
    return t.events.select(F.col("event_type").alias("metric"), "ts", F.floor(F.col("value") * 1000).cast("long").alias("value"))


SQL["metrics"] = "SELECT event_type AS metric, ts, floor(value * 1000)::BIGINT AS value FROM events"
