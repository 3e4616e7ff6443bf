"""Queries on readers and writers: files are written to the shared folder from the tables, then read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers as R
from ..sources.shared import shared_path
from .registry import query


def _citations(t):
    style = F.element_at(F.array(F.lit("APA"), F.lit("MLA"), F.lit("IEEE")), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.concat(F.lit(' “'), F.col("text"), F.lit('” '))
    return t.documents.select(text.alias("citation_text"), style.alias("citation_style"), F.when(F.col("doc_id") % 2 == 0, "Yes").otherwise("non-compliant").alias("is_format_compliant"), F.col("source").alias("issue_description"))


_CITED = r"""SELECT md5(trim(regexp_replace('"' || text || '"', '\s+', ' ', 'g'))) AS h, ['APA', 'MLA', 'IEEE'][doc_id % 3 + 1] AS citation_style, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS ok, source AS issue_description FROM documents"""


@query("read_labeled_citations", _CITED)
def read_labeled_citations(t):
    path = shared_path(t.spark, "citations")
    R.write_labeled_dataset([_citations(t)], path)
    return R.read_labeled_citations(t.spark, path).select(F.md5("citation_text").alias("h"), "citation_style", "ok", "issue_description")


@query("write_labeled_dataset", "SELECT ['APA', 'MLA', 'IEEE'][doc_id % 3 + 1] AS citation_style, 2 * count(*) AS n FROM documents GROUP BY 1")
def write_labeled_dataset(t):
    part = _citations(t)
    path = shared_path(t.spark, "labeled")
    R.write_labeled_dataset([part, part], path)
    return R.read_labeled_citations(t.spark, path).groupBy("citation_style").agg(F.count("*").alias("n"))


@query("read_labeled_mechanics", "SELECT lang AS rule_type, count(*) AS n FROM documents GROUP BY 1")
def read_labeled_mechanics(t):
    path = shared_path(t.spark, "mechanics")
    t.documents.select(F.concat(F.lit("Use "), F.col("text")).alias("source_text"), F.col("lang").alias("rule_type"), F.col("source").alias("rule_value")).write.option("header", True).option("escape", '"').csv(path)
    return R.read_labeled_mechanics(t.spark, path).groupBy("rule_type").agg(F.count("*").alias("n"))


def _parsed(t):
    """Units as parsed layout, written as JSON and read with the fixed schema."""
    span = F.struct("text", "font", "size", (F.col("face") == "bold").alias("bold"), (F.col("face") == "italic").alias("italic"), F.lit(0).alias("color"), F.array(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]).alias("bbox"))
    line = F.struct(F.col("line_index").cast("int").alias("line_index"), "text", F.lit(False).alias("table_row"), span["bbox"].alias("bbox"), F.array(span).alias("spans"))
    pages = t.unit_boxes.groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list(F.struct("n", line.alias("l")))).alias("ls"))
    page = F.struct(F.col("page_index").cast("int").alias("page_index"), F.lit(612.0).alias("width_points"), F.lit(792.0).alias("height_points"), F.lit(0).alias("image_count"), F.transform("ls", lambda x: x["l"]).alias("lines"))
    docs = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_index", page.alias("p")))).alias("ps")).select("doc_id", F.struct(F.lit("pdf").alias("format")).alias("metadata"), F.transform("ps", lambda x: x["p"]).alias("pages"))
    path = shared_path(t.spark, "parsed")
    docs.write.option("compression", "gzip").json(path)
    return R.read_parsed_documents(t.spark, path, t.documents.select("doc_id", "text"))


@query("read_parsed_documents", "SELECT doc_id, (len(string_split(text, chr(10))) + 39) // 40 AS n_pages, length(text) AS n FROM documents")
def read_parsed_documents(t):
    return _parsed(t).select("doc_id", F.when(F.col("pages").isNotNull(), F.size("pages")).cast("long").alias("n_pages"), F.length("text").alias("n"))


@query("explode_layout", "SELECT doc_id, page_index, line_index, md5(text) AS h, x0, x1, font FROM unit_boxes")
def explode_layout(t):
    flat = R.explode_layout(_parsed(t))
    spans = flat["spans"].select("doc_id", "page_index", "line_index", "font")
    return flat["lines"].join(spans, ["doc_id", "page_index", "line_index"]).select("doc_id", "page_index", "line_index", F.md5("text").alias("h"), F.col("bbox")[0].cast("long").alias("x0"), F.col("bbox")[2].cast("long").alias("x1"), "font")


@query(
    "intake_files",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'type' WHEN doc_id % 11 = 0 THEN 'empty' WHEN doc_id % 13 = 0 THEN 'size' WHEN doc_id % 5 IN (1, 3) THEN 'signature' END AS reason FROM documents""",
)
def intake_files(t):
    k = F.col("doc_id") % 5
    path = F.concat(F.lit("up/"), F.col("doc_id").cast("string"), F.when(k <= 1, ".pdf").when(k <= 3, ".DOCX").otherwise(".txt"))
    head = F.when(k == 0, F.lit("junk %PDF-1.7 ")).when(k == 2, F.decode(F.unhex(F.lit("504B0304")), "US-ASCII")).otherwise("none ")
    content = F.encode(F.concat(head, F.col("text")), "UTF-8")
    length = F.when(F.col("doc_id") % 11 == 0, 0).when(F.col("doc_id") % 13 == 0, 200 * R.MIB).otherwise(F.length(content))
    return R.intake_files(t.documents.select("doc_id", path.alias("path"), length.alias("length"), content.alias("content")), F.lit("pro")).select("doc_id", "reason")


@query(
    "probe_sample",
    """WITH p AS (SELECT doc_id, page_index, sum(length(text)) AS chars, string_agg(text, chr(10) ORDER BY n) AS text FROM units GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
       SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE before < 400) AS n_used, md5(string_agg(text, chr(10) ORDER BY page_index) FILTER (WHERE before < 400)) AS h, count(*) FILTER (WHERE before < 400) < count(*) AS deferred FROM b GROUP BY 1""",
)
def probe_sample(t):
    return R.probe_sample(t.units).select("doc_id", "n_pages", "n_used", F.md5("sample").alias("h"), "deferred")


@query("read_usage_metrics", "SELECT metric, date_trunc('hour', ts) AS ts, sum(value)::BIGINT AS value FROM metrics GROUP BY 1, 2")
def read_usage_metrics(t):
    hourly = t.metrics.groupBy("metric", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("value").alias("value"))
    path = shared_path(t.spark, "usage")
    points = F.map_from_arrays(F.array(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.array("value"))
    hourly.select(F.map_from_arrays(F.array("metric"), F.array(points)).alias("metrics")).write.json(path)
    return R.read_usage_metrics(t.spark, path)


@query("read_legacy_tables", "SELECT 'manuscripts' AS name, count(*) AS n FROM orders UNION ALL SELECT unnest(['mechanics', 'manuscript_versions', 'compliance_scans', 'section_formatting_checks', 'subscriptions', 'otps', 'challenges', 'otp_sends']), 0")
def read_legacy_tables(t):
    path = shared_path(t.spark, "legacy")
    t.orders.select(F.col("o_orderkey").alias("id")).write.parquet(f"{path}/manuscripts.parquet")
    out = None
    for name, table in R.read_legacy_tables(t.spark, path).items():
        n = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("write_scan_artifacts", "SELECT scan_id, coalesce(count(issue_type), 0) AS n_issues FROM (SELECT DISTINCT scan_id FROM observations) LEFT JOIN issues USING (scan_id) GROUP BY 1")
def write_scan_artifacts(t):
    issues = t.issues.groupBy("scan_id").agg(F.collect_list("issue_type").alias("issues"))
    scans = t.overall.join(issues, "scan_id", "left").select("scan_id", F.col("scan_id").alias("owner"), F.lit("done").alias("status"), F.col("overall").alias("score"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))
    path = shared_path(t.spark, "artifacts")
    R.write_scan_artifacts(scans, path)
    return t.spark.read.parquet(f"{path}/scans").select("scan_id", F.col("n_issues").cast("long").alias("n_issues"))


@query("insert_if_absent", "SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_orderkey % 3 <> 0")
def insert_if_absent(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"))
    return R.insert_if_absent(rows.unionByName(rows), rows.where("id % 3 = 0"), ["id"])
