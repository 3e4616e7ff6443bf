"""Readers, writers and what is accepted at the door."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, parse_compliant
from ..schemas import PARSED

CITATION_COLUMNS = ("citation_text", "citation_style", "is_format_compliant", "issue_description")
MIB = 1024 * 1024
SIZE_LIMITS = {"free": 15 * MIB, "premium": 45 * MIB, "pro": 120 * MIB}
LEGACY = ("mechanics", "manuscripts", "manuscript_versions", "compliance_scans", "section_formatting_checks", "subscriptions", "otps", "challenges", "otp_sends")


def _csv(spark: SparkSession, path: str, columns: tuple) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(", ".join(f"{c} string" for c in columns)).csv(path)


def read_labeled_citations(spark: SparkSession, path: str, least: int = 30) -> DataFrame:
    """Cleaned citations with a 0/1 label; fails where a style has fewer than ``least`` rows."""
    rows = _csv(spark, path, CITATION_COLUMNS)
    clean = rows.select(
        clean_text(F.col("citation_text")).alias("citation_text"), F.upper(clean_text(F.col("citation_style"))).alias("citation_style"),
        parse_compliant(F.col("is_format_compliant")).alias("ok"), clean_text(F.col("issue_description")).alias("issue_description"),
    ).where("citation_text <> '' and citation_style <> ''")
    few = clean.groupBy("citation_style").count().where(F.col("count") < least).limit(1).collect()
    if few:
        raise ValueError(f"style {few[0][0]} has {few[0][1]} rows; {least} are needed")
    return clean


def read_labeled_mechanics(spark: SparkSession, path: str, least: int = 20) -> DataFrame:
    """Cleaned rule sentences; fails with fewer than ``least`` in all."""
    clean = _csv(spark, path, ("source_text", "rule_type", "rule_value")).select(*[clean_text(F.col(c)).alias(c) for c in ("source_text", "rule_type", "rule_value")])
    clean = clean.where("source_text <> '' and rule_type <> ''")
    if clean.count() < least:
        raise ValueError(f"fewer than {least} rule sentences")
    return clean


def read_parsed_documents(spark: SparkSession, path: str, embedded: DataFrame | None = None) -> DataFrame:
    """Parsed layout from JSON; documents without an artifact fall back to the embedded text."""
    parsed = spark.read.schema(PARSED).json(path)
    if embedded is None:
        return parsed
    own = embedded.select("doc_id", F.col("text").alias("_text"))
    return own.join(parsed, "doc_id", "left").withColumn("text", F.coalesce("text", "_text")).drop("_text")


def explode_layout(parsed: DataFrame) -> dict[str, DataFrame]:
    """The nested layout as flat tables."""
    pages = parsed.select("doc_id", F.explode("pages").alias("p"))
    lines = pages.select("doc_id", F.col("p.page_index").alias("page_index"), F.explode("p.lines").alias("l"))
    paragraphs = parsed.select("doc_id", F.explode("paragraphs").alias("p"))
    return {
        "pages": pages.select("doc_id", "p.page_index", "p.width_points", "p.height_points", "p.image_count"),
        "lines": lines.select("doc_id", "page_index", "l.line_index", "l.text", "l.table_row", "l.bbox"),
        "spans": lines.select("doc_id", "page_index", F.col("l.line_index").alias("line_index"), F.posexplode("l.spans").alias("at", "s")).select("doc_id", "page_index", "line_index", "at", "s.*"),
        "paragraphs": paragraphs.select("doc_id", "p.paragraph_index", "p.section_index", "p.style", "p.text"),
        "runs": paragraphs.select("doc_id", F.col("p.paragraph_index").alias("paragraph_index"), F.posexplode("p.runs").alias("at", "r")).select("doc_id", "paragraph_index", "at", "r.*"),
        "sections": parsed.select("doc_id", F.inline("sections")),
    }


def intake_files(files: DataFrame, tier: Column) -> DataFrame:
    """Accepts non-empty .pdf and .docx files within the plan's size that begin as such files do; else a reason.
    Files: (path, length, content) as ``spark.read.format("binaryFile")`` gives."""
    low = F.lower("path")
    limit = F.when(tier == "pro", SIZE_LIMITS["pro"]).when(tier == "premium", SIZE_LIMITS["premium"]).otherwise(SIZE_LIMITS["free"])
    head = F.substring("content", 1, 1024)
    pdf, docx = low.endswith(".pdf"), low.endswith(".docx")
    reason = (
        F.when(~(pdf | docx), "type").when(F.col("length") == 0, "empty").when(F.col("length") > limit, "size")
        .when(pdf & ~F.hex(head).contains("255044462D"), "signature").when(docx & (F.hex(F.substring("content", 1, 4)) != "504B0304"), "signature")
    )
    return files.select("*", reason.isNull().alias("accepted"), reason.alias("reason"))


def probe_sample(lines: DataFrame, least: int = 400) -> DataFrame:
    """Page count and the text of the first pages until ``least`` characters; ``deferred`` where more follow."""
    pages = lines.groupBy("doc_id", "page_index").agg(F.sum(F.length("text")).alias("chars"), F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])).alias("text"))
    w = Window.partitionBy("doc_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    own = pages.withColumn("_before", F.coalesce(F.sum("chars").over(w), F.lit(0)))
    used = F.when(F.col("_before") < least, F.struct("page_index", "text"))
    return own.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count(used).alias("n_used"), F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(used)), lambda x: x["text"])).alias("sample")).withColumn("deferred", F.col("n_used") < F.col("n_pages"))


def read_usage_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(metric, ts, value) from JSON objects of {metric: {timestamp: value}}."""
    raw = spark.read.schema("metrics map<string,map<string,bigint>>").json(path)
    return raw.select(F.explode("metrics").alias("metric", "points")).select("metric", F.explode("points").alias("ts", "value")).withColumn("ts", F.to_timestamp("ts"))


def read_legacy_tables(spark: SparkSession, folder: str, names: tuple = LEGACY, schema: str = "id long") -> dict[str, DataFrame]:
    """The old store's tables as Parquet; a missing one is empty."""
    out = {}
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        at = path(f"{folder}/{name}.parquet")
        out[name] = spark.read.parquet(at.toString()) if at.getFileSystem(conf).exists(at) else spark.createDataFrame([], schema)
    return out


def write_scan_artifacts(scans: DataFrame, path: str) -> None:
    """A slim table of scores and counts and a fat one of issues, both by owner, so lists never read the fat one."""
    owner = F.col("owner") % 16  # a bounded number of folders
    scans.select("scan_id", "owner", "status", "score", F.size("issues").alias("n_issues"), owner.alias("owner_part")).write.partitionBy("owner_part").parquet(f"{path}/scans")
    scans.select("scan_id", "owner", "issues", owner.alias("owner_part")).write.partitionBy("owner_part").parquet(f"{path}/artifacts")


def insert_if_absent(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the source whose keys the target lacks, once per key."""
    return source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def write_labeled_dataset(parts: list[DataFrame], path: str, each: int | None = None) -> DataFrame:
    """Unites the parts of a labelled set and writes them as CSV; with ``each``, every style must have so many rows."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    if each is not None:
        off = whole.groupBy("citation_style").count().where(F.col("count") != each).limit(1).collect()
        if off:
            raise ValueError(f"style {off[0][0]} has {off[0][1]} rows, not {each}")
    whole.select(*CITATION_COLUMNS).write.option("header", True).option("escape", '"').csv(path)
    return whole
