"""Shared parts of the corpus operators: the shared scratch folder, lineage cuts, ranks and components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


#: Rows of an Arrow batch of texts.
BATCH_ROWS = 2000
#: Rows of a sieve at most, 64 bits each.
SIEVE = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own on a single
    machine, as in tests; on a cluster an error, since executors would write to their own disks."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = sc._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        found = _OWN.get(sc.applicationId)
        if not found:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            found = _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="manuscript-jobs-")
            sc.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch:
    """Tables that one operator run writes to the shared folder to cut its lineage.

    A written table survives lost executors, and reading it again costs no recomputation.
    ``drop`` deletes a table that nothing reads any more; what an operator's lazy result still
    reads stays in the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")

    def tidy(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now: it does so when the driver's collector
        finds their plans unused, which else may be much later."""
        gc.collect()
        self.spark._jvm.System.gc()


def sieve(ids: DataFrame, column: str) -> DataFrame:
    """(_word, _bits): 2^24 bits, set by hash of ``column``. It has SIEVE rows at most whatever the input, so it
    may be broadcast; it lets through every id of ``ids`` and, up to some millions of ids, few others."""
    slot = F.pmod(F.xxhash64(column), F.lit(64 * SIEVE)).alias("_slot")
    word = F.expr("_slot div 64").alias("_word")
    return ids.select(slot).groupBy(word).agg(F.expr("bit_or(shiftleft(1L, cast(_slot % 64 as int)))").alias("_bits"))


def sifted(df: DataFrame, column: str, sieve: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows that the sieve lets through (``left_semi``) or that it holds back for sure (``left_anti``)."""
    slot = F.pmod(F.xxhash64(column), F.lit(64 * SIEVE))
    some = df.withColumn("_slot", slot)
    hit = (F.expr("_slot div 64") == F.col("_word")) & (F.getbit("_bits", F.col("_slot") % 64) == 1)
    return some.join(F.broadcast(sieve), hit, how).drop("_slot")


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, for a Python step over texts: Spark's default of 10,000 rows an Arrow batch is too much for whole
    documents, so a session that has it gets BATCH_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def global_rank(df: DataFrame, order: list[str], scratch: Scratch, name: str, out: str = "rank") -> DataFrame:
    """Adds ``out``: the row's number from 0 in ascending ``order`` (nulls first) over the whole table.

    Rows are dealt out by range and written, so the numbering reads one fixed layout; each range
    is numbered by itself and moved by the count of rows in the ranges before it. Only a count
    per range meets in one place. Rows equal in all of ``order`` get adjacent numbers in any order.
    """
    n = max(width(df.sparkSession), 1)
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = scratch.cut(df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()), name)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )  # a row for each range
    within = Window.partitionBy("_range").orderBy(*keys)
    return (
        dealt.join(F.broadcast(starts), "_range")
        .withColumn(out, F.col("_before") + F.row_number().over(within) - 1)
        .drop("_range", "_before")
    )


def own_keys(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with ``_own``, a number for each distinct (doc_id, text) in the order of ids (null last) and text
    hashes, and (_own, doc_id) of each. Where ids are unique and none is null, ``_own`` is the id itself and there
    is no second table."""
    last = 2**63 - 1
    counts = docs.groupBy("doc_id").count()
    row = counts.agg(F.max("count").alias("most"), F.max(F.col("doc_id").isNull() | (F.col("doc_id") == last)).alias("odd")).first()
    if (row.most or 0) <= 1 and not row.odd:
        return docs.withColumn("_own", F.col("doc_id").cast("long")), None
    own = docs.withColumn("_hash", F.xxhash64(F.col("text").isNull(), "text"))
    pairs = own.select(F.col("doc_id").isNull().alias("_null"), "doc_id", "_hash").distinct()
    pairs = scratch.cut(global_rank(pairs, ["_null", "doc_id", "_hash"], scratch, "own-dealt", "_own"), "own-keys")
    named = pairs.select(F.col("doc_id").alias("_p"), F.col("_hash").alias("_h"), "_own")
    keyed = own.join(named, F.col("doc_id").eqNullSafe(F.col("_p")) & (F.col("_hash") == F.col("_h"))).drop("_p", "_h", "_hash")
    return scratch.cut(keyed, "own-texts"), pairs.select("_own", "doc_id")


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) links to (node, component): each linked node with the smallest node it reaches.

    Alternates large-star and small-star steps; each round is written to the shared folder and
    the former one deleted. Rounds grow with the logarithm of the longest chain.
    """
    now = scratch.cut(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0"
    )  # a < b
    mark = None
    for step in range(1, 100):
        both = now.union(now.select("b", "a"))
        # Large star: hang every larger neighbour of a node under the smallest of its neighbourhood.
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: hang a node and its smaller neighbours under the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        nxt = small.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").union(low.select(F.col("m").alias("a"), "b")).distinct()
        nxt = scratch.cut(nxt, f"{name}-{step}")
        row = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{step - 1}")
        now = nxt
        if mark == tuple(row):
            break
        mark = tuple(row)
    else:
        raise RuntimeError("components did not settle in 99 rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
