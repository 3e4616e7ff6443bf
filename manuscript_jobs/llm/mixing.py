"""Mixing sources to target weights by capped water-filling, with DataFrame functions alone.

Each source gets its weight's share of the budget, at most ``max_epochs`` times its own size; what a
capped source cannot take is shared again by weight among the others until none is above its cap.
Documents of a source stand in a seeded order. Every document is taken as many whole times as the
source's epochs have whole numbers; the fraction is a further repetition of the first documents in
that order, the last of them in part, so that a source's taken words equal its target but for rounding.

Null text has no words; a document of size 0 is taken 0 words. A null source is a source of its own,
after all others. Repeated rows count each. An empty table gives no rows; where all sizes are 0 the
targets are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, global_rank

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, scratch: Scratch, share: float, max_epochs: int, weights: tuple) -> DataFrame:
    """(source, source_size, weight, target) from (source, size). Weights repeat over the sources in
    order of code points, null last. Only one row a source is left after the first aggregation."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    ranked = global_rank(sources, ["_null", "source"], scratch, "sources")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = scratch.cut(ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))), "weighted")
    cap = F.col("source_size") * float(max_epochs)
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    budget, level, done = share * total.t, None, 0
    # Each round fixes the sources the level floods; the level only rises, so a round without a new
    # one ends it. A round is one aggregation over the sources.
    weight, capped = float(total.w), 0.0
    while weight > 0:
        level = (budget - capped) / weight
        row = ranked.where(cap < F.col("weight") * level).agg(
            F.count("*").alias("n"), F.coalesce(F.sum(cap), F.lit(0.0)).alias("c"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")
        ).first()
        if row.n == done:
            break
        done, capped, weight = row.n, row.c, float(total.w - row.w)
    level = F.lit(float("inf") if weight <= 0 else level)
    return ranked.select("source", "source_size", "weight", F.least(cap, F.col("weight") * level).alias("target"))


def mix(
    docs: DataFrame,
    share: float = 1.5,
    max_epochs: int = 2,
    weights: tuple = WEIGHTS,
    seed: str = "mix-1",
    buckets: int = 1024,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: tuple = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, *carry), a row for each row of ``docs``.

    Sizes are words. The order within a source is that of md5(seed, doc_id). A source is never
    gathered: its documents fall into ``buckets`` by that order, sums of buckets give each bucket its
    place, and only a bucket's rows are ordered together.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.col(doc_id).cast("string"))).alias("_key"),
        *carry,
    )
    small = scratch.cut(sized, "sizes") if not carry else sized
    targets = source_targets(small.select("source", "size"), scratch, share, max_epochs, weights)
    small = small.withColumn("_bucket", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % buckets)
    order = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        small.groupBy("source", "_bucket")
        .agg(F.sum("size").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
        .join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_before", "source_size", "target")
    )
    within = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target").cast("long") / F.col("source_size"))).otherwise(0)
    rest = F.round("target").cast("long") - whole * F.col("source_size")
    begin = F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = small.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return placed.withColumn("_begin", begin).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_begin")))).cast("long").alias("taken"),
        *carry,
    )
