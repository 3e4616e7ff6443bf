"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join_components

    return join_components(_table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import neighbour_likeness

    return neighbour_likeness(_table(spark, sf_dir, "documents"))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the words that lie in repeated paragraphs, their runs, where they stand first, and what stays."""
    from .paragraph_dedup import dedup_paragraphs

    return dedup_paragraphs(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_removed",
        "n_spans",
        F.array_sort(F.array_distinct(F.transform("removed", lambda r: r["first_doc_id"]))).alias("first_doc_ids"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).drop("source")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["begin"])
    return remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, held_out, score_documents

    docs = _table(spark, sf_dir, "documents")
    crf = fit(docs, _table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    scored = score_documents(docs, crf)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_packing, op3_ngram_join, op4_fingerprints, op5_paragraph_dedup, op6_mixing,
        op7_suffix_dedup, op8_sharding, op9_topk, op10_quality, op11_divergence, op12_lexical, op13_simhash, pipeline,
    )
}
