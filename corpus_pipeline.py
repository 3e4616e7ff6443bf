"""The corpus pipeline: quality, near duplicates, repeated passages, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads
it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manuscript_jobs.llm.common import Scratch, own_keys, sieve, sifted
from manuscript_jobs.llm.mixing import WORD, mix
from manuscript_jobs.llm.ngram_join import join_components
from manuscript_jobs.llm.packing import pack
from manuscript_jobs.llm.quality import fit, held_out, score_documents
from manuscript_jobs.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECT_BELOW = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores below REJECT_BELOW go. Null and empty texts are one empty line and
    scored as such; rows that share an id, repeated rows and rows of a null id are scored each, equal rows alike.
    Without labels of both kinds every score is 0.5 and all stay. An empty table gives none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    crf = fit(docs, labels, lambda i: ~held_out(i))
    return score_documents(docs, crf, COLUMNS).where(F.col("score") >= REJECT_BELOW).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8, the document of the smallest id stays.

    Distinct (id, text) pairs are documents of their own, in the order of ids (null last) and text hashes, so
    texts that share an id or have none only go for a link of theirs. Equal rows collapse, and rows of one id
    and text do where the text has words. Null and empty texts, and texts without words, stay. Only documents that
    a sieve of the keys to go lets through are shuffled. An empty table gives none; other columns are dropped.
    """
    table = Scratch(spark, "near-duplicates")
    keyed, names = own_keys(docs.select(*COLUMNS), table)
    groups = join_components(keyed, size=5, num=80, den=100, doc_id="_own").withColumnRenamed("doc_id", "_own")
    gone = groups.where("_own <> component_id").select("_own", F.lit(1).alias("goes"))
    if names is not None:
        gone = gone.union(groups.groupBy("_own").count().where("count > 1").select("_own", F.lit(0)))
    gone = table.cut(gone.groupBy("_own").agg(F.max("goes").alias("goes")), "gone")
    marks, keyed = sieve(gone, "_own"), keyed.select("_own", *COLUMNS)
    rest = sifted(keyed, "_own", marks).join(gone, "_own", "left")
    single = rest.where("goes is null").select(*COLUMNS)
    others = F.struct("doc_id", "text", "lang", "source", "n_chars")
    wordless = F.when(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)), others)
    repeated = rest.where("goes = 0").groupBy("_own", wordless.alias("_row")).agg(F.min(others).alias("r")).select("r.*")
    return sifted(keyed, "_own", marks, "left_anti").select(*COLUMNS).union(single).union(repeated)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every character inside a string of 100 bytes that starts earlier. A document of which
    nothing but white space is left goes, an empty one that lost nothing stays."""
    left = remove_repeats(docs, whole_chars=True, carry=("lang", "source"))
    kept = left.withColumn("text", F.decode("kept", "UTF-8")).where((F.size("spans") == 0) | F.col("text").rlike(WORD))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as its source's target takes it; the part of a repetition that a
    target still takes is the document's first words, joined by spaces. Documents without words (null and empty
    texts) take no part and go. Rows that share an id, have none or are equal are mixed each by itself; ties are
    broken by the order of keys. An empty table gives none."""
    scratch = Scratch(spark, "mixing")
    docs, names = own_keys(docs.select(*COLUMNS), scratch)
    if names is not None:  # rows may be equal: each is numbered in the written table
        docs = scratch.cut(docs.withColumn("_own", F.monotonically_increasing_id()), "numbered")
    taken = mix(docs, doc_id="_own").select(F.col("doc_id").alias("_id"), "size", "taken").where("taken > 0")
    both = docs.join(taken, F.col("_own") == F.col("_id"))
    whole = F.expr("taken div size")
    parts = F.transform(F.sequence(F.lit(1).cast("long"), F.expr("taken div size + if(taken % size > 0, 1, 0)")), lambda i: i <= whole)
    both = both.withColumn("_whole", F.explode(parts))
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.expr("cast(taken % size as int)")), " ")
    both = both.withColumn("text", F.when(F.col("_whole"), F.col("text")).otherwise(some))
    return both.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 2048 by best fit decreasing: a row a piece. A null or empty text is its end token alone;
    rows that share an id, have none or are equal are packed each. An empty table gives none."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixing", mixing), ("packing", packing)]

#: The line field and best-fit packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs
