"""Text classifiers at scale: splits, features, training, reports and prediction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import terms
from ..sources.shared import shared_path


def stratified_split(df: DataFrame, label: str, key: str, shares: tuple = (0.7, 0.15, 0.15), seed: str = "split-1") -> DataFrame:
    """Adds ``part``: each label's rows in a seeded order, cut by share. No sampling noise: the same at every run.

    A row's place in its label is its place among the rows whose hash begins alike (one in 4,096) and the count of those
    before, so a label that holds most rows is never one task. A null label is a label of its own."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    dealt = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    w = Window.partitionBy("_l").orderBy("_c")
    sizes = dealt.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    sizes = sizes.select("_l", "_c", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("_l")).alias("_all"))
    placed = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) - 1)
    placed = placed.join(sizes, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c")))
    part, upto = F.lit(len(shares) - 1), 0.0
    cuts = []
    for i, s in enumerate(shares[:-1]):
        upto += s
        cuts.append((i, round(upto, 9)))
    for i, cut in reversed(cuts):
        part = F.when(F.col("_at") < cut, i).otherwise(part)
    return placed.withColumn("_at", (F.col("_before") + F.col("_at")) / F.col("_all")).withColumn("part", part).drop("_h", "_b", "_l", "_c", "_before", "_all", "_at")


def ngram_terms(df: DataFrame, text: str, words: int = 3, chars: tuple = (2, 4)) -> DataFrame:
    """Adds ``terms``: word n-grams and n-grams of characters within words (padded by a space), by built-in
    array functions."""
    none = F.array().cast("array<string>")

    def runs(n: int):
        pick = lambda i: F.array_join(F.slice("_w", i, n), " ")
        return F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), pick)).otherwise(none)

    def parts(n: int):
        cut = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.concat(F.lit("~"), F.substring(x, i, F.lit(n))))
        return F.flatten(F.transform(padded, lambda x: F.when(F.length(x) >= n, cut(x)).otherwise(none)))

    w = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    padded = F.transform(F.array_distinct("_w"), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))
    grams = [runs(n) for n in range(2, words + 1)]
    pieces = [parts(n) for n in range(chars[0], chars[1] + 1)]
    return df.withColumn("_w", w).withColumn("words", F.concat(F.col("_w"), *grams)).withColumn("pieces", F.concat(*pieces)).drop("_w")


TERMS = ("words", "pieces")


def lower_words(text: Column) -> Column:
    """The words that n-grams are made of, in order; none of a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def weighted_features() -> list:
    """Stages that turn counts of terms into their features: TF-IDF, each of unit length, one after the other."""
    stages = []
    for name in TERMS:
        stages += [IDF(inputCol=f"{name}_tf", outputCol=f"{name}_idf", minDocFreq=2), Normalizer(inputCol=f"{name}_idf", outputCol=f"{name}_unit")]
    return [*stages, VectorAssembler(inputCols=[f"{name}_unit" for name in TERMS], outputCol="features")]


def tfidf_features(dimensions: int = 1 << 16) -> Pipeline:
    """TF-IDF of the word and character n-grams of ``ngram_terms``, each of unit length, hashed to a bounded vocabulary."""
    return Pipeline(stages=[*[HashingTF(inputCol=name, outputCol=f"{name}_tf", numFeatures=dimensions) for name in TERMS], *weighted_features()])


def term_counts(df: DataFrame, text: str, dimensions: int = 1 << 16) -> DataFrame:
    """``words_tf`` and ``pieces_tf`` in place of the text: what ``HashingTF`` makes of ``ngram_terms``, counted in Arrow
    batches, written to the shared folder once and read again by every fit."""
    spark, kept = df.sparkSession, [c for c in df.columns if c != text]

    def run(batches):
        for batch in batches:
            at = 0
            for counts in terms.counted(batch.column("_w"), dimensions):
                n = len(counts[0][0]) - 1
                rows = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], *[terms.vectors(c, dimensions) for c in counts]], [*kept, *[f"{name}_tf" for name in TERMS]])
                at += n

    fields, stored = df.select(*kept).schema.fields, VectorUDT.sqlType()
    as_type = lambda kind: StructType([*fields, *[StructField(f"{name}_tf", kind) for name in TERMS]])
    path = shared_path(spark, "term-counts")
    df.select(*kept, lower_words(F.col(text)).alias("_w")).mapInArrow(run, as_type(stored)).write.parquet(path)
    return spark.read.schema(as_type(VectorUDT())).parquet(path)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: n / (k * n_class), from counts joined by class (a row for each class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("t"), F.count("*").alias("k")).first()
    return df.join(F.broadcast(counts.withColumn("weight", F.lit(float(total.t)) / (total.k * F.col("_n"))).drop("_n")), label)


def train_classifier(train: DataFrame, text: str, label: str, rounds: int = 30, dimensions: int = 1 << 14, reg: float = 0.01, even: bool = False) -> PipelineModel:
    """Logistic regression over the n-gram features, classes balanced or, where ``even``, each row weighing alike. Terms of
    a text are counted once."""
    counts = term_counts(train.select(text, label), text, dimensions)
    stages = [StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="keep", stringOrderType="alphabetAsc"), Pipeline(stages=weighted_features()), LogisticRegression(labelCol="label_index", weightCol="weight", maxIter=rounds, regParam=reg)]
    return Pipeline(stages=stages).fit(counts.withColumn("weight", F.lit(1.0)) if even else balanced(counts, label))


def predict(model: PipelineModel, df: DataFrame, text: str) -> DataFrame:
    """Adds ``predicted`` and ``confidence``: the model's weights and coefficients over counts of terms, in Arrow batches."""
    names, features, fit = model.stages[0].labels, model.stages[1].stages, model.stages[-1]
    weights = [s.idf.toArray() for s in features if hasattr(s, "idf")]
    coefficients, intercepts = fit.coefficientMatrix.toArray().T, fit.interceptVector.toArray()
    if coefficients.shape[1] == 1:  # of two classes, the first has a margin of 0
        coefficients, intercepts = np.hstack([np.zeros_like(coefficients), coefficients]), np.append(0.0, intercepts)
    dimensions = len(weights[0])
    parts = coefficients[:dimensions].copy(), coefficients[dimensions:].copy()

    @F.arrow_udf("struct<prediction: int, confidence: double>")
    def told(words: pa.Array) -> pa.Array:
        best, sure = [np.empty(0, np.int32)], [np.empty(0)]
        for counts in terms.counted(words, dimensions):
            p = terms.shares(intercepts + sum(terms.margins(*x) for x in zip(counts, weights, parts)))
            best.append(p.argmax(axis=1).astype(np.int32))
            sure.append(p.max(axis=1))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (best, sure)], ["prediction", "confidence"])

    # Not deterministic to the optimizer, which else repeats it in a filter on its results and in what they are selected for.
    out = df.withColumn("_told", told.asNondeterministic()(lower_words(F.col(text))))
    return out.withColumn("confidence", F.col("_told.confidence")).withColumn("predicted", F.try_element_at(F.array(*[F.lit(x) for x in names]), F.col("_told.prediction") + 1)).drop("_told")


def classification_report(pairs: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class from one pass over a confusion table; 0 where empty."""
    cells = pairs.groupBy(label, predicted).agg(F.count("*").alias("c"))
    marked = cells.select(F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit("t").alias("side")), F.struct(F.col(predicted).alias("class"), F.lit("p").alias("side")))).alias("x"), "c", (F.col(label) == F.col(predicted)).alias("hit"))
    sums = marked.groupBy("x.class").agg(
        F.sum(F.when(F.col("x.side") == "t", F.col("c")).otherwise(0)).alias("support"), F.sum(F.when(F.col("x.side") == "p", F.col("c")).otherwise(0)).alias("n_predicted"),
        F.sum(F.when((F.col("x.side") == "t") & F.col("hit"), F.col("c")).otherwise(0)).alias("hits"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = sums.withColumn("precision", ratio(F.col("hits"), F.col("n_predicted"))).withColumn("recall", ratio(F.col("hits"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


COMPLIANT = "compliant"


# Names for what marks a citation's form beside its words.
MARKS = ((r"\b[0-9]{4}\b", "yearlike"), (r"[0-9]+", "numlike"), ('["“”]', "quotemark"), (r"\[", "bracket"), (r"\(", "paren"), ("&", "ampersand"))


def citation_shape(text: Column) -> Column:
    """A citation with its numbers and marks named by words, so that word n-grams hold its form."""
    for pattern, name in MARKS:
        text = F.regexp_replace(text, pattern, f" {name} ")
    return text


def train_citation_models(labelled: DataFrame, most: int = 4000, rounds: int = 30, dimensions: int = 1 << 12) -> tuple[PipelineModel, PipelineModel]:
    """Two models of citations (text, style, issue): their style, and what is wrong with them, a null issue being a
    compliant one. Classes are balanced. Fitted on at most ``most`` rows drawn by hash, the bound of what is read for
    the fit; rows without a text or a style take no part."""
    rows = labelled.where("text is not null and style is not null").select(citation_shape(F.col("text")).alias("text"), "style", F.coalesce("issue", F.lit(COMPLIANT)).alias("issue"))
    path = shared_path(labelled.sparkSession, "labelled-citations")  # both fits read them again and again
    rows.dropDuplicates().orderBy(F.xxhash64("text", "style", "issue"), "text").limit(most).repartition("text").write.parquet(path)
    drawn = labelled.sparkSession.read.parquet(path)
    return tuple(train_classifier(drawn, "text", label, rounds, dimensions, reg=1e-3) for label in ("style", "issue"))


def predict_citations(models: tuple[PipelineModel, PipelineModel], df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``style`` and ``style_confidence``, ``compliant``, ``issue`` (null for compliant ones) and ``issue_confidence``.
    Two narrow passes of the models over every row; a null text is told like an empty one."""
    some = df.withColumn("_text", citation_shape(F.coalesce(F.col(text), F.lit(""))))
    first = predict(models[0], some, "_text").select(*some.columns, F.col("predicted").alias("style"), F.col("confidence").alias("style_confidence"))
    out = predict(models[1], first, "_text").withColumn("compliant", F.col("predicted") == COMPLIANT)
    return out.select(*df.columns, "style", "style_confidence", "compliant", F.when(~F.col("compliant"), F.col("predicted")).alias("issue"), F.col("confidence").alias("issue_confidence"))
