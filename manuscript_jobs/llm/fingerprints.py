"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct hashes of a document's shingles. Sketches of parts merge into the
sketch of the whole; two sketches estimate resemblance, containment and the count of distinct
shingles. Empty texts have an empty sketch; two empty sketches resemble each other fully, an empty and
a full one not at all.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import width

K, SIZE = 256, 5
#: Characters of a range of documents.
RANGE_CHARS = 1 << 25


def sketches(texts: list[str], k: int = K, size: int = SIZE) -> list[np.ndarray]:
    data, offsets = H.text_bytes(pa.array(texts, pa.large_string()))
    out = []
    for a, b in H.slices(offsets):
        hashes, bounds = H.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
        out += [hashes[s : min(s + k, e)].copy() for s, e in zip(bounds[:-1], bounds[1:])]
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what two sketches stand for."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the union's shingles that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    total = len(both) - int(twice.sum())
    if total > k:
        first = np.ones(len(both), bool)
        first[1:] = ~twice
        cut = both[first][k - 1]
        return float((twice & (both[1:] <= cut)).sum()) / k
    return float(twice.sum()) / total


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8").astype(np.uint64)


def fingerprint(docs: DataFrame, k: int = K, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, n_shingles_est) of every row, without a shuffle."""

    def made(batches):
        for batch in batches:
            found = sketches([t or "" for t in batch.column(1).to_pylist()], k, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(map(encode, found), pa.string()), pa.array([distinct_count(f, k) for f in found], pa.float64())],
                [doc_id, "fingerprint", "n_shingles_est"],
            )

    return docs.select(F.col(doc_id).cast("long").alias(doc_id), text).mapInArrow(made, f"{doc_id} long, fingerprint string, n_shingles_est double")


def neighbour_likeness(docs: DataFrame, k: int = K, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints each document, its edited text (the last quarter of its code points replaced by the
    first as many of the next document) and compares both and the next document's.

    Documents are ordered by id (null first), rows of one id by text; after the last comes the first.
    Texts are shuffled once, into ranges of ids whose bounds are ids of the table; a range also gets
    the rows of the next range's first id, so that each range knows its last document's next one. Only
    the bounds (one for each RANGE_CHARS characters, four for each shuffle partition at least) pass through the driver.
    """
    spark = docs.sparkSession
    id_ = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col(doc_id).cast("long").alias("_own"), id_.alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    size_of = rows.agg(F.sum(F.length("_text") + 16)).first()[0] or 0
    parts = max(4 * width(spark), size_of // RANGE_CHARS)
    row = rows.agg(F.percentile_approx("_id", [i / parts for i in range(1, parts)] if parts > 1 else [0.5], 20 * parts).alias("q"), F.min("_id").alias("m")).first()
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    least = row.m
    bounds = np.array(sorted({b for b in row.q or [] if b != least}), np.int64)
    count = len(bounds)

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series) -> pd.Series:
        x = ids.to_numpy(np.int64)
        at = np.searchsorted(bounds, x, "right")
        first = np.zeros(len(x), bool)
        if count:
            first[at > 0] = bounds[at[at > 0] - 1] == x[at > 0]
        wrap = x == least
        return pd.Series(
            [[2 * a] + ([2 * (a - 1) + 1] if f else []) + ([2 * count + 1] if w else []) for a, f, w in zip(at.tolist(), first.tolist(), wrap.tolist())]
        )

    # An even place is a document's own; an odd one is a copy that only serves as the range's next.
    dealt = rows.withColumn("_place", F.explode(ranges("_id"))).withColumn("_range", F.expr("_place div 2"))
    dealt = dealt.repartition(max(width(spark), size_of // RANGE_CHARS), "_range").sortWithinPartitions("_range", "_place", "_id", "_text")

    def compared(batches):
        held = None  # (range, id, text, sketch), the last document without its next yet
        for batch in batches:
            place, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            todo, at = [], 0
            while at < len(ids):
                size_now, stop = 0, at
                while stop < len(ids) and (stop == at or size_now < 1_000_000):
                    size_now += len(texts[stop])
                    stop += 1
                own = sketches(texts[at:stop], k, size)
                todo = [held] if held else []
                todo += [(p // 2, p % 2, i, t, s) for p, i, t, s in zip(place[at:stop], ids[at:stop], texts[at:stop], own)]
                held, at = todo[-1], stop
                pairs = [(a, b) for a, b in zip(todo, todo[1:]) if not a[1]]
                edited = []
                for a, b in pairs:
                    n = len(a[3]) // 4
                    edited.append(a[3][: len(a[3]) - n] + b[3][:n])
                marks = sketches(edited, k, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[2] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([encode(a[4]) for a, _ in pairs], pa.string()),
                        pa.array([encode(m) for m in marks], pa.string()),
                        pa.array([resemblance(a[4], m, k) for (a, _), m in zip(pairs, marks)], pa.float64()),
                        pa.array([resemblance(a[4], b[4], k) for a, b in pairs], pa.float64()),
                    ],
                    [f.split()[0] for f in schema.split(", ")],
                )

    return dealt.select("_place", "_own", "_text").mapInArrow(compared, schema)
