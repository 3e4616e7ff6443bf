"""N-gram Jaccard join: groups of documents linked by a similarity of their word-shingle sets.

Sizes are divided into bands; a tile pairs a band with the sizes that can link to it. Hashes have one order
for all sets: those that a count sketch of fixed size finds frequent come last. A set of n hashes shows the
first n - ceil(t * n) + 1 of them in each of its tiles; two sets that link at similarity t have one of these in
common, since otherwise too few are left to share. What meets is bounded from above by hashed bitmaps and
decided by exact sorted-array intersection (``similarity``). No link is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import Scratch
from .similarity import COUNTERS, classes_of, components, levels, prepared

_U = np.uint64
_LAST = 2**63 - 1


class Tiles:
    """Bands of set sizes, each ``step`` times as wide as the one below, and how far a tile reaches above its band."""

    def __init__(self, num: int, den: int, step: int = 3, most: int = 1 << 40):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < most:
            low.append(low[-1] * step)
        self.low = np.array(low, np.int64)
        self.reach = (self.low[1:] - 1) * den // num  # the largest partner of a set of the band

    def of(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The band of each size, and whether the tile of the band below reaches it."""
        own = np.searchsorted(self.low, size, "right") - 1
        return own, (own > 0) & (size <= self.reach[np.maximum(own - 1, 0)])


def shown(hashes: np.ndarray, bounds: np.ndarray, tiles: Tiles, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, hash): the first hashes of each set by (level, hash), as many as a link needs. A set that no other
    can link with shows none."""
    size = np.diff(bounds)
    need = np.where(size * tiles.den >= tiles.num * (size + 1), size + (-size * tiles.num) // tiles.den + 1, 0)
    of = np.repeat(np.arange(len(size)), size)
    rank = level[(hashes & _U(COUNTERS - 1)).astype(np.int64)]
    cold = rank == 0
    upto = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(cold, out=upto[1:])
    take = cold & (upto[:-1] - upto[bounds[:-1]][of] < need[of])  # hashes of a set are in ascending order
    for i in np.flatnonzero(upto[bounds[1:]] - upto[bounds[:-1]] < need).tolist():
        s, e = bounds[i], bounds[i + 1]
        hot = np.flatnonzero(~cold[s:e]) + s
        short = need[i] - (e - s - len(hot))
        take[hot[np.argsort(rank[hot], kind="stable")[:short]]] = True
    return of[take], hashes[take]


def signatures(hashes: np.ndarray, bounds: np.ndarray, tiles: Tiles, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature): each shown hash in each tile of its set."""
    of, some = shown(hashes, bounds, tiles, level)
    own, below = tiles.of(np.maximum(np.diff(bounds), 1))
    tile = lambda number: H.mix((number + 2).astype(_U) * _U(0xD6E8FEB86659FD93))
    low = below[of]
    sigs = np.concatenate([H.mix(some + tile(own)[of]), H.mix(some[low] + tile(own - 1)[of[low]])])
    return np.concatenate([of, of[low]]), sigs


def whole_texts(size: int):
    def itemise(data, offsets):
        hashes, bounds = H.shingle_sets(data, offsets, size)
        n = len(bounds) - 1
        return np.arange(n), np.zeros(n, np.int64), hashes, bounds

    return itemise


def join_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: two documents link when
    den * |intersection| >= num * |union| of their sets of ``size``-word shingles; a component is named by
    its smallest id.

    A text of fewer words is one shingle. Null and empty texts, or texts without words, have an empty set
    and stay alone. Rows that share an id share a component; a null id is an id after all others. Repeated
    rows stay rows; an empty table gives none. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc_id"), F.col(text).alias("text"))
    tiles, itemise = Tiles(num, den), whole_texts(size)
    level = levels(docs, itemise)
    prep = scratch.cut(prepared(docs, itemise, lambda _, hashes, bounds: signatures(hashes, bounds, tiles, level)), "prepared")
    prep, classes, signed = classes_of(prep, scratch)
    rows = scratch.cut(prep.select("doc_id", "n", "key"), "rows")
    # Rows of one id with different texts belong together.
    several = rows.where("n > 0").groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("_top")).where("a <> _top")
    several = rows.where("n > 0").select("doc_id", "key").join(several.select("doc_id", "a"), "doc_id").select("a", F.col("key").alias("b"))
    joined = components(prep, signed, docs, itemise, num, den, scratch, several)
    named = classes.select("key", "rep").join(joined, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = scratch.cut(named.join(least, "component").select("key", "component_id"), "named")
    id_ = lambda c: F.nullif(c, F.lit(_LAST))
    return rows.join(named, "key", "left").select(
        id_(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), id_(F.coalesce("component_id", "doc_id")).alias("component_id")
    )
