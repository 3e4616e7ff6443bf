"""Exact top-k by inner product, over KD-trees of shards of the vectors.

Components are quantised to floor(256 * x) as double. Vectors fall into shards of bounded size by a
hash of their rows, queries into blocks; each (shard, block) pair is one task's work. A shard's tree
splits at the median of its widest component, with tight bounding boxes. The inner product of a query
with any vector in a box is at most the sum of its products with the box's better corner; nodes are
visited best bound first until no bound reaches the k-th score. Shards are searched in rounds of one, two, four and
so on; the k-th score that the rounds before have found is handed on as a floor.

Every query meets every shard, so rows shuffled are vectors x query blocks + queries x shards: for a query set in
proportion to the vectors the work is quadratic, as an exact search without pruning is.

Vectors that are null, empty or hold null or non-finite components take no part; all finite ones do, whatever their size.
Vectors whose scores might pass 64 bits (max^2 * length of 2^63 or more) have a tree of their own in each shard, over
integers of any length. A score beyond 64 bits is ranked by its exact value and given as the nearest 64-bit integer. Only
vectors of equal length meet. Scores beyond 2^53 are summed as 64-bit integers. A query's own row is left out, other
rows of its id are not. Ties go to the smaller id, a null id after all others: a row without an id is a candidate and
never a query. Each row of a repeated id is a candidate, and a query where chosen.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

LEAF = 256
LONGS = (-(1 << 63), (1 << 63) - 1)
_NAMELESS = 1 << 62  # added to the row of a vector without an id


class KdTree:
    """Median splits over vectors of int64, or of integers of any length; boxes are tight. ``ids`` and ``rows`` name the vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        lows, highs, spans, kids = [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            s, e, parent, side = todo.pop()
            own = vectors[order[s:e]]
            low, high = own.min(0), own.max(0)
            at = len(spans)
            lows.append(low), highs.append(high), spans.append((s, e)), kids.append([-1, -1])
            if parent >= 0:
                kids[parent][side] = at
            axis = int((high - low).argmax())
            if e - s > leaf and high[axis] > low[axis]:
                mid = (e - s) // 2
                along = own[:, axis]
                order[s:e] = order[s:e][np.argsort(along, kind="stable") if along.dtype == object else np.argpartition(along, mid)]
                todo += [(s, s + mid, at, 0), (s + mid, e, at, 1)]
        self.most = int(np.abs(vectors).max(initial=0))
        self.exact = vectors.dtype == object
        self.whole, self.ids, self.rows = vectors[order], ids[order], rows[order]
        self.vectors = self.whole if self.exact else self.whole.astype(np.float64)
        self.low, self.high = (np.array(x, object if self.exact else np.float64) for x in (lows, highs))
        self.spans, self.kids = spans, kids

    def scores(self, s: int, e: int, query: np.ndarray) -> np.ndarray:
        """Exact inner products: in float64 where no sum can pass 2^53, in int64 or integers of any length else."""
        if self.exact:
            return self.whole[s:e] @ query
        if self.most * int(np.abs(query).max(initial=0)) * len(query) < 1 << 53:
            return (self.vectors[s:e] @ query.astype(np.float64)).astype(np.int64)
        return self.whole[s:e] @ query

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None, bound: np.ndarray) -> list[tuple[int, int, int]]:
        """Up to k (score, id, row) with score >= floor, best first. ``bound`` has each node's bound for the query."""
        best: list[tuple[int, int, int]] = []  # a heap, worst first: (score, -id, -row)
        todo = [(-bound[0], 0)]
        floor = float("-inf") if floor is None else floor
        while todo:
            reach, node = heapq.heappop(todo)
            least = max(floor, best[0][0]) if len(best) == k else floor
            if -reach < least:
                break  # a bound equal to the k-th score may still hold a smaller id
            left, right = self.kids[node]
            if left >= 0:
                heapq.heappush(todo, (-bound[left], left))
                heapq.heappush(todo, (-bound[right], right))
                continue
            s, e = self.spans[node]
            scores = self.scores(s, e, query)
            good = np.flatnonzero((scores >= least) & (self.rows[s:e] != own))
            if len(good) > k and not self.exact:  # of many, those up to the k-th and its ties
                cut = np.partition(scores[good], len(good) - k)[len(good) - k]
                good = good[scores[good] >= cut]
            for i in good.tolist():
                item = (int(scores[i]), -int(self.ids[s + i]), -int(self.rows[s + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i, -r) for s, i, r in sorted(best, reverse=True)]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Of each query and node: no vector in the node's box has a higher inner product. Rounding is made up for."""
        if self.exact:
            return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        x = queries.astype(np.float64)
        bound = np.maximum(x, 0) @ self.high.T + np.minimum(x, 0) @ self.low.T
        return bound + (np.abs(x) @ np.maximum(np.abs(self.low), np.abs(self.high)).T) * 2.0**-40


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _integers(x: np.ndarray, wide: bool) -> np.ndarray:
    """floor(256 * x), exactly: int64, or integers of any length."""
    if not wide:
        return np.floor(x * 256).astype(np.int64)
    return np.array([[int(v) * 256 if abs(v) >= 1 << 52 else int(np.floor(v * 256)) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _beyond(score: int) -> str:
    """Orders scores that share a 64-bit value: "m" within 64 bits, else a text that sorts as the score does."""
    if LONGS[0] <= score <= LONGS[1]:
        return "m"
    digits = f"{abs(score):x}"
    if score > 0:
        return f"z{len(digits):08x}{digits}"
    return f"a{0xFFFFFFFF - len(digits):08x}" + "".join(f"{15 - int(d, 16):x}" for d in digits) + "g"


def _search_pairs(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Cogroups (shard, block, dim) parts; queries carry a floor."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            far, near, large = _matrix(right["v"]), _matrix(left["v"]), left["wide"].to_numpy()
            ids, rows, asks_large = left["id"].to_numpy(), left["row"].to_numpy(), right["wide"].to_numpy()
            own, floors = right["row"].to_pylist(), right["floor"].to_pylist()
            # Plain queries meet plain vectors in 64 bits; all other pairs meet in integers of any length.
            for vector_set, query_set, exact in ((~large, ~asks_large, False), (large, ~asks_large, True), (np.ones(len(large), bool), asks_large, True)):
                if vector_set.any() and query_set.any():
                    tree = KdTree(_integers(near[vector_set], exact), ids[vector_set], rows[vector_set])
                    asked = _integers(far[query_set], exact)
                    bound = tree.bounds(asked)
                    for i, q in enumerate(np.flatnonzero(query_set).tolist()):
                        found += [(own[q], *x) for x in tree.search(asked[i], own[q], k, floors[q], bound[i])]
        query, score, vec, row = list(zip(*found)) or [(), (), (), ()]
        cols = [pa.array(c, pa.int64()) for c in (query, [min(max(x, LONGS[0]), LONGS[1]) for x in score], vec, row)]
        return pa.table([cols[0], cols[1], pa.array([_beyond(x) for x in score], pa.string()), cols[2], cols[3]], ["query_row", "score", "beyond", "vec_id", "vec_row"])

    keys = ("shard", "block", "dim")
    return vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, "query_row long, score long, beyond string, vec_id long, vec_row long")


def top_k(vectors: DataFrame, queries, k: int = 5, shard_rows: int = 8192, block_rows: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    ``queries`` is a predicate on ``vec_id`` that chooses the query rows. Every vector is indexed. A
    task holds one shard and one block of queries, both of bounded size whatever the input.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    x = F.col(embedding)
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    most = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))) * 256 + 1
    row, number = F.monotonically_increasing_id(), F.col(vec_id).cast("long")  # rows are numbered as they are written
    whole = vectors.where(x.isNotNull() & (F.size(x) > 0) & fine).select(
        F.coalesce(number, F.lit(LONGS[1])).alias("id"), F.transform(x, lambda v: v.cast("double")).alias("v"), F.size(x).alias("dim"),
        (most * most * F.size(x) >= float(1 << 63)).alias("wide"), F.when(number.isNull(), row + _NAMELESS).otherwise(row).alias("row"),
    )
    whole = scratch.cut(whole, "vectors")
    asked = scratch.read("vectors", whole.schema).where((F.col("row") < _NAMELESS) & queries(F.col("id")))
    shards, blocks = max(1, -(-whole.count() // shard_rows)), max(1, -(-asked.count() // block_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    placed = whole.withColumn("shard", F.pmod(F.xxhash64("row", "v"), F.lit(shards)))
    spread = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id", "vec_row")
    found, low, n = None, 0, 0
    while low < shards:
        high = min(2 * low + 1, shards)  # shards low to high - 1
        handed = asked.withColumn("floor", F.lit(None).cast("long"))
        if found is not None:
            kth = found.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where((F.col("n") >= k) & (F.col("floor") > LONGS[0]))
            handed = asked.join(kth.select(F.col("query_row").alias("row"), "floor"), "row", "left")
        handed = handed.withColumn("shard", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))))
        made = _search_pairs(spread.where(F.col("shard").between(low, high - 1)), handed, k)
        ranked = (made if found is None else found.drop("rank").union(made)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found, low, n = scratch.cut(ranked, f"found-{n}"), high, n + 1
    names = asked.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    named = F.when(F.col("vec_row") < _NAMELESS, F.col("vec_id")).alias("vec_id")
    return found.join(names, "query_row").select("query_id", "rank", named, "score")
