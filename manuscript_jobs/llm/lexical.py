"""Ranked lexical search: the best documents of every item of a query table, by pair-bound MaxScore.

Terms are runs of letters, digits and bytes of 0x80 or more, A-Z lower-cased. One pass over the texts keeps, of each
document, its count of terms and how often it holds each term of the items; that table gives the corpus counts. Then
every task turns bounded blocks of it into postings with exact integer impacts. Ahead of the items a block
intersects the postings of term pairs that the items name and keeps each pair's joint maximum impact and the
documents that reach it. An item pairs its terms so that the joint maxima save most against the terms' own; pairs and
terms left over are its units. Units whose bounds together stay under the item's k-th score are not
essential: documents that hold none of the others are skipped, and those that do drop out as soon as what
is left can't lift them. The k-th score starts from the documents of the pair lists and is handed from block to block
of a task. A task gives k rows an item at most; a ranking over them ends it.

Items are taken in blocks of bounded count and size, each a search of its own; only a block's items and counts of its
terms are on the driver and in the tasks.

Null and empty texts have no terms: such items find nothing and such documents count nowhere. Equal scores go by
ascending id, null ids last. Rows of one id, or of one text, are each a document; each row of the item
table is an item. Empty tables give no rows. Only ids and texts are read of either table.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import Scratch, text_batches

#: Maps A-Z to a-z and every byte outside of terms to a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Items and bytes of item texts in a block; documents and postings in a block of a task; seeds of a pair list.
ITEMS, ITEM_BYTES = 4096, 1 << 23
ROWS, POSTINGS = 1 << 16, 1 << 21
SEEDS = 32


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def candidate_pairs(items: list[dict[int, int]], weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """Of each item, the pairs (a, b) of terms that are neighbours, or one apart, from light to heavy."""
    out = []
    for counts in items:
        order = sorted(counts, key=lambda t: (weights[t], t))
        out.append([(min(a, b), max(a, b)) for step in (1, 2) for a, b in zip(order, order[step:])])
    return out


class Block:
    """Postings of some documents: ``docs[start[t]:start[t + 1]]`` hold term t, with ``impact`` beside."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, rows: int, n_terms: int, pairs: set[tuple[int, int]]):
        order = np.argsort(term, kind="stable")
        self.docs, self.impact, self.rows = doc[order], impact[order], rows
        held = np.bincount(term, minlength=n_terms)
        self.start = np.concatenate([[0], np.cumsum(held)])
        self.most = np.zeros(n_terms, np.int64)
        some = np.flatnonzero(held)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.impact, self.start[some])
        self.joint, self.top = {}, {}
        self.sums = np.zeros(rows, np.int64)
        by_long: dict[int, list[int]] = {}
        for a, b in pairs:
            long, short = (a, b) if held[a] >= held[b] else (b, a)
            if held[short]:
                by_long.setdefault(long, []).append(short)
        for long, shorts in by_long.items():  # a pair's list: the documents of its rarer term that hold the other
            docs, impact = self.posting(long)
            self.sums[docs] = impact
            for short in shorts:
                some, impact = self.posting(short)
                other = self.sums[some]
                both = np.flatnonzero(other)
                if len(both):
                    total = other[both] + impact[both]
                    if len(both) > SEEDS:
                        best = np.argpartition(total, len(both) - SEEDS)[-SEEDS:]
                        both, total = both[best], total[best]
                    key = (min(long, short), max(long, short))
                    self.joint[key], self.top[key] = int(total.max()), some[both]
            self.sums[docs] = 0

    def posting(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        return self.docs[self.start[t] : self.start[t + 1]], self.impact[self.start[t] : self.start[t + 1]]

    def units(self, counts: dict[int, int], pairs: list[tuple[int, int]]) -> list[tuple[int, tuple[int, ...]]]:
        """(bound, terms) of an item, ascending: disjoint pairs that save most, and the other terms alone."""
        single = {t: q * int(self.most[t]) for t, q in counts.items() if self.most[t]}
        saved = []
        for a, b in pairs:
            if a in single and b in single:
                few, more = (a, b) if counts[a] <= counts[b] else (b, a)
                both = counts[few] * self.joint.get((a, b), 0) + (counts[more] - counts[few]) * int(self.most[more]) if (a, b) in self.joint else 0
                bound = max(both, single[a], single[b])
                if bound < single[a] + single[b]:
                    saved.append((single[a] + single[b] - bound, bound, (a, b)))
        out = []
        for _, bound, pair in sorted(saved, key=lambda x: (-x[0], x[2])):
            if pair[0] in single and pair[1] in single:
                del single[pair[0]], single[pair[1]]
                out.append((bound, pair))
        return sorted(out + [(bound, (t,)) for t, bound in single.items()])

    def added(self, scores: np.ndarray, among: np.ndarray, some: tuple[int, ...], counts: dict[int, int]) -> None:
        """Adds the terms' impacts to ``scores`` of the ascending documents ``among``."""
        for t in some:
            docs, impact = self.posting(t)
            at = np.searchsorted(docs, among)
            at[at == len(docs)] = 0
            hit = docs[at] == among
            scores[hit] += counts[t] * impact[at[hit]]

    def search(self, counts: dict[int, int], pairs: list[tuple[int, int]], floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all whose score is at least ``floor`` and the block's k-th best as far as it is known."""
        units = self.units(counts, pairs)
        floor = max(floor, 1)
        seeds = [self.top[p] for p in pairs if p in self.top]
        if seeds:
            seeds = np.unique(np.concatenate(seeds))
            if len(seeds) >= k:
                scores = np.zeros(len(seeds), np.int64)
                for _, some in units:
                    self.added(scores, seeds, some, counts)
                floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        upto = np.cumsum([0] + [bound for bound, _ in units])
        spare = int(np.searchsorted(upto, floor, "left")) - 1  # the units that can't reach the floor together
        for _, some in units[spare:]:
            for t in some:
                docs, impact = self.posting(t)
                self.sums[docs] += counts[t] * impact
        found = np.flatnonzero(self.sums)
        scores = self.sums[found]
        self.sums[found] = 0
        for i in range(spare, -1, -1):
            good = scores + upto[i] >= floor
            found, scores = found[good], scores[good]
            if i and len(found):
                self.added(scores, found, units[i - 1][1], counts)
        return found, scores


def _counted(docs: DataFrame, index) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with terms."""

    def made(batches):
        known = index.value
        for batch in batches:
            data, offsets = H.text_bytes(batch.column(1))
            at, rows, n, ids, counts, upto = offsets.tolist(), [], [], [], [], [0]
            for d, (s, e) in enumerate(zip(at, at[1:])):
                words = terms(data[s:e].tobytes())
                if not words:
                    continue
                held = Counter(map(known.get, words))
                held.pop(None, None)
                rows.append(d), n.append(len(words))
                ids += held.keys()
                counts += held.values()
                upto.append(len(ids))
            ends = pa.array(upto, pa.int32())
            cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "terms", "counts"])

    return text_batches(docs).mapInArrow(made, "doc_id long, n long, terms array<int>, counts array<long>")


def _held(counted: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term stands; a row a term and task is all that is shuffled."""

    def made(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten(), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for term, df in counted.select("terms").mapInArrow(made, "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # the terms of a block of items
        out[term] = df
    return out


def _best(ids, null, scores, k):
    order = np.lexsort((ids, null, -scores))[:k]
    return ids[order], null[order], scores[order]


def _searched(counted: DataFrame, shared, n_docs: int, n_words: int, k: int, block_rows: int) -> DataFrame:
    """(item, doc_id, score): of each task, the k best documents of each item."""

    def ranked(batches):
        numbers, items, weights = shared.value
        pairs = candidate_pairs(items, weights)
        every = {p for own in pairs for p in own}
        none = np.zeros(0, np.int64)
        best = [(none, none.astype(bool), none)] * len(items)

        def run(held):
            batch = pa.Table.from_batches(held).combine_chunks()
            ids, n = batch["doc_id"].fill_null(0).to_numpy(), batch["n"].to_numpy()
            null = batch["doc_id"].is_null().to_numpy()
            lists = batch["terms"].combine_chunks()
            term, tf = lists.flatten().to_numpy(), batch["counts"].combine_chunks().flatten().to_numpy()
            doc = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
            m = 75 + (25 * n * n_docs // n_words if 25 * int(n.max(initial=0)) * n_docs < 1 << 63 else np.array([25 * x * n_docs // n_words for x in n.tolist()], np.int64))
            block = Block(term, doc, weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc])), len(n), len(weights), every)
            for i, counts in enumerate(items):
                mine = best[i]
                floor = int(mine[2][-1]) if len(mine[2]) == k else 1
                found, scores = block.search(counts, pairs[i], floor, k)
                if len(found):
                    best[i] = _best(np.concatenate([mine[0], ids[found]]), np.concatenate([mine[1], null[found]]), np.concatenate([mine[2], scores]), k)

        held, rows, size, step = [], 0, 0, min(1024, block_rows)
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                held.append(part)
                rows, size = rows + part.num_rows, size + len(part.column(2).flatten())
                if rows >= block_rows or size >= POSTINGS:
                    run(held)
                    held, rows, size = [], 0, 0
        if held:
            run(held)
        cols = [np.repeat(numbers, [len(b[0]) for b in best]), *(np.concatenate([b[j] for b in best]) if best else none for j in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], mask=cols[2].astype(bool)), pa.array(cols[3], pa.int64())], ["item", "doc_id", "score"])

    return counted.mapInArrow(ranked, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", most_items: int = ITEMS, block_rows: int = ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item, its ``k`` documents of highest score above 0, or all.

    A document of n terms has m = 75 + (25 * n * N) div L; a term w = floor(1000 * ln((2 N + 2) / (2 df + 1))); the score
    sums w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms with repeats.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = scratch.cut(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    total = asked.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-total.rows // most_items), -(-(total.bytes or 0) // ITEM_BYTES))
    found = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "text").collect()  # a block of bounded size
        counts = [Counter(terms((r.text or "").encode())) for r in rows]
        index = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        counted = scratch.cut(_counted(base, spark.sparkContext.broadcast(index)), f"counted-{b}")
        n = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
        df = _held(counted, len(index))
        weights = np.array([weight(n.docs, int(x)) for x in df], np.int64)
        shared = spark.sparkContext.broadcast((np.array([r.item for r in rows], np.int64), [{index[t]: q for t, q in c.items()} for c in counts], weights))
        part = scratch.cut(_searched(counted, shared, n.docs, n.words or 1, k, block_rows), f"found-{b}")
        scratch.drop(f"counted-{b}")
        found = part if found is None else found.union(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
