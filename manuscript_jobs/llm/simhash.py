"""SimHash near-duplicates: every link within a Hamming radius, over vantage-point trees of equal parts.

A document's words (runs of bytes other than space and 0x09-0x0D, A-Z lower-cased) give word shingles, repeats
included; a bit of its fingerprint is set where it is set in over half of the shingles' XXH64 hashes. Documents of
one fingerprint are a class, so copies never meet; only distinct fingerprints do.

A fingerprint is cut into one part more than the radius has bits, so two that link have an equal part. It is dealt
once for each part, to a shard drawn from the part's value: as many rows as there are parts, however many shards. In a shard's
task those of one value are searched together: few by pairs at a time, many in a vantage-point tree with the tight range of
distances of every branch, where the triangle inequality leaves branches out. Values that more than ``shard_rows``
fingerprints have are dealt further, each by a vantage-point tree over a bounded sample of them: a node has a vantage
point and a cut, nearer ones go inside and others outside; a fingerprint belongs to one such shard and visits every later
one that its ball of the radius reaches, so of a linked pair one meets the other. Links are kept as a forest, so a dense
shard gives a row a fingerprint and not its pairs.

Null or empty texts, and texts without words, have fingerprint zero and link like any other; a text of fewer
words than a shingle has its whole sequence as one. A null id is named by no component unless all ids of it are null
(then the component is null). Repeated rows come out as often as they went in. An empty table gives no rows.
Only ids and texts are read, so further columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import Scratch, connected_components, text_batches, width

_U = np.uint64
_LOWER = bytes(H.LOWER)
LEAF = 96
#: Fingerprints of a shard at most on average, and shingles hashed at once.
SHARD, CHUNK = 1 << 20, 1 << 16
#: Fingerprints asked of a tree at once.
QUERIES = 2048
#: Sampled fingerprints a shard, for the tree that deals to shards.
SAMPLE = 64


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < size:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([xxh64_intdigest(line[s:e], seed) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def distance(a, b):
    return np.bitwise_count(a ^ b).astype(np.int64)


def split(points: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """(vantage point, cut, distances) that halve distinct points best; None where no point splits them well."""
    best = None
    for k in range(4):
        vantage = points[(2 * k + 1) * len(points) // 8]
        d = distance(points, vantage)
        cut = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        cut -= int((d <= cut).all())
        inside = int((d <= cut).sum())
        less = min(inside, len(d) - inside)
        if best is None or less > best[0]:
            best = less, vantage, cut, d
        if 3 * less >= len(d):
            break
    return None if best[0] * 32 < len(points) else best[1:]


class VantageTree:
    """Distinct fingerprints under median splits by distance; every branch knows its least and greatest distance."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        self.vantage, self.kids, self.span, self.range = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            s, e, parent, side = todo.pop()
            at = len(self.span)
            self.vantage.append(_U(0)), self.kids.append([-1, -1]), self.span.append((s, e)), self.range.append([None, None])
            if parent >= 0:
                self.kids[parent][side] = at
            own = order[s:e]
            found = split(points[own]) if e - s > leaf else None
            if found is not None:
                self.vantage[at], cut, d = found
                inside = d <= cut
                mid = s + int(inside.sum())
                order[s:e] = np.concatenate([own[inside], own[~inside]])
                self.range[at] = [(int(x.min()), int(x.max())) for x in (d[inside], d[~inside])]
                todo += [(s, mid, at, 0), (mid, e, at, 1)]
        self.order, self.points = order, points[order]

    def pairs(self, asked: np.ndarray, radius: int):
        """(number of the query, number of the point) arrays of all pairs within the radius, in pieces."""
        todo = [(0, np.arange(len(asked)))] if len(self.points) else []
        while todo:
            node, who = todo.pop()
            if self.kids[node][0] >= 0:
                d = distance(asked[who], self.vantage[node])
                for kid, (low, high) in zip(self.kids[node], self.range[node]):
                    near = who[(d >= low - radius) & (d <= high + radius)]
                    if len(near):
                        todo.append((kid, near))
                continue
            s, e = self.span[node]
            step = max(1, (1 << 20) // (e - s))
            for at in range(0, len(who), step):
                some = who[at : at + step]
                q, p = np.nonzero(np.bitwise_count(asked[some][:, None] ^ self.points[s:e]) <= radius)
                if len(q):
                    yield some[q], self.order[s + p]


class ShardTree:
    """Deals fingerprints to ``shards`` by the cuts of a vantage-point tree over a sample."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list[tuple | None] = []
        todo = [(sample, shards, -1, 0)]
        self.shards = 0
        while todo:
            points, n, parent, side = todo.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][2 + side] = at
            found = split(points) if n > 1 and len(points) > 1 else None
            if found is None:
                self.nodes.append([None, self.shards, -1, -1])
                self.shards += 1
                continue
            vantage, cut, d = found
            self.nodes.append([vantage, cut, -1, -1])
            inside = d <= cut
            part = min(max(round(n * float(inside.mean())), 1), n - 1)
            todo += [(points[~inside], n - part, at, 1), (points[inside], part, at, 0)]

    def reached(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the point, shard) of all shards that balls of the radius reach; radius 0: where each belongs."""
        found, todo = [], [(0, np.arange(len(points)))]
        while todo:
            node, who = todo.pop()
            vantage, cut, inner, outer = self.nodes[node]
            if vantage is None:
                found.append((who, np.full(len(who), cut, np.int64)))
                continue
            d = distance(points[who], vantage)
            todo += [(kid, near) for kid, near in ((inner, who[d - radius <= cut]), (outer, who[d + radius > cut])) if len(near)]
        return np.concatenate([w for w, _ in found]), np.concatenate([s for _, s in found])


class Forest:
    """Joins numbers to groups; each is labelled by the smallest of its group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.label[a], self.label[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(self.label, up := self.label[self.label]):
                self.label = up


def _fingerprints(docs: DataFrame, size: int) -> DataFrame:
    def made(batches):
        for batch in batches:
            data, offsets = H.text_bytes(batch.column(1))
            at = offsets.tolist()
            prints = np.array([fingerprint(data[s:e].tobytes(), size) for s, e in zip(at, at[1:])], _U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return text_batches(docs).mapInArrow(made, "doc_id long, print long")


def parts(points: np.ndarray, radius: int) -> list[np.ndarray]:
    """The values of radius + 1 parts of each fingerprint: of two within the radius, one is equal."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(points >> _U(s)) & _U((1 << (e - s)) - 1) for s, e in zip(edges, edges[1:])]


def paired(points: np.ndarray, values: np.ndarray, radius: int):
    """(number, number) arrays of all pairs of points of equal value within the radius, in pieces; ``values`` ascend."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1]) if len(values) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(values)))
    many = sizes > LEAF
    for s, n in zip(first[many].tolist(), sizes[many].tolist()):
        tree = VantageTree(points[s : s + n])
        for at in range(s, s + n, QUERIES):
            for q, p in tree.pairs(points[at : min(at + QUERIES, s + n)], radius):
                yield q + at, p + s
    few = np.flatnonzero(np.repeat(~many, sizes))
    own, value = points[few], values[few]
    for apart in range(1, LEAF):
        i = np.flatnonzero(value[apart:] == value[:-apart])
        if not len(i):
            break
        i = i[np.bitwise_count(own[i] ^ own[i + apart]) <= radius]
        if len(i):
            yield few[i], few[i + apart]


def _crowded(prints: DataFrame, radius: int, shard_rows: int) -> dict[tuple[int, int], tuple[int, ShardTree]]:
    """(part, value) of over ``shard_rows`` fingerprints: number of its first shard, and the tree that deals them out."""

    def valued(batches):
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False)
            for part, value in enumerate(parts(raw.view(_U), radius)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), part)), pa.array(value.view(np.int64)), batch.column(0)], ["part", "value", "print"])

    each = prints.mapInArrow(valued, "part long, value long, print long")
    counts = each.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows)
    most = {(r.part, r.value): r.n for r in counts.collect()}  # at most (radius + 1) * fingerprints / shard_rows
    if not most:
        return {}
    every = prints.sparkSession.createDataFrame([(*k, -(-n // shard_rows), n) for k, n in most.items()], "part long, value long, shards long, n long")
    drawn = each.join(F.broadcast(every), ["part", "value"]).where(F.pmod(F.xxhash64("print", F.lit(13)), F.greatest(F.lit(1), F.expr(f"n div ({SAMPLE} * shards)"))) == 0)
    samples: dict[tuple[int, int], list[int]] = {}
    for r in drawn.select("part", "value", "print").collect():  # some SAMPLE for each shard
        samples.setdefault((r.part, r.value), []).append(r.print)
    out, upto = {}, 0
    for k, n in sorted(most.items()):
        tree = ShardTree(np.sort(np.array(samples.get(k, []), np.int64)).view(_U), -(-n // shard_rows))
        out[k] = upto, tree
        upto += tree.shards
    return out


def _placed(prints: DataFrame, crowded: dict, shards: int, radius: int) -> DataFrame:
    """(shard, visits, value, print): a row for each part, and one more for each later shard of a crowded value that the
    fingerprint visits (1). Shards of crowded values have negative numbers and one value."""

    def table(shard, visits, value, raw):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (shard, visits, value, raw)], ["shard", "visits", "value", "print"])

    def dealt(batches):
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False)
            for part, value in enumerate(parts(raw.view(_U), radius)):
                plain = np.ones(len(raw), bool)
                for v in [v for p, v in crowded if p == part]:
                    mine = np.flatnonzero(value == _U(v))
                    if not len(mine):
                        continue
                    plain[mine] = False
                    (begin, tree), points = crowded[part, v], raw[mine].view(_U)
                    who, shard = tree.reached(points, 0)
                    home = np.zeros(len(points), np.int64)
                    home[who] = shard
                    who, shard = tree.reached(points, radius)
                    keep = shard >= home[who]
                    who, shard = who[keep], shard[keep]
                    yield table(-1 - begin - shard, shard > home[who], np.zeros(len(who)), raw[mine][who])
                own = value[plain]
                drawn = H.mix(own + _U(part << 32)) % _U(shards)
                yield table(drawn.astype(np.int64) + part * shards, np.zeros(len(own)), own.view(np.int64), raw[plain])

    return prints.mapInArrow(dealt, "shard long, visits long, value long, print long")


def _links(placed: DataFrame, radius: int) -> DataFrame:
    """(a, b): a forest of the links that each shard finds."""

    def searched(batches):
        shard, held, tree, forest = None, [], None, None

        def visited(asked):
            """A link of each visitor that meets any; all that it meets are joined."""
            nonlocal tree
            tree = tree or VantageTree(points)
            least = np.full(len(asked), len(points))
            for q, p in tree.pairs(asked, radius):
                fresh = least[q] == len(points)
                np.minimum.at(least, q[fresh], p[fresh])
                forest.join(least[q], p)
            some = np.flatnonzero(least < len(points))
            return np.stack([asked[some].view(np.int64), points[least[some]].view(np.int64)], 1)

        def built():
            nonlocal forest, points
            values, points = np.concatenate([np.zeros((2, 0), np.int64), *held], 1)
            points, forest, found, n = points.view(_U), Forest(len(points)), [], 0
            for pair in paired(points, values, radius):
                found.append(np.stack(pair))
                n += len(pair[0])
                if n >= SHARD:
                    forest.join(*np.concatenate(found, 1))
                    found, n = [], 0
            if found:
                forest.join(*np.concatenate(found, 1))

        def flushed():
            if shard is None:
                return np.zeros((0, 2), np.int64)
            if forest is None:
                built()
            away = np.flatnonzero(forest.label != np.arange(len(points)))
            return np.stack([points[away].view(np.int64), points[forest.label[away]].view(np.int64)], 1)

        table = lambda x: pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in (0, 1)], ["a", "b"])
        points = np.zeros(0, _U)
        for batch in batches:
            of, visits, value, raw = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            edge = np.flatnonzero(np.diff(of) | np.diff(visits)) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(of)]):
                if s == e:
                    continue
                if of[s] != shard:
                    yield table(flushed())
                    shard, held, tree, forest = of[s], [], None, None
                if not visits[s]:
                    held.append(np.stack([value[s:e], raw[s:e]]))
                else:
                    if forest is None:
                        built()
                    yield table(visited(raw[s:e].view(_U)))
        yield table(flushed())

    dealt = placed.repartition("shard").sortWithinPartitions("shard", "visits", "value")
    return dealt.mapInArrow(searched, "a long, b long")


def simhash_components(docs: DataFrame, size: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text", shard_rows: int = SHARD, least_rows: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id): ``fingerprint`` in 16 hex digits; ``component_id`` is the smallest id reached
    by links of fingerprints that differ in at most ``radius`` bits.

    There are as many shards of a part as the session has shuffle partitions, each of ``least_rows`` fingerprints or more, and
    more where a shard would pass ``shard_rows``. The sample that cuts a crowded value holds some SAMPLE fingerprints a shard.
    ``radius`` is below 64.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = scratch.cut(_fingerprints(base, size), "prints")
    classes = scratch.cut(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "classes")
    n = classes.count()
    shards = max(1, -(-n // shard_rows), min(width(spark), n // least_rows))
    crowded = _crowded(classes.select("print"), radius, shard_rows) if n > shard_rows else {}
    links = scratch.cut(_links(_placed(classes.select("print"), crowded, shards, radius), radius), "links")
    joined = scratch.cut(connected_components(links, scratch, "joined"), "components")
    named = classes.join(joined.withColumnRenamed("node", "print"), "print", "left").select("print", "first", F.coalesce("component", "print").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = scratch.cut(named.join(least, "component").select("print", "component_id"), "named")
    out = prints.join(named, "print")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
