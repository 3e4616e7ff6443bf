"""Components of items (texts or parts of texts) under an exact Jaccard threshold of their hash sets.

Items with equal sets form a class, told by two 64-bit hashes of the set (``key``, or one made of both where
two sets have the same ``key``); only classes meet, and only where they share a signature. In a signature's bucket every class is first held against one hub, then,
after the first links are joined to components, against the class of most copies; a last round holds
classes of different components in a bucket against each other, in blocks of bounded size. So a large group of copies never makes all its
pairs, yet every pair that shares a signature is decided. Pairs are bounded from above by hashed parity
bitmaps - every bit that differs is a hash only one set has - and the rest is decided by intersecting
the exact sorted arrays, read again from the texts of the documents concerned alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import Scratch, connected_components, sieve, sifted, text_batches

_U = np.uint64
BLOCK = 1024
#: Members of a bucket up to which short bitmaps will do.
FEW = 32
CHUNK = 256
MOST_BITS = 1 << 15
COUNTERS = 1 << 20

#: (bytes, offsets) -> (document of each item, item's number in it, hashes, bounds of each item's sorted distinct hashes)
Itemise = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def set_keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set: sums of differently mixed members, so independent of each other."""
    out = []
    for salt, odd in ((0x5851F42D4C957F2D, 0x9E3779B97F4A7C15), (0x14057B7EF767814F, 0xD1342543DE82EF95)):
        upto = np.zeros(len(hashes) + 1, _U)
        np.cumsum(H.mix(hashes ^ _U(salt)), out=upto[1:])
        out.append(H.mix(upto[bounds[1:]] - upto[bounds[:-1]] + np.diff(bounds).astype(_U) * _U(odd)))
    return out[0], out[1]


def other_key(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """The key of a set whose ``key`` another set has as well."""
    return H.mix(key * _U(3) ^ check)


def levels(docs: DataFrame, itemise: Itemise) -> np.ndarray:
    """For each of COUNTERS hash values, 0 or, where far more hashes than the mean fall on it, the logarithm of
    their number: a count sketch of fixed size. It only orders hashes; any order gives the same result."""

    def counted(batches):
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            data, offsets = H.text_bytes(batch.column(0))
            for a, b in H.slices(offsets):
                _, _, hashes, _ = itemise(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                np.add.at(seen, (hashes & _U(COUNTERS - 1)).astype(np.int64), 1)
        mean = seen.mean()
        hot = np.flatnonzero(seen > mean + 4 * np.sqrt(mean) + 2)
        yield pa.RecordBatch.from_arrays([pa.array(hot), pa.array(seen[hot])], ["slot", "n"])

    rows = text_batches(docs).select("text").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("level"))
    out = np.zeros(COUNTERS, np.uint8)
    for r in rows.collect():  # COUNTERS rows at most
        out[r.slot] = r.level + 1
    return out


def bitmap(hashes: np.ndarray) -> bytes:
    """Parity bits of the hashes modulo a power of two of at least twice their number, from 256 up to MOST_BITS."""
    bits = min(1 << max(8, (2 * len(hashes) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((hashes & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A parity bitmap of fewer words: bits that fall together add up."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def differing(a: bytes, b: bytes) -> int:
    """At least so many hashes are in one set alone."""
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    n = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, n) ^ fold(y, n)).sum())


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(_U).view(np.int64))


def prepared(docs: DataFrame, itemise: Itemise, sign: Callable) -> DataFrame:
    """A row for each item of (doc_id, text): doc_id, item, n (set size), key and check (of its class, null for
    an empty set), sigs and bits. A class gives its signatures and bitmap once in a task; ``sign`` takes the
    numbers, hashes and bounds of the items that do."""

    def made(batches):
        seen = set()
        for batch in batches:
            ids = batch.column(0)
            data, offsets = H.text_bytes(batch.column(1))
            for a, b in H.slices(offsets):
                doc, item, hashes, bounds = itemise(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                (keys, checks), n = set_keys(hashes, bounds), np.diff(bounds)
                fresh = np.zeros(len(n), bool)
                for i, key in enumerate(zip(keys.tolist(), checks.tolist())):
                    if n[i] and key not in seen:
                        seen.add(key)
                        fresh[i] = True
                mine = np.flatnonzero(fresh)
                some = np.zeros(len(mine) + 1, np.int64)
                np.cumsum(n[mine], out=some[1:])
                of, sig = sign(item[mine], hashes[np.repeat(fresh, n)], some)
                order = np.argsort(of, kind="stable")
                counts = np.zeros(len(n), np.int64)
                counts[mine] = np.bincount(of, minlength=len(mine))
                upto = np.zeros(len(n) + 1, np.int32)
                np.cumsum(counts, out=upto[1:])
                bits = [bitmap(hashes[bounds[i] : bounds[i + 1]]) if counts[i] else None for i in range(len(n))]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(doc + a)),
                        pa.array(item.astype(np.int64)),
                        pa.array(n),
                        pa.array(keys.view(np.int64), mask=n == 0),
                        pa.array(checks.view(np.int64), mask=n == 0),
                        pa.ListArray.from_arrays(pa.array(upto), _long(sig[order])),
                        pa.array(bits, pa.binary()),
                    ],
                    ["doc_id", "item", "n", "key", "check", "sigs", "bits"],
                )

    return text_batches(docs).mapInArrow(made, "doc_id long, item long, n long, key long, check long, sigs array<long>, bits binary")


def _bounded(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that sizes and bitmaps don't rule out, with the documents that stand for them."""
    side = lambda k: classes.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"), F.col("rep").alias(f"rep_{k}"))

    def kept(batches):
        for batch in batches:
            na, nb, xa, xb = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))
            good = [(num + den) * differing(x, y) <= (den - num) * (m + n) for m, n, x, y in zip(na, nb, xa, xb)]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b", "rep_a", "rep_b"])

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}")
    return sized.select("a", "b", "rep_a", "rep_b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(kept, "a long, b long, rep_a long, rep_b long")


def _verified(pairs: DataFrame, docs: DataFrame, itemise: Itemise, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose exact sets link.

    Texts of the documents that stand for the pairs' classes are read again; a sieve of their ids is broadcast
    to leave out other texts before the exact join. A hub's partners go to chunks of about CHUNK, each with the
    hub's set.
    """
    pairs = scratch.cut(pairs, f"{name}-pairs")
    need = pairs.select(F.col("a").alias("key"), F.col("rep_a").alias("doc_id")).union(pairs.select("b", "rep_b")).distinct()
    need = need.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))  # at most a document's items
    texts = sifted(docs, "doc_id", sieve(need, "doc_id"))

    def hashed(batches):
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            data, offsets = H.text_bytes(batch.column(1))
            for a, b in H.slices(offsets):
                doc, _, hashes, bounds = itemise(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                key, check = set_keys(hashes, bounds)
                keys, others = key.view(np.int64).tolist(), other_key(key, check).view(np.int64).tolist()
                asked = [set(w) for w in wanted[a:b]]
                named = [k if k in asked[d] else o if o in asked[d] else None for d, k, o in zip(doc.tolist(), keys, others)]
                good = [i for i, k in enumerate(named) if k is not None]
                sets = [hashes[bounds[i] : bounds[i + 1]].tobytes() for i in good]
                yield pa.RecordBatch.from_arrays([pa.array([named[i] for i in good], pa.int64()), pa.array(sets, pa.binary())], ["key", "hashes"])

    sets = need.join(texts, "doc_id").select("keys", "text").mapInArrow(hashed, "key long, hashes binary").dropDuplicates(["key"])
    sets = scratch.cut(sets, f"{name}-sets")
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    members = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "chunks").alias("chunk"))
    asked = members.select("a", "chunk", F.col("b").alias("key"), F.lit(1).alias("member")).union(
        members.select("a", "chunk", F.col("a").alias("key"), F.lit(0).alias("member")).distinct()
    )
    placed = asked.join(sets, "key").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "member")

    def compared(batches):
        hub = values = None
        for batch in batches:
            a, chunk, key, member, sets = (batch.column(i).to_pylist() for i in range(5))
            out = []
            for i in range(len(a)):
                mine = np.frombuffer(sets[i], _U)
                if not member[i]:
                    hub, values = (a[i], chunk[i]), mine
                    continue
                if hub != (a[i], chunk[i]) or not len(values):
                    continue
                at = np.searchsorted(values, mine)
                shared = int((values[np.minimum(at, len(values) - 1)] == mine).sum())
                if den * shared >= num * (len(values) + len(mine) - shared):
                    out.append((a[i], key[i]))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in (0, 1)], ["a", "b"])

    links = placed.select("a", "chunk", "key", "member", "hashes").mapInArrow(compared, "a long, b long")
    links = scratch.cut(links, f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-pairs")
    del pairs, need, texts, sets, chunks, members, asked, placed
    scratch.tidy()
    return links


def short_bitmap(bits: bytes, size: int, num: int, den: int) -> bytes:
    """The bitmap of a set of ``size`` folded to the fewest bits that still tell unrelated sets apart: about half of
    them differ between two such sets, and that is to be well over what a link allows."""
    allowed = -(-2 * size * (den - num) // (num + den))
    words = max(1 << (3 * allowed - 1).bit_length(), 64) // 64 if allowed else 1
    return fold(np.frombuffer(bits, _U), words).tobytes()


def _cross(rows: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes of different components within a bucket that bitmaps allow: short ones in a bucket of up to FEW
    ``members``, whole ones in a larger one, where the many near misses would pass short ones by the square of its size.
    A bucket of over BLOCK rows is cut into ``blocks``; each pair of blocks is a group of bounded size, as a bitmap has
    MOST_BITS at most."""

    @F.arrow_udf("binary")
    def shortened(bits: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if x is None else short_bitmap(x, m, num, den) for x, m in zip(bits.to_pylist(), n.to_pylist())], pa.binary())

    small, large = rows.where(F.col("members") <= FEW), rows.where(F.col("members") > FEW)
    whole = classes.select("key", "n", "bits")
    cut = small.join(whole.withColumn("bits", shortened("bits", "n")), "key").union(large.join(sifted(whole, "key", sieve(large, "key")), "key"))
    cut = cut.withColumn("_block", F.pmod(F.xxhash64("key"), "blocks"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.select("sig", F.least("_block", "_other").alias("low"), F.greatest("_block", "_other").alias("high"), "_block", "key", "component", "n", "bits")
    placed = cut.repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high")

    def pairs_of(rows):
        keys, comps = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        sizes, block = np.array([r[3] for r in rows]), np.array([r[0] for r in rows])
        maps = [np.frombuffer(r[4], _U) for r in rows]
        lengths = np.array([len(m) for m in maps])
        # A pair is bounded at the length of its shorter bitmap; sizes within the threshold differ by a factor
        # of two at most there.
        found = set(lengths.tolist())
        levels = {n: np.array([fold(m, n) if len(m) >= n else np.zeros(n, _U) for m in maps]) for n in sorted(found | {n // 4 for n in found if n >= 8})}
        inner = len(set(block.tolist())) == 1
        for i in range(len(rows)):
            if not inner and block[i] != block.min():
                continue
            good = comps != comps[i]
            if inner:
                good[: i + 1] = False
            else:
                good &= block != block[i]
            good &= np.minimum(sizes, sizes[i]) * den >= np.maximum(sizes, sizes[i]) * num
            at = np.flatnonzero(good)
            shorter = np.minimum(lengths[at], lengths[i])
            for n in set(shorter.tolist()):
                some = at[shorter == n]
                for words in (n // 4, n) if n >= 8 else (n,):  # a quarter of the bits rules out most
                    off = np.bitwise_count(levels[words][some] ^ levels[words][i]).sum(1, dtype=np.int64)
                    some = some[(num + den) * off <= (den - num) * (sizes[some] + sizes[i])]
                for k in keys[some].tolist():
                    yield min(keys[i], k), max(keys[i], k)

    def crossed(batches):
        group, held = None, []

        def flush():
            out = sorted(set(pairs_of(held))) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([int(o[j]) for o in out], pa.int64()) for j in (0, 1)], ["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(8)]
            for row in zip(*cols):
                if row[:3] != group:
                    yield flush()
                    group, held = row[:3], []
                held.append(row[3:])
        yield flush()

    return placed.mapInArrow(crossed, "a long, b long").distinct()


def classes_of(prep: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``prep``, classes, signed): classes are (key, rep, n, copies), each with its smallest document and the count
    of its items; ``signed`` has those that show signatures, with their ``bits``. Where sets that differ have one key (two
    in 2^64 do), both get ``other_key`` in all tables."""
    aggs = (F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies"))
    classes = scratch.cut(prep.where("n > 0").groupBy("key", "check").agg(*aggs), "classes")
    bits = scratch.cut(prep.where("bits is not null").groupBy("key", "check").agg(F.max("bits").alias("bits")), "bits")
    signed = scratch.cut(sifted(classes, "key", sieve(bits, "key")).join(bits, ["key", "check"]), "signed")
    scratch.drop("bits")
    twice = classes.groupBy("key").agg(F.count("*").alias("_sets")).where("_sets > 1")
    if twice.isEmpty():
        return prep, classes.drop("check"), signed.drop("check")

    @F.arrow_udf("long")
    def other(key: pa.Array, check: pa.Array) -> pa.Array:
        return _long(other_key(*(x.fill_null(0).to_numpy(zero_copy_only=False).view(_U) for x in (key, check))))

    def renamed(df):
        both = df.join(twice, "key", "left")
        return both.withColumn("key", F.when(F.col("_sets").isNull(), F.col("key")).otherwise(other("key", "check"))).select(df.columns)

    return renamed(prep), scratch.cut(renamed(classes).drop("check"), "classes-named"), scratch.cut(renamed(signed).drop("check"), "signed-named")


def components(
    prep: DataFrame, classes: DataFrame, docs: DataFrame, itemise: Itemise, num: int, den: int, scratch: Scratch, extra: DataFrame | None = None, used: tuple = ("prepared",)
) -> DataFrame:
    """(key, component) of each class with a partner: ``classes`` (the signed ones) link when den * |intersection| >= num *
    |union|; ``extra`` (a, b) are further links. A component is named by its smallest key. The tables ``used`` of the
    scratch folder, which ``prep`` reads, are deleted once signatures have met."""
    bucket = Window.partitionBy("sig")
    met = prep.select("key", F.explode("sigs").alias("sig")).select("sig", "key", F.min("key").over(bucket).alias("_low"), F.max("key").over(bucket).alias("_top"))
    met = met.where("_low <> _top").select("sig", "key").distinct()
    # Near copies share most of their signatures: buckets of the same members are one, named by a hash of them.
    # (Should two names be equal, their members meet as well.)
    members = F.xxhash64(*[F.bit_xor(F.xxhash64("key", F.lit(i))).over(bucket) for i in (1, 2)], F.count("*").over(bucket))
    shared = met.select(members.alias("sig"), "key").distinct().withColumn("hub", F.min("key").over(bucket))
    shared = scratch.cut(shared, "shared")
    del met
    scratch.drop(*used)
    scratch.tidy()
    star = shared.where("hub <> key").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    links = _verified(_bounded(star, classes, num, den), docs, itemise, num, den, scratch, "star")
    first = connected_components(links, scratch, "first")

    def mixed(joined: DataFrame, name: str) -> DataFrame:
        """(sig, key, component, members, blocks): the buckets that hold several components, and into how many blocks each is cut."""
        known = shared.select("sig", "key").distinct().join(joined.withColumnRenamed("node", "key"), "key", "left")
        known = known.withColumn("component", F.coalesce("component", "key"))
        spread = known.withColumn("_low", F.min("component").over(bucket)).withColumn("_top", F.max("component").over(bucket))
        spread = spread.withColumn("members", F.count("*").over(bucket)).withColumn("blocks", F.ceil(F.col("members") / BLOCK))
        return scratch.cut(spread.where("_low <> _top").select("sig", "key", "component", "members", "blocks"), name)

    # A further hub of each bucket joins most of what the first left apart: the class of most copies (edited
    # copies are nearer to what was copied than to each other), of equals one of a few drawn by hash.
    draw = F.struct("copies", F.xxhash64("key", F.col("sig").bitwiseAND(3)), "key", "component")
    known = mixed(first, "mixed-1").join(classes.select("key", "copies"), "key")
    drawn = known.withColumn("_hub", F.max(draw).over(bucket)).where("_hub.component <> component")
    drawn = drawn.select(F.col("_hub.key").alias("a"), F.col("key").alias("b")).distinct()
    links = links.union(_verified(_bounded(drawn, classes, num, den), docs, itemise, num, den, scratch, "drawn"))
    second = connected_components(links, scratch, "second")
    scratch.drop("mixed-1")
    # Last, all that share a bucket but no component yet.
    crossed = _cross(mixed(second, "mixed-2"), classes, num, den)
    crossed = crossed.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = _verified(_bounded(crossed, classes, num, den), docs, itemise, num, den, scratch, "cross")
    every = links.union(more)
    joined = connected_components(every if extra is None else every.union(extra), scratch, "all")
    scratch.drop("shared", "mixed-2", "signed", "star-links", "drawn-links", "cross-links")
    return joined.withColumnRenamed("node", "key")
