"""Suffix-array dedup: every byte of an n-byte string that also starts earlier in the corpus is removed.

1. Anchors. Each n-byte string has an anchor: of the k-grams in it the one with the least hash, the
   leftmost on ties. Equal strings have equal anchors in the same place, so only strings with equal
   anchors can be equal. Neighbouring strings mostly share their anchor; such a run is a block, and
   only (anchor, block, document, place) is shuffled, about two rows for each n - k bytes. Blocks that a
   task has seen before don't meet the others: they are copies already.
2. Blocks. Of equal blocks the earliest stays; all strings of the others start earlier too. An anchor
   with one distinct block needs no more. Of an anchor with several, the first of each distinct block
   goes on to:
3. Suffix arrays. The bytes of these blocks come together by anchor. A task sorts their suffixes to a depth of
   n bytes, finds for each the nearest suffixes before and after it in that order which start earlier in the
   corpus (previous and next smaller positions), and takes the longer common prefix with the two: the longest
   previous factor, up to n. Where it reaches n the string starts earlier. So that a task's bytes are bounded, an
   anchor with more than ``group`` distinct blocks is not gathered: its strings are told apart by hashes, one row
   a string, and the earliest of each stays.

"Earlier" is a smaller document id, or the same document and a smaller start. Equal anchors and block hashes,
64 bits each of differently mixed 8-byte words, stand for equal blocks. Null and empty texts have no bytes.
Where ids repeat or are null, distinct (id, text) pairs are ordered by id (null first) and text hash, and judged
in that order; repeated rows are one document and get its result each. An empty table gives no rows. Only ids and
texts are read. A text of 2^28 bytes or more, or an n over 1023, is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import Scratch, global_rank, sieve, sifted, text_batches

_U = np.uint64
PLACES = 1 << 28
HELD = 500_000
SPANS = "array<struct<begin:bigint,end:bigint>>"


def word_hash(data: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``prefix_hash`` over the mixed 8-byte words that begin at each byte; of [s, e) take [s, e - 7)."""
    words, have = data.astype(_U), 1
    while have < 8:
        words = (words[:-have] << _U(8 * have)) | words[have:]
        have *= 2
    return H.prefix_hash(H.mix(words + H.constants(1, seed)[0]))


def blocks(data: np.ndarray, offsets: np.ndarray, n: int, k: int):
    """(document, first start, anchor's distance, further starts, anchor hash, block hash) of all blocks."""
    empty = np.zeros(0, np.int64)
    if len(data) >= PLACES:
        raise ValueError("a text of 2^28 bytes or more")
    if len(data) < n:
        return empty, empty, empty, empty, empty.astype(_U), empty.astype(_U)
    sums, down = word_hash(data, 21)
    grams = H.mix((sums[k - 7 :] - sums[: len(data) - k + 1]) * down[: len(data) - k + 1])
    place = np.arange(len(grams), dtype=_U)
    low = _U(PLACES - 1)
    least = (grams & ~low) | place
    span, reach = n - k + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(data) - n + 1], least[span - reach :][: len(data) - n + 1])
    anchor = (least & low).astype(np.int64)
    # Strings that cross the end of a document are none.
    doc_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc_of[: len(anchor)] == doc_of[n - 1 :]
    start = np.flatnonzero(inside)
    if not len(start):
        return empty, empty, empty, empty, empty.astype(_U), empty.astype(_U)
    doc, at = doc_of[start], anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    first, more = start[head], tail - head
    sums, down = word_hash(data, 22)
    block = (sums[first + more + n - 7] - sums[first]) * down[first]
    shift = at[head] - first
    block = H.mix(block + H.mix((shift * 1024 + more).astype(_U)))
    return doc[head], first - offsets[doc[head]], shift, more, grams[at[head]], block


def ranks(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of the string of that length at each position), lengths doubling from 8 up to ``depth``, by
    prefix doubling; what lies past the end counts as zero bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(len(data), _U)
    for i in range(8):
        key = (key << _U(8)) | padded[i : len(data) + i].astype(_U)
    out = [(8, np.unique(key, return_inverse=True)[1].astype(np.int64))]
    while out[-1][0] < depth:
        have, rank = out[-1]
        step = min(have, depth - have)
        later = np.zeros(len(data), np.int64)
        later[: len(data) - step] = rank[step:] + 1
        out.append((have + step, np.unique(rank * (len(data) + 2) + later, return_inverse=True)[1].astype(np.int64)))
    return out


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place of ``values``, all distinct, the nearest place before it with a smaller value, or -1.

    All places step at once along the pointers found so far: what lies between a place and its pointer is always
    larger than its value, so a pointer may be followed before it is final."""
    at = np.arange(len(values)) - 1
    padded = np.append(values, np.iinfo(np.int64).min)  # at -1
    wrong = np.flatnonzero(padded[at] > values)
    while len(wrong):
        at[wrong] = at[at[wrong]]
        wrong = wrong[padded[at[wrong]] > values[wrong]]
    return at


def longest_previous_factor(data: np.ndarray, starts: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """For the n-byte string at each of ``starts``, the length of its longest prefix that also begins another
    one of less ``order`` (distinct numbers), up to n."""
    levels = ranks(data, n)
    suffixes = np.argsort(levels[-1][1][starts], kind="stable")
    mine = order[suffixes]
    before = previous_smaller(mine)
    after = len(mine) - 1 - previous_smaller(mine[::-1])[::-1]  # len(mine) where there is none
    longest = np.zeros(len(starts), np.int64)
    for other in (before, after):
        here = np.flatnonzero((other >= 0) & (other < len(mine)))
        a, b = starts[suffixes[here]], starts[suffixes[other[here]]]
        common, alive = np.zeros(len(here), np.int64), np.ones(len(here), bool)
        same = levels[-1][1][a] == levels[-1][1][b]
        common[same], alive[same] = n, False
        for length, rank in levels[-2::-1]:
            equal = np.flatnonzero(alive)
            x, y = a[equal] + common[equal], b[equal] + common[equal]
            inside = np.maximum(x, y) < len(data)
            equal = equal[inside][rank[x[inside]] == rank[y[inside]]]
            common[equal] += length
        padded = np.append(data, np.zeros(n + 8, np.uint8))
        for _ in range(8):
            equal = np.flatnonzero(alive)
            equal = equal[padded[a[equal] + common[equal]] == padded[b[equal] + common[equal]]]
            alive[:] = False
            alive[equal] = True
            common[equal] += 1
        longest[suffixes[here]] = np.maximum(longest[suffixes[here]], np.minimum(common, n))
    return longest


def _runs(doc: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans covered by strings at sorted (doc, start), touching ones joined."""
    if not len(start):
        return doc, start, start
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + n)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    return doc[head], start[head], start[tail] + n


def repeated_spans(docs: DataFrame, scratch: Scratch, n: int, k: int, group: int, batch_bytes: int = 400_000) -> DataFrame:
    """(doc_id, begin, end) of bytes to remove, from (doc_id, text) with distinct ids; spans may overlap."""

    def found(batches):
        held, size = [], 0

        def flush():
            anchor, block, doc, place = (np.concatenate(c) for c in zip(*held))
            by = np.lexsort((place, doc, block, anchor))
            copy = np.zeros(len(by), bool)
            copy[by[1:]] = (anchor[by[1:]] == anchor[by[:-1]]) & (block[by[1:]] == block[by[:-1]])
            # Copies need no other row, so they go anywhere.
            anchor[copy] = H.mix(doc[copy].astype(_U) * _U(3) + H.mix(place[copy].astype(_U))).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor, block, doc, place, copy)], ["anchor", "block", "doc_id", "place", "copy"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = H.text_bytes(batch.column(1))
            for a, b in H.slices(offsets):
                doc, first, shift, more, anchor, block = blocks(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n, k)
                held.append((anchor.view(np.int64), block.view(np.int64), ids[doc + a], first << 20 | shift << 10 | more))
                size += len(doc)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = text_batches(docs).mapInArrow(found, "anchor long, block long, doc_id long, place long, copy boolean")
    by_anchor = Window.partitionBy("anchor")
    by_block = Window.partitionBy("anchor", "block").orderBy("doc_id", "place")
    rows = rows.repartition("anchor").sortWithinPartitions("anchor", "block", "doc_id", "place")
    judged = rows.select(
        "anchor", "block", "doc_id", "place", F.greatest(F.row_number().over(by_block), F.col("copy").cast("int") * 2).alias("_nth"),
        F.min("block").over(by_anchor).alias("_low"), F.max("block").over(by_anchor).alias("_top"),
    )
    hits = scratch.cut(
        judged.where("_nth > 1 or _low <> _top").select("doc_id", "place", F.col("_nth").alias("nth"), F.when(F.col("_nth") == 1, F.col("anchor")).alias("anchor")), "hits"
    )
    start, more = F.expr("shiftright(place, 20)"), F.expr("place & 1023")
    copies = hits.where("nth > 1").select("doc_id", start.alias("begin"), (start + more + n).alias("end"))

    # The first of each distinct block of an anchor with several.
    firsts = hits.where("nth = 1").withColumn("_many", F.count("*").over(Window.partitionBy("anchor")) > group)
    asked = firsts.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place", "_many")).alias("asked"))  # at most a document's blocks
    asked = scratch.cut(asked, "asked")
    texts = sifted(docs, "doc_id", sieve(asked, "doc_id"))

    def cut_out(batches):
        for batch in batches:
            for i, doc in enumerate(batch.column(0).to_pylist()):
                raw = batch.column(2)[i].as_buffer().to_pybytes()
                rows = []
                for item in batch.column(1)[i].as_py():
                    begin, further = item["place"] >> 20, item["place"] & 1023
                    if not item["_many"]:
                        rows.append((item["anchor"], 0, doc, begin, raw[begin : begin + further + n]))
                        continue
                    part = np.frombuffer(raw, np.uint8)[begin : begin + further + n]
                    sums, down = word_hash(part, 23)
                    own = H.mix((sums[n - 7 :] - sums[: further + 1]) * down[: further + 1]).view(np.int64)
                    rows += [(item["anchor"], 1 if h == 0 else h, doc, begin + j, None) for j, h in enumerate(own.tolist())]
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["anchor", "string", "doc_id", "begin", "bytes"]
                )

    parts = asked.join(texts, "doc_id").select("doc_id", "asked", F.col("text").cast("binary")).mapInArrow(
        cut_out, "anchor long, string long, doc_id long, begin long, bytes binary"
    )
    parts = scratch.cut(parts, "parts")

    def sorted_out(batches):
        held, size = [], 0  # whole anchors, up to batch_bytes

        def flush():
            data = np.frombuffer(b"".join(r[3] for r in held), np.uint8)
            lengths = np.array([len(r[3]) for r in held], np.int64)
            count = lengths - n + 1
            base = np.cumsum(lengths) - lengths
            of = np.repeat(np.arange(len(held)), count)
            inner = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            doc, begin = np.array([r[1] for r in held], np.int64)[of], np.array([r[2] for r in held], np.int64)[of] + inner
            rank = np.empty(len(of), np.int64)
            rank[np.lexsort((begin, doc))] = np.arange(len(of))
            gone = longest_previous_factor(data, base[of] + inner, rank, n) >= n
            by = np.lexsort((begin[gone], doc[gone]))
            out = _runs(doc[gone][by], begin[gone][by], n)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "begin", "end"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for row in zip(*cols):
                if size >= batch_bytes and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush()

    gathered = parts.where("string = 0").select("anchor", "doc_id", "begin", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    by_suffix = gathered.mapInArrow(sorted_out, "doc_id long, begin long, end long")
    nth = F.row_number().over(Window.partitionBy("anchor", "string").orderBy("doc_id", "begin"))
    by_hash = parts.where("string <> 0").withColumn("_nth", nth).where("_nth > 1").select("doc_id", "begin", (F.col("begin") + n).alias("end"))
    return copies.union(by_suffix).union(by_hash)


def remove_repeats(
    docs: DataFrame, n: int = 100, k: int = 32, group: int = 8192, whole_chars: bool = False, carry: tuple = (), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, *carry): ``spans`` are the maximal removed byte runs in order, ``kept`` the
    remaining bytes end to end. With ``whole_chars`` a character of which a byte stays is kept whole."""
    if not 8 <= k <= n <= 1023:
        raise ValueError("8 <= k <= n <= 1023")
    scratch = Scratch(docs.sparkSession, "suffix")
    base = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    counts = base.groupBy("_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"), F.max(F.col("_id").isNull()).alias("null")).first()
    plain = counts.most <= 1 and not counts.null
    if plain:
        keyed = base.withColumn("doc_id", F.col("_id"))
    else:
        own = base.withColumn("_hash", F.xxhash64("text"))
        pairs = global_rank(own.select("_id", "_hash").distinct(), ["_id", "_hash"], scratch, "pairs", "doc_id")
        pairs = scratch.cut(pairs, "ranked").withColumnRenamed("_id", "_p").withColumnRenamed("_hash", "_h")
        keyed = own.join(pairs, F.col("_id").eqNullSafe(F.col("_p")) & (F.col("_hash") == F.col("_h"))).drop("_p", "_h", "_hash")
    texts = keyed.select("doc_id", "text") if plain else keyed.select("doc_id", "text").dropDuplicates(["doc_id"])
    spans = repeated_spans(texts, scratch, n, k, group)
    spans = scratch.cut(spans.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("found")), "spans")  # at most a document's blocks
    marks = sieve(spans, "doc_id")
    kinds = dict(docs.dtypes)
    extra = "".join(f", `_carry_{c}` {kinds[c]}" for c in carry)

    def removed(batches):
        for batch in batches:
            spans_out, kept = [], []
            for found, raw in zip(batch.column("found").to_pylist(), batch.column("raw").to_pylist()):
                bad = np.zeros(len(raw) + 1, np.int32)
                for f in found or ():
                    bad[f["begin"]] += 1
                    bad[f["end"]] -= 1
                bad = np.cumsum(bad[:-1]) > 0
                data = np.frombuffer(raw, np.uint8)
                if whole_chars and bad.any():
                    lead = np.flatnonzero((data & 0xC0) != 0x80)
                    bad = np.repeat(np.logical_and.reduceat(bad, lead), np.diff(np.append(lead, len(data))))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], bad.view(np.int8), [0]])))
                spans_out.append([{"begin": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
                kept.append(data[~bad].tobytes())
            rest = [batch.column(f"_carry_{c}") for c in carry]
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            n_bytes = pa.array([len(r) for r in batch.column("raw").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), n_bytes, pa.array(spans_out, kind), pa.array(kept, pa.binary()), *rest],
                ["_id", "n_bytes", "spans", "kept", *(f"_carry_{c}" for c in carry)],
            )

    raw = F.col("text").cast("binary")
    carried = [f"_carry_{c}" for c in carry]
    alone = sifted(keyed, "doc_id", marks, "left_anti").select(
        "_id", F.length(raw).cast("long").alias("n_bytes"), F.array().cast(SPANS).alias("spans"), raw.alias("kept"), *carried
    )
    hit = sifted(keyed, "doc_id", marks).join(spans, "doc_id", "left").select("_id", "found", raw.alias("raw"), *carried)
    hit = hit.mapInArrow(removed, f"_id long, n_bytes long, spans {SPANS}, kept binary{extra}")
    return alone.union(hit).select(F.col("_id").alias("doc_id"), "n_bytes", "spans", "kept", *[F.col(f"_carry_{c}").alias(c) for c in carry])
