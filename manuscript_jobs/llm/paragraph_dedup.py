"""Substring dedup: repeated and near-identical paragraphs across a corpus, wherever they lie in a text.

A paragraph is one of two:

* a line of at least ``min_words`` words, as a set of word shingles. ``bands`` bands of ``rows`` MinHashes each bring
  similar lines together (at a Jaccard similarity of 0.8, 6 bands of 2 miss 2 pairs in 1,000), exact Jaccard
  decides, and components of links are clusters. Lines too short to link with a different one are told by their
  class alone;
* a piece of the whole text between two cuts. A cut lies where a hash of two words is the least within
  ``radius`` words to both sides, so it depends on the words around it alone: a passage that is copied into the
  middle of other text, or wrapped at other places, has the same pieces inside, of 9 words on average at the default
  radius. Equal sets of shingles are a cluster; edits of a passage leave the pieces between them equal.

The first paragraph of a cluster, by (document id, place), stays; the others are removed, but for those that
overlap the first itself. Shingles don't cross the ends of a paragraph. A run of removed pieces is carried on to both
sides, up to ``REACH`` words, as far as the words beside it agree with those beside the first: over equal words, and
over a changed, added or missing word where ``SURE`` equal ones follow it, so a fifth of the words differ at most. A copied
passage so goes to its last word, and one edited here and there goes where a piece of it was left equal. Runs that
even so are shorter than ``least`` words stay, as common phrases are no copies, but for words of a removed line.

Null and empty texts have no paragraphs to remove. Rows that share an id are each judged: distinct (id, text)
pairs are ordered by id and text hash, a null id after all others, and repeated rows are one document and
get its result each. An empty table gives no rows. Only ids and texts are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import Scratch, own_keys, sieve, sifted
from .similarity import classes_of, components, prepared

_U = np.uint64
_PIECE = 1 << 62
_HALF = 31
#: Words that a run of pieces may be carried on to either side, and equal words that must follow an edit.
REACH, SURE = 32, 4
REMOVED = "array<struct<begin:bigint,end:bigint,first_doc_id:bigint,first_begin:bigint>>"


def cuts(hashed: np.ndarray, bounds: np.ndarray, radius: int) -> np.ndarray:
    """Words that begin a piece: each document's first and those whose two-word hash is the least within ``radius``
    words to both sides, the leftmost of equal ones."""
    n = len(hashed)
    if not n:
        return np.zeros(0, np.int64)
    pair = H.mix(hashed * _U(3) + np.append(hashed[1:], _U(0)) * _U(7)) >> _U(1)
    last = bounds[1:][np.diff(bounds) > 0] - 1
    pair[last] = H.mix(hashed[last]) >> _U(1)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(n) + radius * (doc + 1)  # documents stand ``radius`` apart
    line = np.full(n + radius * (len(bounds) + 1), ~_U(0))
    line[place] = pair
    least, reach = line, 1
    while 2 * reach <= radius:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    side = np.minimum(least[: len(line) - radius + 1], least[radius - reach :][: len(line) - radius + 1])  # of ``radius`` words from here
    first = np.zeros(n, bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    return np.flatnonzero(first | ((pair < side[place - radius]) & (pair <= side[place + 1])))


def paragraphs(size: int, min_words: int, radius: int):
    """Items are the lines and pieces of at least ``min_words`` words; an item's number holds the words it
    spans. Pieces have hashes of their own, so a piece and a line are never one class."""

    def sets(hashed, first, end, bounds, salt):
        good = end - first >= min_words
        first, count = first[good], (end - first)[good]
        upto = np.zeros(len(first) + 1, np.int64)
        np.cumsum(count, out=upto[1:])
        at = np.repeat(first - upto[:-1], count) + np.arange(int(upto[-1]))
        hashes, upto = H.distinct(*H.shingles(hashed[at] * _U(salt), upto, size))
        doc = np.searchsorted(bounds, first, "right") - 1
        begin = first - bounds[doc]
        return doc, begin << _HALF | (begin + count), hashes, upto

    def itemise(data, offsets):
        hashed, start, _, bounds = H.words(data, offsets)
        edges = np.union1d(np.searchsorted(start, np.flatnonzero(data == 10)), bounds)
        lines = sets(hashed, edges[:-1], edges[1:], bounds, 1)
        edges = np.append(cuts(hashed, bounds, radius), len(hashed))
        pieces = sets(hashed, edges[:-1], edges[1:], bounds, 0xC2B2AE3D27D4EB4F)
        upto = np.concatenate([lines[3], pieces[3][1:] + lines[3][-1]])
        return np.concatenate([lines[0], pieces[0]]), np.concatenate([lines[1], pieces[1] | _PIECE]), np.concatenate([lines[2], pieces[2]]), upto

    return itemise


def banded(bands: int, rows: int, num: int, den: int):
    """(item, signature): each band's combined MinHashes of each line. A set of n hashes has at most n / (n + 1) in
    common with another; where that is below num / den it needs none."""

    def sign(number, hashes, bounds):
        size = np.diff(bounds)
        use = (size * den >= num * (size + 1)) & (number < _PIECE)
        items, hashes = np.flatnonzero(use), hashes[np.repeat(use, size)]
        n = len(items)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        bounds = np.zeros(n + 1, np.int64)
        np.cumsum(size[items], out=bounds[1:])
        turns = H.constants(bands * rows, 11)
        out = np.zeros((bands, n), _U)
        for b in range(bands):
            for r in range(rows):
                least = np.minimum.reduceat(hashes * turns[b * rows + r], bounds[:-1])
                out[b] = H.mix(out[b] + least * _U(2 * r + 3))
            out[b] = H.mix(out[b] + _U(b + 1))
        return np.tile(items, bands), out.ravel()

    return sign


def carried(own: list[int], other: list[int]) -> tuple[int, int]:
    """How many words of either list, both read away from a match, go on with it: equal words, and single edits that
    SURE equal words follow."""
    i = j = 0
    while i < len(own) and j < len(other):
        if own[i] == other[j]:
            i, j = i + 1, j + 1
            continue
        for x, y in ((i + 1, j + 1), (i + 1, j), (i, j + 1)):
            if x + SURE <= len(own) and own[x : x + SURE] == other[y : y + SURE]:
                i, j = x, y
                break
        else:
            break
    return i, j


def _around(batches):
    """(component, before, after): hashes of up to REACH words to each side of a paragraph that stays, read outward."""
    for batch in batches:
        items = batch.column(0).to_pylist()
        data, offsets = H.text_bytes(batch.column(1))
        for a, b in H.slices(offsets):
            hashed, _, _, bounds = H.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out = []
            for d in range(a, b):
                own = hashed[bounds[d - a] : bounds[d - a + 1]]
                out += [(x["component"], own[max(x["begin"] - REACH, 0) : x["begin"]][::-1].tobytes(), own[x["end"] : x["end"] + REACH].tobytes()) for x in items[d]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["component", "before", "after"]
            )


def _carry_on(item: dict, edge: dict, hashed: np.ndarray) -> None:
    """Moves the ends of a removed piece outward; in the document of the first, half of the words between are left to each."""
    begin, end, most = item["begin"], item["end"], min(REACH, item["room"])
    for side in ("before", "after"):
        other = np.frombuffer(edge[side] or b"", _U)[:most].tolist()
        own = hashed[max(begin - most, 0) : begin][::-1] if side == "before" else hashed[end : end + most]
        i, j = carried(own.tolist(), other)
        if side == "before":
            item["begin"], item["first_begin"] = begin - i, item["first_begin"] - j
        else:
            item["end"] = end + i


_REMOVED = pa.list_(pa.struct([(k, pa.int64()) for k in ("begin", "end", "first_doc_id", "first_begin")]))


def _long_runs(items: list[dict], least: int) -> list[dict]:
    """``items`` without the pieces that, with those they touch, make up less than ``least`` words."""
    out, run, upto = [r for r in items if r["component"] is None], [], -1
    for r in [*sorted((r for r in items if r["component"] is not None), key=lambda r: r["begin"]), None]:
        if r is None or r["begin"] > upto:
            out += run if run and upto - run[0]["begin"] >= least else []
            run, upto = [], -1
        if r is not None:
            run.append(r)
            upto = max(upto, r["end"])
    return sorted(out, key=lambda r: (r["begin"], r["end"]))


def _cut_out(batches, least: int):
    """Texts without the words that lie in a removed paragraph, nor the space between two such words."""
    for batch in batches:
        removed, edges = batch.column("removed").to_pylist(), batch.column("edges").to_pylist()
        data, offsets = H.text_bytes(batch.column("text"))
        words_gone, spans, kept = [], [], []
        for i, items in enumerate(removed):
            own = data[offsets[i] : offsets[i + 1]]
            hashed, start, end, _ = H.words(own, np.array([0, len(own)]))
            pieces = {r["begin"]: r for r in items if r["component"] is not None}
            for e in edges[i]:
                _carry_on(pieces.pop(e["begin"]), e, hashed)
            items = removed[i] = _long_runs(items, least)
            edge = np.zeros(len(start) + 1, np.int64)
            np.add.at(edge, [r["begin"] for r in items], 1)
            np.add.at(edge, [r["end"] for r in items], -1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            parts, at = [], 0
            for s, e in zip(turn[::2], turn[1::2]):
                parts.append(own[at : start[s]])
                at = end[e - 1]
            parts.append(own[at:])
            words_gone.append(int(gone.sum()))
            spans.append(len(turn) // 2)
            kept.append(np.concatenate(parts).tobytes().decode("utf-8", "replace"))
        spanned = pa.array([[{f.name: r[f.name] for f in _REMOVED.value_type} for r in items] for items in removed], _REMOVED)
        out = [batch.column("_id"), pa.array(words_gone, pa.int64()), pa.array(spans, pa.int64()), spanned, pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_removed", "n_spans", "removed", "kept"])


def _open_edges(gone: DataFrame) -> DataFrame:
    """(doc_id, begin, component, left, right): removed pieces with no removed piece right before or right after them."""
    piece = gone.select("doc_id", F.filter("removed", lambda x: x["component"].isNotNull()).alias("_p"))
    piece = piece.select("doc_id", "_p", F.posexplode("_p").alias("_i", "_x"))
    left = F.coalesce(F.get("_p", F.col("_i") - 1)["end"] < F.col("_x.begin"), F.lit(True))
    right = F.coalesce(F.get("_p", F.col("_i") + 1)["begin"] > F.col("_x.end"), F.lit(True))
    return piece.select("doc_id", "_x.begin", "_x.component", left.alias("left"), right.alias("right")).where("left or right")


def dedup_paragraphs(
    docs: DataFrame,
    size: int = 5,
    num: int = 80,
    den: int = 100,
    bands: int = 6,
    rows: int = 2,
    min_words: int = 5,
    radius: int = 4,
    least: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_removed, n_spans, removed, kept): ``removed`` lists the removed paragraphs as words [begin, end) with
    the document and first word of the one that stays, ``n_removed`` counts the words in any of them, ``n_spans`` the
    maximal runs of such words, and ``kept`` is the text without these runs."""
    scratch = Scratch(docs.sparkSession, "paragraphs")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed, names = own_keys(base, scratch)
    keyed = keyed.select(F.col("doc_id").alias("_id"), F.col("_own").alias("doc_id"), "text")
    docs = keyed.select("doc_id", "text") if names is None else keyed.select("doc_id", "text").dropDuplicates(["doc_id"])
    itemise = paragraphs(size, min_words, radius)
    prep = scratch.cut(prepared(docs, itemise, banded(bands, rows, num, den)), "prepared")
    prep, classes, signed = classes_of(prep, scratch)
    joined = scratch.cut(components(prep, signed, docs, itemise, num, den, scratch, used=()), "joined")
    clusters = joined.union(classes.where("copies > 1").join(joined, "key", "left_anti").select("key", F.col("key").alias("component")))
    items = prep.where("n > 0").select("doc_id", "key", F.expr(f"item & {_PIECE - 1}").alias("item"), F.expr(f"item >= {_PIECE}").alias("piece"))
    places = scratch.cut(sifted(items, "key", sieve(clusters, "key")).join(clusters, "key").select("component", "doc_id", "item", "piece"), "places")
    scratch.drop("prepared", "joined", "classes")
    first = places.groupBy("component").agg(F.min(F.struct("doc_id", "item")).alias("first"))
    begin_of, end_of = (lambda c: F.shiftright(c, _HALF)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << _HALF) - 1)))
    own, begin, end = F.col("doc_id") == F.col("first.doc_id"), begin_of("item"), end_of("item")
    gone = places.join(first, "component").where(~own | (begin >= end_of("first.item")))
    room = F.when(own, F.floor((begin - end_of("first.item")) / 2)).otherwise(REACH)
    gone = gone.select(
        "doc_id", begin.alias("begin"), end.alias("end"), F.col("first.doc_id").alias("first_doc_id"), begin_of("first.item").alias("first_begin"),
        F.when(F.col("piece"), F.col("component")).alias("component"), room.cast("long").alias("room"),
    )
    if names is not None:
        gone = gone.join(names.select(F.col("_own").alias("first_doc_id"), F.col("doc_id").alias("_name")), "first_doc_id")
        gone = gone.withColumn("first_doc_id", F.col("_name"))
    item = F.struct("begin", "end", "first_doc_id", "first_begin", "component", "room")
    gone = scratch.cut(gone.groupBy("doc_id").agg(F.sort_array(F.collect_set(item)).alias("removed")), "gone")  # at most a document's paragraphs
    edges = scratch.cut(_open_edges(gone), "edges")
    asked = edges.select("component").distinct().join(first, "component")
    asked = asked.select(F.col("first.doc_id").alias("doc_id"), F.struct("component", begin_of("first.item").alias("begin"), end_of("first.item").alias("end")).alias("x"))
    asked = scratch.cut(asked.groupBy("doc_id").agg(F.collect_list("x").alias("items")), "asked")  # at most a document's pieces
    around = asked.join(sifted(docs, "doc_id", sieve(asked, "doc_id")), "doc_id").select("items", "text")
    around = around.mapInArrow(_around, "component long, before binary, after binary")
    beside = F.struct("begin", F.when(F.col("left"), F.col("before")).alias("before"), F.when(F.col("right"), F.col("after")).alias("after"))
    edges = edges.join(around, "component").groupBy("doc_id").agg(F.collect_list(beside).alias("edges"))  # at most a document's pieces
    gone = scratch.cut(gone.join(edges, "doc_id", "left"), "carried")
    scratch.drop("places", "gone", "edges", "asked")
    marks = sieve(gone, "doc_id")
    none = {"removed": gone.schema["removed"].dataType, "edges": gone.schema["edges"].dataType}
    whole = (F.col("_id").alias("doc_id"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.array().cast(REMOVED).alias("removed"), F.col("text").alias("kept"))
    hit = sifted(keyed, "doc_id", marks).join(gone, "doc_id", "left").select("_id", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()], "text")
    hit = hit.mapInArrow(lambda batches: _cut_out(batches, least), f"doc_id long, n_removed long, n_spans long, removed {REMOVED}, kept string")
    return sifted(keyed, "doc_id", marks, "left_anti").select(*whole).union(hit)
