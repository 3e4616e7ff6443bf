"""Packing documents into fixed windows of tokens by best fit decreasing.

Each task tokenizes its documents, cuts full windows off overlong ones at once and keeps only the
length and place of each remainder. Remainders are packed in blocks: longest first, each into the
open window with the least room that still holds it, found in a segment tree indexed by remaining
capacity. Nothing is shuffled and no task holds more than one block, so the work grows with the
input alone; a block leaves at most a few windows part full.

Null text is empty (its document is the end id alone); repeated rows are packed each for itself; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import hashing as H
from .common import text_batches

TOKENIZER = "word_bpe_49k.json"
PIECE_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Counts open windows by remaining capacity; ``fit(n)`` finds the least capacity of n or more in use."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list] = [[] for _ in range(self.size)]

    def add(self, room: int, window) -> None:
        self.open[room].append(window)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, room: int):
        at = room + self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.open[room].pop()

    def fit(self, need: int) -> int:
        """The least capacity >= need that an open window has, or -1."""
        count, at = self.count, need + self.size
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:  # a right sibling holds larger capacities only
                at += 1
                while at < self.size:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """(window number, offset) of each piece and the count of windows. Equal lengths go in input order."""
    tree, made = CapacityTree(window), 0
    number, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        room = tree.fit(need)
        if room < 0:
            at, room, made = made, window, made + 1
        else:
            at = tree.take(room)
        number[i], offset[i] = at, window - room
        if room > need:
            tree.add(room - need, at)
    return number, offset, made


class WordTokens:
    """Token ids of whole documents, looked up by word.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words
    in turn. Each distinct word is tokenized once per task (by the tokenizer itself; plain Latin
    words in one call for all, with its normalizer's and splitter's work done here) and its ids kept
    under the word's 64-bit hash, case and all, as special tokens are told by case. The store is emptied at ``most``
    words. A tokenizer file that normalizes or splits in another way is refused.
    """

    # What a tokenizer file does to a text ahead of its vocabulary, and its splitter's pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMALIZERS, SPLITTERS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]

    def __init__(self, path: str, most: int = 1_000_000):
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        steps = json.loads(self.full.to_str())
        before, split = ((steps[k] or {}).get(n, []) for k, n in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        if [x["type"] for x in before] != self.NORMALIZERS or [x["type"] for x in split] != self.SPLITTERS or split[0]["pattern"] != {"Regex": self.PATTERN}:
            raise ValueError(f"{path} splits texts in another way than this packer")
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.bare.encode_special_tokens = True
        self.split = regex.compile(self.PATTERN).findall
        self.plain = regex.compile("[!-~¡-įı-ɏ]*").fullmatch
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(hidden)} | {32: " "}
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.pieces: dict[str, bytes] = {}

    def _tokenize(self, texts: list[str]) -> list[bytes]:
        plain = [bool(self.plain(w)) and "<|" not in w for w in texts]
        parts = [self.split(w.lower()) if p else None for w, p in zip(texts, plain)]
        if len(self.pieces) > 100_000:
            self.pieces = {}
        fresh = list({p for q in parts if q for p in q}.difference(self.pieces))
        if fresh:
            got = self.bare.encode(" ".join(fresh).encode().decode("latin-1").translate(self.alphabet), add_special_tokens=False)
            ends = np.searchsorted(np.array(got.word_ids), np.arange(len(fresh) + 1)).tolist()
            raw = np.array(got.ids, "<u4").tobytes()
            for piece, s, e in zip(fresh, ends, ends[1:]):
                self.pieces[piece] = raw[4 * s : 4 * e]
        known = self.pieces
        return [
            b"".join([known[p] for p in q]) if q is not None else np.array(self.full.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            for w, q in zip(texts, parts)
        ]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the documents between the offsets."""
        hashed, start, end, bounds = H.words(data, offsets, folded=False)
        unique, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            got = self._tokenize([raw[s:e].decode() for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            lengths = np.array([len(g) // 4 for g in got], np.int64)
            starts = len(self.flat) + np.cumsum(lengths) - lengths
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(got), "<u4")])
            self.starts = np.insert(self.starts, at[new], starts)
            self.lengths = np.insert(self.lengths, at[new], lengths)
            self.keys = np.insert(self.keys, at[new], unique[new])
            at = np.searchsorted(self.keys, unique)
        per_word = self.lengths[at][inverse]
        upto = np.zeros(len(per_word) + 1, np.int64)
        np.cumsum(per_word, out=upto[1:])
        where = np.repeat(self.starts[at][inverse] - upto[:-1], per_word) + np.arange(upto[-1])
        return self.flat[where], upto[bounds]


@lru_cache(1)
def _tokens(path: str | None) -> WordTokens:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return WordTokens(path)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    window: int = 2048,
    end_id: int = 1,
    block: int = 16_384,
    keep_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens,
    sequence_id, offset (in its sequence) and, with ``keep_ids``, the ids themselves.

    ``tokenizer`` is the vocabulary file's path (by default the public one). A block of up to
    ``block`` remainders is packed together within the task that cut them. A sequence's id is made of
    the partition's number and a count.
    """

    def packed(batches):
        tokens, part = _tokens(tokenizer), TaskContext.get().partitionId() << 40
        made, waiting = 0, []
        names = [f.split()[0] for f in PIECE_SCHEMA.split(",")]

        def table(ids, rows, pieces):
            cols = [ids, *(pa.array(c, pa.int64()) for c in zip(*rows))]
            if keep_ids:
                cols.append(pa.array(pieces, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(cols, [doc_id, *names, *["ids"] * keep_ids])

        def flush():
            nonlocal made, waiting
            where, offset, used = best_fit_decreasing([r[2] for r in waiting], window)
            out = table(
                pa.array([r[0] for r in waiting], pa.int64()),
                [(r[1], r[2], r[3], r[4], part + made + w, o) for r, w, o in zip(waiting, where, offset)],
                [r[5] for r in waiting],
            )
            made, waiting = made + used, []
            return out

        for batch in batches:
            keys = batch.column(0).to_pylist()
            data, offsets = H.text_bytes(batch.column(1))
            for a, b in H.slices(offsets, 500_000):
                ids, bounds = tokens.ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                whole = []
                for d in range(b - a):
                    own = np.append(ids[bounds[d] : bounds[d + 1]], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(own), window):
                        piece = own[s : s + window]
                        row = (keys[a + d], s, len(piece), zlib.crc32(piece.tobytes()), len(own), piece.astype(np.int32) if keep_ids else None)
                        if len(piece) == window:
                            whole.append(row)
                        else:
                            waiting.append(row)
                    if len(waiting) >= block:
                        yield flush()
                if whole:
                    yield table(
                        pa.array([r[0] for r in whole], pa.int64()),
                        [(*r[1:5], part + made + i, 0) for i, r in enumerate(whole)],
                        [r[5] for r in whole],
                    )
                    made += len(whole)
        if waiting:
            yield flush()

    schema = f"{doc_id} long, {PIECE_SCHEMA}" + ", ids array<int>" * keep_ids
    return text_batches(docs).selectExpr(f"cast(`{doc_id}` as long) `{doc_id}`", f"`{text}` _text").mapInArrow(packed, schema)
