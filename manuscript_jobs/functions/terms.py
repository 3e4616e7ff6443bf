"""Counts of hashed n-grams of lists of words, for Arrow batches inside tasks.

Terms are hashed as Spark's ``HashingTF`` does (Murmur3 of the UTF-8 bytes, seed 42), so counts are those of its vectors.
A slice's words lie in one buffer with a space between, where every n-gram is a run of bytes: all of them are hashed at
once. Character n-grams are hashed once a distinct word of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 16  # words taken together
_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _mixed(k: np.ndarray) -> np.ndarray:
    return _turned(k * _C1, 15) * _C2


def murmur(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Murmur3 (32 bits, seed 42) of runs of bytes; ``data`` goes on for four bytes after the last."""
    four = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    h, blocks = np.full(len(start), 42, np.uint32), size >> 2
    live, j = np.flatnonzero(blocks), 0
    while len(live):
        h[live] = _turned(h[live] ^ _mixed(four[start[live] + 4 * j]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        j += 1
        live = live[blocks[live] > j]
    rest = four[start + 4 * blocks] & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], np.uint32)[size & 3]
    h ^= _mixed(rest)
    h ^= size.astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _slots(h: np.ndarray, dimensions: int) -> np.ndarray:
    return h.view(np.int32).astype(np.int64) % dimensions


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every count, one after the other."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def _joined(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes with a space before, between and after them; where each begins and its bytes."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.full(9, 32, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    _, at, data = words.buffers()
    at = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(at)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    out = np.full(len(raw) + len(words) + 9, 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(1, len(words) + 1), size)] = raw
    return out, at[:-1] - at[0] + np.arange(1, len(words) + 1), size


def _counts(key: np.ndarray, rows: int, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of rows, indices and counts of keys row * dimensions + index."""
    key = key.astype(np.int32) if rows * dimensions < 1 << 31 else key
    found, n = np.unique(key, return_counts=True)
    return np.searchsorted(found, np.arange(rows + 1, dtype=np.int64) * dimensions), (found % dimensions).astype(np.int32), n.astype(np.float64)


def _pieces(words: pa.Array, dimensions: int, chars: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the character n-grams of every word, padded by a space, and where each word's begin and end."""
    data, start, size = _joined(words)
    total = int(start[-1] + size[-1]) + 1 if len(words) else 0
    at = np.flatnonzero((data[:total] & 0xC0) != 0x80)  # where characters begin
    first, last = np.searchsorted(at, start - 1), np.searchsorted(at, start + size)
    ends, owner, begin, length = np.append(at, total), [], [], []
    for n in range(chars[0], chars[1] + 1):
        count = np.maximum(last - first + 2 - n, 0)
        i = _spread(first, count)
        owner.append(np.repeat(np.arange(len(words)), count))
        begin.append(ends[i])
        length.append(ends[i + n] - ends[i])
    owner, begin, length = (np.concatenate(x) for x in (owner, begin, length))
    order = np.argsort(owner, kind="stable")
    begin, length, wide = begin[order], length[order], 4 * (chars[1] + 1) + 4
    marked = np.zeros((len(begin), wide), np.uint8)  # a piece after its mark
    marked[:, 0] = ord("~")
    for i in range(int(length.max(initial=0))):
        some = length > i
        marked[some, i + 1] = data[begin[some] + i]
    slots = _slots(murmur(np.append(marked.ravel(), np.zeros(4, np.uint8)), np.arange(len(begin)) * wide, length + 1), dimensions)
    return slots, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]).astype(np.int64)


def counted(lists: pa.Array, dimensions: int, words: int = 3, chars: tuple = (2, 4)) -> Iterator[tuple]:
    """Slices of lists of words: for each, the counts (ends of rows, indices, counts) of word n-grams and of the character
    n-grams of its distinct words."""
    lists = lists.cast(pa.large_list(pa.large_string()))
    ends = np.asarray(lists.offsets)
    ends, flat, at = ends - ends[0], lists.flatten(), 0
    while at < len(lists):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        upto = min(upto, at + SLICE)
        here = flat.slice(int(ends[at]), int(ends[upto] - ends[at]))
        yield _slice(here, ends[at : upto + 1] - ends[at], dimensions, words, chars)
        at = upto


def _slice(flat: pa.Array, ends: np.ndarray, dimensions: int, words: int, chars: tuple) -> tuple:
    rows = len(ends) - 1
    row, last = np.repeat(np.arange(rows), np.diff(ends)), np.repeat(ends[1:], np.diff(ends))
    data, start, size = _joined(flat)
    keys = []
    for n in range(1, words + 1):
        i = np.flatnonzero(np.arange(len(flat)) + n <= last)
        j = i + n - 1
        keys.append(row[i] * dimensions + _slots(murmur(data, start[i], start[j] + size[j] - start[i]), dimensions))
    coded = flat.dictionary_encode()
    slots, upto = _pieces(coded.dictionary, dimensions, chars)
    kinds = max(len(coded.dictionary), 1)
    distinct = np.unique(row * kinds + np.asarray(coded.indices))
    owner, word = distinct // kinds, distinct % kinds
    count = upto[word + 1] - upto[word] if len(word) else word
    pieces = np.repeat(owner, count) * dimensions + slots[_spread(upto[word], count)]
    return _counts(np.concatenate(keys), rows, dimensions), _counts(pieces, rows, dimensions)


def vectors(counts: tuple, dimensions: int) -> pa.Array:
    """Counts as sparse vectors, in the form that Spark stores them."""
    ends, n = pa.array(counts[0].astype(np.int32)), len(counts[0]) - 1
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in counts[1:]]
    return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, dimensions, np.int32)), *lists], ["type", "size", "indices", "values"])


def scaled(counts: tuple, weights: np.ndarray) -> np.ndarray:
    """Weighted counts, each row of unit length."""
    ends, indices, values = counts
    x, size = values * weights[indices], np.diff(ends)
    length = np.sqrt(np.bincount(np.repeat(np.arange(len(size)), size), x * x, len(size)))
    return x / np.repeat(np.where(length > 0, length, 1.0), size)


def margins(counts: tuple, weights: np.ndarray, coefficients: np.ndarray, most: int = 1 << 16) -> np.ndarray:
    """The product of weighted rows of unit length and coefficients (index x class), a bounded run of rows at a time."""
    ends, indices, _ = counts
    x, out = scaled(counts, weights), np.zeros((len(ends) - 1, coefficients.shape[1]))
    full = np.flatnonzero(np.diff(ends))
    begin, at = ends[full], 0
    while at < len(full):
        upto = max(at + 1, int(np.searchsorted(begin, begin[at] + most)))
        low, high = begin[at], ends[full[upto - 1] + 1]
        out[full[at:upto]] = np.add.reduceat(coefficients[indices[low:high]] * x[low:high, None], begin[at:upto] - low, axis=0)
        at = upto
    return out


def shares(margin: np.ndarray) -> np.ndarray:
    """Softmax of every row; infinite margins take all."""
    most = margin.max(axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        e = np.where(np.isinf(most), margin == most, np.exp(margin - most))
    return e / e.sum(axis=1, keepdims=True)
