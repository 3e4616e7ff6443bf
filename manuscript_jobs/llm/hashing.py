"""Vectorised word, shingle and byte-string hashes over Arrow text columns.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A hash is a
polynomial over the whole string modulo 2**64, finished by a mixer; equal strings always have
equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants made from a seed."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed * 1_000_003)) * _U(_BASE)) | _U(1)


_BYTE = constants(256, 1)
_LOW_BYTE = _BYTE[LOWER]
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column end to end and n + 1 offsets; null is empty."""
    if pa.types.is_string(column.type) and column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 300_000) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes each, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): hash of [s, e) before mixing is (sums[e] - sums[s]) * inverse[s]."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def words(data: np.ndarray, offsets: np.ndarray, folded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, bounds): the words of all documents; bounds[d]:bounds[d + 1] are document d's. Words that
    differ in the case of A-Z alone have one hash, but not where ``folded`` is false."""
    n = len(data)
    if not n:
        zero = np.zeros(0, np.int64)
        return np.zeros(0, _U), zero, zero, np.zeros(len(offsets), np.int64)
    full = ~SPACES[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = full.copy()
    first[1:] &= ~full[:-1] | cut[1:n]
    last = full.copy()
    last[:-1] &= ~full[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums, down = prefix_hash((_LOW_BYTE if folded else _BYTE)[data])
    hashed = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))
    return hashed, start, end, np.searchsorted(start, offsets)


def shingles(hashed: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bounds) of all ``size``-word shingles with repeats; a document of fewer words has its
    whole sequence as one, one without words none."""
    ks = constants(size + 1, 7)
    n = len(hashed)
    count = np.diff(bounds)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(made, out=out[1:])
    total = np.zeros(max(n - size + 1, 0), _U)
    for j in range(size):
        total += hashed[j : n - size + 1 + j] * ks[j] if n >= size else 0
    result = np.zeros(int(out[-1]), _U)
    long = count >= size
    if long.any():
        keep = np.ones(len(total), bool)
        # A shingle that begins in the last words of a document would cross its end.
        ends = bounds[1:][count > 0]
        for j in range(1, size):
            at = ends - j
            at = at[(at >= 0) & (at < len(total))]
            keep[at] = False
        # Documents shorter than a shingle lose all their starts.
        mask = np.repeat(long, made)
        result[mask] = total[keep]
    short = np.flatnonzero((count > 0) & ~long)
    if len(short):
        total = np.zeros(len(short), _U)
        for j in range(size - 1):
            has = count[short] > j
            total[has] += hashed[bounds[short[has]] + j] * ks[j]
        result[out[short]] = total + ks[size] * count[short].astype(_U)
    return mix(result), out


def distinct(hashed: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document."""
    hashed = hashed.copy()
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - s > 1:
            hashed[s:e].sort()
    fresh = np.ones(len(hashed), bool)
    fresh[1:] = hashed[1:] != hashed[:-1]
    fresh[bounds[:-1][np.diff(bounds) > 0]] = True
    upto = np.zeros(len(hashed) + 1, np.int64)
    np.cumsum(fresh, out=upto[1:])
    return hashed[fresh], upto[bounds]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    hashed, _, _, bounds = words(data, offsets)
    return distinct(*shingles(hashed, bounds, size))
