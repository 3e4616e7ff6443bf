"""Document quality by a linear-chain conditional random field over lines.

Each line is labelled good or bad. Its features are shape figures of the line itself and of the lines
before and after it (no words, language, source or id); neighbouring labels are tied by transition
weights. Forward-backward marginals of the lines, averaged by length, give a document's quality, which
a logistic curve turns into a probability of label 1.

The field is fitted on a bounded sample of labelled documents (``most`` documents, those with the least
md5 of their ids, each with a run of ``most_lines`` lines at most; a line has its document's label). Everything
else covers all lines of all documents. Null and empty texts are one empty line. Repeated rows are scored
each; an empty table gives no rows; without labels of both kinds every document gets 0.5.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import text_batches

MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_OWN = 14 + len(MARKS)
WIDTH = 3 * _OWN + 1


def _classes() -> np.ndarray:
    """For each byte: upper, lower, digit, other ASCII, lead byte of a longer character; then one column a mark."""
    table = np.zeros((256, 5 + len(MARKS)), bool)
    table[65:91, 0] = True
    table[97:123, 1] = True
    table[48:58, 2] = True
    table[[*MARKS], 3] = True
    table[192:256, 4] = True
    for i, b in enumerate(MARKS):
        table[b, 5 + i] = True
    return table


@dataclass
class Lines:
    """All lines of all documents: bytes [starts, ends), document of each; bounds[d]:bounds[d + 1] are document d's."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    bounds: np.ndarray
    twin: np.ndarray  # whether the same line stands elsewhere in its document

    def features(self, i: int, j: int) -> np.ndarray:
        """The own features of lines i to j - 1; no bytes but theirs are looked at."""
        low = self.starts[i]
        data, starts, ends = self.data[low : self.ends[j - 1]], self.starts[i:j] - low, self.ends[i:j] - low
        n, length = j - i, (ends - starts).astype(np.float64)

        def per_line(flag: np.ndarray) -> np.ndarray:
            upto = np.zeros(len(data) + 1, np.int64)
            np.cumsum(flag, out=upto[1:])
            return (upto[ends] - upto[starts]).astype(np.float64)

        hashed, word_start, _, _ = H.words(data, np.append(starts, len(data)))
        word_line = np.searchsorted(starts, word_start, "right") - 1
        words = np.bincount(word_line, minlength=n).astype(np.float64)
        same = np.zeros((3, n))
        for k in range(1, 4):
            if len(hashed) > k:
                hit = (hashed[k:] == hashed[:-k]) & (word_line[k:] == word_line[:-k])
                same[k - 1] = np.bincount(word_line[k:][hit], minlength=n)
        by = np.lexsort((hashed, word_line))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (hashed[by][1:] != hashed[by][:-1]) | (word_line[by][1:] != word_line[by][:-1])
        distinct = np.bincount(word_line[by][fresh], minlength=n)
        table = _classes()
        there = np.bincount(data, minlength=256) > 0
        marks = [per_line(table[data, 5 + m]) if there[MARKS[m]] else np.zeros(n) for m in range(len(MARKS))]
        upper, lower, digit, punct, wide = (per_line(table[data, m]) for m in range(5))
        w, c = np.maximum(words, 1), np.maximum(length, 1)
        final = np.where(ends > starts, data[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
        head = np.where(ends > starts, data[np.minimum(starts, max(len(data) - 1, 0))] if len(data) else 0, 0)
        return np.stack(
            [
                np.log1p(length) / 5, np.log1p(words) / 4, length / w / 10, upper / c, lower / c, digit / c, wide / c,
                np.minimum(punct / w, 3), same[0] / w, same[1] / w, same[2] / w, distinct / w, self.twin[i:j].astype(float),
                np.isin(final, [46, 33, 63]).astype(float) + 0.5 * ((head >= 65) & (head < 91)),
                *(np.minimum(m / w, 3) for m in marks),
            ],
            axis=1,
        ).astype(np.float32)

    def runs(self, most_lines: int, most_bytes: int):
        """Ranges of lines of bounded count and bytes, one line at least."""
        i = 0
        while i < len(self.starts):
            j = min(i + most_lines, int(np.searchsorted(self.ends, self.starts[i] + most_bytes, "right")))
            yield i, max(i + 1, j)
            i = max(i + 1, j)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """A line begins at a document's start and after each line feed; an empty document has one empty line."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    docs = np.concatenate([np.arange(n_docs), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((starts, docs))
    starts, docs = starts[order], docs[order]
    last = np.ones(len(starts), bool)
    last[:-1] = docs[1:] != docs[:-1]
    ends = np.where(last, offsets[docs + 1], np.append(starts[1:], 0) - 1)
    sums, down = H.prefix_hash(H._BYTE[data])
    line_hash = (sums[ends] - sums[starts]) * down[starts]
    by = np.lexsort((line_hash, docs))
    twin = np.zeros(len(starts), bool)
    eq = (line_hash[by][1:] == line_hash[by][:-1]) & (docs[by][1:] == docs[by][:-1])
    twin[by[1:][eq]] = True
    twin[by[:-1][eq]] = True
    return Lines(data, starts, ends, docs, np.searchsorted(docs, np.arange(n_docs + 1)), twin)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, bounds) of all lines: own features, those of the line before and after, and 1."""
    lines = lines_of(data, offsets)
    own = lines.features(0, len(lines.starts))
    before, after = np.zeros_like(own), np.zeros_like(own)
    inner = np.flatnonzero(lines.docs[1:] == lines.docs[:-1])
    before[inner + 1] = own[inner]
    after[inner] = own[inner + 1]
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], axis=1), (lines.ends - lines.starts) + 1.0, lines.bounds


def _logsum(a, b):
    return np.logaddexp(a, b)


def marginals(unary: np.ndarray, bounds: np.ndarray, turn: np.ndarray, counts: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(line good), expected transitions per document [d, 2, 2] if ``counts``, log normaliser) by forward-backward.

    ``unary`` [lines, 2] and ``turn`` [2, 2] are log potentials. Documents step through their lines
    together, the longest first."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    first, sizes = bounds[:-1][order], n[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")  # documents with more than t lines
    forward, backward = np.array(unary, np.float64), np.zeros_like(unary, np.float64)
    for t in range(1, steps):
        at = first[: active[t]] + t
        prev = forward[at - 1]
        for y in (0, 1):
            forward[at, y] += _logsum(prev[:, 0] + turn[0, y], prev[:, 1] + turn[1, y])
    last = bounds[1:] - 1
    norm = _logsum(forward[last, 0], forward[last, 1])
    pairs = np.zeros((len(n), 2, 2))
    for t in range(steps - 2, -1, -1):
        who = order[: active[t + 1]]
        at = first[: active[t + 1]] + t
        nxt = backward[at + 1] + unary[at + 1]
        for y in (0, 1):
            backward[at, y] = _logsum(nxt[:, 0] + turn[y, 0], nxt[:, 1] + turn[y, 1])
            for z in (0, 1) if counts else ():
                pairs[who, y, z] += np.exp(forward[at, y] + turn[y, z] + nxt[:, z] - norm[who])
    belief = forward + backward
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), pairs, norm


@dataclass
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of a good line against a bad one
    turn: np.ndarray
    curve: tuple[float, float]
    constant: float | None = None

    def potentials(self, lines: Lines, most_lines: int = 4000, most_bytes: int = 300_000) -> np.ndarray:
        """Each line's log potential of good against bad. Features are made for a run of lines at a time and kept
        as three sums a line: its own share and what it gives to the lines after and before it."""
        each = (self.weights / self.scale).astype(np.float64)
        shares = np.zeros((len(lines.starts), 3))
        for i, j in lines.runs(most_lines, most_bytes):
            shares[i:j] = lines.features(i, j) @ each[:-1].reshape(3, _OWN).T
        total = shares[:, 0] + each[-1] - float(each @ self.mean)
        inner = np.flatnonzero(lines.docs[1:] == lines.docs[:-1])
        total[inner + 1] += shares[inner, 1]
        total[inner] += shares[inner + 1, 2]
        return np.clip(total, -30, 30)

    def quality(self, potentials: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals."""
        good, _, _ = marginals(np.stack([np.zeros(len(potentials)), potentials], axis=1), bounds, self.turn, False)
        return np.add.reduceat(good * lengths, bounds[:-1]) / np.add.reduceat(lengths, bounds[:-1])

    def score(self, lines: Lines) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(lines.bounds) - 1, self.constant)
        q = np.clip(self.quality(self.potentials(lines), lines.ends - lines.starts + 1.0, lines.bounds), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(q / (1 - q)) + self.curve[1])))


def train(x: np.ndarray, lengths: np.ndarray, bounds: np.ndarray, labels: np.ndarray, rounds: int = 300, rate: float = 0.05, decay: float = 1e-3) -> Crf:
    """Maximises the conditional likelihood of the lines' labels by Adam; both labels weigh the same."""
    if not len(labels) or labels.min() == labels.max():
        return Crf(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), (1.0, 0.0), 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    z = ((x - mean) / scale).astype(np.float64)
    n = np.diff(bounds)
    line_label = np.repeat(labels, n)
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    weight = share / n  # a document counts once, whatever its lines
    line_weight = np.repeat(weight, n)
    want = np.zeros((2, 2))
    for y in (0, 1):
        want[y, y] = (weight * (n - 1))[labels == y].sum()
    theta, turn = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = v = np.zeros(len(theta) + 4)
    for step in range(1, rounds + 1):
        unary = np.stack([np.zeros(len(z)), np.clip(z @ theta, -30, 30)], axis=1)
        good, pairs, _ = marginals(unary, bounds, turn)
        grad = np.concatenate(
            [z.T @ (line_weight * (line_label - good)) - decay * theta, (want - (pairs * weight[:, None, None]).sum(0) - decay * turn).ravel()]
        )
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta, turn = theta + move[:-4], turn + move[-4:].reshape(2, 2)
    crf = Crf(mean, scale, theta, turn, (1.0, 0.0))
    q = np.clip(crf.quality(np.clip(z @ theta, -30, 30), lengths, bounds), 1e-4, 1 - 1e-4)
    logit, a, b = np.log(q / (1 - q)), 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(a * logit + b)))
        a += 0.05 * (((labels - p) * logit).mean() - 0.01 * (a - 0.5))
        b += 0.2 * (labels - p).mean()
    crf.curve = (max(float(a), 0.05), float(b))
    return crf


def fit(docs: DataFrame, labels: DataFrame, usable, most: int = 4000, most_lines: int = 60, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Crf:
    """Fits on up to ``most`` labelled documents for which ``usable`` (a predicate on the id) holds. Only the
    features of a run of ``most_lines`` lines of each, begun at a place drawn by a hash of its id, come to the
    driver: with the defaults 240,000 lines, 134 MB, at most. Of rows that share an id and a label one counts, the least
    by its features."""
    chosen = (
        labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(usable(F.col("doc_id")) & F.col("label").isin(0, 1))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "label")
        .limit(most)
        .distinct()
    )
    sample = text_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")

    def features(batches):
        for batch in batches:
            data, offsets = H.text_bytes(batch.column("text"))
            for a, b in H.slices(offsets):
                x, lengths, bounds = line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                first = bounds[:-1] + np.array([zlib.crc32(str(i).encode()) % max(1, m - most_lines + 1) for i, m in zip(batch.column("doc_id")[a:b].to_pylist(), np.diff(bounds).tolist())])
                keep = [(i, s, min(e, s + most_lines)) for i, (s, e) in enumerate(zip(first.tolist(), bounds[1:].tolist()))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[a:b],
                        batch.column("label")[a:b],
                        pa.array([x[s:e].tobytes() for _, s, e in keep], pa.binary()),
                        pa.array([lengths[s:e].tobytes() for _, s, e in keep], pa.binary()),
                    ],
                    ["doc_id", "label", "x", "lengths"],
                )

    rows = sample.select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, x binary, lengths binary")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct("x", "lengths")).alias("f")).select("doc_id", "label", "f.*").collect()  # ``most`` rows at most
    rows.sort(key=lambda r: (r.doc_id, r.label, bytes(r.x)))
    if not rows:
        return train(np.zeros((0, WIDTH)), np.zeros(0), np.zeros(1, int), np.zeros(0))
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in rows]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
    return train(np.concatenate(xs), np.concatenate([np.frombuffer(r.lengths) for r in rows]), bounds, np.array([r.label for r in rows]))


def score_documents(docs: DataFrame, crf: Crf, keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``score`` of every row, in one pass without a shuffle."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        data, offsets = H.text_bytes(texts)
        out = []
        for a, b in H.slices(offsets):
            out.append(crf.score(lines_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return text_batches(docs).select(*keep, scored(F.coalesce(F.col(text), F.lit(""))).alias("score"))


def held_out(doc_id, modulus: int = 4, rest: int = 2):
    """crc32 of the id as text, modulo: which rows no label is learnt from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))
