"""SimHash, lexical search and source divergence against brute force."""

import random

import numpy as np
import pytest
from test_corpus_operators import LOWER, WORDS, corpus, empty, roots, text


def simhash(t, size=3):
    import xxhash

    w = WORDS.findall((t or "").encode().translate(LOWER))
    if not w:
        return 0
    grams = [b" ".join(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))]
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def grouped(rows, radius=3):
    """{(id, text): component} by all pairs."""
    prints = [simhash(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    out = {}
    for k, members in enumerate(by_root(roots(len(rows), links)).values()):
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[rows[i]] = f"{prints[i]:016x}", min(ids, default=None)
    return out


def by_root(root):
    out = {}
    for i, r in enumerate(root):
        out.setdefault(r, []).append(i)
    return out


@pytest.mark.parametrize("shard_rows", [1 << 20, 8])
def test_simhash_components(spark, shard_rows):
    from manuscript_jobs.llm.simhash import simhash_components

    docs, _ = corpus(spark, 3)
    more = [(None, "null id here", *[None] * 7), (None, "", *[None] * 7), (0, "shared id, another text of some words", *[None] * 7)]
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame(more, docs.schema))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = simhash_components(docs, shard_rows=shard_rows, least_rows=4).collect()
    want = grouped(rows)
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *want[i, t])) for i, t in rows)
    assert simhash_components(empty(spark)).count() == 0


@pytest.mark.parametrize("leaf", [4, 96])
def test_vantage_trees_find_all_pairs(leaf):
    from manuscript_jobs.llm.simhash import ShardTree, VantageTree

    r = np.random.default_rng(leaf)
    base = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    points = np.unique(np.concatenate([base, base[:100] ^ (np.uint64(1) << r.integers(0, 64, 100, dtype=np.uint64)), base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    want = {(i, j) for i in range(len(points)) for j in range(len(points)) if int(points[i] ^ points[j]).bit_count() <= 3}
    assert {(int(a), int(b)) for q, p in VantageTree(points, leaf).pairs(points, 3) for a, b in zip(q, p)} == want
    tree = ShardTree(np.sort(points[::3]), 7)
    assert tree.shards == 7
    home = dict(zip(*(x.tolist() for x in tree.reached(points, 0))))
    reached = set(zip(*(x.tolist() for x in tree.reached(points, 3))))
    assert len(home) == len(points)
    assert all((i, home[j]) in reached for i, j in want)


def test_fingerprints_are_dealt_in_proportion(spark):
    """As many rows a fingerprint whatever the number of shards, and of each linked pair both in one shard."""
    from manuscript_jobs.llm import simhash as S

    r = np.random.default_rng(8)
    base = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    flips = [base[:600] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (3, 600), dtype=np.uint64)) for _ in range(2)]
    points = np.unique(np.concatenate([base, *flips, base[0] ^ (np.uint64(1) << np.arange(63, dtype=np.uint64))]))
    prints = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "print long")
    for shards in (1, 40):
        placed = [tuple(x) for x in S._placed(prints, {}, shards, 3).collect()]
        assert len(placed) == 4 * len(points) and len({x[0] for x in placed}) >= shards
    want = roots(len(points), [(i, j) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]) <= 3).tolist()])
    number = {int(x): i for i, x in enumerate(points.view(np.int64))}
    for crowded in ({}, S._crowded(prints, 3, 30)):
        links = [(number[x.a], number[x.b]) for x in S._links(S._placed(prints, crowded, 40, 3), 3).collect()]
        assert roots(len(points), links) == want
    assert crowded


def test_fingerprint_of_a_long_text():
    from manuscript_jobs.llm import simhash as S

    t = text(random.Random(5), 4000)
    S.CHUNK, old = 1000, S.CHUNK
    try:
        assert S.fingerprint(t.encode()) == simhash(t)
    finally:
        S.CHUNK = old


def lexical(docs, items, k):
    """Rows by the formula, over all documents and items in Python."""
    import math
    import re

    cut = lambda t: [w for w in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))]
    held = [(i, cut(t)) for i, t in docs if cut(t)]
    n, words = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, t in items:
        scored = []
        for i, w in held:
            m = 75 + 25 * len(w) * n // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * w.count(x) // (1000 * w.count(x) + 12 * m)) for x in cut(t) if x in df)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize("rows, most_items", [(1 << 16, 4096), (7, 2)])
def test_lexical_search(spark, rows, most_items):
    from manuscript_jobs.llm import lexical as L

    docs, _ = corpus(spark, 4)
    docs = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, "theta zeta iota", *[None] * 7), (None, None, *[None] * 7)], docs.schema)).coalesce(2)
    r = random.Random(8)
    items = [(0, None), (1, ""), (2, "Theta, THETA theta iota; kappa?"), (2, "δέλτα new7 word e"), (None, "alpha beta"), (5, "unknown words 123")] + [(i, text(r, 9)) for i in range(6, 14)]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = L.search(docs, asked, k=6, most_items=most_items, block_rows=rows).collect()
    assert sorted(map(str, map(tuple, got))) == lexical([tuple(x) for x in docs.select("doc_id", "text").collect()], items, 6)
    assert L.search(empty(spark), asked).count() == 0
    assert L.search(docs, asked.limit(0)).count() == 0


def test_pair_bounds_hold_and_skip():
    """Every pair's joint maximum bounds its documents, pair units never add up to more than terms alone, and the
    search reads fewer postings for it."""
    from manuscript_jobs.llm.lexical import Block, candidate_pairs

    r = np.random.default_rng(3)
    n, k = 400, 5
    held = r.random((12, n)) < np.linspace(0.05, 0.5, 12)[:, None]
    held[3] &= ~held[4]
    term, doc = np.nonzero(held)
    impact = r.integers(1, 1000, len(term))
    counts = {t: 1 + t % 3 for t in range(12)}
    pairs = candidate_pairs([counts], np.arange(12))[0]
    block = Block(term, doc, impact, n, 12, set(pairs))
    full = np.zeros((12, n), np.int64)
    full[term, doc] = impact
    for a, b in pairs:
        both = (full[a] > 0) & (full[b] > 0)
        assert block.joint.get((a, b), 0) == (full[a] + full[b])[both].max(initial=0)
    units = block.units(counts, pairs)
    assert sorted(t for _, some in units for t in some) == list(range(12))
    for bound, some in units:
        assert bound >= sum(counts[t] * full[t] for t in some).max()
    assert sum(b for b, _ in units) < sum(q * full[t].max() for t, q in counts.items())
    score = sum(q * full[t] for t, q in counts.items())
    found, scores = block.search(counts, pairs, 1, k)
    top = np.sort(score)[::-1][:k]
    assert np.array_equal(np.sort(scores)[::-1][:k], top) and np.array_equal(score[found], scores)
    assert not block.sums.any()


def divergence(rows, min_df, top):
    """Rows by the definition, over all terms, groups and pairs in Python."""
    import re
    from collections import Counter

    docs = [(g or "", s or "", re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))) for g, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = [w for w, n in df.items() if n >= min_df]
        counts = {s: Counter(w for d in mine if d[1] == s for w in d[2] if df[w] >= min_df) for s in {d[1] for d in mine}}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in p:
            ranked = {"pair": [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in p if o != s], "term": [(q[w] - p[s][w], w) for w in kept if counts[s][w] and p[s][w] > q[w]]}
            for part, found in ranked.items():
                for r, (v, item) in enumerate(sorted(found), 1):
                    if part == "pair" or r <= top:
                        out.append((lang, s, part, item.decode(), -v, r))
    return sorted(out)


@pytest.mark.parametrize("most_terms", [1 << 20, 3])
def test_source_divergence(spark, most_terms):
    from manuscript_jobs.llm.divergence import audit

    docs, _ = corpus(spark, 6)
    rows = [(None, "theta Zeta iota\x01a", None, None, *[None] * 5), (None, None, None, "s1", *[None] * 5), (9, "ʼn7x-δ ÀB É", "de", "s\U0001f600", *[None] * 5), (9, "δ alpha alpha", "de", "s\uffff", *[None] * 5), (9, "zeta", "fr", "s1", *[None] * 5)]
    docs = docs.union(docs.limit(4)).union(spark.createDataFrame(rows, docs.schema))
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    for min_df in (1, 3):
        got = audit(docs, min_df=min_df, top=4, most_terms=most_terms).collect()
        assert sorted(map(tuple, got)) == divergence(rows, min_df, 4)
    assert audit(empty(spark)).count() == 0


def test_divergence_of_many_sources(spark):
    from manuscript_jobs.llm import divergence as D

    r = random.Random(2)
    rows = [("en", f"s{r.randrange(300)}", text(r, 6)) for _ in range(900)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert len({s for _, s, _ in rows}) > D.SOURCES
    assert sorted(map(tuple, D.audit(docs, top=3).collect())) == divergence(rows, 30, 3)


@pytest.mark.parametrize("merged", [1, 1 << 20])
def test_terms_of_a_group_are_counted_together(spark, merged):
    """Counts and document frequencies are the sums of weights, with fewer strings than the texts have terms."""
    from collections import Counter

    from manuscript_jobs.llm.divergence import term_rows

    texts = [("en", "a", "one two Two 3two"), ("en", "a", "two, one-one"), ("en", "b", "two"), ("de", "a", "zw\u00f6lf zw\u00f6lf"), ("de", "", "12"), ("", "", "")] + [("en", "a", "two two two")] * 20
    docs = spark.createDataFrame(texts, "lang string, source string, text string").coalesce(1)
    count, held, want, want_held = Counter(), Counter(), Counter(), Counter()
    rows = term_rows(docs, merged).collect()
    for x in rows:
        for t in x.tokens or ():
            count[x.lang, x.source, t] += x.weight
        for t in x.held or ():
            held[x.lang, t] += x.weight
    for lang, source, text_ in texts:
        words = "".join(c if c.isalpha() else " " for c in text_.lower()).split()
        want.update((lang, source, w) for w in words)
        want_held.update((lang, w) for w in set(words))
    assert count == want and held == want_held
    assert {(x.lang, x.source) for x in rows if x.tokens is not None} == {t[:2] for t in texts}
    if merged > 1:
        assert sum(len(x.tokens or ()) for x in rows) < 15 < sum(want.values())
