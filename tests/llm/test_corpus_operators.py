"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties,
repeated rows, clashing extra columns and no rows at all."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, key long, size long, hub string"


def text(r, n):
    return " ".join(r.choice(["alpha", "Beta", "gamma,", "δέλτα", "e", "zeta.", "eta", "theta", "iota", "kappa"]) for _ in range(n))


def corpus(spark, seed=1):
    r = random.Random(seed)
    base = [text(r, n) for n in (80, 120, 200, 60, 40)]
    rows = [None, "", "   \n\t ", "one", "one two", "One TWO", "x" * 5000, "is " * 300, base[0], base[0]]
    for b in base:
        for _ in range(4):
            w = b.split(" ")
            for _ in range(r.choice([1, 1, 2, 6])):
                w[r.randrange(len(w))] = r.choice(["new", "other", "Word"]) + str(r.randrange(99))
            rows.append(" ".join(w))
    rows += [text(r, 30) + "\n" + base[1] + "\n" + text(r, 30), base[2][:300] + " " + text(r, 20), text(r, 3000)]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    out = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None, 7, 8, 9, "z") for i, t in zip(ids, rows)]
    return spark.createDataFrame(out, DOCS), {i: t for i, t in zip(ids, rows)}


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(t, size):
    w = WORDS.findall((t or "").encode().translate(LOWER))
    if 0 < len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def roots(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_urls(spark):
    from manuscript_jobs.llm.url_filter import SOFT, STRICT, filter_urls, vocabulary

    urls = [
        None, "", "no scheme", "http://", "HTTPS://A.Example.COM/en/x?y#z", "http://www.example.com/en/", "http://x.net/es/1", "http://x.net/esp",
        "http://com", "http://com/", "http://xcom/", "http://a.org/porn", "http://a.org/pornography", "http://a.org/free-casino", "http://a.org/free/free",
        "http://a.org/?q=1\n/en", "a://b://c/d", "http://a.org/" + "free" * 5000, "http://fr.net/fr/a", "http://a.org/free-casino", "http://a.org/sexy",
        "http://a.org/free-win", "http://a.org/free-win-hot", "http://a.org/casino/casino", "http://a.org/poker-casino", "http://a.org/FREE/Poker",
    ]
    df = spark.createDataFrame([(i, u, "c", "d") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = {r.page_id: r for r in filter_urls(df).collect()}
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = host.encode().translate(LOWER).decode()
        fit = max(((len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        low = (u or "").encode().translate(LOWER).decode()
        bounded = lambda t: re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", low)
        soft = [w for t, w in SOFT if bounded(t)]
        own = "block" if any(map(bounded, STRICT)) or (len(soft) >= 2 and sum(soft) >= 3) else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, fit and fit[1], fit[2] if fit else own), u
    assert [got[i].verdict for i in range(len(urls) - 5, len(urls))] == ["allow", "block", "allow", "block", "block"]  # weights decide between pairs
    assert not set(STRICT) & {t for t, _ in SOFT} and len({t for t, _ in SOFT}) == len(SOFT) and {w for _, w in SOFT} == {1, 2}
    assert filter_urls(df.limit(0)).count() == 0
    terms = spark.createDataFrame([("Bad", 1, True), ("so", 2, False), ("so", 3, None), ("la", None, False), (None, 1, True), ("", 1, True)], "term string, weight int, strict boolean")
    assert vocabulary(terms) == (("bad",), (("la", 1), ("so", 3)))
    few = spark.createDataFrame([(1, "http://a/so-so"), (2, "http://a/so-la"), (3, "http://a/bad"), (4, "http://a/badly")], "page_id long, url string")
    strict, soft = vocabulary(terms)
    assert [r.verdict for r in filter_urls(few, rules=(), strict=strict, soft=soft).orderBy("page_id").collect()] == ["allow", "block", "block", "allow"]
    with pytest.raises(ValueError):
        vocabulary(terms, 1)


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    files = pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(files.path("word_bpe_49k.json"))


def test_packing(spark, tokenizer):
    from manuscript_jobs.llm.packing import pack

    df, texts = corpus(spark)
    odd = {900: "İstanbul ΣΑΣ ΟΔΟΣ\u00a0x\x1cy", 901: "a<|endoftext|>b it's WE'LL 12345 !!?? é e\u0301", 902: "日本語 テキスト\u3000🙂", 903: text(random.Random(5), 9000)}
    df = df.union(spark.createDataFrame([(i, t, "en", "s", None, 7, 8, 9, "z") for i, t in odd.items()], DOCS))
    texts = texts | odd
    rows = pack(df.repartition(3), keep_ids=True, block=7).collect()
    for i, t in texts.items():
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == want
        for r in mine:
            assert (r.length, r.doc_tokens) == (len(r.ids), len(want)) and want[r.start : r.start + r.length] == r.ids
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert pack(empty(spark)).count() == 0
    twice = df.where("doc_id < 3")
    assert sum(r.length for r in pack(twice.union(twice)).collect()) == 2 * sum(r.length for r in pack(twice).collect())


def test_best_fit_is_the_tightest():
    from manuscript_jobs.llm.packing import best_fit_decreasing

    r = random.Random(3)
    lengths = [r.randrange(1, 65) for _ in range(400)]
    number, offset, made = best_fit_decreasing(lengths, 64)
    room, want = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [x for x in room if x >= lengths[i]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - lengths[i])
        else:
            room.append(64 - lengths[i])
        want[i] = 1
    assert made == len(room) and sum(want) == len(lengths)
    fill = [sorted((o, n) for k, o, n in zip(number, offset, lengths) if k == w) for w in range(made)]
    assert sorted(64 - sum(n for _, n in f) for f in fill) == sorted(room)
    assert all(sum(n for _, n in f[:i]) == o for f in fill for i, (o, _) in enumerate(f))


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_ngram_join(spark, size, num, den):
    from manuscript_jobs.llm.ngram_join import join_components

    df, texts = corpus(spark, size)
    ids = sorted(texts)
    sets = [shingle_set(texts[i], size) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = {ids[i]: (len(sets[i]), ids[c]) for i, c in enumerate(roots(len(ids), links))}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join_components(df, size, num, den).collect()}
    assert got == want and len(links) > 3
    assert join_components(empty(spark)).count() == 0


def test_ngram_join_second_round_and_repeats(spark, monkeypatch):
    """A hub that links with none of its bucket must not part those that link with each other."""
    from manuscript_jobs.llm import similarity
    from manuscript_jobs.llm.ngram_join import join_components

    monkeypatch.setattr(similarity, "BLOCK", 4)
    r = random.Random(9)
    shared = [f"w{i}" for i in range(60)]
    rows, k = [], 0
    for g in range(12):
        own = [f"g{g}x{i}" for i in range(60)]
        for _ in range(3):
            w = shared + own
            w[100 + r.randrange(15)] = f"n{k}"
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(5, rows[5][1]), (7, "entirely other words " * 9), (None, rows[0][1]), (None, None)]
    got = join_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert len(got) == len(rows)
    sets = [shingle_set(t, 4) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    links += [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] == rows[b][0] and sets[a] and sets[b]]
    big = 1 << 62
    comp = {}
    root = roots(len(rows), links)
    for i, (d, _) in enumerate(rows):
        comp[root[i]] = min(comp.get(root[i], big), big if d is None else d)
    want = sorted(str((d, len(sets[i]), None if comp[root[i]] == big else comp[root[i]])) for i, (d, _) in enumerate(rows))
    assert sorted(str((x.doc_id, x.n_shingles, x.component_id)) for x in got) == want


@pytest.mark.parametrize("blocks", [1, 3])
def test_near_misses_of_a_large_bucket_are_no_pairs(spark, blocks):
    """Sets that share most of their hashes but don't link: their pairs must not come out by the square of the bucket,
    and those that do link must."""
    from manuscript_jobs.llm import similarity as S

    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 128, dtype=np.uint64)
    sets = [np.concatenate([base[r.permutation(128)[:114]], r.integers(0, 1 << 63, 14, dtype=np.uint64)]) for _ in range(90)]
    sets += [np.append(sets[i][1:], np.uint64(i)) for i in range(10)]
    n = len(sets)
    links = {(a, b) for b in range(n) for a in range(b) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    rows = spark.createDataFrame([(1, i, i, n, blocks) for i in range(n)], "sig long, key long, component long, members long, blocks long")
    classes = spark.createDataFrame([(i, 128, bytearray(S.bitmap(np.sort(x)))) for i, x in enumerate(sets)], "key long, n long, bits binary")
    got = {tuple(x) for x in S._cross(rows, classes, 85, 100).collect()}
    assert links <= got and len(links) >= 10
    assert len(got - links) < 0.1 * n * (n - 1) / 2


def test_fingerprints(spark):
    from manuscript_jobs.llm import fingerprints as P

    df, texts = corpus(spark)
    ids = sorted(texts)
    got = {r.doc_id: r for r in P.neighbour_likeness(df).collect()}
    assert sorted(got) == ids
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t, u, r = texts[i] or "", texts[nxt] or "", got[i]
        n = len(t) // 4
        edited = t[: len(t) - n] + u[:n]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (shingle_set(x, 5) for x in (t, edited, u))
        for est, x, y in ((r.near_edited, a, b), (r.near_next, a, c)):
            true = len(x & y) / len(x | y) if x | y else 1.0
            assert abs(est - true) <= (1e-9 if len(x | y) <= P.K else 0.15)
        assert len(P.decode(r.fingerprint)) == min(P.K, len(a))
    same = P.neighbour_likeness(spark.createDataFrame([(3, "a b"), (3, "a b"), (3, "c d e f"), (None, None)], "doc_id long, text string")).collect()
    assert len(same) == 4 and len({r.fingerprint for r in same}) == 3
    assert P.neighbour_likeness(empty(spark)).count() == 0
    x, y = (" ".join(f"w{i}" for i in range(s, s + 4000)) for s in (0, 1000))
    a, b = P.sketches([x, y])
    whole = P.sketches([" ".join(f"w{i}" for i in range(5000))])[0]
    assert (P.merge(a, b) == whole).all()
    assert abs(P.distinct_count(a) - 3996) < 600 and abs(P.containment(a, b) - 0.75) < 0.15


def goes_on(a, b):
    """Words of a and b that agree from the start, over single edits that four equal words follow."""
    if not a or not b:
        return 0, 0
    for x, y in ((1, 1),) if a[0] == b[0] else ((1, 1), (1, 0), (0, 1)):
        if a[0] == b[0] or (len(a) >= x + 4 and a[x : x + 4] == b[y : y + 4]):
            i, j = goes_on(a[x:], b[y:])
            return i + x, j + y
    return 0, 0


def brute_paragraphs(rows, radius=4, least=20):
    """removed of each (key, text), keys ascending: lines and pieces told apart by loops."""
    from manuscript_jobs.llm import hashing as H

    lines, pieces, known = [], [], {}
    for key, t in rows:
        w = [m.span() for m in WORDS.finditer((t or "").encode())]
        words = known[key] = WORDS.findall((t or "").encode().translate(LOWER))
        n = len(w)
        raw = np.frombuffer((t or "").encode(), np.uint8)
        h = [int(x) for x in H.words(raw, np.array([0, len(raw)]))[0]]
        mask = (1 << 64) - 1
        mixed = lambda x: int(H.mix(np.array([x & mask], np.uint64))[0]) >> 1
        pair = [mixed(h[i] * 3 + h[i + 1] * 7) if i + 1 < n else mixed(h[i]) for i in range(n)]
        edges = [i for i in range(n) if not i or (all(pair[i] < x for x in pair[max(0, i - radius) : i]) and all(pair[i] <= x for x in pair[i : i + radius + 1]))] + [n]
        pieces += [(key, s, e, shingle_set(b" ".join(words[s:e]).decode(), 5)) for s, e in zip(edges, edges[1:]) if e - s >= 5]
        at = 0
        for line in (t or "").split("\n"):
            k = len(WORDS.findall(line.encode()))
            if k >= 5:
                lines.append((key, at, at + k, shingle_set(line, 5)))
            at += k
    out, found = {key: set() for key, _ in rows}, {key: {} for key, _ in rows}
    spans = {key: [] for key, _ in rows}
    for items, link in ((lines, lambda a, b: 100 * len(a & b) >= 80 * len(a | b)), (pieces, lambda a, b: a == b)):
        items.sort(key=lambda x: x[:3])
        links = [(a, b) for a in range(len(items)) for b in range(a) if link(items[a][3], items[b][3])]
        for i, root in enumerate(roots(len(items), links)):
            (d, s, e, _), (fd, fs, fe, _) = items[i], items[root]
            if i != root and (d != fd or s >= fe):
                if items is pieces:
                    found[d][s] = (e, fd, fs, fe)
                else:
                    out[d].add((s, e, fd, fs))
    for d, mine in found.items():
        for s, (e, fd, fs, fe) in mine.items():
            most = min(32, (s - fe) // 2) if d == fd else 32
            left = right = (0, 0)
            if not any(x[0] == s for x in mine.values()):
                left = goes_on(known[d][max(s - most, 0) : s][::-1], known[fd][max(fs - most, 0) : fs][::-1])
            if e not in mine:
                right = goes_on(known[d][e : e + most], known[fd][fe : fe + most])
            spans[d].append((s - left[0], e + right[0], fd, fs - left[1]))
    for d, mine in spans.items():
        covered = {i for s, e, *_ in mine for i in range(s, e)}
        for x in mine:
            s, e = x[:2]
            while s - 1 in covered:
                s -= 1
            while e in covered:
                e += 1
            if e - s >= least:
                out[d].add(x)
    return {k: sorted(v) for k, v in out.items()}


def without(t, removed):
    """(n_removed, n_spans, kept) by loops over words."""
    raw = (t or "").encode()
    w = [m.span() for m in WORDS.finditer(raw)]
    gone = [any(s <= i < e for s, e, *_ in removed) for i in range(len(w))]
    runs = [len(list(g)) for k, g in itertools.groupby(gone) if k]
    kept, at, i = b"", 0, 0
    while i < len(w):
        if gone[i]:
            kept += raw[at : w[i][0]]
            while i < len(w) and gone[i]:
                i += 1
            at = w[i - 1][1]
        else:
            i += 1
    return sum(gone), len(runs), (kept + raw[at:]).decode()


def test_paragraph_dedup(spark):
    from manuscript_jobs.llm.paragraph_dedup import dedup_paragraphs

    df, texts = corpus(spark, 4)
    r = random.Random(4)
    long = [text(r, n) for n in (60, 70, 90)]
    near = long[0].split(" ")
    near[30] = "changed"
    more = {
        900: long[0] + "\nshort line\n" + text(r, 40), 901: "short line\n" + " ".join(near), 902: long[1] + "\n" + long[1],
        905: text(r, 50) + "\n\n" + long[1] + "\n", 906: long[2], 907: long[2], 908: "short line", 909: "\n" * 50 + long[2].replace(" ", "\n"),
        910: " ".join(f"u{i % 7000}" for i in range(15000)),
    }
    df = df.select("doc_id", "text", "n", "key").union(spark.createDataFrame([(i, t, 1, 2) for i, t in more.items()], "doc_id long, text string, n long, key long"))
    texts = texts | more
    want = brute_paragraphs(sorted(texts.items()))
    got = {x.doc_id: x for x in dedup_paragraphs(df).collect()}
    assert {d: [tuple(x) for x in g.removed] for d, g in got.items()} == want and sum(map(len, want.values())) > 50
    for d, t in texts.items():
        assert (got[d].n_removed, got[d].n_spans, got[d].kept) == without(t, want[d]), d
    assert dedup_paragraphs(empty(spark)).count() == 0


def test_paragraphs_inside_lines(spark):
    """Passages of 55 words and more are found in the middle of other lines and wrapped anew; other texts stay whole."""
    from manuscript_jobs.llm.paragraph_dedup import dedup_paragraphs

    r = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    rows, k = [], 0
    for _ in range(120):
        passage = some(r.choice([55, 60, 80, 120]))
        rows.append((k, " ".join(some(r.randrange(20, 100)) + passage + some(r.randrange(20, 100)))))
        wrapped = some(r.randrange(20, 100)) + passage + some(r.randrange(20, 100))
        rows.append((k + 1, "\n".join(" ".join(wrapped[i : i + 13]) for i in range(0, len(wrapped), 13)) if k % 4 else " ".join(wrapped).upper()))
        k += 2
    clean = [(k + i, " ".join(some(200))) for i in range(100)]
    got = {x.doc_id: x.n_removed for x in dedup_paragraphs(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    assert sum(got[i] > 0 for i, _ in rows[1::2]) >= 114
    assert not any(got[i] for i, _ in rows[::2] + clean)


@pytest.mark.parametrize("edit", ["none", "changed", "missing", "added"])
def test_passages_go_to_their_ends(spark, edit):
    """Of 60-word passages in longer lines exact copies go to the word; copies with two edits go but for what lies
    beyond an edit within four words of an end. What the copy stands in stays, and so does the first."""
    from manuscript_jobs.llm.paragraph_dedup import dedup_paragraphs

    r = random.Random(9)
    words = [f"w{i}" for i in range(50_000)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    rows, sizes = [], []
    for k in range(100):
        passage, before, after = some(60), some(50), some(50)
        copy = list(passage)
        for at in (r.randrange(32, 55), r.randrange(5, 28)) if edit != "none" else ():
            copy[at : at + 1 if edit != "added" else at] = [] if edit == "missing" else ["edited"]
        rows += [(2 * k, " ".join(some(40) + passage + some(40))), (2 * k + 1, " ".join(before + copy + after))]
        sizes.append((len(copy), " ".join(before), " ".join(after)))
    got = {x.doc_id: x for x in dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k].kept == rows[2 * k][1] for k in range(100))
    hits = [got[2 * k + 1] for k in range(100) if got[2 * k + 1].n_removed]
    assert len(hits) >= 90
    full = sum(got[2 * k + 1].n_removed == n for k, (n, _, _) in enumerate(sizes))
    assert full >= (0.98 if edit == "none" else 0.8) * len(hits), (full, len(hits))
    assert all(x.kept.startswith(sizes[x.doc_id // 2][1]) and x.kept.endswith(sizes[x.doc_id // 2][2]) for x in hits)


def test_paragraph_dedup_short_lines(spark):
    """A line of five words and more goes where it repeats, near copies among them; one of four stays."""
    from manuscript_jobs.llm.paragraph_dedup import dedup_paragraphs

    r = random.Random(6)
    words = [f"w{i}" for i in range(2000)]
    five, eight, long = ([r.choice(words) for _ in range(n)] for n in (5, 8, 19))
    near = " ".join([*long, "more"])
    docs = {
        1: "\n".join(" ".join(p) for p in (five, eight, long)), 2: " ".join(five) + "\nfour words stay here\n" + near,
        3: "four words stay here\n" + " ".join(eight).upper() + "\n" + " ".join(five[:4] + ["other"]), 4: " ".join(eight[:7]),
    }
    got = {x.doc_id: {tuple(y) for y in x.removed} for x in dedup_paragraphs(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert {d: [tuple(y) for y in v] for d, v in brute_paragraphs(list(docs.items())).items()} == {d: sorted(v) for d, v in got.items()}
    assert {(0, 5, 1, 0), (9, 29, 1, 13)} <= got[2] and (4, 12, 1, 5) in got[3] and not got[1] | got[4]


@pytest.mark.parametrize("shared", [None, 7])
def test_paragraph_dedup_shared_ids(spark, shared):
    """Texts under one id, or none, lose their own repeats and not each other's."""
    from manuscript_jobs.llm.paragraph_dedup import dedup_paragraphs

    r = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    line = [" ".join(r.choice(words) for _ in range(30)) for _ in range(6)]
    rows = [(1, line[0] + "\n" + line[1]), (shared, line[2] + "\n" + line[0]), (shared, line[3] + "\n" + line[4]), (shared, line[1] + "\n" + line[5])]
    rows.append(rows[1])
    got = dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, 0, rows[0][1]), (shared, 30, line[2] + "\n"), (shared, 0, rows[2][1]), (shared, 30, "\n" + line[5]), (shared, 30, line[2] + "\n")]
    assert sorted(map(str, ((x.doc_id, x.n_removed, x.kept) for x in got))) == sorted(map(str, want))
    assert {(y.first_doc_id, y.first_begin) for x in got for y in x.removed if y.end - y.begin == 30} == {(1, 0), (1, 30)}


def test_mixing(spark):
    from manuscript_jobs.llm.mixing import mix

    df, texts = corpus(spark)
    rows = mix(df).collect()
    assert len(rows) == len(texts)
    sizes = {i: len(WORDS.findall((t or "").encode())) for i, t in texts.items()}
    assert {r.doc_id: r.size for r in rows} == sizes
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted(s for s in by if s is not None) + [None]
    total = {s: sum(r.size for r in by[s]) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left = {}, 1.5 * sum(total.values())
    while True:
        free = [s for s in names if s not in target]
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * total[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        for s in over:
            target[s] = 2.0 * total[s]
        left = 1.5 * sum(total.values()) - sum(target.values())
    for s in names:
        assert abs(by[s][0].target - target[s]) < 1e-6 * max(1, target[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= 1
        assert all(0 <= r.taken <= 2 * r.size and r.source_size == total[s] for r in by[s])
    assert sorted(map(str, mix(df.repartition(7)).collect())) == sorted(map(str, rows))
    assert mix(empty(spark)).count() == 0
    assert [r.taken for r in mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()] == [0, 0]


def removed_bytes(texts, n):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        bad = bytearray(len(raw))
        for s in range(len(raw) - n + 1):
            w = raw[s : s + n]
            if w in seen:
                bad[s : s + n] = b"\1" * n
            seen.add(w)
        out[i] = bad
    return out


def test_longest_previous_factor():
    from manuscript_jobs.llm.suffix_dedup import longest_previous_factor, previous_smaller

    r = random.Random(7)
    for _ in range(200):
        v = np.array(r.sample(range(1000), r.randrange(1, 40)))
        want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(len(v))]
        assert previous_smaller(v).tolist() == want
    for n in (8, 9, 16, 20, 100):
        for alphabet in (b"a", b"ab", b"abcd", bytes(range(256))):
            raw = bytes(r.choice(alphabet) for _ in range(400))
            raw += raw[50:200] + bytes(r.choice(alphabet) for _ in range(50)) + raw[10:160]
            starts = np.array(sorted(r.sample(range(len(raw) - n + 1), 150)))
            order = np.array(r.sample(range(10_000), 150))
            got = longest_previous_factor(np.frombuffer(raw, np.uint8), starts, order, n)
            common = lambda a, b: next((i for i in range(n) if raw[a + i] != raw[b + i]), n)  # noqa: B023, E731
            want = [max((common(s, t) for t, p in zip(starts, order) if p < o), default=0) for s, o in zip(starts, order)]
            assert got.tolist() == want


@pytest.mark.parametrize("group", [8192, 1])
def test_suffix_dedup(spark, group):
    from manuscript_jobs.llm.suffix_dedup import remove_repeats

    df, texts = corpus(spark, group)
    want = removed_bytes(texts, 100)
    got = {r.doc_id: r for r in remove_repeats(df, group=group, carry=("lang",)).collect()}
    assert sorted(got) == sorted(texts)
    for i, bad in want.items():
        raw = (texts[i] or "").encode()
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(bad))]
        assert [tuple(s) for s in got[i].spans] == spans and got[i].n_bytes == len(raw)
        assert bytes(got[i].kept) == bytes(b for b, x in zip(raw, bad) if not x)
    assert sum(map(sum, want.values())) > 1000
    assert remove_repeats(empty(spark)).count() == 0
    t = text(random.Random(8), 60)
    odd = spark.createDataFrame([(1, t), (1, t), (1, t + " more"), (None, "x" + t), (None, None)], "doc_id long, text string")
    rows = remove_repeats(odd).collect()
    assert len(rows) == 5 and all((sum(s.end - s.begin for s in r.spans) > 0) == (r.doc_id == 1) for r in rows)
    with pytest.raises(ValueError):
        remove_repeats(df, n=2000)
    whole = {r.doc_id: bytes(r.kept).decode() for r in remove_repeats(df, whole_chars=True).collect()}
    assert all(len(whole[i].encode()) >= len(got[i].kept) for i in whole)


def test_sharding(spark):
    from manuscript_jobs.llm.sharding import permute, shard

    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(permute(np.arange(n), n, 5).tolist()) == list(range(n))
    df, texts = corpus(spark)
    rows = shard(df.union(df.limit(3)), 16).collect()
    assert len(rows) == len(texts) + 3
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 16, len(rows) // 16 + 1)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    key = lambda rs: sorted((r.doc_id, r.shard, r.slot) for r in rs)
    assert key(shard(df.repartition(5)).collect()) == key(shard(df).collect())
    assert shard(empty(spark)).count() == 0


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_topk(spark, shard_rows):
    from manuscript_jobs.llm.topk import top_k

    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)], 0) for i in range(300)]
    rows += [(400 + i, [0.5] * 6, 0) for i in range(60)]
    rows += [(500, None, 1), (550, [float("nan")] * 6, 1), (551, [None] * 6, 1), (600, [1.0] * 3, 1), (None, [1.0] * 6, 1), (601, [2.0] * 3, 1), (602, [], 1), (250, [0.1] * 6, 1), (250, [0.3] * 6, 1)]
    rows += [(700, [1e300] * 6, 1), (750, [3e6] * 6, 1), (751, [3e6] * 5 + [2e6], 1), (752, [float("inf")] * 6, 1)]
    rows += [(800, [-1e200] * 5 + [1.7e308], 1), (801, [1e300] * 5 + [1.1e300], 1), (802, [-1e300] * 6, 1), (803, [1e12] * 6, 1), (850, [0.0] * 6, 1), (None, [1e300] * 6, 1), (900, [-1.0] + [0.0] * 5, 1)]
    rows += [(1000 + i, [-1e300 * (i + 1)] * 3 + [0.0] * 4, 1) for i in range(8)] + [(950, [1.0] * 7, 1)]  # all scores of 950 lie far below 64 bits
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    whole = lambda x: int(x) * 256 if abs(x) >= 2**52 else int(np.floor(256 * x))
    fine = [(i, [whole(x) for x in v]) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for at, (q, v) in enumerate(fine):
        if q is not None and q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for j, (i, w) in enumerate(fine) if j != at and len(w) == len(v))[:5]
            want += [(q, k + 1, None if none else i, min(max(-s, -(2**63)), 2**63 - 1)) for k, (s, none, i) in enumerate(scored)]
    got = [tuple(x) for x in top_k(df, lambda i: i % 50 == 0, 5, shard_rows, 3).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_crf_marginals():
    from manuscript_jobs.llm.quality import marginals

    r = np.random.default_rng(1)
    bounds = np.array([0, 1, 4, 6])
    unary, turn = r.normal(size=(6, 2)), r.normal(size=(2, 2))
    good, pairs, norm = marginals(unary, bounds, turn)
    for d, (s, e) in enumerate(zip(bounds, bounds[1:])):
        total, at, two = 0.0, np.zeros(e - s), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=e - s):
            p = np.exp(sum(unary[s + i, y] for i, y in enumerate(path)) + sum(turn[a, b] for a, b in zip(path, path[1:])))
            total += p
            at += p * np.array(path)
            for a, b in zip(path, path[1:]):
                two[a, b] += p
        assert np.allclose(good[s:e], at / total) and np.allclose(pairs[d], two / total) and np.isclose(norm[d], np.log(total))


def test_line_features():
    from manuscript_jobs.llm.hashing import text_bytes
    from manuscript_jobs.llm.quality import WIDTH, line_features

    texts = ["", None, "one line", "a b\nA A!\n", "\n", "x\n\ny z"]
    x, length, bounds = line_features(*text_bytes(pa.array(texts)))
    assert np.diff(bounds).tolist() == [len((t or "").split("\n")) for t in texts] and x.shape == (bounds[-1], WIDTH)
    assert (length - 1).tolist() == [len(p) for t in texts for p in (t or "").split("\n")]
    own = (WIDTH - 1) // 3
    for d in range(len(texts)):
        s, e = bounds[d], bounds[d + 1]
        alone, _, _ = line_features(*text_bytes(pa.array([texts[d]], pa.string())))
        assert np.allclose(alone, x[s:e])
        assert np.allclose(x[s : e - 1, :own], x[s + 1 : e, own : 2 * own]) and not x[s, own : 2 * own].any() and not x[e - 1, 2 * own : 3 * own].any()


def test_potentials_in_runs():
    """Line scores are the same however many lines are held at once, those of many lines and of one long line too."""
    from manuscript_jobs.llm.hashing import text_bytes
    from manuscript_jobs.llm.quality import WIDTH, Crf, line_features, lines_of

    r = np.random.default_rng(3)
    crf = Crf(r.normal(size=WIDTH), r.uniform(0.5, 2, WIDTH), r.normal(size=WIDTH) / 20, r.normal(size=(2, 2)), (1.0, 0.0))
    texts = ["", "a b\nA A!\n\nx", None, "\n" * 20_000, "word " * 30_000, "Ünï çode\nlines.\n" * 300]
    data, offsets = text_bytes(pa.array(texts))
    lines = lines_of(data, offsets)
    want = np.clip(((line_features(data, offsets)[0] - crf.mean) / crf.scale) @ crf.weights, -30, 30)
    for most in (1_000_000, 997, 64):
        assert np.allclose(crf.potentials(lines, most, 5000), want, atol=1e-3)
    assert len(crf.score(lines)) == len(texts)


def test_quality(spark):
    from manuscript_jobs.llm.quality import fit, held_out, score_documents

    r = random.Random(6)
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        line = lambda: " ".join(w.upper() + "!!" for w in text(r, 12).split()) if bad else text(r, 12).capitalize() + "."  # noqa: B023, E731
        rows.append((i, "\n".join(line() for _ in range(r.randrange(1, 6)))))
        labels.append((i, int(not bad)))
    rows += [(900, None), (901, ""), (902, "\n" * 3000), (902, "\n" * 3000)]
    df = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, quality int")
    crf = fit(df, lab, lambda i: ~held_out(i), most=150)
    got = {x.doc_id: x.score for x in score_documents(df, crf).collect()}
    assert len(got) == 243 and all(0 <= s <= 1 for s in got.values())
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in held]) > 0.97
    none = fit(df, lab.limit(0), lambda i: ~held_out(i))
    assert {x.score for x in score_documents(df, none).collect()} == {0.5}
    assert score_documents(df.limit(0), crf).count() == 0


def test_registered_queries(spark, tmp_path):
    """The queries' own columns on a table of their own, against brute force."""
    from manuscript_jobs.llm.queries import QUERIES

    df, texts = corpus(spark, 3)
    df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda name: {r.doc_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want, got = removed_bytes(texts, 100), rows("op7_suffix_dedup")
    for i, bad in want.items():
        raw = (texts[i] or "").encode()
        kept = bytes(b for b, x in zip(raw, bad) if not x)
        assert tuple(got[i]) == (i, len(raw), sum(bad), len(re.findall(b"\1+", bytes(bad))), sha(kept))
    want, got = brute_paragraphs(sorted(texts.items())), rows("op5_paragraph_dedup")
    for i, removed in want.items():
        words, spans, kept = without(texts[i], removed)
        assert (got[i].n_removed, got[i].n_spans, got[i].first_doc_ids, got[i].kept_sha256) == (words, spans, sorted({r[2] for r in removed}), sha(kept.encode()))
    got = rows("op8_sharding")
    assert sorted(got) == sorted(texts) and {(r.law, r.grown_shard) for r in got.values()} == {("rows", None)}
    assert all((r.size, r.text_crc32) == (len((texts[i] or "").encode()) + 1, zlib.crc32((texts[i] or "").encode())) for i, r in got.items())


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(12)
    base = [text(r, n).capitalize() + "." for n in (60, 90, 130, 70, 200, 80)]
    texts = [*base, base[0], base[1] + " end", "\n".join(["LOUD!! NOISE!! " * 9] * 4), text(r, 40) + "\n" + base[4], None, ""]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i != 8), 0) for i in range(10) if i % 4 != 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    near = stages["near_duplicates"](spark, docs.union(docs.where("doc_id = 3")), str(tmp_path))
    assert sorted(x.doc_id for x in near.collect()) == [0, 1, 2, 3, 4, 5, 8, 10, 11]
    want = removed_bytes(dict(enumerate(texts)), 100)
    rep = {x.doc_id: x for x in stages["repeats"](spark, docs, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        if raw and all(want[i]):
            assert i not in rep
        elif raw.isascii():
            assert rep[i].text == bytes(b for b, x in zip(raw, want[i]) if not x).decode() and rep[i].n_chars == len(rep[i].text)
    from manuscript_jobs.llm.mixing import mix

    taken = {x.doc_id: x.taken for x in mix(docs).collect()}
    got = {i: 0 for i in taken}
    for x in stages["mixing"](spark, docs, str(tmp_path)).collect():
        got[x.doc_id] += len(WORDS.findall(x.text.encode()))
    assert got == taken
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[0] == "doc_id"
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name


def test_pipeline_shared_ids(spark):
    """Different texts without an id, or under one, stay unless they are near copies themselves; mixing counts each row."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from manuscript_jobs.llm.mixing import mix

    r = random.Random(13)
    words = [f"w{i}" for i in range(2000)]
    t = [" ".join(r.choice(words) for _ in range(60)) for _ in range(6)]
    rows = [(1, t[0]), (2, t[1]), (None, t[0] + " end"), (None, t[1] + " end"), (None, t[2]), (None, t[3]), (None, t[3]), (9, t[4]), (9, t[5]), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    near = stages["near_duplicates"](spark, docs, "").collect()
    want = [(1, t[0]), (2, t[1]), (None, t[2]), (None, t[3]), (9, t[4]), (9, t[5]), (None, "")]
    assert sorted(str((x.doc_id, x.text)) for x in near) == sorted(map(str, want))
    total = sum(len(WORDS.findall(x.text.encode())) for x in stages["mixing"](spark, docs, "").collect())
    assert total == mix(docs).selectExpr("sum(taken)").first()[0]


def test_token_ids_of_special_tokens_and_case():
    """Ids equal the tokenizer's, whatever case comes first and whatever was seen before."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from manuscript_jobs.llm import hashing as H
    from manuscript_jobs.llm.packing import TOKENIZER, WordTokens

    path = public_tokenizers.path(TOKENIZER)
    full, r = Tokenizer.from_file(path), random.Random(4)
    pieces = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|", "|>", "Word", "WORD", "word", "It's", "IT'S", "É", "é", "a1B2", "ſ", "İ", "\u0301"]
    texts = ["<|endoftext|> <|ENDOFTEXT|>", "<|ENDOFTEXT|> <|endoftext|>", "<|STARTOFTEXT|> <|startoftext|>", "<|startoftext|> <|STARTOFTEXT|>"]
    texts += ["".join(r.choice([*pieces, " ", " ", "\n"]) for _ in range(12)) for _ in range(300)]
    for order in (texts, texts[::-1]):
        tokens = WordTokens(path)
        for t in order:
            data, offsets = H.text_bytes(pa.array([t]))
            assert tokens.ids(data, offsets)[0].tolist() == full.encode(t, add_special_tokens=False).ids, t


def test_fit_reads_a_row_an_id_and_label(spark):
    """Labels and documents of one id many times over bring no more than ``most`` rows to the driver."""
    from manuscript_jobs.llm import quality as Q

    r = random.Random(3)
    docs = spark.createDataFrame([(i % 2, text(r, 20)) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 2, i % 2) for i in range(50)], "doc_id long, quality int")
    seen, train = [], Q.train
    Q.train = lambda x, lengths, bounds, y: seen.append(len(y)) or train(x, lengths, bounds, y)
    try:
        Q.fit(docs, labels, lambda i: i >= 0, most=30)
    finally:
        Q.train = train
    assert seen == [2]
