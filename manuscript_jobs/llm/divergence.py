"""Source divergence audit: how far the term shares of the sources of a language lie apart, and which terms stand out.

Terms are runs of letters and bytes of 0x80 or more, A-Z lower-cased. Documents of a (lang, source) that lie beside each
other are counted together, some MERGED bytes of text at a time, and a count is given as the powers of two that it is
made of: a row of distinct terms for each. A count vectorizer with a least document
frequency per language and the greatest integer vocabulary size makes an exact sparse vector of every such row; its
terms carry their language, so one model holds the vocabularies of all languages side by side, and where they
pass ``most_terms`` together they are taken in slices, a model each. (The document frequencies are counted
by a hash aggregate ahead of the models, since the vectorizer's own count shuffles objects of its own.) Vectors are summed by
(lang, source) as integers, index by index, each by its row's weight. From there on only groups and their terms are left.

Pairs: terms are dealt out by hash, and all sources of a language that hold a term come as one sparse row. A task lays
rows side by side and adds up every pair's distances in a matrix of two blocks of sources; a term that neither of a
pair holds adds the distance of their shares at count 0, which is added in one go for all such terms.
Counts are 64-bit integers; shares are divided in decimals of 38 digits.

Null text, language and source are ''. A language without kept terms gives pairs of value 0. A source alone in its
language has no pairs. Repeated rows count each. An empty table gives no rows. Further columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import Scratch, global_rank, text_batches, width

MOST_TERMS = 1 << 20
#: Sources in a block of pairs, and terms of a row that are laid side by side.
SOURCES, ROWS = 256, 512
#: Bytes of text that are counted together.
MERGED = 8 << 20
#: Bytes of a term: letters and all of 0x80 or more.
_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = "\x01"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts that lie end to end, and how many each text has."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    last = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    ends = np.zeros(len(first) + 1, np.int32)
    np.cumsum(last - first, out=ends[1:])
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(H.LOWER[data[inside[1:-1]]]))
    return words, np.diff(np.searchsorted(first, offsets))


def _counted(keys: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, ascending, how often each occurs); keys are below ``end``."""
    if end > 1 << 23:
        return np.unique(keys, return_counts=True)
    n = np.bincount(keys)
    found = np.flatnonzero(n)
    return found, n[found]


def _once(code: np.ndarray, ends: np.ndarray, terms: int) -> np.ndarray:
    """Marks one place of each term in each document."""
    place, out = np.zeros(terms, np.int64), np.arange(len(code))
    for s, e in zip([0, *ends.tolist()], ends.tolist()):
        place[code[s:e]] = out[s:e]  # of places of one term, one stays
        out[s:e] = place[code[s:e]]
    return out == np.arange(len(code))


def _by_powers(pairs: np.ndarray, counts: np.ndarray, terms: pa.Array, groups: int):
    """(groups, weight, their terms) for each power of two: the terms whose count has it. ``pairs`` (group * terms + term)
    ascend. All groups are in the first."""
    for k in range(max(int(counts.max(initial=0)).bit_length(), 1)):
        some = pairs[counts >> k & 1 == 1]
        ends = np.searchsorted(some, np.arange(groups + 1) * len(terms))
        own = np.flatnonzero((np.diff(ends) > 0) | (k == 0))
        yield own, 1 << k, pa.ListArray.from_arrays(pa.array(np.append(ends[own], len(some)).astype(np.int32)), terms.take(pa.array(some % max(len(terms), 1))))


def term_rows(docs: DataFrame, merged: int = MERGED) -> DataFrame:
    """(lang, source, weight, tokens, held): a (lang, source) has a term in ``tokens`` as often as the weights of the rows that
    hold it add up to; ``held`` counts so the documents of a language that hold it, in rows without source and tokens.
    A row's terms are distinct. Every group has a row with tokens, be they none."""
    names = ["lang", "source", "weight", "tokens", "held"]

    def added(held):
        langs, sources, words = (pa.chunked_array([h[i] for h in held], pa.string()).combine_chunks().dictionary_encode() for i in range(3))
        lang, source, code = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources, words))
        n, terms = np.concatenate([h[3] for h in held]), words.dictionary
        known, group = np.unique(lang * len(sources.dictionary) + source, return_inverse=True)
        empty = lambda rows, kind: pa.nulls(rows, kind)
        pairs, counts = _counted(np.repeat(group, n) * len(terms) + code, len(known) * len(terms))
        for own, weight, lists in _by_powers(pairs, counts, terms, len(known)):
            of = [langs.dictionary.take(pa.array(known[own] // len(sources.dictionary))), sources.dictionary.take(pa.array(known[own] % len(sources.dictionary)))]
            yield pa.RecordBatch.from_arrays([*of, pa.array(np.full(len(own), weight)), lists, empty(len(own), lists.type)], names)
        once = _once(code, np.cumsum(n), len(terms))
        pairs, counts = _counted((np.repeat(lang, n) * len(terms) + code)[once], len(langs.dictionary) * len(terms))
        for own, weight, lists in _by_powers(pairs, counts, terms, len(langs.dictionary)):
            of = [langs.dictionary.take(pa.array(own)), empty(len(own), pa.string())]
            yield pa.RecordBatch.from_arrays([*of, pa.array(np.full(len(own), weight)), empty(len(own), lists.type), lists], names)

    def made(batches):
        held, size = [], 0
        for batch in batches:
            data, offsets = H.text_bytes(batch.column(2))
            for a, b in H.slices(offsets):
                held.append((*(batch.column(i).slice(a, b - a).cast(pa.string()) for i in (0, 1)), *_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
                size += int(offsets[b] - offsets[a])
                if size >= merged:
                    yield from added(held)
                    held, size = [], 0
        if held:
            yield from added(held)

    return text_batches(docs).select("lang", "source", "text").mapInArrow(made, "lang string, source string, weight long, tokens array<string>, held array<string>")


def _marked(lang, term):
    """A term as the models know it; its language is hex, so that no language runs into a term."""
    return F.concat(F.hex(lang), F.lit(_MARK), term)


def _vectorized(words: DataFrame, kept: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(lang, source, term, count) of the rows' vectors over one slice of the vocabulary, summed by weight."""
    slices = kept.groupBy(F.pmod(F.xxhash64("lang", "term"), F.lit(16))).agg(F.collect_list(_marked("lang", F.col("term"))).alias("words"))
    model = CountVectorizer(inputCol="words", outputCol="vector", vocabSize=2**31 - 1, minDF=1.0).fit(slices)
    path = f"{scratch.root}/{name}"
    model.write().overwrite().save(path)
    vocabulary = kept.sparkSession.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("index", "marked"))
    vocabulary = scratch.cut(vocabulary.join(kept.withColumn("marked", _marked("lang", F.col("term"))), "marked").select("index", "term"), f"{name}-terms")
    vectors = model.transform(words.select("lang", "source", "weight", F.transform("tokens", lambda t: F.concat(F.col("mark"), t)).alias("words")))
    entries = vectors.select("lang", "source", "weight", F.explode(F.unwrap_udt("vector")["indices"]).alias("index"))  # a term is once in a row
    sums = entries.groupBy("lang", "source", "index").agg(F.sum("weight").alias("count"))
    return sums.join(vocabulary, "index").select("lang", "source", "term", "count")


def group_counts(docs: DataFrame, min_df: int, most_terms: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, kept, groups): (lang, source, term, count) above 0; (lang, term) of the vocabularies; (lang, source)."""
    rows = scratch.cut(term_rows(docs).withColumn("mark", _marked("lang", F.lit(""))), "words")
    words = rows.where("tokens is not null")
    kept = rows.where("held is not null").select("lang", "weight", F.explode("held").alias("term")).groupBy("lang", "term").agg(F.sum("weight").alias("df"))
    kept = scratch.cut(kept.where(F.col("df") >= min_df).select("lang", "term"), "kept")
    slices = max(1, -(-kept.count() // most_terms))
    if slices > 1:
        kept = scratch.cut(global_rank(kept, ["lang", "term"], scratch, "kept-dealt").withColumn("slice", F.floor(F.col("rank") / most_terms)), "kept-sliced")
    parts = [_vectorized(words, kept if slices == 1 else kept.where(F.col("slice") == i).select("lang", "term"), scratch, f"model-{i}") for i in range(slices)]
    counts = None
    for i, part in enumerate(parts):
        part = scratch.cut(part, f"counts-{i}")
        counts = part if counts is None else counts.union(part)
    groups = scratch.cut(words.select("lang", "source").distinct(), "groups")
    scratch.drop("words")
    return counts, kept.select("lang", "term"), groups


def _share(count, total, terms):
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exact."""
    wide = lambda x: x.cast("decimal(20,0)")
    return F.call_function("div", (wide(count) + 5) * F.lit(1_000_000_000).cast("decimal(10,0)"), wide(total) + wide(terms) * 5) + 1


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, j, sum, seen) for the numbered sources i < j of a language: the distances over the ``seen`` terms that
    any source of their two blocks holds. ``groups`` has lang, source, number, zero (the share at count 0)."""
    salts = width(groups.sparkSession)
    numbered = counts.join(groups.select("lang", "source", "number"), ["lang", "source"])
    blocks = groups.groupBy("lang").agg(F.max("block").alias("last"))
    reach = F.sequence(F.lit(0), F.col("last"))
    tile = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    cells = numbered.withColumn("block", F.floor(F.col("number") / SOURCES).cast("int")).join(blocks, "lang").withColumn("other", F.explode(reach))
    cells = cells.select("lang", *tile, "term", "number", "share").groupBy("lang", "low", "high", "term").agg(F.collect_list(F.struct("number", "share")).alias("cells"))  # at most two blocks of sources
    cells = cells.select("lang", "low", "high", F.pmod(F.xxhash64("term"), F.lit(salts)).alias("salt"), F.lit(1).alias("kind"), "cells")
    heads = groups.join(blocks, "lang").withColumn("other", F.explode(reach)).select("lang", *tile, "number", F.col("zero").alias("share"))
    heads = heads.groupBy("lang", "low", "high").agg(F.collect_list(F.struct("number", "share")).alias("cells"))
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).select("lang", "low", "high", "salt", F.lit(0).alias("kind"), "cells")
    keys = ["lang", "low", "high", "salt"]
    dealt = heads.union(cells).repartition(*keys).sortWithinPartitions(*keys, "kind")

    def added(batches):
        key, low, zero, numbers, total, seen, rows = None, None, None, None, None, 0, []

        def lay():
            nonlocal seen, rows
            if not rows:
                return
            table = np.tile(zero, (len(rows), 1))
            for r, (number, share) in enumerate(rows):
                table[r, np.searchsorted(numbers, number)] = share
            for i in range(len(numbers)):
                total[i] += np.abs(table[:, i:i + 1] - table).sum(0)
            seen, rows = seen + len(rows), []

        def flushed():
            cols = [[], [], [], [], []]
            if key is not None:
                lay()
                block = numbers // SOURCES
                i, j = np.triu_indices(len(numbers), 1)
                mine = (block[i] == key[1]) & (block[j] == key[2])
                i, j = i[mine], j[mine]
                cols = [[key[0]] * len(i), numbers[i], numbers[j], total[i, j], np.full(len(i), seen)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["lang", "i", "j", "sum", "seen"])

        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            cells = batch.column(5)
            number, share = (cells.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
            at = np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False))])
            for r, name in enumerate(names):
                own = number[at[r] : at[r + 1]].astype(np.int64), share[at[r] : at[r + 1]].astype(np.int64)
                if name != key:
                    yield flushed()
                    order = np.argsort(own[0])
                    key, numbers, zero = name, own[0][order], own[1][order]
                    total, seen, rows = np.zeros((len(numbers), len(numbers)), np.int64), 0, []
                    continue
                rows.append(own)
                if len(rows) >= ROWS:
                    lay()
        yield flushed()

    return dealt.mapInArrow(added, "lang string, i long, j long, sum long, seen long")


def audit(docs: DataFrame, min_df: int = 30, top: int = 50, most_terms: int = MOST_TERMS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows have each other source of the language and its distance,
    ``term`` rows the ``top`` terms whose share in the source lies most above their share in the language."""
    scratch = Scratch(docs.sparkSession, "divergence")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    counts, kept, groups = group_counts(base, min_df, most_terms, scratch)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    own = Window.partitionBy("lang").orderBy("source")
    groups = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "total"])
    groups = groups.withColumn("number", (F.row_number().over(own) - 1).cast("long")).withColumn("block", F.floor(F.col("number") / SOURCES).cast("int"))
    groups = scratch.cut(groups.withColumn("zero", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)), "shares")
    shared = counts.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"])
    shared = scratch.cut(shared.select("lang", "source", "term", "count", _share(F.col("count"), F.col("total"), F.col("terms")).alias("share")), "group-terms")

    sums = _pairs(shared, groups).groupBy("lang", "i", "j").agg(F.sum("sum").alias("sum"), F.sum("seen").alias("seen"))
    side = lambda k: groups.select("lang", F.col("number").alias(k), F.col("source").alias(f"source_{k}"), F.col("zero").alias(f"zero_{k}"))
    sums = sums.join(side("i"), ["lang", "i"]).join(side("j"), ["lang", "j"]).join(sizes, "lang", "left").fillna(0, ["terms"])
    value = F.col("sum") + (F.col("terms") - F.col("seen")) * F.abs(F.col("zero_i") - F.col("zero_j"))
    sums = scratch.cut(sums.select("lang", "source_i", "source_j", value.alias("value")), "pairs")
    pairs = sums.union(sums.select("lang", "source_j", "source_i", "value")).toDF("lang", "source", "item", "value")

    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    everywhere = shared.groupBy("lang", "term").agg(F.sum("count").alias("all")).join(whole, "lang")
    everywhere = everywhere.select("lang", "term", _share(F.col("all"), F.col("total"), F.col("terms")).alias("q"))
    above = shared.join(everywhere, ["lang", "term"]).where("share > q").select("lang", "source", F.col("term").alias("item"), (F.col("share") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").union(ranked(above, "term").where(F.col("rank") <= top))
