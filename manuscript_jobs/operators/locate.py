"""Finding excerpts again in the pages of their document."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def excerpt_needles(excerpts: DataFrame) -> DataFrame:
    """Search keys of an excerpt, longest first: all of it, its first and last 40 characters (the last not for a
    paragraph's start), its first three words; distinct, of two characters and more."""
    t = F.lower(F.trim(F.regexp_replace("excerpt", r"\s+", " ")))
    three = F.array_join(F.slice(F.split(t, " "), 1, 3), " ")
    keys = F.array(t, F.trim(F.substring(t, 1, 40)), F.when(~F.col("paragraph_start"), F.trim(F.right(t, F.lit(40)))), three)
    good = F.filter(F.array_distinct(keys), lambda k: k.isNotNull() & (F.length(k) >= 2))
    return excerpts.select("doc_id", "excerpt_id", "page_index", F.posexplode(good).alias("rank", "needle"))


class _Document:
    """The excerpts of one document, searched by one automaton of all their needles."""

    def __init__(self, doc_id):
        from ahocorasick import Automaton

        self.doc_id, self.named, self.needles, self.pages = doc_id, {}, {}, set()
        self.best: dict = {}
        self.automaton = Automaton()

    def ask(self, excerpt, page, needle: str) -> None:
        self.named[excerpt] = page
        self.needles.setdefault(needle, []).append(excerpt)
        self.automaton.add_word(needle, needle)

    def read(self, at, text: str | None) -> None:
        """A page; pages come in ascending order, so a needle's first page is its earliest."""
        if not self.pages and self.needles:
            self.automaton.make_automaton()
        self.pages.add(at)
        if self.needles and text:
            for needle in {n for _, n in self.automaton.iter(text)}:
                for excerpt in self.needles.pop(needle, ()):
                    known = self.best.get(excerpt)
                    if known is None or len(needle) > known[0]:
                        self.best[excerpt] = len(needle), at

    def found(self) -> list[tuple]:
        if not self.pages:
            return []
        return [(self.doc_id, x, page if page is not None and page in self.pages else self.best.get(x, (0, None))[1]) for x, page in self.named.items()]


def locate_excerpts(excerpts: DataFrame, pages: DataFrame) -> DataFrame:
    """The named page if the document has it, else the page with the longest needle (the earliest on ties), else none.

    Needles and pages of a document meet in one shuffle, needles first; an automaton of all needles reads each page once, so
    time follows the texts and not needles times pages. A task holds the needles of one document and a batch of pages.
    Documents without pages, and excerpts without needles, give no row; a null document is one like others."""
    text = F.lower(F.regexp_replace("text", r"\s+", " "))
    asked = excerpt_needles(excerpts).select("doc_id", F.lit(0).alias("kind"), F.col("page_index").cast("long").alias("at"), "excerpt_id", F.col("needle").alias("text"))
    read = pages.select("doc_id", F.lit(1).alias("kind"), F.col("page_index").cast("long").alias("at"), F.lit(None).cast(excerpts.schema["excerpt_id"].dataType).alias("excerpt_id"), text.alias("text"))
    rows = asked.union(read).repartition("doc_id").sortWithinPartitions("doc_id", "kind", "at")
    types = {n: pages.schema[n].dataType.simpleString() if n == "page_index" else excerpts.schema[n].dataType.simpleString() for n in ("doc_id", "excerpt_id", "page_index")}

    def searched(batches):
        now = None
        for batch in batches:
            out = []
            for doc_id, kind, at, excerpt, said in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if now is None or doc_id != now.doc_id:
                    out += now.found() if now else []
                    now = _Document(doc_id)
                if kind:
                    now.read(at, said)
                else:
                    now.ask(excerpt, at, said)
            yield table(out)
        yield table(now.found() if now else [])

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["doc_id", "excerpt_id", "page_index"])

    found = rows.selectExpr("cast(doc_id as long) doc_id", "kind", "at", "cast(excerpt_id as long) excerpt_id", "text").mapInArrow(searched, "doc_id long, excerpt_id long, page_index long")
    return found.select(*[F.col(n).cast(kind) for n, kind in types.items()])
