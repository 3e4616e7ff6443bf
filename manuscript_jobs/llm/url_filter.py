"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

The automaton reports every vocabulary term in the lower-cased URL; a hit counts when the characters
around it are no letters or digits. One strict hit rejects, and so do soft hits of two distinct terms or more
whose weights add up to ``soft_limit``. The vocabulary is a parameter; ``vocabulary`` reads one from a table. Null and empty URLs have an empty host and
path, no hits and the verdict ``allow``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
STRICT = (
    "adult", "bdsm", "blowjob", "camgirl", "camgirls", "camsex", "escort", "escorts", "fetish", "hentai", "hookup", "milf", "nsfw", "nude", "nudes", "onlyfans",
    "porn", "porno", "pornstar", "sex", "sexcam", "sexcams", "sexchat", "sextube", "striptease", "upskirt", "webcamsex", "xrated", "xvideos", "xxx",
)
#: Two weak signs (1 each) are no reason; a strong one (2) and a weak one are, or three weak ones.
SOFT = (
    ("bet", 1), ("bets", 1), ("betting", 2), ("bingo", 1), ("blackjack", 2), ("bonus", 1), ("casino", 2), ("casinos", 2), ("cheap", 1), ("cialis", 2), ("coupon", 1), ("crack", 1), ("cracked", 1),
    ("dating", 2), ("discount", 1), ("flirt", 2), ("free", 1), ("freespins", 2), ("gamble", 2), ("gambling", 2), ("hardcore", 2), ("hot", 1), ("jackpot", 2), ("keygen", 2), ("levitra", 2), ("lingerie", 2),
    ("loan", 1), ("loans", 1), ("lotto", 2), ("lottery", 1), ("mature", 1), ("naked", 2), ("nudity", 2), ("payday", 1), ("pharmacy", 1), ("pills", 1), ("poker", 2), ("replica", 1), ("roulette", 2), ("serial", 1), ("sexy", 2),
    ("singles", 1), ("slot", 1), ("slots", 2), ("teen", 1), ("teens", 1), ("torrent", 2), ("torrents", 2), ("tube", 1), ("viagra", 2), ("warez", 2), ("webcam", 1), ("win", 1), ("xanax", 2),
)
SOFT_LIMIT = 3


def vocabulary(terms: DataFrame, most: int = 100_000) -> tuple[tuple, tuple]:
    """(strict, soft) for ``filter_urls`` from a table (term, weight, strict), lower-cased, without null or empty
    terms; a term's largest weight counts. A table of over ``most`` terms is an error, since each task holds them all."""
    fine = terms.select(ascii_lower(F.col("term")).alias("term"), F.coalesce("weight", F.lit(1)).cast("int").alias("weight"), F.coalesce("strict", F.lit(False)).alias("strict"))
    rows = fine.where(F.length("term") > 0).groupBy("term").agg(F.max("weight").alias("weight"), F.max("strict").alias("strict")).orderBy("term").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of over {most} terms")
    return tuple(r.term for r in rows if r.strict), tuple((r.term, r.weight) for r in rows if not r.strict)


def host_and_path(url):
    """(host, path) columns: the host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; the path from there to ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def rule_columns(host, path, rules=RULES):
    """(rule, action) of the longest rule whose host is the url's or a parent domain of it and whose
    path begins the url's. ``rules`` is a short written list, so it becomes one expression."""
    rule = action = None
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, action)


@lru_cache(4)
def _automaton(strict: tuple, soft: tuple):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in soft:
        found.add_word(term, (term, weight, False))
    for term in strict:
        found.add_word(term, (term, 1, True))
    found.make_automaton()
    return found


def count_terms(url: str | None, strict: tuple = STRICT, soft: tuple = SOFT) -> tuple[int, int, int]:
    """(distinct strict terms, distinct soft terms, the weight of these) in one lower-cased URL."""
    hits, softs, weights, seen = 0, 0, 0, set()
    for last, (term, weight, is_strict) in _automaton(strict, soft).iter(url or ""):
        first = last - len(term) + 1
        around = url[first - 1 : first] + url[last + 1 : last + 2]
        if term in seen or any(c.isascii() and c.isalnum() for c in around):
            continue
        seen.add(term)
        if is_strict:
            hits += 1
        else:
            softs += 1
            weights += weight
    return hits, softs, weights


def filter_urls(
    pages: DataFrame, url: str = "url", rules=RULES, strict: tuple = STRICT, soft: tuple = SOFT, soft_limit: int = SOFT_LIMIT, keep: tuple = ("page_id",)
) -> DataFrame:
    """Judges every row: the ``keep`` columns, host, path, rule, verdict, strict_hits, soft_hits and soft_weight.

    Rows stay as they are (repeats too); nothing is shuffled. Other columns of ``pages`` are not read.
    """

    @F.pandas_udf("strict_hits int, soft_hits int, soft_weight int")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([count_terms(u, strict, soft) for u in part], columns=["strict_hits", "soft_hits", "soft_weight"])

    host, path = host_and_path(F.col(url))
    rule, action = rule_columns(F.col("_host"), F.col("_path"), rules)
    lowered = F.coalesce(ascii_lower(F.col(url)), F.lit(""))
    found = pages.select(*keep, host.alias("_host"), path.alias("_path"), counted(lowered).alias("_hits"))
    method = F.when((F.col("_hits.strict_hits") >= 1) | ((F.col("_hits.soft_hits") >= 2) & (F.col("_hits.soft_weight") >= soft_limit)), "block").otherwise("allow")
    return found.select(
        *keep,
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        rule.alias("rule"),
        F.coalesce(action, method).alias("verdict"),
        F.col("_hits.strict_hits").alias("strict_hits"),
        F.col("_hits.soft_hits").alias("soft_hits"),
        F.col("_hits.soft_weight").alias("soft_weight"),
    )
