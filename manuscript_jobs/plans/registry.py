"""The registry of queries: each is a function of (Tables) with, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Driver tables and the views derived from them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        view = getattr(fixtures, f"view_{name}", None)
        df = view(self) if view else self.table(name)
        self.__dict__[name] = df
        return df

    def table(self, name: str) -> DataFrame:
        """A driver table; its times without a zone are UTC."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def with_views(body: str) -> str:
    """Puts the SQL of all views that a query names, and those they name, before it."""
    needed: list[str] = []

    def visit(text: str, above: tuple = ()) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
            if name in fixtures.SQL and name not in needed and name not in above:
                visit(fixtures.SQL[name], (*above, name))
                if name not in needed:
                    needed.append(name)

    visit(body)
    # "at" is a word of the dialect, so as a name it is quoted (not inside literals).
    quoted = lambda sql: "".join(x if i % 2 else re.sub(r'(?<!")\bat\b(?!")', '"at"', x) for i, x in enumerate(re.split(r"('(?:[^']|'')*')", sql)))
    views = ", ".join(f"{name} AS ({fixtures.SQL[name]})" for name in needed)
    if not views:
        return quoted(body)
    rest = body.strip()
    return quoted(f"WITH {views}, {rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {views} {rest}")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def oracles() -> dict[str, str]:
    """All SQL, complete with the views it names."""
    return {name: with_views(sql) for name, sql in ORACLES.items()}
