"""Decisions that each depend on the ones before: a fold over each key's rows in their order."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_in_order(rows: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable, step: Callable, close: Callable | None = None) -> DataFrame:
    """Rows of ``schema`` from ``step(state, row) -> (state, rows out)`` and, after a key's last row, from
    ``close(key, state)``.

    Rows come sorted from the shuffle in Arrow batches, so a task holds a batch and one state, however many rows
    a key has. A null key is a key like others; an empty table gives no rows.
    """
    made = to_arrow_schema(StructType.fromDDL(schema))
    columns = rows.columns

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(made)], schema=made)

    def run(batches):
        key = state = None
        for batch in batches:
            out = []
            for values in zip(*(batch.column(c).to_pylist() for c in columns)):
                row = dict(zip(columns, values))
                mine = tuple(row[k] for k in keys)
                if mine != key:
                    if key is not None and close:
                        out += close(key, state)
                    key, state = mine, start()
                state, new = step(state, row)
                out += new
            yield batch_of(out)
        if key is not None and close:
            yield batch_of(close(key, state))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
