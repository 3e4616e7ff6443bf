"""Sharding by a Feistel permutation over global row numbers.

Rows are numbered from 0 in order of (doc_id, size, crc); a keyed Feistel network with cycle walking
permutes the numbers within [0, rows). The permuted number modulo the shards is the shard and its
quotient the slot, so that both can be computed from a row's number alone, counts differ by one at
most and slots have no gaps. Null text has no bytes; null ids come first; repeated rows have numbers
of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, global_rank
from .hashing import mix


def feistel(x: np.ndarray, half: int, key: int, rounds: int = 4) -> np.ndarray:
    """A bijection on numbers of 2 * half bits."""
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in range(rounds):
        turn = mix(right ^ np.uint64((key * 31 + r) * 0x9E3779B9 & (1 << 64) - 1)) & mask
        left, right = right, left ^ turn
    return (left << np.uint64(half)) | right


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The permutation of [0, n): numbers that leave the range walk on until they are back in it."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = feistel(x.astype(np.uint64), half, key)
    while (off := out >= np.uint64(n)).any():
        out[off] = feistel(out[off], half, key)
    return out.astype(np.int64)


def shard(docs: DataFrame, shards: int = 16, key: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, row_number, shard, slot): size is UTF-8 bytes plus 1. Only ids,
    sizes and checksums are shuffled, once, to number the rows."""
    small = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    ranked = global_rank(small, ["doc_id", "size", "text_crc32"], Scratch(docs.sparkSession, "shard"), "rows", "row_number")
    rows = docs.select(F.count("*")).first()[0]

    @F.pandas_udf("long")
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), rows, key))

    return ranked.withColumn("_place", permuted("row_number")).select(
        "doc_id", "size", "text_crc32", "row_number", (F.col("_place") % shards).cast("int").alias("shard"), F.expr(f"_place div {shards}").alias("slot")
    )
