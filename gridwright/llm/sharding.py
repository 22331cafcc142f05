"""Sharding by a Feistel permutation of global row numbers, walked along its cycles into range."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.checkpoints import cut

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser over half a block and a round key."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_keys(seed: int) -> list[int]:
    return [int(_mixed(np.array([seed & (2**64 - 1)], np.uint64), i + 1)[0]) for i in range(ROUNDS)]


def feistel(numbers: np.ndarray, rows: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The place of each number in [0, rows) under the seed's permutation of that range, or the number at each place."""
    half = max(1, ((max(rows, 2) - 1).bit_length() + 1) // 2)
    mask, keys = np.uint64((1 << half) - 1), _round_keys(seed)

    def block(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mixed(left, key) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, key) & mask)
        return left << np.uint64(half) | right

    with np.errstate(over="ignore"):
        out = block(numbers.astype(np.uint64))
        outside = np.flatnonzero(out >= rows)
        while len(outside):  # the cycle comes back into range, at its start at the latest
            out[outside] = block(out[outside])
            outside = outside[out[outside] >= rows]
    return out.astype(np.int64)


def numbered(rows: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` from 0 in the order of ``by``, and their count. Only one small row per partition reaches the driver."""
    ordered = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by)).withColumn("__gw_at", F.monotonically_increasing_id())
    part, within = F.shiftright("__gw_at", 33), F.col("__gw_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(ordered.groupBy(part.alias("p")).count().collect())
    starts, total = {}, 0
    for p, n in sizes:
        starts[p], total = total, total + n
    spark = rows.sparkSession
    offsets = F.broadcast(spark.createDataFrame(list(starts.items()), "__gw_part long, __gw_start long"))  # a row per partition
    out = ordered.withColumn("__gw_part", part.cast("long")).join(offsets, "__gw_part").withColumn("row_number", F.col("__gw_start") + within)
    return out.drop("__gw_at", "__gw_part", "__gw_start"), total


def shards(docs: DataFrame, count: int = 8, seed: int = 20240607, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), row_number, place.

    Rows are numbered by id, then CRC and size of the text (null ids first); the Feistel permutation
    of the seed gives each number its place p, and p mod count, p div count are shard and slot. So
    shard sizes differ by one row at most, slots have no gaps, and either can be computed from the
    number alone. size is the text's UTF-8 bytes plus 1, a null text counts as empty. Equal rows get
    different places. An empty table gives an empty result; other columns are not read.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows, total = numbered(narrow, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(), total, seed))

    placed = rows.withColumn("place", place("row_number"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % count).cast("int").alias("shard"), F.expr(f"place div {count}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number", "place")
