"""Keyed reads: equality filters, joined reads and existence checks that the scan can prune by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equals(df: DataFrame, **wanted) -> DataFrame:
    """Rows in which every named column has the value given; a list means any of its values, None means null."""

    def one(name: str, value) -> Column:
        col = df[name]
        return col.isNull() if value is None else col.isin(list(value)) if isinstance(value, (list, tuple, set)) else col == F.lit(value)

    return df.where(reduce(lambda a, b: a & b, (one(k, v) for k, v in wanted.items()), F.lit(True)))


def joined(left: DataFrame, right: DataFrame, on: list[str], select: list[str] | None = None, **wanted) -> DataFrame:
    """Inner join on the keys, filtered as in ``equals``, projected to ``select``. Filters of either side reach its scan."""
    out = equals(left.join(right, on), **wanted)
    return out.select(*select) if select else out


def exists(df: DataFrame, **wanted) -> bool:
    """Whether a row has those values; reads no further than the first."""
    return equals(df, **wanted).limit(1).count() > 0


def flagged(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    """``left`` with a boolean that tells whether ``right`` has the row's keys. Left rows keep their number."""
    marks = right.select(*on).distinct().withColumn(name, F.lit(True))
    return left.join(marks, on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def resolve_regions(register: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(postcodes with their register rows in order, wanted codes that the register lacks)."""
    codes = wanted.select(key).distinct()
    return register.join(codes, key, "left_semi").orderBy("plz", "ags"), codes.join(register, key, "left_anti")


def first_unfinished(clusters: DataFrame, finished: DataFrame, key: str = "kcid") -> DataFrame:
    """The smallest cluster id without a result."""
    return clusters.select(key).join(finished.select(key), key, "left_anti").agg(F.min(key).alias(key))
