"""Numbers in a total order over all rows of a table, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.checkpoints import cut


def numbered(rows: DataFrame, order: list[str | Column], name: str = "id", start: int = 1) -> DataFrame:
    """``rows`` with ``name``: start, start + 1, ... in the given order (nulls first), which should be total.

    Rows are dealt to partitions by ranges of the order and sorted there; a row's place is its place in the
    partition plus the rows of all partitions before. Only one count per partition reaches the driver. An
    empty table stays empty.
    """
    tagged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__gw_m", F.monotonically_increasing_id()))
    part = F.shiftright("__gw_m", 33)
    offsets, before = [], start
    for p, n in sorted(tagged.groupBy(part.alias("p")).count().collect()):  # a row per partition
        offsets.append((p, before))
        before += n
    first = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__gw_p long, __gw_o long"))
    at = F.col("__gw_o") + F.col("__gw_m").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.withColumn("__gw_p", part.cast("long")).join(first, "__gw_p").withColumn(name, at).drop("__gw_p", "__gw_o", "__gw_m")
