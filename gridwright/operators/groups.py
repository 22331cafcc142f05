"""Groups that are worked on one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.checkpoints import cut


def dealt(df: DataFrame, by: list[str], times: int = 1) -> DataFrame:
    """``df`` dealt out by its groups to as many partitions as shuffles have, or ``times`` as many where groups cost much.

    Adaptive execution would join partitions that are small in bytes; what a group costs here is time, so they stay apart.
    """
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Rows of a group's parts that one task works on, about.
SHARE = 20_000


def shared_out(whole: DataFrame, parts: DataFrame, over: list[str], more: list[str], rows: int = SHARE) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(``whole`` for each share (__share) of its group, a function that gives rows of the group's parts theirs).

    over: the group's key; more: what tells its parts apart. A group has a share for every ``rows`` rows of ``parts``, and a part is in one of them.
    """
    n = F.ceil(F.count("*") / rows).cast("int") if more else F.lit(1)
    size = cut(parts.groupBy(*over).agg(n.alias("__n")))
    place = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in more]), F.col("__n")).cast("int") if more else F.lit(0)
    each = whole.join(size, over).withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    return each, lambda df: df.join(size, over).withColumn("__share", place).drop("__n")


#: Rows of a small table up to which it is broadcast.
SMALL = 200_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it is small; beyond it the same join shuffles. ``df`` should be cut already."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_join(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``few`` where few keys hold nearly all pairs: each key's rows of ``many`` are dealt evenly over salts, each salt meets all of ``few``.

    A task holds a small share of a key's pairs then, so its time falls with the number of partitions. how: inner or left (keeps all of ``many``).
    """
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = many.withColumn("__salt", F.pmod(F.xxhash64(*many.columns), F.lit(parts)).cast("int"))
    each = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    key = [*on, "__salt"]
    tasks = 4 * parts
    return salted.repartition(tasks, *key).join(each.repartition(tasks, *key), key, how).drop("__salt")
