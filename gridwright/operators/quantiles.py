"""Exact ranks, quantiles and running totals of groups of any size: ranges of partitions instead of one sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.checkpoints import cut
from gridwright.operators.groups import broadcast_if_small


def _same(by: list[str], other: str) -> Column:
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"{other}{i}"))
    return out


def with_group(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of their group's row; null keys are a group. Without ``by`` groups has one row."""
    named = groups.select(*[F.col(c).alias(f"__gw_k{i}") for i, c in enumerate(by)], *[c for c in groups.columns if c not in by])
    keys = [f"__gw_k{i}" for i in range(len(by))]
    return rows.join(broadcast_if_small(named), _same(by, "__gw_k")).drop(*keys) if by else rows.crossJoin(F.broadcast(named))


def running(rows: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """``rows``, one for each value of a group, with ``<sum>_upto`` (the sums up to and with this value) and ``next`` (the group's next value, or null).

    Rows are dealt to partitions by ranges of (by, value) and summed up inside each. What a group has in earlier
    partitions is added, and its next value looked up in a later one, for the groups that a range's border cuts:
    two a partition at most. Nulls in ``by`` are a group.
    """
    dealt = cut(rows.repartitionByRange(*by, value).withColumn("__gw_p", F.spark_partition_id()))
    group = Window.partitionBy(*by).orderBy("__gw_p")
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    pieces = dealt.groupBy("__gw_p", *by).agg(*[F.sum(c).alias(c) for c in sums], F.min(value).alias("__gw_v"))
    pieces = pieces.withColumns({**{f"__gw_b_{c}": F.sum(c).over(before) for c in sums}, "__gw_next": F.lead("__gw_v").over(group)})
    pieces = pieces.where(F.col(f"__gw_b_{sums[0]}").isNotNull() | F.col("__gw_next").isNotNull())  # at most two rows a partition
    pieces = F.broadcast(pieces.select(F.col("__gw_p").alias("__gw_q"), *[f"__gw_b_{c}" for c in sums], "__gw_next", *[F.col(c).alias(f"__gw_k{i}") for i, c in enumerate(by)]))
    inside = Window.partitionBy("__gw_p", *by).orderBy(value)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({**{f"__gw_r_{c}": F.sum(c).over(upto) for c in sums}, "__gw_lead": F.lead(value).over(inside)})
    out = out.join(pieces, (F.col("__gw_p") == F.col("__gw_q")) & _same(by, "__gw_k"), "left")
    return out.select(*rows.columns, *[(F.col(f"__gw_r_{c}") + F.coalesce(f"__gw_b_{c}", F.lit(0))).alias(f"{c}_upto") for c in sums], F.coalesce("__gw_lead", "__gw_next").alias("next"))


def rank_counts(rows: DataFrame, by: list[str], value: str, n: str | None = None) -> DataFrame:
    """by, value, n, below, upto: how often each value of a group occurs, and how many of its rows are smaller, and not larger.

    ``n`` names a column that says how often a row counts. Null values are left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(n or F.lit(1)).cast("long").alias("n"))
    return running(counts, by, value, ["n"]).select(*by, value, "n", (F.col("n_upto") - F.col("n")).alias("below"), F.col("n_upto").alias("upto"))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], n: str | None = None) -> DataFrame:
    """by and, for each name of ``shares``, the exact quantile with linear interpolation between neighbouring ranks.

    The same as ``percentile``, without a buffer of a group's values. A group of nulls only is left out.
    """
    ranked = cut(rank_counts(rows, by, value, n))
    totals = cut(ranked.groupBy(*by).agg(F.max("upto").alias("__gw_n")))
    place = {name: F.lit(share) * (F.col("__gw_n") - 1) for name, share in shares.items()}
    held = lambda at: (F.col("below") <= at) & (at < F.col("upto"))
    wanted = F.lit(False)
    for at in place.values():
        wanted = wanted | held(F.floor(at)) | held(F.ceil(at))
    hits = with_group(ranked, totals, by).where(wanted)  # a few rows a group

    def between(at: Column) -> Column:
        low, high = (F.max(F.when(held(f(at)), F.col(value).cast("double"))) for f in (F.floor, F.ceil))
        return low + (high - low) * F.max(at - F.floor(at))

    return hits.groupBy(*by).agg(*[between(at).alias(name) for name, at in place.items()])
