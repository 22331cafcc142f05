"""Metrics of grids from their element tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.checkpoints import cut
from gridwright.operators.quantiles import quantiles, running, with_group


def _parallel() -> Column:
    p = F.coalesce(F.col("parallel").cast("double"), F.lit(1.0))
    return F.when(p == 0, 1.0).otherwise(p)


def cable_length(lines: DataFrame, by: list[str]) -> DataFrame:
    """cable_length_km: length times number in parallel of lines in service."""
    return lines.where("in_service").groupBy(*by).agg(F.sum(F.col("parallel") * F.col("length_km")).alias("cable_length_km"))


def graph_length(lines: DataFrame, by: list[str]) -> DataFrame:
    """graph_length: routed length of lines in service, parallel ones once."""
    return lines.where("in_service").groupBy(*by).agg(F.sum("length_km").alias("graph_length"))


def graph_resistance(lines: DataFrame, by: list[str], in_service: bool = True) -> DataFrame:
    """graph_resistance: sum of length * r / parallel; a null or zero parallel counts as one. Without the needed columns, 0 for each group."""
    if {"length_km", "r_ohm_per_km", "x_ohm_per_km", "from_bus", "to_bus"} - set(lines.columns):
        return lines.groupBy(*by).agg(F.lit(0.0).alias("graph_resistance"))
    rows = lines.where("in_service") if in_service and "in_service" in lines.columns else lines
    ohm = F.coalesce("length_km", F.lit(0.0)) * F.coalesce("r_ohm_per_km", F.lit(0.0)) / (_parallel() if "parallel" in lines.columns else F.lit(1.0))
    return rows.groupBy(*by).agg(F.sum(ohm).alias("graph_resistance"))


def capacity_map(rows: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """doc: {size: [values]} as JSON, sizes ascending, values ascending."""
    lists = rows.groupBy(*by, key).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("__v"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("int").alias("k"), F.col("__v").alias("v"))))
    return lists.groupBy(*by).agg(F.to_json(F.map_from_entries(entries)).alias("doc"))


def read_capacity_map(rows: DataFrame, doc: str) -> DataFrame:
    """kva, vals for each entry of a JSON map of lists."""
    others = [c for c in rows.columns if c != doc]
    return rows.select(*others, F.explode(F.from_json(doc, "map<string, array<double>>")).alias("kva", "vals")).withColumn("kva", F.col("kva").cast("int"))


def median_neighbour_distance(near: DataFrame, by: list[str]) -> DataFrame:
    """Median over points of the mean distance to their nearest others (by, id, dist)."""
    return quantiles(near.groupBy(*by, "id").agg(F.avg("dist").alias("m")), by, "m", {"house_distance": 0.5})


def peak_at_distance(distances: DataFrame, peaks: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Simultaneous peak stored for a distance: a join on the rounded distance in place of equality of floats."""
    key = F.round("distance", digits).alias("__d")
    stored = peaks.select(*by, F.round("distance", digits).alias("__d"), "peak").groupBy(*by, "__d").agg(F.min("peak").alias("peak"))
    return distances.withColumn("__d", key).join(stored, [*by, "__d"], "left").drop("__d")


def wasserstein(rows: DataFrame, by: list[str], value: str, source: str, one: str, other: str) -> DataFrame:
    """Wasserstein-1 distance of two sources' values in each group, scaled by the pooled interquartile range.

    The distance is the integral of the gap between the two distribution functions, a running sum over
    the pooled values. A range of 0 gives way to the pooled population deviation, and that to 1.
    Groups without values of one source get nulls.
    """
    v = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("v"), F.col(source).alias("s"))
    per = cut(v.groupBy(*by, "v").agg(F.count_if(F.col("s") == one).alias("a"), F.count_if(F.col("s") == other).alias("b")))
    totals = cut(per.groupBy(*by).agg(F.sum("a").alias("n_one"), F.sum("b").alias("n_other")))
    steps = with_group(running(per, by, "v", ["a", "b"]), totals, by)
    gap = F.abs(F.try_divide("a_upto", "n_one") - F.try_divide("b_upto", "n_other"))
    moved = steps.groupBy(*by, "n_one", "n_other").agg(F.sum(gap * (F.col("next") - F.col("v"))).alias("d"))
    mine = per.withColumn("n", F.col("a") + F.col("b")).where("n > 0")
    shape = v.where(F.col("s").isin(one, other)).groupBy(*by).agg(F.stddev_pop("v").alias("sd"))
    spread = shape.join(quantiles(mine, by, "v", {"low": 0.25, "high": 0.75}, "n"), by).withColumn("iqr", F.col("high") - F.col("low"))
    out = moved.join(spread, by)
    both = (F.col("n_one") > 0) & (F.col("n_other") > 0)
    scale = F.when(F.col("iqr") > 0, F.col("iqr")).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    dist = F.when(both, F.coalesce("d", F.lit(0.0)))
    return out.select(*by, "n_one", "n_other", dist.alias("wasserstein_distance"), F.when(both, scale).alias("pooled_iqr"), (dist / scale).alias("normalized_wasserstein"))


def density_curve(rows: DataFrame, by: list[str], value: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid over each group's range, with Scott's bandwidth."""
    per = cut(rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")))
    spread = rows.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.stddev_samp(value).alias("sd"), F.count(value).alias("all"))
    h = F.greatest(F.coalesce("sd", F.lit(0.0)) * F.pow("all", F.lit(-0.2)), F.lit(1e-9))
    met = with_group(per, cut(spread.withColumn("h", h)), by).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    met = met.withColumn("at", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    kernel = F.exp(-F.pow((F.col("at") - F.col("v")) / F.col("h"), 2) / 2) / (F.col("h") * 2.5066282746310002)
    return met.groupBy(*by, "i", "at").agg((F.sum(kernel * F.col("n")) / F.sum("n")).alias("density"))


def box_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    ends = rows.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return with_group(quantiles(rows, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), cut(ends), by)
