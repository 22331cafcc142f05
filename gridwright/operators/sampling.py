"""Stratified sampling: quotas by population, density bins, weighted draws without replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.checkpoints import cut
from gridwright.functions.hashing import digits, uniform
from gridwright.operators.groups import broadcast_if_small


def quotas(register: DataFrame, by: str, weight: str, samples: int) -> DataFrame:
    """(by, samples): each class's share of the weight, rounded half to even."""
    total = register.agg(F.sum(weight).alias("total"))
    per = register.groupBy(by).agg(F.sum(weight).alias("w")).crossJoin(F.broadcast(total))
    return per.select(by, F.bround(F.col("w") * float(samples) / F.col("total"), 0).cast("int").alias("samples"))


def density_bins(register: DataFrame, by: str, value: str, few: int = 100, bins: tuple[int, int] = (5, 10)) -> DataFrame:
    """Rows with bin_no (equal widths within the class, the last bin closed) and class_rows."""
    span = register.groupBy(by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(value).alias("class_rows"))
    rows = register.join(broadcast_if_small(cut(span)), by)
    count = F.when(F.col("class_rows") < few, bins[0]).otherwise(bins[1])
    width = F.col("__hi") - F.col("__lo")
    at = F.when(width == 0, 0).otherwise(F.floor((F.col(value) - F.col("__lo")) / F.when(width == 0, 1.0).otherwise(width) * count))
    return rows.withColumn("bin_no", F.least(at.cast("int"), (count - 1).cast("int"))).drop("__lo", "__hi")


def stratified_sample(register: DataFrame, by: str, weight: str, value: str, key: str, samples: int, seed: int = 42) -> DataFrame:
    """About ``samples`` rows: each class's quota, drawn without replacement.

    Every row of a class is as likely as the share of its density bin divided by the bin's rows. Draws
    take the largest -ln(u)/weight order keys, with u from a hash of the key, so a seed gives one sample.
    """
    first = Window.partitionBy(key).orderBy(by)
    rows = register.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")
    binned = density_bins(rows, by, value)
    per = Window.partitionBy(by, "bin_no")
    binned = binned.withColumn("perc_bin", F.count("*").over(per) / F.col("class_rows")).withColumn("count", F.count("*").over(per)).withColumn("perc", F.col("perc_bin") / F.col("count"))
    drawn = Window.partitionBy(by).orderBy(-F.log(uniform(key, seed)) / F.col("perc"), key)
    quota = quotas(rows, by, weight, samples)
    return binned.withColumn("place", F.row_number().over(drawn)).join(broadcast_if_small(cut(quota)), by).where(F.col("place") <= F.col("samples")).drop("place", "samples")


def replace_samples(sample: DataFrame, register: DataFrame, gone: DataFrame, by: str, value: str, key: str, seed: int = 42) -> DataFrame:
    """``sample`` with each key in ``gone`` replaced by an unused one of the same class and density bin, first by a hash order; without one it is dropped."""
    binned = density_bins(register.dropDuplicates([key]), by, value).join(sample.select(key), key, "left_anti")
    order = lambda *c: Window.partitionBy(by, "bin_no").orderBy(*c)
    spare = binned.withColumn("__at", F.row_number().over(order(digits(key, seed), key))).select(by, "bin_no", "__at", F.col(key).alias("__new"))
    out = sample.join(gone.select(key).distinct(), key, "left_semi").withColumn("__at", F.row_number().over(order(key)))
    swapped = out.join(spare, [by, "bin_no", "__at"]).withColumn(key, F.col("__new")).select(*sample.columns)
    return sample.join(gone.select(key), key, "left_anti").unionByName(swapped)
