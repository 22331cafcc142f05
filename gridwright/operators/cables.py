"""Cable choice as a ranking of (number in parallel, cross-section), without a loop over rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.config import CABLES, DEFAULT, Config
from gridwright.functions.electrical import SQRT3


def _least_parallel(ka: Column, km: Column, drop_percent: Column, i: float, z: float, nominal_kv: float) -> Column:
    """Fewest cables of one kind that carry the current and keep the voltage drop."""
    by_current = F.ceil(ka / i - 1e-12)
    by_drop = F.when(ka * km > 0, F.ceil(SQRT3 * ka * km * z / (nominal_kv * drop_percent / 100) - 1e-12)).otherwise(1)
    return F.greatest(F.lit(1), by_current, by_drop).cast("int")


def choose(load_kw: Column, metres: Column, drop_percent: Column, pool: Column, config: Config = DEFAULT) -> tuple[Column, Column]:
    """(cable, number in parallel) with the fewest in parallel and, of those, the smallest cross-section.

    pool: 'feeder', 'consumer' or 'both'. A cable needs n >= I / I_max for the current and
    n >= sqrt(3) I Z L / (U drop) for the voltage, so the search for n is a closed form.
    """
    ka = load_kw / (config.nominal_v * config.band_low * SQRT3)
    km = metres / 1000
    options = []
    for name, amps, r, x, _, _, use in CABLES:
        n = _least_parallel(ka, km, drop_percent, amps / 1000, math.hypot(r, x) / 1000, config.nominal_v / 1000)
        # a number that fits for the smallest count of all may be passed by others: order by count, cross-section, list
        options.append(F.when((pool == "both") | (pool == use), F.struct(n.alias("n"), F.lit(float(name.split("_")[-1])).alias("q"), F.lit(name).alias("name"))))
    best = F.array_min(F.filter(F.array(*options), lambda o: o.isNotNull()))
    return best["name"], best["n"]


def consumer_cable(load_kw: Column, metres: Column, at_transformer: Column, config: Config = DEFAULT) -> tuple[Column, Column]:
    """Cable of a house: a stricter drop for small loads, feeder cables too for large loads right at the transformer."""
    large = load_kw > config.small_load_kw
    drop = F.when(large, config.drop_large_percent).otherwise(config.drop_small_percent)
    return choose(load_kw, metres, drop, F.when(at_transformer & large, "both").otherwise("consumer"), config)


def feeder_cable(load_kw: Column, metres: Column, config: Config = DEFAULT) -> tuple[Column, Column]:
    return choose(load_kw, metres, F.lit(config.drop_feeder_percent), F.lit("feeder"), config)


def fallback_cable(cables: DataFrame) -> DataFrame:
    """family, name: the strongest cable of each family, which stands in for one that is missing."""
    family = F.regexp_extract("name", r"^([A-Z]+)", 1)
    best = Window.partitionBy("family").orderBy(F.desc("max_i_ka"), "name")
    return cables.withColumn("family", family).withColumn("__at", F.row_number().over(best)).where("__at = 1").select("family", "name")
