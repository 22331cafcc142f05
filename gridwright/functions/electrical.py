"""Loads, currents and sizes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwright.config import DEFAULT, RESIDENTIAL, Config

SQRT3 = math.sqrt(3)


def simultaneous_load(installed: Column, count: Column, factor: Column) -> Column:
    """P * (g + (1 - g) * n ** -3/4); 0 where P or n is null or not positive."""
    p, n = installed.cast("double"), count.cast("double")
    return F.when((F.coalesce(p, F.lit(0.0)) <= 0) | (F.coalesce(n, F.lit(0.0)) <= 0), 0.0).otherwise(p * (factor + (1 - factor) * F.pow(n, F.lit(-0.75))))


def main_category(kind: Column) -> Column:
    """Residential, Commercial, Public or Industrial; null for other types."""
    return F.when(kind.isin(*RESIDENTIAL), "Residential").when(kind.isin("Commercial", "Public", "Industrial"), kind)


def households(kind: Column, area: Column, floors: Column, given: Column) -> Column:
    """Households of a building where none are given: by type, area (m2) and floors."""
    rule = (
        F.when(kind.isin("TH", "Commercial", "Public", "Industrial"), 1)
        .when(kind == "SFH", F.when(area < 160, 1).otherwise(2))
        .when(kind.isin("MFH", "AB"), (F.floor(area / 50) * floors).cast("int"))
        .otherwise(0)
    )
    return F.coalesce(given.cast("int"), rule.cast("int"))


def peak_load(kind: Column, area: Column, homes: Column, per_household: Column, per_m2: Column) -> Column:
    """kW: households times the category's load, or area times W per m2; 0 without a category."""
    home = F.when(kind.isin(*RESIDENTIAL), homes * per_household)
    return F.coalesce(home.when(kind.isin("Commercial", "Public", "Industrial"), area * per_m2 / 1000).otherwise(F.lit(0.0)), F.lit(0.0))


def without_too_large(kind: Column, load: Column, limit: float = 100.0) -> Column:
    """0 for commercial and public buildings above the limit, which get a supply of their own."""
    return F.when((load > limit) & kind.isin("Commercial", "Public"), 0.0).otherwise(load)


def settlement_score(mean_households: Column, mean_distance: Column, config: Config = DEFAULT) -> Column:
    """0 (rural) to 1 (urban): mean of households and closeness, each scaled between the two limits."""
    scaled = lambda x, low, high: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))
    dense = scaled(mean_households, config.rural_max_households, config.urban_min_households)
    near = scaled(mean_distance, config.rural_min_distance, config.urban_max_distance)
    return (dense + near) / 2


def settlement_type(score: Column) -> Column:
    """1 below a third, 2 below two thirds, else 3."""
    return F.when(score < 1 / 3, 1).when(score < 2 / 3, 2).when(score.isNotNull(), 3)


def current_ka(load_kw: Column, config: Config = DEFAULT) -> Column:
    """Current at the lowest voltage allowed."""
    return load_kw / (config.nominal_v * config.band_low * SQRT3)


def max_impedance(drop_percent: Column, ka: Column, km: Column, parallel: Column, config: Config = DEFAULT) -> Column:
    """Ohm per km up to which the voltage drop is kept; infinite where nothing flows."""
    below = SQRT3 * ka * km / parallel
    return F.when(F.coalesce(below, F.lit(0.0)) <= 0, F.lit(float("inf"))).otherwise(config.nominal_v / 1000 * drop_percent / 100 / below)


def reactive_kvar(kw: Column, config: Config = DEFAULT) -> Column:
    return kw * F.tan(F.acos(F.lit(config.power_factor)))


def transformer_build(rated: Column) -> tuple[Column, Column, Column]:
    """(name, kVA of one, number in parallel) of a rated power."""
    single, double = rated.isin(100, 160, 250, 400, 630), rated.isin(500, 800, 1260)
    many = F.greatest(F.lit(1), (rated / 630).cast("int"))
    name = (
        F.when(single, F.concat(F.lit("single "), rated.cast("int").cast("string"), F.lit(" kva transformer")))
        .when(double, F.concat(F.lit("double "), (rated * 0.5).cast("decimal(10,1)").cast("string"), F.lit(" transformer")))
        .otherwise(F.concat(many.cast("string"), F.lit("-fold 630 transformer")))
    )
    kva = F.when(single, rated.cast("double")).when(double, rated * 0.5).otherwise(F.lit(630.0))
    return name, kva, F.when(single, 1).when(double, 2).otherwise(many)


def grouped_rating(rated: Column, allowed: Column) -> Column:
    """Rated power as it is if it is an allowed size or twice the third or fourth one; else the next multiple of 630."""
    doubled = F.transform(F.slice(F.array_sort(allowed), 3, 2), lambda k: k * 2)
    known = F.array_contains(F.concat(allowed, doubled).cast("array<double>"), rated.cast("double"))
    return F.when(known, rated.cast("int")).otherwise((F.ceil(rated / 630) * 630).cast("int"))


def power_flow_status(converged: Column, least_vm: Column, most_vm: Column, config: Config = DEFAULT) -> Column:
    return F.when(~F.coalesce(converged, F.lit(False)), "not_converged").when((least_vm < config.band_low) | (most_vm > config.band_high), "voltage_violation").otherwise("converged")


def fit_label(normalized: Column) -> Column:
    """Quality of a normalised Wasserstein distance."""
    return F.when(normalized.isNull(), "insufficient_data").when(normalized <= 0.10, "excellent").when(normalized <= 0.25, "good").when(normalized <= 0.50, "acceptable").otherwise("poor")
