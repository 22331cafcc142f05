"""Simultaneous loads of groups and their share at each vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.electrical import main_category, simultaneous_load


def allocate(buildings: DataFrame, group: list[str]) -> DataFrame:
    """sim, units and load_type of each vertex of a group, so that a main category's loads add up to its grouped load.

    Each building's own simultaneous load is scaled by grouped / sum of own in its group and category.
    A vertex has its buildings' type; where types differ it is 'Commercial', but single-family houses
    that come first (by osm_id) give way to the one other type. Needs type, kw, homes, sim_factor, osm_id, vertice_id.
    """
    b = buildings.withColumn("category", main_category(F.col("type"))).withColumn("own", simultaneous_load(F.col("kw"), F.col("homes"), F.col("sim_factor")))
    w = Window.partitionBy(*group, "category")
    grouped = simultaneous_load(F.sum("kw").over(w), F.sum("homes").over(w), F.min("sim_factor").over(w))
    total = F.sum("own").over(w)
    b = b.withColumn("share", F.col("own") * F.when(total > 0, grouped / total).otherwise(0.0))
    other = F.col("type") != "SFH"
    out = b.groupBy(*group, "vertice_id").agg(
        F.sum("share").alias("sim"),
        F.sum("homes").cast("long").alias("units"),
        F.sum("kw").alias("installed_kw"),
        F.countDistinct("type").alias("types"),
        F.min("type").alias("any_type"),
        F.countDistinct(F.when(other, F.col("type"))).alias("others"),
        F.min(F.when(other, F.col("type"))).alias("other"),
        F.max(F.when(~other, F.col("osm_id"))).alias("last_sfh"),
        F.min(F.when(other, F.col("osm_id"))).alias("first_other"),
    )
    gives_way = (F.col("types") == 2) & (F.col("others") == 1) & (F.col("last_sfh") < F.col("first_other"))
    kind = F.when(F.col("types") == 1, F.col("any_type")).when(gives_way, F.col("other")).otherwise("Commercial")
    return out.withColumn("load_type", kind).select(*group, "vertice_id", "sim", "units", "installed_kw", "load_type")
