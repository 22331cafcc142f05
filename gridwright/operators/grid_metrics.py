"""Metric sets of grids: counts, distances, simultaneity upstream, path impedance, and their joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.config import DEFAULT, RESIDENTIAL, SIM_FACTOR, Config
from gridwright.functions.electrical import simultaneous_load
from gridwright.functions.text import bus_type
from gridwright.operators import metrics, routing


def zone_category(zone: Column) -> Column:
    """Residential unless a bus's zone is another known category."""
    return F.when(zone.isin("Commercial", "Public"), zone).otherwise("Residential")


def upstream_simultaneity(parents: DataFrame, loads: DataFrame, by: list[str]) -> DataFrame:
    """by, node, sim_load, peak_load, sim_factor_cumulated of the line into each node.

    parents: by, node, parent; loads: by, node, zone, count, max_p_mw. Counts and loads of all below
    add up by category, and each category has its own simultaneity.
    """
    by_zone = routing.subtree_sums(parents, loads.withColumn("zone", zone_category(F.col("zone"))), by, ["count", "max_p_mw"], ["zone"])
    factor = F.element_at(F.create_map(*[F.lit(v) for pair in SIM_FACTOR.items() for v in pair]), F.col("zone"))
    out = by_zone.groupBy(*by, "node").agg(F.sum(simultaneous_load(F.col("max_p_mw"), F.col("count"), factor)).alias("sim_load"), F.sum("max_p_mw").alias("peak_load"))
    return out.withColumn("sim_factor_cumulated", F.when(F.col("peak_load") > 0, F.col("sim_load") / F.col("peak_load")).otherwise(0.0))


def path_impedance(into: DataFrame, weights: DataFrame, by: list[str], simultaneous: bool = True) -> DataFrame:
    """by, node, branch, path_weight, r, x: the path from the root to each weighted bus.

    into: by, node, parent, length_km, r_ohm_per_km, x_ohm_per_km (line into a node; of parallel rows the
    first), cabinet and sim_factor_cumulated; weights: by, node, path_weight. The branch is the first node
    below the root on the path, or the second if the first is a cabinet.
    """
    factor = F.coalesce("sim_factor_cumulated", F.lit(1.0)) if simultaneous else F.lit(1.0)
    factor = F.when(factor == 0, 1.0).otherwise(factor)
    steps = into.select(*by, "node", "parent", (F.col("length_km") * F.col("r_ohm_per_km") * factor).alias("r"), (F.col("length_km") * F.col("x_ohm_per_km")).alias("x"))
    paths = routing.path_sums(steps, by, ["r", "x"]).where("steps > 0")
    kinds = into.where("cabinet").select(*by, F.col("node").alias("first"), F.lit(True).alias("__cabinet"))
    met = paths.join(weights.where("path_weight > 0"), [*by, "node"]).join(kinds, [*by, "first"], "left")
    return met.select(*by, "node", F.when(F.col("__cabinet") & F.col("second").isNotNull(), F.col("second")).otherwise(F.col("first")).alias("branch"), "path_weight", "r", "x")


def impedance_metrics(paths: DataFrame, by: list[str]) -> DataFrame:
    """max_weight_of_a_branch, resistance, reactance, ratio, max_vsw_of_a_branch, total_weight of each grid."""
    w = F.col("path_weight")
    branch = paths.groupBy(*by, "branch").agg(F.sum(w).alias("bw"), F.sum(w * F.col("r")).alias("br"), F.sum(w * F.col("x")).alias("bx"))
    out = branch.groupBy(*by).agg(F.max("bw").alias("max_no_of_households_of_a_branch"), F.sum("br").alias("resistance"), F.sum("bx").alias("reactance"), F.max("br").alias("max_vsw_of_a_branch"), F.sum("bw").alias("total_weight"))
    return out.withColumn("ratio", F.when(F.col("reactance") > 0, F.col("resistance") / F.col("reactance")).otherwise(0.0))


def household_path_proxy(paths: DataFrame, by: list[str]) -> DataFrame:
    """Impedance metrics per unit of weight, for weights that count households."""
    m = impedance_metrics(paths, by)
    mean = lambda c: F.when(F.col("total_weight") > 0, F.col(c) / F.col("total_weight")).otherwise(0.0)
    return m.withColumn("resistance", mean("resistance")).withColumn("reactance", mean("reactance"))


def rooted(lines: DataFrame, bus: DataFrame, roots: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(tree: by, node, parent, hops, dist in km; into: the line into each node with depth and cabinet mark)."""
    edges = lines.where("in_service").select(*by, F.col("from_bus").alias("source"), F.col("to_bus").alias("target"), F.col("length_km").alias("cost"))
    tree = routing.bfs_parents(edges, roots, by)
    ends = lambda a, b: lines.select(*by, F.col(a).alias("node"), F.col(b).alias("parent"), "name", "length_km", "r_ohm_per_km", "x_ohm_per_km")
    both = ends("to_bus", "from_bus").unionByName(ends("from_bus", "to_bus"))
    first = Window.partitionBy(*by, "node").orderBy("name", "length_km")
    kinds = bus.select(*by, F.col("bus").alias("node"), (bus_type(F.col("name")) == "kvs").alias("cabinet"))
    into = tree.join(both, [*by, "node", "parent"]).withColumn("__at", F.row_number().over(first)).where("__at = 1").drop("__at", "name")
    return tree, into.join(kinds, [*by, "node"], "left").withColumn("cabinet", F.coalesce("cabinet", F.lit(False))).withColumnRenamed("hops", "depth")


def trafo_distances(tree: DataFrame, consumers: DataFrame, by: list[str]) -> DataFrame:
    """avg_trafo_dis, max_trafo_dis over consumer buses (by, node) that the root reaches; 0 without any."""
    d = consumers.join(tree.select(*by, "node", "dist"), [*by, "node"], "left")
    return d.groupBy(*by).agg(F.coalesce(F.avg("dist"), F.lit(0.0)).alias("avg_trafo_dis"), F.coalesce(F.max("dist"), F.lit(0.0)).alias("max_trafo_dis"))


def clustering_metrics(tables: dict[str, DataFrame], by: list[str], config: Config = DEFAULT) -> DataFrame:
    """The clustering parameters of each grid from its tables bus, line, load, trafo and ext_grid (bus with x and y, if known)."""
    bus, line, load, trafo = tables["bus"], tables["line"], tables["load"], tables["trafo"]
    roots = routing.root_bus(bus, trafo, tables["ext_grid"], by)
    tree, into = rooted(line, bus, roots, by)
    count = lambda word: F.count_if(F.coalesce("name", F.lit("")).contains(word))
    n = bus.groupBy(*by).agg(count("Consumer Nodebus").cast("int").alias("no_house_connections"), count("Connection Nodebus").cast("int").alias("no_connection_buses"))
    power = load.groupBy(*by).agg(F.sum("max_p_mw").alias("max_power_mw"), F.sum("p_mw").alias("simultaneous_peak_load_mw"), F.count("*").cast("int").alias("no_households"))
    typed = bus.select(*by, "bus", bus_type(F.col("name")).alias("bus_type"))
    edges = line.where("in_service").select(*by, F.col("from_bus").alias("source"), F.col("to_bus").alias("target"))
    branches = routing.feeders(edges, typed, roots, trafo, by)
    consumers = bus.where(F.col("name").contains("Consumer Nodebus")).select(*by, F.col("bus").alias("node"))
    zones = load.join(bus.select(*by, "bus", "zone"), [*by, "bus"], "left")
    per = zones.groupBy(*by, F.col("bus").alias("node"), "zone").agg(F.count("name").alias("count"), F.sum("max_p_mw").alias("max_p_mw"))
    sims = upstream_simultaneity(tree, per, by).select(*by, "node", "sim_factor_cumulated")
    weights = load.groupBy(*by, F.col("bus").alias("node")).agg((F.sum("max_p_mw") * 1000 / config.peak_load_household).alias("path_weight"))
    vsw = impedance_metrics(path_impedance(into.join(sims, [*by, "node"], "left"), weights, by), by).drop("total_weight")
    out = n.join(power, by, "left").join(branches.select(*by, F.col("feeder_lines").alias("no_branches")), by, "left").join(metrics.cable_length(line, by), by, "left")
    out = out.join(trafo_distances(tree, consumers, by), by, "left").join(trafo.groupBy(*by).agg(F.min("sn_mva").alias("transformer_mva")), by, "left").join(vsw, by, "left")
    if {"x", "y"} <= set(bus.columns):
        from gridwright.operators.spatial import nearest

        p = bus.where("x is not null").select(*by, F.col("bus").alias("id"), "x", "y")
        out = out.join(metrics.median_neighbour_distance(nearest(p, p, 4, by, itself=False), by).withColumn("house_distance_km", F.col("house_distance") / 1000).drop("house_distance"), by, "left")
    share = lambda a, b: F.when(F.coalesce(F.col(b), F.lit(0)) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return (
        out.withColumn("no_household_equ", F.col("max_power_mw") * 1000 / config.peak_load_household)
        .withColumn("no_house_connections_per_branch", share("no_house_connections", "no_branches"))
        .withColumn("no_households_per_branch", share("no_household_equ", "no_branches"))
        .withColumn("cable_len_per_house", share("cable_length_km", "no_house_connections"))
        .withColumn("vsw_per_branch", share("resistance", "no_branches"))
    )


def comparison_metrics(tables: dict[str, DataFrame], by: list[str], consumers: DataFrame | None = None, least_buses: int = 5) -> DataFrame:
    """The seven parameters by which synthetic and measured grids are compared; grids with fewer buses than ``least_buses`` go."""
    bus, line, trafo = tables["bus"], tables["line"], tables["trafo"]
    kept = bus.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least_buses).select(*by)
    roots = routing.root_bus(bus, trafo, tables["ext_grid"], by).join(kept, by, "left_semi")
    if consumers is None:
        named = bus.where(F.col("name").contains("Consumer Nodebus")).select(*by, F.col("bus").alias("node"))
        loaded = tables["load"].select(*by, F.col("bus").alias("node")).distinct()
        consumers = named.unionByName(loaded.join(named.select(*by).distinct(), by, "left_anti"))
    tree, _ = rooted(line, bus, roots, by)
    edges = line.where("in_service").select(*by, F.col("from_bus").alias("source"), F.col("to_bus").alias("target"))
    n = routing.feeders(edges, bus.select(*by, "bus", bus_type(F.col("name"), "Consumer Nodebus|NS_HaAn").alias("bus_type")), roots, trafo, by, recursive=True)
    out = kept.join(n, by, "left").join(consumers.groupBy(*by).agg(F.count("*").alias("__c")), by, "left")
    d = trafo_distances(tree, consumers, by).withColumnsRenamed({"avg_trafo_dis": "avg_trafo_distance", "max_trafo_dis": "max_trafo_distance"})
    out = out.join(metrics.graph_length(line, by), by, "left").join(d, by, "left").join(trafo.groupBy(*by).agg(F.min("sn_mva").alias("transformer_mva")), by, "left").join(metrics.graph_resistance(line, by), by, "left")
    per = F.when(F.coalesce("feeder_lines", F.lit(0)) > 0, F.coalesce("__c", F.lit(0)) / F.col("feeder_lines")).otherwise(0.0)
    return out.withColumn("buildings_per_feeder", per).drop("__c").fillna(0.0, ["graph_length", "graph_resistance", "avg_trafo_distance", "max_trafo_distance"])


def grid_filters(grids: DataFrame, buildings: DataFrame, lower: dict[str, float], key: str, most_km: float = 2.5, most_households: int = 150) -> DataFrame:
    """``filtered``: too far from the transformer, a building with too many households, or below any lower bound; else false."""
    large = buildings.where(F.col("households_per_building") > most_households).select(key).distinct().withColumn("__large", F.lit(True))
    low = F.lit(False)
    for name, bound in lower.items():
        low = low | F.coalesce(F.col(name) < bound, F.lit(False))
    far = F.coalesce(F.col("max_trafo_dis") > most_km, F.lit(False))
    return grids.join(large, key, "left").withColumn("filtered", far | F.coalesce("__large", F.lit(False)) | low).drop("__large")


def consumer_buses(loads: DataFrame, buildings: DataFrame, buses: DataFrame, by: list[str]) -> DataFrame:
    """by, bus: the buses of measured grids that serve consumers.

    A grid with loads (by, bus) has them at their buses. In a grid without any, each building (by, id, x, y)
    belongs to the nearest bus (by, id, x, y; ties to the smaller id).
    """
    from gridwright.operators.spatial import nearest

    stated = loads.select(*by, "bus").distinct()
    rest = lambda df: df.join(stated.select(*by).distinct(), by, "left_anti")
    near = nearest(rest(buildings).select(*by, "id", "x", "y"), rest(buses).select(*by, "id", "x", "y"), 1, by)
    return stated.unionByName(near.select(*by, F.col("other").alias("bus")).distinct())
