"""From buildings, ways and known transformers to sized grids: one job for all postcodes.

Every step works on all postcodes at once; grouped maps run per (plz, kcid) or (plz, kcid, bcid).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.checkpoints import cut
from gridwright.config import DEFAULT, Config
from gridwright.functions import electrical as E
from gridwright.functions import geometry as G
from gridwright.operators import clustering, network, routing, spatial
from gridwright.operators.components import JOINED, connected_components
from gridwright.operators.loads import allocate
from gridwright.sources.sinks import duplicates

AREA = ["plz", "kcid"]
#: The part of the network that a cluster lies in, and the cluster with it.
NET, PART = ["plz", "component"], ["plz", "component", "kcid"]
GRID = ["plz", "kcid", "bcid"]


def settlement_types(buildings: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """plz, settlement_type from mean households and the mean distance to four neighbours."""
    p = buildings.select(F.col("osm_id").alias("id"), "x", "y", "plz")
    near = spatial.nearest(p, p, 4, ["plz"], itself=False).groupBy("plz").agg(F.avg("dist").alias("house_distance"))
    homes = buildings.groupBy("plz").agg(F.avg("homes").alias("avg_households"))
    return homes.join(near, "plz", "left").withColumn("settlement_type", F.coalesce(E.settlement_type(E.settlement_score(F.col("avg_households"), F.col("house_distance"), config)), F.lit(1)))


def with_loads(buildings: DataFrame, categories: DataFrame) -> DataFrame:
    """homes, kw and sim_factor; buildings without load and those too large are left out."""
    b = buildings.join(F.broadcast(categories.select(F.col("definition").alias("type"), "peak_load", "peak_load_per_m2", "sim_factor")), "type", "left")
    b = b.withColumn("homes", E.households(F.col("type"), F.col("area"), F.col("floors"), F.col("households_per_building")))
    b = b.withColumn("kw", E.peak_load(F.col("type"), F.col("area"), F.col("homes"), F.col("peak_load"), F.col("peak_load_per_m2")))
    return b.withColumn("kw", E.without_too_large(F.col("type"), F.col("kw"))).where("kw > 0").drop("peak_load", "peak_load_per_m2")


class Plan(Mapping):
    """The tables of all grids by name, each built when it is first asked for; ``by`` is the grid's key.

    grids, line, load, bus, trafo, ext_grid, flow, unreached (vertices without a way to their transformer) and left_out (buildings with
    a load that are in no grid: unreached ones, and those alone in what is left of their part of the network).
    """

    by = GRID
    names = ("by", "grids", "bus", "line", "load", "trafo", "ext_grid", "flow", "unreached", "left_out")

    def __init__(self, buildings: DataFrame, ways: DataFrame, transformers: DataFrame, categories: DataFrame, config: Config = DEFAULT):
        self.inputs, self.config = (buildings, ways, transformers, categories), config

    def __getitem__(self, name: str):
        if name not in self.names:
            raise KeyError(name)
        return getattr(self, name)

    def __iter__(self):
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)

    @cached_property
    def _buildings(self) -> DataFrame:
        return cut(with_loads(self.inputs[0], self.inputs[3]))

    @cached_property
    def _types(self) -> DataFrame:
        return cut(settlement_types(self._buildings, self.config).select("plz", "settlement_type"))

    @cached_property
    def _network(self) -> tuple[DataFrame, DataFrame]:
        """(vertices, edges): the ways and a connection line from each building and transformer to its nearest way."""
        _, ways, transformers, _ = self.inputs
        places = self._buildings.select(F.concat(F.lit("b"), F.col("osm_id").cast("string")).alias("id"), "x", "y").unionByName(transformers.select(F.concat(F.lit("t"), F.col("osm_id").cast("string")).alias("id"), "x", "y"))
        net = cut(spatial.connect(places, ways.select("way_id", "clazz", "line")))
        vertices, edges = routing.topology(net)
        return vertices, cut(edges.select("source", "target", "cost", "clazz").where("source <> target"))

    def _at(self, df: DataFrame) -> DataFrame:
        return spatial.snap_join(df, self._network[0].select(F.col("id").alias("vid"), "x", "y"))

    @cached_property
    def _clusters(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(house, with its postcode's cluster (kcid): a component of the network, or a part of it; edges and known transformers of each component)."""
        edges = self._network[1]
        hook = edges.where("clazz = 110").select(F.col("source").alias("vid"), F.col("target").alias("connection_point")).union(edges.where("clazz = 110").select("target", "source"))
        first = F.row_number().over(Window.partitionBy("osm_id").orderBy("connection_point"))
        house = cut(self._at(self._buildings).join(hook, "vid").withColumn("__at", first).where("__at = 1").drop("__at"))
        comp = cut(connected_components(edges, "source", "target", joined=JOINED))
        rows = house.join(comp.withColumnRenamed("node", "vid"), "vid").select("plz", "component", "vid", "x", "y")
        kcid = cut(clustering.components_to_clusters(rows, ["plz"], self.config).select("plz", "vid", "component", "kcid"))
        house = cut(house.join(kcid.select("plz", "vid", "component", "kcid").distinct(), ["plz", "vid"]).join(self._types, "plz"))
        groups = kcid.select(*NET).distinct()
        e = cut(edges.join(comp.withColumnRenamed("node", "source"), "source").join(groups, "component").select(*NET, "source", "target", "cost"))
        trafo = self._at(self.inputs[2].select("osm_id", "plz", "x", "y", "transformer_rated_power"))
        known = cut(trafo.join(comp.withColumnRenamed("node", "vid"), "vid").join(groups, NET).select(*NET, "vid", "transformer_rated_power"))
        return house, e, known

    @cached_property
    def _members(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(member: plz, vid, kcid, bcid; brown; green): existing transformers take what they can (bcid < 0), the rest is clustered anew (bcid > 0)."""
        house, e, known = self._clusters
        stock = house.select(*PART, "vid", "type", "kw", "homes", "settlement_type")
        brown = cut(clustering.brownfield_nearest(e, known, stock, PART, self.config, NET).drop("component"))
        left = house.join(brown.select(*AREA, "vid"), [*AREA, "vid"], "left_anti")
        left = cut(left.withColumn("__n", F.count("*").over(Window.partitionBy(*AREA))).where("__n > 1").drop("__n"))
        by_point = left.select(*PART, F.col("connection_point").alias("vid"), "type", "kw", "homes", "settlement_type")
        green = cut(clustering.greenfield_clusters(e.join(left.select(*NET).distinct(), NET, "left_semi"), by_point, PART, self.config, NET).drop("component"))
        new = left.select(*AREA, "vid", "connection_point").distinct().join(green.select(*AREA, F.col("vid").alias("connection_point"), "bcid"), [*AREA, "connection_point"])
        return cut(brown.select(*AREA, "vid", "bcid").unionByName(new.select(*AREA, "vid", "bcid"))), brown, green

    @cached_property
    def grids(self) -> DataFrame:
        """Places and ratings of the transformers."""
        (_, brown, green), known = self._members, self._clusters[2]
        new = green.groupBy(*GRID).agg(F.first("rated").alias("rated"), F.first("ont_vid").alias("ont_vid")).join(self._types, "plz")
        sizes = F.element_at(F.create_map(*[x for k, s in self.config.capacities.items() for x in (F.lit(k), F.array(*map(F.lit, s)))]), F.col("settlement_type"))
        new = new.withColumn("rated", E.grouped_rating(F.col("rated"), sizes).cast("double")).drop("settlement_type")
        old = brown.groupBy(*GRID).agg(F.first("trafo").alias("ont_vid"), F.first("rated").alias("rated"))
        old = old.join(known.select("plz", F.col("vid").alias("ont_vid"), F.col("transformer_rated_power").cast("double").alias("given")).dropDuplicates(["plz", "ont_vid"]), ["plz", "ont_vid"], "left").withColumn("rated", F.greatest("rated", F.coalesce("given", F.lit(0.0)))).drop("given")
        return cut(old.select(*GRID, "ont_vid", "rated").unionByName(new.select(*GRID, "ont_vid", "rated")))

    @cached_property
    def _served(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(full: houses in grids, loads of their vertices, tree of cables)."""
        house, e, _ = self._clusters
        full = cut(house.join(self._members[0], [*AREA, "vid"]).join(self.grids.select(*GRID), GRID, "left_semi"))
        loads = cut(allocate(full.withColumn("vertice_id", F.col("vid")), GRID))
        served = full.join(loads.select(*GRID, F.col("vertice_id").alias("vid"), "sim"), [*GRID, "vid"])
        grids = self.grids.join(house.select(*PART).distinct(), AREA)
        by = [*PART, "bcid"]
        tree = cut(network.branch_tree(e, served.select(*by, "vid", "connection_point", "type", "kw", "homes", "sim"), grids, by, self.config, NET).drop("component"))
        return full, loads, tree

    @property
    def unreached(self) -> DataFrame:
        return self._served[2].where("kind = 'unreached'").select(*GRID, F.col("node").alias("vertice_id"))

    @property
    def _loads(self) -> DataFrame:
        return self._served[1].join(self.unreached, [*GRID, "vertice_id"], "left_anti")

    @cached_property
    def line(self) -> DataFrame:
        return cut(network.sized_lines(self._served[2], self.grids, GRID, self.config))

    @property
    def load(self) -> DataFrame:
        return network.load_table(self._loads, GRID, self.config)

    @property
    def trafo(self) -> DataFrame:
        return network.trafos(self.grids, GRID)

    @property
    def ext_grid(self) -> DataFrame:
        return network.ext_grids(self.grids, GRID)

    @cached_property
    def bus(self) -> DataFrame:
        """Buses with their places; a number that two buses of a grid share is an error."""
        bus = network.buses(self.line, self._loads, self.grids, GRID, self.config)
        spots = self._network[0].select(F.col("id").alias("__v"), "x", "y")
        fixed = F.col("bus").isin(network.LV_BUS, network.MV_BUS)
        place = F.when(fixed, F.col("ont_vid")).when(F.col("bus") < 0, -2 - F.col("bus")).otherwise(F.col("bus"))
        bus = bus.join(self.grids.select(*GRID, "ont_vid"), GRID).withColumn("__v", place).join(spots, "__v", "left")
        bus = cut(bus.withColumn("y", F.when(F.col("bus") == network.MV_BUS, F.col("y") + 1.5e-4).otherwise(F.col("y"))).drop("__v", "ont_vid"))
        if twice := duplicates(bus, [*GRID, "bus"]).head(3):
            raise ValueError(f"buses with one number: {twice}")
        return bus

    @cached_property
    def left_out(self) -> DataFrame:
        full, lost = self._served[0], self.unreached.withColumnRenamed("vertice_id", "vid")
        served = full.join(lost, [*GRID, "vid"], "left_anti").select("osm_id")
        far = full.join(lost, [*GRID, "vid"], "left_semi").select("osm_id", F.lit(True).alias("__far"))
        reason = F.when(F.col("__far"), "unreached").otherwise("alone").alias("reason")
        return cut(self._buildings.select("plz", "osm_id").join(served, "osm_id", "left_anti").join(far, "osm_id", "left").select("plz", "osm_id", reason))

    @cached_property
    def flow(self) -> DataFrame:
        return cut(network.power_flow(self.line, self.load, self.grids.select(*GRID, F.lit(network.LV_BUS).cast("long").alias("vid")), GRID, self.config))


def generate(buildings: DataFrame, ways: DataFrame, transformers: DataFrame, categories: DataFrame, config: Config = DEFAULT) -> Plan:
    """The plan of all grids; nothing runs before one of its tables is asked for.

    buildings: osm_id, plz, x, y, type, area, floors, households_per_building; ways: plz, way_id, clazz,
    line; transformers: osm_id, plz, x, y, transformer_rated_power.
    """
    return Plan(buildings, ways, transformers, categories, config)


def demo_inputs(v) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Towns from the adapter tables: every postcode as a block of streets, all buildings and transformers moved close to them."""
    from gridwright import config

    b = v.x_buildings.selectExpr("osm_id", "plz", "plz * 5000.0D + pmod(x, 1200) AS x", "pmod(y, 900) + 0.5D AS y", "type", "area", "floors", "households_per_building")
    towns = v.x_buildings.select("plz").union(v.x_transformers.select("plz")).distinct()
    street = towns.crossJoin(v.spark.range(10)).selectExpr("CAST(plz AS INT) AS plz", "id", "plz * 5000.0D AS x0", "id * 100.0D AS y0", "id * 100.0D + IF(id < 9, 100, 50) AS y1")
    corner = G.point(F.col("x0") + 1200, F.col("y0"))  # where a street meets the road along all streets
    along, up = F.array(G.point(F.col("x0"), F.col("y0")), corner), F.array(corner, G.point(F.col("x0") + 1200, F.col("y1")))
    ways = street.select("plz", F.posexplode(F.array(along, up)).alias("k", "line"), "id").selectExpr("plz", "plz * 100 + k * 50 + id + 1 AS way_id", "41 AS clazz", "line")
    t = v.x_transformers.selectExpr("osm_id", "plz", "plz * 5000.0D + pmod(x, 1200) + 0.25D AS x", "pmod(y, 900) + 0.75D AS y", "transformer_rated_power")
    return b, ways, t, config.categories(v.spark)
