import os

import pytest
from pyspark.sql import functions as F

FOLDER = os.environ.get("GRIDWRIGHT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def plan(spark):
    from gridwright.plans.generate import demo_inputs, generate
    from gridwright.queries.registry import Views

    return generate(*demo_inputs(Views(spark, FOLDER)))


def test_grids_have_one_transformer_each(plan):
    by = plan["by"]
    assert plan["grids"].count() > 0
    assert plan["grids"].groupBy(*by).count().where("count > 1").count() == 0


def test_every_load_hangs_on_a_line(plan):
    by = plan["by"]
    assert plan["load"].join(plan["line"].withColumnRenamed("to_bus", "bus"), [*by, "bus"], "left_anti").count() == 0


def test_cables_carry_their_current(plan):
    bad = plan["line"].where(F.col("load_kw") / (400 * 0.9 * 3**0.5) > F.col("max_i_ka") * F.col("parallel") + 1e-9)
    assert bad.count() == 0


def test_flow_converges_and_falls_along_the_feeders(plan):
    flow = plan["flow"]
    assert flow.where("not converged").count() == 0
    assert flow.agg(F.max("vm_pu")).first()[0] == pytest.approx(1.0)


def test_inputs_hold_all_rows_and_postcodes(spark, plan):
    from gridwright.plans.generate import demo_inputs
    from gridwright.queries.registry import Views

    v = Views(spark, FOLDER)
    buildings, ways, transformers, _ = demo_inputs(v)
    ids = lambda df, c="osm_id": sorted(r[0] for r in df.select(c).collect())
    assert ids(buildings) == ids(v.x_buildings) and ids(transformers) == ids(v.x_transformers)
    towns = {r[0] for r in v.x_buildings.select("plz").collect()} | {r[0] for r in v.x_transformers.select("plz").collect()}
    assert {r[0] for r in ways.select("plz").collect()} == towns
    assert any(r[0] >= 4 for r in plan["grids"].select("plz").collect())


def test_bus_numbers_differ(spark):
    from gridwright.operators import network

    vertices = range(0, 300)
    grids = spark.createDataFrame([(1, 0, 400.0)], "g int, ont_vid long, rated double")
    loads = spark.createDataFrame([(1, v, "house") for v in vertices], "g int, vertice_id long, load_type string")
    lines = spark.createDataFrame([(1, "feeder", v) for v in vertices], "g int, kind string, to_bus long")
    bus = network.buses(lines, loads, grids, ["g"])
    assert bus.count() == 602 == bus.select("bus").distinct().count()
    assert network.trafos(grids, ["g"]).join(bus.select(F.col("bus").alias("hv_bus")), "hv_bus").count() == 1


def test_tables_are_built_when_asked_for(spark):
    from gridwright.plans.generate import demo_inputs, generate
    from gridwright.queries.registry import Views

    plan = generate(*demo_inputs(Views(spark, FOLDER)))
    assert set(plan) == set(plan.names) and len(plan) == len(plan.names)
    assert plan["grids"].count() > 0
    assert not {"_served", "line", "bus", "flow", "left_out"} & set(vars(plan))
    with pytest.raises(KeyError):
        plan["nothing"]


LARGER = os.path.join(os.path.dirname(FOLDER), "sf0.01")


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
def test_larger_tables_give_whole_grids(spark, monkeypatch):
    from gridwright.operators import network
    from gridwright.plans.generate import demo_inputs, generate
    from gridwright.queries import QUERIES, sizing
    from gridwright.queries.registry import Views

    plan = generate(*demo_inputs(Views(spark, LARGER)))
    monkeypatch.setattr(sizing, "_plan", lambda _: plan)
    by, bus = plan["by"], plan["bus"]
    assert bus.count() == bus.select(*by, "bus").distinct().count()
    assert bus.where(F.col("bus") == network.MV_BUS).count() == plan["grids"].count()
    assert bus.where("bus = -100").count() > 0  # a house, and no other bus
    assert QUERIES["clustering_metrics"](spark, LARGER).count() == plan["grids"].count()
    layers = QUERIES["gis_layers"](spark, LARGER).where("from_x is not null")
    assert layers.count() == plan["line"].count()


def test_buildings_at_one_place_count_once_each(spark):
    from gridwright import config
    from gridwright.functions import geometry as G
    from gridwright.plans.generate import generate

    places = [(1, 10.0, 5.0), (2, 10.0, 5.0), (3, 10.0, 5.0), (4, 60.0, 5.0), (5, 2010.0, 5.0), (6, 2010.0, 5.0), (7, 2050.0, 5.0)]
    b = spark.createDataFrame([(i, 1, x, y, "SFH", 90.0, 1, 1) for i, x, y in places], "osm_id long, plz int, x double, y double, type string, area double, floors int, households_per_building int")
    ways = spark.range(1).select(F.lit(1).alias("plz"), F.lit(1).cast("long").alias("way_id"), F.lit(41).alias("clazz"), F.array(G.point(F.lit(0.0), F.lit(0.0)), G.point(F.lit(2100.0), F.lit(0.0))).alias("line"))
    t = spark.createDataFrame([(1, 1, 30.0, 3.0, 250)], "osm_id long, plz int, x double, y double, transformer_rated_power int")
    plan = generate(b, ways, t, config.categories(spark))
    full, loads, _ = plan._served
    assert sorted(r["osm_id"] for r in full.collect()) == [1, 2, 3, 4, 5, 6, 7]  # the last three are clustered anew
    assert loads.agg(F.sum("installed_kw")).first()[0] == pytest.approx(7 * 17.425)
