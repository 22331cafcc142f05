import math

import pytest
from pyspark.sql import functions as F

from gridwright import config
from gridwright.functions import electrical as E
from gridwright.functions import geometry as G
from gridwright.functions import text as T
from gridwright.operators import cables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("p", "n", "expected"), [(69.7, 4, 27.796684), (0.0, 4, 0.0), (5.0, 0, 0.0), (None, 3, 0.0), (5.0, None, 0.0)])
def test_simultaneous_load(spark, p, n, expected):
    got = value(spark, E.simultaneous_load(F.lit(p).cast("double"), F.lit(n).cast("int"), F.lit(0.07)))
    assert got == pytest.approx(expected, abs=1e-5)


@pytest.mark.parametrize(
    ("kind", "area", "floors", "given", "expected"),
    [("SFH", 159.0, 1, None, 1), ("SFH", 160.0, 1, None, 2), ("TH", 500.0, 2, None, 1), ("MFH", 260.0, 3, None, 15), ("Barn", 90.0, 1, None, 0), ("SFH", 300.0, 1, 7, 7)],
)
def test_households(spark, kind, area, floors, given, expected):
    assert value(spark, E.households(F.lit(kind), F.lit(area), F.lit(floors), F.lit(given).cast("int"))) == expected


def test_peak_load(spark):
    assert value(spark, E.peak_load(F.lit("Commercial"), F.lit(500.0), F.lit(1), F.lit(None).cast("double"), F.lit(79.0))) == pytest.approx(39.5)
    assert value(spark, E.peak_load(F.lit("Industrial"), F.lit(500.0), F.lit(1), F.lit(None).cast("double"), F.lit(None).cast("double"))) == 0


@pytest.mark.parametrize(("score", "expected"), [(0.0, 1), (1 / 3, 2), (0.5, 2), (2 / 3, 3), (1.0, 3)])
def test_settlement_boundaries(spark, score, expected):
    assert value(spark, E.settlement_type(F.lit(score))) == expected


def test_settlement_score(spark):
    assert value(spark, E.settlement_score(F.lit(2.25), F.lit(37.5))) == pytest.approx(0.5)


@pytest.mark.parametrize(("rated", "name", "unit", "parallel"), [(400, "single 400 kva transformer", 400, 1), (800, "double 400.0 transformer", 400, 2), (1890, "3-fold 630 transformer", 630, 3), (315, "1-fold 630 transformer", 630, 1)])
def test_transformer_build(spark, rated, name, unit, parallel):
    a, b, c = E.transformer_build(F.lit(rated))
    row = spark.range(1).select(a.alias("a"), b.alias("b"), c.alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (name, unit, parallel)


@pytest.mark.parametrize(("given", "expected"), [("NAYY 4x120 SE", "NAYY_4_120"), ("NAYY_4_150", "NAYY_4_150"), (" NYY 4x35 ", "NYY_4_35")])
def test_cable_name(spark, given, expected):
    assert value(spark, T.cable_name(F.lit(given))) == expected


@pytest.mark.parametrize(("amps", "expected"), [(300, ("NAYY_4_185", 1)), (400, ("NAYY_4_120", 2))])
def test_feeder_cable_by_current(spark, amps, expected):
    kw = amps / 1000 * 400 * 0.9 * math.sqrt(3)
    name, n = cables.feeder_cable(F.lit(kw), F.lit(0.0))
    row = spark.range(1).select(name.alias("name"), n.alias("n")).first()
    assert tuple(row) == expected


def test_way_class_and_codes(spark):
    assert value(spark, T.way_class(F.lit(" Radweg "))) == 81
    assert value(spark, T.way_class(F.lit("Pfad"))) == 99
    assert value(spark, T.substation(F.lit("70411"))) == "041"
    assert value(spark, T.substation(F.lit("5041"))) is None


def test_projection_round_trip(spark):
    x, y = G.to_3035(F.lit(11.6), F.lit(48.1))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert row["x"] == pytest.approx(4440000, abs=3000)
    lon, lat = G.from_3035(F.lit(row["x"]), F.lit(row["y"]))
    back = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert tuple(back) == pytest.approx((11.6, 48.1), abs=1e-8)


def test_projection_centre(spark):
    x, y = G.to_3035(F.lit(10.0), F.lit(52.0))
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx((4321000.0, 3210000.0))


def test_config_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("PEAK_LOAD_HOUSEHOLD: 14.5\nV_BAND: x\nSMALL_LOAD_KW: 90\n")
    c = config.load(str(tmp_path / "c.yaml"))
    assert (c.peak_load_household, c.small_load_kw, c.nominal_v) == (14.5, 90.0, 400.0)
