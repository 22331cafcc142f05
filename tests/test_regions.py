import os

import pytest

from gridwright.plans.generate import demo_inputs, generate
from gridwright.plans.regions import postcodes, run_regions, runs
from gridwright.queries.registry import Views

FOLDER = os.environ.get("GRIDWRIGHT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_codes_become_postcodes(spark):
    register = spark.createDataFrame([(81, 1), (82, 1), (83, 2), (83, 1)], "plz int, ags int")
    assert postcodes(register, plz=[83, 81, 83]) == [81, 83] and postcodes(register, ags=[1]) == [81, 82, 83]
    with pytest.raises(ValueError, match=r"lacks ags \[7\]"):
        postcodes(register, ags=[1, 7])
    with pytest.raises(ValueError):
        postcodes(register)


def test_runs_go_on_around_postcodes_that_fail(spark, tmp_path):
    inputs, calls = demo_inputs(Views(spark, FOLDER)), []

    def build(buildings, *more):
        here = sorted(r[0] for r in buildings.select("plz").distinct().collect())
        calls.append(here)
        if 3 in here and calls.count([3]) < 9:
            raise RuntimeError("three is broken\nand more")
        return generate(buildings, *more)

    path = str(tmp_path / "out")
    assert runs(spark, path).count() == 0
    got = {r["plz"]: (r["state"], r["attempt"], r["error"]) for r in run_regions(inputs, [1, 2, 3], path, tries=2, build=build).collect()}
    assert got == {1: ("done", 1, None), 2: ("done", 1, None), 3: ("failed", 2, "three is broken")}
    grids = spark.read.parquet(f"{path}/grids")
    assert {r[0] for r in grids.select("plz").distinct().collect()} == {1, 2}
    lines = spark.read.parquet(f"{path}/line").count()
    calls.clear()
    got = {r["plz"]: r["state"] for r in run_regions(inputs, [1, 2, 3], path, build=generate).collect()}
    assert got == {1: "done", 2: "done", 3: "done"} and spark.read.parquet(f"{path}/line").count() > lines
    assert run_regions(inputs, [1, 2, 3], path, build=build).count() == 3 and not calls
