import os
import random

import pytest
from pyspark.sql import functions as F

from gridwright.operators.refresh import Store, Totals, refresh_joined, refresh_totals

ROWS = "k long, name string, v int, x double"


def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def key(r):
    return tuple((v is None, v if v is not None else 0) for v in r)


@pytest.fixture
def state():
    rng = random.Random(6)
    rows = [(rng.randrange(60), rng.choice("ab"), rng.choice([None, rng.randrange(9)]), float(rng.randrange(50))) for _ in range(900)]
    return rng, rows + [(None, "a", 4, 1.0), (None, "b", None, 2.0), (777, "a", 1, 5.0)]


def test_refreshed_totals_equal_the_full_build(spark, tmp_path, state):
    rng, rows = state
    base = Store(spark, str(tmp_path / "base"), ["k", "name"], 16).write(spark.createDataFrame(rows, ROWS))
    totals = Totals(("k", "name"), ("v", "x"), ("v", "x"))
    derived = Store(spark, str(tmp_path / "sums"), ["k", "name"], 16).write(totals.of(base.read()))
    for step in range(4):
        out = rng.sample(rows, 12) if step else [r for r in rows if r[0] in (777, None, 5)]
        new = [(rng.choice([3, 900 + step, None]), rng.choice("ab"), rng.randrange(-3, 20), float(rng.randrange(99))) for _ in range(8)]
        for r in out:
            rows.remove(r)
        rows += new
        before = files_of(tmp_path / "sums"), files_of(tmp_path / "base")
        changes = spark.createDataFrame([(*r, -1) for r in out] + [(*r, 1) for r in new], ROWS + ", sign int")
        touched = refresh_totals(derived, totals, base, changes)
        assert 0 < len(touched) <= 16
        want = totals.of(spark.createDataFrame(rows, ROWS)).collect()
        got = derived.read().collect()
        assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
        assert sorted(map(tuple, base.read().collect()), key=key) == sorted(rows, key=key)
        for old, now in zip(before, (files_of(tmp_path / "sums"), files_of(tmp_path / "base")), strict=True):
            alone = {f: t for f, t in old.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
            assert alone.items() <= now.items()
    assert refresh_totals(derived, totals, base, spark.createDataFrame([], ROWS + ", sign int")) == []


def test_only_touched_folders_are_read(spark, tmp_path, state):
    base = Store(spark, str(tmp_path / "base"), ["k", "name"], 16).write(spark.createDataFrame(state[1], ROWS))
    plan = base.read([3, 7])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    got = base.read([3, 7]).withColumn("b", base.bucket()).select("b").distinct().collect()
    assert {r[0] for r in got} <= {3, 7}


def test_refreshed_view_equals_the_join(spark, tmp_path, state):
    rng, rows = state
    grids = [(k, f"g{k}", k % 3) for k in range(0, 60, 2)]
    shape = "k long, grid string, size int"
    of = lambda r, g: spark.createDataFrame(r, ROWS).join(spark.createDataFrame(g, shape), "k")
    left, right = Store(spark, str(tmp_path / "rows"), ["k"], 8).write(spark.createDataFrame(rows, ROWS)), Store(spark, str(tmp_path / "grids"), ["k"], 8).write(spark.createDataFrame(grids, shape))
    view = Store(spark, str(tmp_path / "view"), ["k"], 8).write(of(rows, grids))
    for _ in range(3):
        out, new = rng.sample(rows, 6), [(rng.choice([4, 5, 6]), "n", 1, 2.0) for _ in range(3)]
        lost, found = rng.sample(grids, 2), [(5, f"new{rng.random()}", 9)]
        for r in out:
            rows.remove(r)
        gone = {g[0]: g for g in [*lost, *(g for g in grids if g[0] == 5)]}.values()
        grids = [g for g in grids if g not in gone]
        rows += new
        grids += found
        refresh_joined(view, left, right, spark.createDataFrame([(*r, -1) for r in out] + [(*r, 1) for r in new], ROWS + ", sign int"), spark.createDataFrame([(*g, -1) for g in gone] + [(*g, 1) for g in found], shape + ", sign int"))
        assert sorted(map(tuple, view.read().collect()), key=key) == sorted(map(tuple, of(rows, grids).collect()), key=key)


def test_a_view_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], ROWS)
    store = Store(spark, str(tmp_path / "t"), ["k"], 4).write(none)
    totals = Totals(("k",), ("x",), ())
    derived = Store(spark, str(tmp_path / "d"), ["k"], 4).write(totals.of(none))
    refresh_totals(derived, totals, store, spark.createDataFrame([(1, "a", 2, 3.0, 1), (2, "a", 2, 3.0, 1)], ROWS + ", sign int"))
    assert sorted(map(tuple, derived.read().collect())) == [(1, 1, 3.0), (2, 1, 3.0)]
    refresh_totals(derived, totals, store, spark.createDataFrame([(1, "a", 2, 3.0, -1)], ROWS + ", sign int"))
    assert sorted(map(tuple, derived.read().collect())) == [(2, 1, 3.0)]
    assert derived.read().where(F.col("k") == 1).isEmpty()
