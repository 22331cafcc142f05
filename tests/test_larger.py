"""Cases that only larger tables hold: touching ways, large components, crowded places."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.functions import geometry as G
from gridwright.operators import clustering, network, spatial
from gridwright.operators.groups import spread_join

from test_graphs import reach


def test_a_way_that_touches_a_point_is_no_candidate_with_its_other_pieces(spark):
    corner = F.array(G.point(F.lit(0), F.lit(0)), G.point(F.lit(6000), F.lit(0)), G.point(F.lit(6000), F.lit(8000)))
    road = spark.range(1).select(F.lit(1).cast("long").alias("way_id"), F.lit(41).alias("clazz"), corner.alias("line"))
    points = spark.createDataFrame([(1, 6000.0, 1298.0), (2, 5000.0, 300.0)], "id long, x double, y double")
    got = spatial.nearest_way(points, spatial.segments(road), 2000.0, 0.1).select("id", "dist", "m").collect()
    assert [tuple(r) for r in got] == [(2, 300.0, 5000.0)]


def test_components_become_clusters_of_any_size(spark):
    n = 6000
    rows = spark.range(n + 5).selectExpr("CAST(1 AS INT) AS plz", f"IF(id < {n}, 7L, IF(id < {n + 2}, 3L, IF(id < {n + 3}, 5L, 9L))) AS component", "id AS vid")
    got = clustering.component_clusters(rows, ["plz"]).groupBy("component", "kcid").count().collect()
    assert sorted(map(tuple, got)) == [(3, 1, 2), (7, 2, n), (9, 3, 2)]


def test_newton_holds_no_matrix_of_all_buses():
    n = 20_000
    r = np.arange(1, n)
    ties = r[r % 3 == 0]
    ends = np.concatenate([np.column_stack([(r - 1) // 2, r]), np.column_stack([ties, ties - 1])])
    ohm = np.full(len(ends), 0.002 + 0.001j)
    demand = np.where(np.arange(n) > 0, 1e-6 + 3e-7j, 0)
    tracemalloc.start()
    v, good = network.newton(ends, ohm, demand, 0.4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    power = (v[ends[:, 0]] - v[ends[:, 1]]) / ohm
    drawn = np.zeros(n, complex)
    np.add.at(drawn, ends[:, 1], power), np.subtract.at(drawn, ends[:, 0], power)
    assert good and np.abs(v * drawn.conj() - demand)[1:].max() < 1e-9
    assert most < 200 << 20  # a dense one has 6.4 GB


def _crowds(seed):
    """Scattered points, two crowds that are just too far apart to touch, one pair that touches by a single step, and one without a place."""
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.uniform(-900, 900, (150, 2)), rng.uniform(0, 20, (60, 2)) + [2000, 0], rng.uniform(0, 20, (60, 2)) + [2000, 121], rng.uniform(0, 1, (20, 2)) + [3000, 0], [[3100.0, 0.0]]])
    return [(int(i), float(x), float(y)) for i, (x, y) in zip(rng.permutation(len(xy)), xy, strict=True)] + [(5000, None, 1.0)]


@pytest.mark.parametrize("seed", range(3))
def test_close_and_touching_points_match_brute_force(spark, seed):
    rows = _crowds(seed)
    points = spark.createDataFrame(rows, "id long, x double, y double")
    near = lambda a, b, r: a[1] is not None and b[1] is not None and np.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) <= r
    kept = {a[0] for a in rows if not any(b[0] > a[0] and near(a, b, np.nextafter(150, 0)) for b in rows)}
    assert {r["id"] for r in spatial.drop_close(points, 150.0).collect()} == kept
    label = reach([(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b, 120)] + [(a[0], a[0]) for a in rows])
    assert {tuple(r) for r in spatial.touching(points, 120.0).collect()} == {x for x in label.items() if x[0] != 5000}
    marked = {label[i] for i in label if i % 50 == 0}
    got = {r["id"]: r["reached"] for r in spatial.spread_within(points, 120.0, F.col("id") % 50 == 0).collect()}
    assert got == {i: c in marked for i, c in label.items()}


def test_crowded_places_make_no_pairs_of_all(spark):
    n = 40_000  # within a radius of each other: 1,600,000,000 pairs
    points = spark.range(n).selectExpr("id", "CAST(id % 200 AS DOUBLE) / 10 AS x", "CAST(id DIV 200 AS DOUBLE) / 10 AS y")
    assert [r["id"] for r in spatial.drop_close(points, 150.0).collect()] == [n - 1]
    assert spatial.touching(points, 120.0).groupBy("component").count().collect() == [(0, n)]
    assert spatial.nearest_within(points, points, 600.0).where("id = other and dist = 0").count() == n


def test_a_key_with_all_pairs_is_dealt_to_many_tasks(spark):
    many = spark.range(4000).selectExpr("id", "IF(id < 3990, 1, CAST(NULL AS INT)) AS k")
    few = spark.range(100).selectExpr("id AS other", "1 AS k")
    out = spread_join(many, few, ["k"], "left")
    assert out.groupBy(F.col("other").isNull()).count().orderBy("count").collect() == [(True, 10), (False, 399_000)]
    tasks = out.where("k = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 2 and max(r["count"] for r in tasks) < 200_000
