"""Groups that share one graph: each part gets what its own points need of it, and the results of a graph for itself."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from gridwright.operators import clustering, hierarchy, routing


def a_tree(n):
    nodes = np.arange(1, n)
    return pd.DataFrame({"source": nodes, "target": (nodes - 1) // 2, "cost": 10.0 + (nodes * 37) % 90})


def test_few_points_of_a_large_graph_take_few_of_its_rows():
    e = a_tree(4000)
    points = np.arange(3, 4000, 40)
    node, hub, cost, level = hierarchy.contracted(*(e[c].to_numpy() for c in ("source", "target", "cost")))
    at = hierarchy.Upward(node, hub, level).rows(points)
    assert len(at) < len(node) / 2
    part = hierarchy.Sweeps(node[at], hub[at], cost[at], level[at], points)
    whole = hierarchy.Sweeps(node, hub, cost, level, points)
    want = whole.from_starts(points)[np.searchsorted(whole.ids, points)]
    assert np.array_equal(hierarchy.between(part, points, 500), want)
    assert np.array_equal(routing.distances(e, points), want)


@pytest.mark.parametrize("core", [20, hierarchy.CORE])
def test_parts_of_one_graph_are_clustered_as_with_a_graph_each(spark, core):
    e = spark.createDataFrame(a_tree(240).assign(g=1))
    b = spark.createDataFrame(pd.DataFrame([(1, i % 3, i, ("SFH", "Public", "MFH")[i % 5 % 3], 10.0 + i % 60, 1 + i % 4, 2) for i in range(243)], columns=["g", "part", "vid", "type", "kw", "homes", "settlement_type"]))
    each = e.join(b.select("g", "part").distinct(), "g")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    got = rows(clustering.greenfield_clusters(e, b, ["g", "part"], over=["g"], core=core))
    assert len(got) == 243
    assert got == rows(clustering.greenfield_clusters(each, b, ["g", "part"]))


def test_waves_walk_like_a_heap():
    rng = np.random.default_rng(5)
    for n, m, kinds in ((1, 0, 2), (6, 7, 3), (40, 60, 3), (300, 500, 2), (300, 299, 60)):
        s, t, c = rng.integers(0, n, m) * 3, rng.integers(0, n, m) * 3, rng.integers(1, kinds, m) / 7
        near = routing._adjacent(pd.DataFrame({"source": s, "target": t, "cost": c}))
        arcs = routing.Arcs(s, t, c, np.array([0, 6]))
        for start in (0, 6):
            got = {int(v): (float(d), int(b), int(h)) for v, d, b, h in zip(*arcs.walked(start), strict=True)}
            assert got == routing.shortest(near, start)


def test_feeders_of_a_large_tree_need_no_lists_of_neighbours():
    e = a_tree(30_000)
    tracemalloc.start()
    near = routing.Neighbours(e["source"].to_numpy(), e["target"].to_numpy())
    kinds = np.zeros(30_000, np.int8)
    assert routing.count_terminal_feeders(near, 0, kinds, set()) == 15_000
    assert routing.count_feeders(near, 0, lambda _: 0, set()) == 2
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * len(near.ids)
    assert near[1] == [0, 3, 4] and near[30_000] == [] and near.ends(0) == 2


def a_town(seed, n=70):
    """(edges, transformers, buildings of two parts) of a random network, with ties and what lies apart."""
    rng = np.random.default_rng(seed)
    m = n + 15
    e = pd.DataFrame({"g": 1, "source": rng.integers(0, n, m), "target": rng.integers(0, n, m), "cost": rng.choice([1.0, 2.0, 5.0, 90.0, 1 / 3], m) * rng.integers(1, 9, m)})
    t = pd.DataFrame({"g": 1, "vid": rng.choice(n + 2, 9, replace=False)})
    b = pd.DataFrame([(1, i % 2, i, ("SFH", "Public", "Commercial", "MFH", "Other")[i % 5], float(rng.choice([30.0, 90.0, 250.0])), int(rng.integers(1, 4)), 2) for i in range(n) for _ in range(1 + i % 9 // 8)], columns=["g", "part", "vid", "type", "kw", "homes", "settlement_type"])
    return e, t, b


@pytest.mark.parametrize("seed", range(4))
def test_transformers_are_filled_without_all_pairs(spark, seed):
    from pyspark.sql import functions as F

    from gridwright.config import DEFAULT

    e, t, b = a_town(seed)
    edges, trafos, buildings = (spark.createDataFrame(x) for x in (e, t, b))
    parts = buildings.select("g", "part").distinct()
    reached = routing.costs(edges.join(parts, "g"), trafos.join(parts, "g"), ["g", "part"], buildings, DEFAULT.brownfield_reach_m)
    pairs = reached.select("g", "part", F.col("end_vid").alias("start_vid"), F.col("start_vid").alias("end_vid"), "agg_cost")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(clustering.brownfield_clusters(pairs, buildings, ["g", "part"]))
    assert rows(clustering.brownfield_nearest(edges, trafos, buildings, ["g", "part"], over=["g"])) == want
    assert rows(clustering.brownfield_nearest(edges.join(parts, "g"), trafos.join(parts, "g"), buildings, ["g", "part"])) == want
    assert want and len(want) < b.groupby(["part", "vid"]).ngroups


def test_many_transformers_make_few_ways():
    n = 20_000
    e, ids = a_tree(n), np.arange(n)
    arcs = routing.Arcs(*(e[c].to_numpy() for c in ("source", "target", "cost")), ids)
    loads = clustering.Loads(ids.tolist(), pd.DataFrame({"vid": ids, "type": "Commercial", "kw": 20.0, "homes": 1}))
    filling = clustering.Filling(loads, ids.tolist(), [630])
    clustering.fill(arcs, ids[::7].tolist(), filling, 750.0)
    assert filling.placed == set(ids.tolist())
    near = arcs.within(np.array([n - 1]), 200.0)
    best = {v for v, (d, *_) in routing.shortest(arcs, n - 1, 200.0).items()}
    assert set(near.tolist()) == best and 1 < len(best) < 200


def test_grids_of_one_graph_are_planned_as_with_a_graph_each(spark):
    from pyspark.sql import functions as F

    from gridwright.operators import network

    e = spark.createDataFrame(a_tree(600).assign(g=1))
    b = spark.createDataFrame(pd.DataFrame([(1, v // 40 % 3, v // 120 % 2, v, (v - 1) // 2, ("SFH", "Commercial")[v % 2], 20.0, 1, 9.0) for v in range(60, 600)], columns=["g", "part", "bcid", "vid", "connection_point", "type", "kw", "homes", "sim"]))
    by = ["g", "part", "bcid"]
    grids = b.groupBy(*by).agg((F.min("vid") % 50).alias("ont_vid"))
    rows = lambda df: sorted((*tuple(r)[:6], r["kind"], round(r["metres"], 9), round(r["load_kw"], 9)) for r in df.where("kind <> 'unreached'").collect())
    got = rows(network.branch_tree(e, b, grids, by, over=["g"]))
    assert len(got) > 540 and got == rows(network.branch_tree(e.join(grids.select(*by), "g"), b, grids, by))
    arcs = routing.Arcs(*(a_tree(600)[c].to_numpy() for c in ("source", "target", "cost")), np.zeros(0, int))
    assert len(routing.shortest(arcs, 500, wanted={499, 250, 249})) < 60


@pytest.mark.parametrize("seed, loops, reach", [(s, k, r) for s in range(6) for k in (0, 0, 4) for r in (25.0, 90.0, 5000.0)])
def test_few_points_are_promising_and_the_best_is_one_of_them(seed, loops, reach):
    rng = np.random.default_rng(seed)
    n = 120
    s, t = np.arange(1, n), np.array([int(rng.integers(max(0, i - 9), i)) for i in range(1, n)])
    s, t = np.append(s, np.arange(2, 2 + loops) * 9), np.append(t, np.arange(2, 2 + loops) * 5)
    keep = np.unique(np.column_stack([np.minimum(s, t), np.maximum(s, t)]), axis=0)
    e = pd.DataFrame({"source": keep[:, 0], "target": keep[:, 1], "cost": rng.choice([1 / 3, 7.7, 20.0], len(keep))})
    points = np.unique(rng.integers(0, n, 80))
    kw = rng.integers(0, 30, len(points)).astype(float)
    arcs = routing.Arcs(*(e[c].to_numpy() for c in ("source", "target", "cost")), points)
    kept = clustering.promising(arcs, points, kw, reach)
    whole = routing.metres(np.floor(routing.distances(e, points))).astype(float)
    best = clustering.best_place(whole, kw, reach)[0]
    assert kept[best]
    assert loops or reach > 25 or kept.mean() < 0.5


def test_a_large_tree_leaves_few_starts():
    e, points = a_tree(30_000), np.arange(30_000)
    arcs = routing.Arcs(*(e[c].to_numpy() for c in ("source", "target", "cost")), points)
    assert 1 <= clustering.promising(arcs, points, 5.0 + points % 40, 400.0).sum() < 100
