import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridwright.functions import geometry as G
from gridwright.operators import clustering, grid_metrics, network, routing, spatial
from gridwright.operators.components import connected_components


def reach(edges):
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("seed", range(3))
def test_components_match_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == reach(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    got = connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")).collect()
    assert [tuple(r) for r in got] == [(1, 1)]


def test_shortest_paths_and_matrix(spark):
    edges = spark.createDataFrame([(0, 1, 2, 1.5), (0, 2, 3, 2.0), (0, 1, 3, 9.0), (1, 5, 6, 4.0)], "g int, source long, target long, cost double")
    points = spark.createDataFrame([(0, 1), (0, 3), (1, 5)], "g int, vid long")
    got = {(r["g"], r["start_vid"], r["end_vid"]): (r["agg_cost"], r["hops"]) for r in routing.costs(edges, points, ["g"], points).collect()}
    assert got[(0, 1, 3)] == (3.5, 2)
    assert got[(0, 3, 1)] == (3.5, 2)
    assert got[(1, 5, 5)] == (0.0, 0)
    path = routing.paths(edges, points.where("vid = 1"), points.where("vid = 3"), ["g"]).first()
    assert path["path"] == [1, 2, 3]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.floats(0.5, 9)), max_size=20))
def test_costs_keep_the_triangle_inequality(edges):
    adjacent = {}
    for a, b, c in edges:
        adjacent.setdefault(a, []).append((b, c))
        adjacent.setdefault(b, []).append((a, c))
    d = {n: routing.shortest(adjacent, n) for n in range(9)}
    for a in d:
        for b in d[a]:
            for c in d[b]:
                assert d[a][c][0] <= d[a][b][0] + d[b][c][0] + 1e-9


def test_subtree_sums(spark):
    parents = spark.createDataFrame([(0, 0, None), (0, 1, 0), (0, 2, 1)], "g int, node long, parent long")
    loads = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0)], "g int, node long, load double")
    sums = routing.subtree_sums(parents, loads, ["g"], ["load"])
    assert {r["node"]: r["load"] for r in sums.collect()} == {0: 6.0, 1: 5.0, 2: 3.0}


def test_feeders_of_a_star_and_a_cabinet(spark):
    def count(edges, kinds, recursive=False):
        e = spark.createDataFrame([(0, a, b) for a, b in edges], "g int, source long, target long")
        b = spark.createDataFrame([(0, n, k) for n, k in kinds.items()], "g int, bus long, bus_type string")
        t = spark.createDataFrame([], "g int, hv_bus long, lv_bus long")
        return routing.feeders(e, b, spark.createDataFrame([(0, 0)], "g int, vid long"), t, ["g"], recursive).first()["feeder_lines"]

    house = "house_connection"
    assert count([(0, 1), (0, 2), (0, 3)], {0: "backbone", 1: house, 2: house, 3: house}) == 1
    assert count([(0, 1), (0, 2), (0, 3), (3, 4)], {0: "backbone", 1: house, 2: "backbone", 3: "backbone", 4: house}) == 2
    assert count([(0, 1), (0, 2), (2, 3), (2, 4), (3, 5)], {0: "backbone", 1: "backbone", 2: "kvs", 3: "backbone", 4: "backbone", 5: house}) == 3
    assert count([(0, 1), (1, 2), (1, 3), (0, 4)], {0: "backbone", 1: "backbone", 2: "backbone", 3: "backbone", 4: "backbone"}, True) == 3


def test_average_linkage_heights():
    d = np.array([[0, 1, 4], [1, 0, 6], [4, 6, 0]], float)
    merges = clustering.average_linkage(d)
    assert [(m[:3]) for m in merges] == [(0, 1, 1.0), (2, 3, 5.0)]
    assert clustering.cut_tree(merges, 3, 2) == [[0, 1], [2]]


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 9), st.integers(0, 1000))
def test_average_linkage_matches_a_plain_search(n, seed):
    rng = np.random.default_rng(seed)
    p = rng.random((n, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    groups, heights = [[i] for i in range(n)], []
    while len(groups) > 1:
        best = min(((np.mean([d[i, j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y))
        heights.append(best[0])
        groups[best[1]] += groups.pop(best[2])
    assert [m[2] for m in clustering.average_linkage(d)] == pytest.approx(heights)


def test_acceptance_rules():
    import pandas as pd

    rows = pd.DataFrame({"vid": range(6), "type": "SFH", "kw": 17.425, "homes": 1})
    loads, near = clustering.Loads(list(range(6)), rows), np.zeros((6, 6))
    assert clustering.accept([0], loads, near, [250, 400, 630], 900) == 250
    assert clustering.accept(list(range(6)), loads, near + 1000 * (1 - np.eye(6)), [250, 400, 630], 900) is None
    heavy = clustering.Loads(list(range(6)), rows.assign(kw=2000.0))
    assert clustering.accept(list(range(6)), heavy, near, [250, 400, 630], 900) is None
    assert clustering.accept([0], heavy, near, [250, 400, 630], 900) == 2000


def test_brownfield_takes_the_nearest_within_reach():
    import pandas as pd

    rows = pd.DataFrame({"vid": [1, 2, 3], "type": "SFH", "kw": 17.425, "homes": 1})
    costs = pd.DataFrame({"start_vid": [1, 2, 3], "end_vid": 9, "agg_cost": [10.0, 20.0, 800.0]})
    assert clustering.brownfield(costs, clustering.Loads([1, 2, 3], rows), [1, 2, 3], [9], [250, 400, 630], 750) == [(-1, 9, [1, 2], 250.0)]


def test_every_consumer_has_one_transformer_at_most(spark):
    rng = random.Random(1)
    costs = spark.createDataFrame([(0, c, t, float(rng.randrange(900))) for c in range(30) for t in (100, 101)], "g int, start_vid long, end_vid long, agg_cost double")
    b = spark.createDataFrame([(0, c, "SFH", 17.425, 1, 1) for c in range(30)], "g int, vid long, type string, kw double, homes int, settlement_type int")
    got = clustering.brownfield_clusters(costs, b, ["g"]).collect()
    assert len({r["vid"] for r in got}) == len(got)


@pytest.mark.parametrize("seed", range(3))
def test_brownfield_rounds_match_the_sequence(spark, seed):
    rng = random.Random(seed)
    costs = [(g, c, 1000 + t, float(rng.choice([rng.randrange(800), rng.randrange(5) * 100]))) for g in (0, 1, 2) for c in range(60) for t in rng.sample(range(7), 4)]
    costs += [(0, 999, 1001, 5.0), (1, 3, 1001, 1.0), (1, 3, 1001, 1.0)]
    houses = [(g, c, rng.choice(["SFH", "MFH", "Commercial", "Public", "Other"]), rng.choice([8.0, 60.0, 250.0]), rng.randrange(0, 4), 1 + g) for g in (0, 1, 2) for c in range(60) for _ in range(rng.randrange(1, 3))]
    c = spark.createDataFrame(costs, "g int, start_vid long, end_vid long, agg_cost double")
    b = spark.createDataFrame(houses, "g int, vid long, type string, kw double, homes int, settlement_type int")
    one, many = ({tuple(r) for r in clustering.brownfield_clusters(c, b, ["g"], pairs=n).collect()} for n in (10**6, 0))
    assert one == many and len({r[1] for r in one}) > 1 and len(one) < 180
    mixed = {tuple(r) for r in clustering.brownfield_clusters(c.where("g < 2 or start_vid < 20"), b, ["g"], pairs=100).collect()}
    assert {r for r in mixed if r[0] < 2} == {r for r in one if r[0] < 2}
    assert clustering.brownfield_rounds(c.limit(0), b, ["g"]).count() == 0


@pytest.mark.parametrize("joined", [0, 5, 40, 10**6])
def test_components_by_tasks_and_rounds(spark, joined):
    from gridwright.operators.components import connected_components

    rng = random.Random(joined)
    edges = [(i, i + 1) for i in range(100, 400)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(None, 3), (7, None), (999, 999)]
    rng.shuffle(edges)
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        todo = [] if n in want else [n]
        while todo:
            m = todo.pop()
            if m not in want:
                want[m] = n
                todo += near[m]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(6), joined=joined).collect()
    assert len(got) == len(want) and {(r["node"], r["component"]) for r in got} == set(want.items())
    named = spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")
    assert {tuple(r) for r in connected_components(named, joined=joined).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


@pytest.mark.parametrize("seed", range(3))
def test_components_after_an_insert(spark, seed):
    from gridwright.operators.components import components_with, connected_components

    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 3), (70, 70)]
    new = [(rng.randrange(80), rng.randrange(80)) for _ in range(12)] + [(90, 91), (92, 92), (None, 5), (1, None)]
    frame = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    known = connected_components(frame(edges))
    want = {tuple(r) for r in connected_components(frame(edges + new)).collect()}
    got = components_with(known, frame(new)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {tuple(r) for r in components_with(known, frame([])).collect()} == {tuple(r) for r in known.collect()}
    assert {tuple(r) for r in components_with(known.limit(0), frame(new)).collect()} == {tuple(r) for r in connected_components(frame(new)).collect()}


def test_split_keeps_length_and_skips_ends(spark):
    line = F.array(G.point(F.lit(0), F.lit(0)), G.point(F.lit(10), F.lit(0)))
    segs = spatial.segments(spark.range(1).select(F.lit(1).cast("long").alias("way_id"), line.alias("line")))
    cuts = spark.createDataFrame([(1, 4.0), (1, 4.0), (1, 7.0), (1, 0.0), (1, 10.0)], "way_id long, m double")
    got = [(r["m0"], r["m1"]) for r in spatial.split_ways(segs, cuts).orderBy("part").collect()]
    assert got == [(0.0, 4.0), (4.0, 7.0), (7.0, 10.0)]


def test_connection_snaps_to_a_near_end(spark):
    line = F.array(G.point(F.lit(0), F.lit(0)), G.point(F.lit(10), F.lit(0)))
    ways = spark.range(1).select(F.lit(1).cast("long").alias("way_id"), F.lit(41).alias("clazz"), line.alias("line"))
    out = spatial.connect(spark.createDataFrame([("a", 0.05, 3.0)], "id string, x double, y double"), ways).orderBy("way_id").collect()
    assert [(r["way_id"], r["clazz"]) for r in out] == [(1, 41), (2, 110)]
    assert out[1]["line"][1].asDict() == {"x": 0.0, "y": 0.0}


def test_unbounded_nearest_matches_brute_force(spark):
    rng = random.Random(3)
    a = [(i, rng.random() * 1000, rng.random() * 3) for i in range(40)]
    b = [(i, rng.random() ** 8 * 1000, rng.random() * 3) for i in range(15)]
    schema = "id long, x double, y double"
    got = {(r["id"], r["rank"]): r["other"] for r in spatial.nearest(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 3).collect()}
    for i, x, y in a:
        order = sorted(b, key=lambda o: (np.hypot(o[1] - x, o[2] - y), o[0]))
        assert [got[(i, k)] for k in (1, 2, 3)] == [o[0] for o in order[:3]]


def test_sweep_agrees_with_the_exact_two_bus_solution():
    z, s, kv = complex(0.1, 0.05), complex(0.03, 0.01), 0.4
    vm, ka, good = network.sweep([0, 1], {1: 0}, {1: z}, {1: s}, kv)
    assert good
    a = z.real * s.real + z.imag * s.imag
    exact = np.sqrt((kv**2 - 2 * a + np.sqrt((kv**2 - 2 * a) ** 2 - 4 * abs(z) ** 2 * abs(s) ** 2)) / 2)
    assert vm[1] * kv == pytest.approx(exact, rel=1e-7)
    assert ka[1] == pytest.approx(abs(s) / (np.sqrt(3) * exact), rel=1e-7)


def test_upstream_simultaneity_counts_all_below(spark):
    parents = spark.createDataFrame([(0, 0, None), (0, 1, 0), (0, 2, 0)], "g int, node long, parent long")
    loads = spark.createDataFrame([(0, 1, "SFH", 1, 0.02), (0, 2, "MFH", 3, 0.06)], "g int, node long, zone string, count int, max_p_mw double")
    got = {r["node"]: r["sim_load"] for r in grid_metrics.upstream_simultaneity(parents, loads, ["g"]).collect()}
    assert got[0] == pytest.approx(0.08 * (0.07 + 0.93 * 4**-0.75))
    assert got[1] == pytest.approx(0.02)


def test_wasserstein_of_shifted_values(spark):
    from gridwright.operators.metrics import wasserstein

    rows = spark.createDataFrame([("m", 0.0, "a"), ("m", 1.0, "a"), ("m", 1.0, "b"), ("m", 2.0, "b"), ("n", 1.0, "a")], "metric string, v double, s string")
    got = {r["metric"]: r for r in wasserstein(rows, ["metric"], "v", "s", "a", "b").collect()}
    assert got["m"]["wasserstein_distance"] == pytest.approx(1.0)
    assert got["n"]["wasserstein_distance"] is None


def test_equal_labelings_agree(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 3) for i in range(30)], "id int, a int, b int")
    assert clustering.adjusted_rand(rows, "a", "b").first()["ari"] == pytest.approx(1.0)


def test_points_on_a_way_go_to_the_next_one(spark):
    """Ways under a building, connection lines and points out of reach (0.1 m, class 110, 2000 m)."""
    line = lambda x: [{"x": x, "y": -50.0}, {"x": x, "y": 50.0}]
    ways = spark.createDataFrame([(1, "a", 41, line(0.0)), (2, "b", 41, line(100.0)), (3, "c", 110, line(40.0)), (4, "d", 41, line(9000.0))], "way_id long, address string, clazz int, line array<struct<x: double, y: double>>")
    points = [(1, 0.0, 0.0, None), (2, 0.05, 0.0, None), (3, 0.2, 0.0, None), (4, 42.0, 0.0, None), (5, 42.0, 0.0, "c"), (6, 42.0, 0.0, "b"), (7, 5000.0, 0.0, None), (8, 0.0, 0.0, "a"), (9, 70.0, 0.0, "no such")]
    got = {r["id"]: (r["way_id"], r["matched"]) for r in spatial.by_address(spark.createDataFrame(points, "id long, x double, y double, address string"), ways).collect()}
    assert got == {1: (2, False), 2: (2, False), 3: (1, False), 4: (1, False), 5: (1, False), 6: (2, True), 8: (1, True), 9: (2, False)}


def test_numbers_follow_a_total_order(spark):
    from gridwright.operators.numbering import numbered

    rng = random.Random(5)
    rows = [(rng.randrange(40), i, None if i % 11 == 0 else float(rng.randrange(9))) for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, c double").repartition(6)
    got = sorted((r["n"], r["a"], r["b"]) for r in numbered(df, [F.col("c"), F.col("a"), F.col("b")], "n", 7).collect())
    want = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0], r[1]))
    assert got == [(7 + i, a, b) for i, (a, b, _) in enumerate(want)]
    assert numbered(df.limit(0), ["a"], "n").count() == 0


def test_unreached_buildings_are_listed(spark):
    by = ["g"]
    edges = spark.createDataFrame([(0, 1, 2, 10.0), (0, 2, 3, 5.0), (0, 8, 9, 5.0)], "g int, source long, target long, cost double")
    b = spark.createDataFrame([(0, 3, 2, "SFH", 17.4, 1, 9.0), (0, 9, 8, "SFH", 17.4, 1, 8.0)], "g int, vid long, connection_point long, type string, kw double, homes int, sim double")
    g = spark.createDataFrame([(0, 1)], "g int, ont_vid long")
    tree = network.branch_tree(edges, b, g, by)
    assert {(r["node"], r["parent"], r["kind"], r["load_kw"]) for r in tree.where("kind in ('unreached', 'consumer')").collect()} == {(9, None, "unreached", 8.0), (3, 2, "consumer", 9.0)}
    assert network.sized_lines(tree, g, by).count() == 2


def test_consumer_buses_by_load_or_place(spark):
    loads = spark.createDataFrame([(1, 5), (1, 5), (1, 6)], "g int, bus long")
    place = "g int, id long, x double, y double"
    buildings = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 2, 0.0, 0.0), (2, 3, 9.0, 0.0), (2, 4, 5.0, 0.0)], place)
    buses = spark.createDataFrame([(1, 7, 0.0, 0.0), (2, 8, 0.0, 1.0), (2, 9, 10.0, 1.0), (2, 10, 99.0, 0.0)], place)
    assert {(r["g"], r["bus"]) for r in grid_metrics.consumer_buses(loads, buildings, buses, ["g"]).collect()} == {(1, 5), (1, 6), (2, 8), (2, 9)}
