"""Clusters, grids, flows and models against plain versions that share no code with them."""

import itertools
import math
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators import clustering, network, routing
from gridwright.queries import QUERIES
from gridwright.queries.registry import Views

FOLDER = os.environ.get("GRIDWRIGHT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SIZES = [100, 160, 250, 400, 630]
SIM = {"Residential": 0.07, "Commercial": 0.5, "Public": 0.6}


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, FOLDER)


@pytest.fixture(scope="module")
def town(v):
    """plz -> (points, all distances in whole metres, buildings by point)."""
    from gridwright.queries.expressions import peaks

    rows = v.x_streets.collect()
    house = {r["osm_id"]: r for r in peaks(v).select("osm_id", "type", "kw", "homes").collect()}
    out = {}
    for plz in {r["plz"] for r in rows}:
        own = [r for r in rows if r["plz"] == plz]
        n = len(own)
        d = np.full((n, n), np.inf)
        np.fill_diagonal(d, 0)
        for r in own:
            if r["source"] > 0:
                d[r["source"], r["target"]] = d[r["target"], r["source"]] = r["cost"]
        for k in range(n):
            d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
        out[plz] = list(range(n)), np.floor(d), {r["source"]: house[r["osm_id"]] for r in own}
    return out


def plain_peak(houses):
    kw, homes = defaultdict(float), defaultdict(float)
    for h in houses:
        kind = h["type"] if h["type"] in ("Commercial", "Public") else "Residential"
        kw[kind] += h["kw"]
        homes[kind] += h["homes"]
    return sum(p * (SIM[k] + (1 - SIM[k]) * homes[k] ** -0.75) for k, p in kw.items() if p > 0 and homes[k] > 0)


def plain_halves(members, d):
    groups = [[m] for m in members]
    while len(groups) > 2:
        _, i, j = min((np.mean([d[a, b] for a in groups[i] for b in groups[j]]), i, j) for i, j in itertools.combinations(range(len(groups)), 2))
        groups[i] += groups.pop(j)
    return groups


def plain_clusters(points, d, houses, sizes, reach):
    todo, out = [list(points)], []
    while todo:
        group = todo.pop()
        for half in plain_halves(group, d) if len(group) > 1 else [group]:
            load = plain_peak([houses[p] for p in half])
            size = None
            if not (load >= max(sizes) and len(half) >= 5) and min(max(d[a, b] for b in half) for a in half) <= reach:
                if load >= max(sizes):
                    size = math.ceil(load)
                else:
                    one, two = min(s for s in sizes if s > load), [2 * s for s in sorted(sizes)[-2:] if 2 * s > 1.15 * load]
                    size = min([one, *two])
            if size is None and len(half) > 1:
                todo.append(half)
            else:
                out.append((sorted(half), size if size is not None else math.ceil(load)))
    return sorted(out)


def test_clusters_match_plain_bisection(spark, v, town):
    from gridwright.config import DEFAULT

    got = defaultdict(lambda: defaultdict(list))
    for r in QUERIES["linkage_clusters"](spark, FOLDER).collect():
        got[r["plz"]][r["bcid"]].append((r["vid"], r["rated"], r["ont_vid"]))
    sizes = list(DEFAULT.capacities[2])
    for plz, (points, d, houses) in town.items():
        want = plain_clusters(points, d, houses, sizes, DEFAULT.greenfield_reach_m)
        mine = sorted((sorted(m[0] for m in c), c[0][1]) for c in got[plz].values())
        assert mine == [(m, float(s)) for m, s in want]
        for c in got[plz].values():
            members = sorted(m[0] for m in c)
            moment = {p: sum(d[p, q] * houses[q]["kw"] for q in members) for p in members}
            near = [p for p in members if max(d[p, q] for q in members) <= DEFAULT.greenfield_reach_m] or members
            assert {m[2] for m in c} == {min(near, key=lambda p: (round(moment[p], 6), p))}
    accepted = {(r["plz"], r["bcid"]): (r["rated"], r["members"], r["first"]) for r in QUERIES["bcid_accept"](spark, FOLDER).collect()}
    assert accepted == {(plz, k): (c[0][1], len(c), min(m[0] for m in c)) for plz, cs in got.items() for k, c in cs.items()}


def test_one_tree_splits_like_a_tree_for_each_half():
    rng = np.random.default_rng(3)
    for n in (2, 3, 17, 60):
        p = rng.random((n, 2)) * 3000
        d = np.hypot(*(p[:, None] - p[None]).T)
        houses = {i: {"type": "SFH" if i % 3 else "Commercial", "kw": float(rng.integers(5, 90)), "homes": 1 + i % 4} for i in range(n)}
        import pandas as pd

        loads = clustering.Loads(list(range(n)), pd.DataFrame([{"vid": i, **h} for i, h in houses.items()]))
        assert clustering.building_clusters(d, list(range(n)), loads, SIZES, 700.0) == [(m, float(s)) for m, s in plain_clusters(range(n), d, houses, SIZES, 700.0)]


def test_consumers_match_a_plain_assignment(spark, v, town):
    from gridwright.config import DEFAULT

    got = {(r["plz"], r["vid"]): (r["trafo"], r["rated"]) for r in QUERIES["brownfield_assign"](spark, FOLDER).collect()}
    sizes, want = list(DEFAULT.capacities[2]), {}
    for plz, (points, d, houses) in town.items():
        trafos = sorted({r["osm_id"] % len(points) for r in v.x_transformers.where(F.col("plz") == plz).collect()})
        held, full, done = defaultdict(list), set(), set()
        for _, c, t in sorted((d[c, t], c, t) for c in points for t in trafos if d[c, t] < DEFAULT.brownfield_reach_m):
            if c in done or t in full:
                continue
            if plain_peak([houses[x] for x in [*held[t], c]]) > max(sizes):
                full.add(t)
                continue
            held[t].append(c)
            done.add(c)
        for t, cs in held.items():
            for c in cs:
                want[(plz, c)] = (t, float(min((s for s in sizes if s > plain_peak([houses[x] for x in cs])), default=max(sizes))))
    assert got == want and got


@pytest.mark.parametrize("seed", range(6))
def test_distances_match_floyd(seed):
    import pandas as pd

    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(2, 40)), int(rng.integers(1, 90))
    e = pd.DataFrame({"source": rng.integers(0, n, m), "target": rng.integers(0, n, m), "cost": rng.integers(1, 50, m).astype(float)})
    d = np.full((n + 3, n + 3), np.inf)
    np.fill_diagonal(d, 0)
    for s, t, c in e.itertuples(index=False):
        d[s, t] = d[t, s] = min(d[s, t], c)
    np.fill_diagonal(d, 0)
    for k in range(n + 3):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    points = np.unique(rng.choice(n + 3, int(rng.integers(1, n + 3)), replace=False))
    assert np.array_equal(routing.distances(e, points), d[np.ix_(points, points)])


def test_costs_stop_at_the_reach(spark):
    edges = spark.createDataFrame([(0, i, i + 1, 10.0) for i in range(9)], "g int, source long, target long, cost double")
    start = spark.createDataFrame([(0, 0)], "g int, vid long")
    assert sorted(r["end_vid"] for r in routing.costs(edges, start, ["g"], reach=35.0).collect()) == [0, 1, 2, 3]


def test_sums_over_a_long_chain_and_a_forest(spark):
    n = 3000
    rows = [(0, i, i - 1 if i else None) for i in range(n)] + [(1, 5, None), (1, 6, 7), (1, 8, 7)]
    parents = spark.createDataFrame(rows, "g int, node long, parent long")
    loads = parents.select("g", "node", F.lit(1).alias("one"), F.when(F.col("node") % 2 == 0, 0.5).alias("half"), (F.col("node") % 2).alias("kind"))
    got = {(r["g"], r["node"]): (r["one"], r["half"]) for r in routing.subtree_sums(parents, loads, ["g"], ["one", "half"]).collect()}
    assert all(got[(0, i)] == (n - i, 0.5 * len(range(i + i % 2, n, 2))) for i in range(n))
    assert {k: x[0] for k, x in got.items() if k[0] == 1} == {(1, 5): 1, (1, 6): 1, (1, 7): 2, (1, 8): 1}
    kinds = {(r["g"], r["node"], r["kind"]): r["one"] for r in routing.subtree_sums(parents, loads, ["g"], ["one"], ["kind"]).where("g = 1").collect()}
    assert kinds == {(1, 5, 1): 1, (1, 6, 0): 1, (1, 7, 0): 2, (1, 8, 0): 1}
    way = {r["node"]: (r["half"], r["first"], r["second"], r["steps"]) for r in routing.path_sums(parents.join(loads, ["g", "node"]).where("g = 0"), ["g"], ["half"]).collect()}
    assert way[0] == (0.5, None, None, 0) and way[1] == (0.5, 1, None, 1) and way[2999] == (750.0, 1, 2, 2999)
    with pytest.raises(Exception, match="no forest"):
        routing.subtree_sums(spark.createDataFrame([(0, 1, 2), (0, 2, 1)], parents.schema), loads, ["g"], ["one"]).collect()


# --- flows -------------------------------------------------------------------------------------
def plain_voltages(lines, demand, root, kv):
    """Voltages by repeated injection through the inverse admittance matrix."""
    nodes = [root, *sorted({n for a, b, _ in lines for n in (a, b)} - {root})]
    at, n = {x: i for i, x in enumerate(nodes)}, len(nodes)
    y = np.zeros((n, n), complex)
    for a, b, z in lines:
        i, j, g = at[a], at[b], 1 / z
        y[i, i] += g
        y[j, j] += g
        y[i, j] -= g
        y[j, i] -= g
    s = np.array([demand.get(x, 0j) for x in nodes])
    v = np.full(n, complex(kv))
    inverse = np.linalg.inv(y[1:, 1:])
    for _ in range(400):
        v[1:] = inverse @ (-(s[1:] / v[1:]).conj() - y[1:, 0] * kv)
    return {x: v[i] for x, i in at.items()}


def test_random_load_flow_matches_nodal_solution(spark, v):
    from gridwright.queries.sizing import street_grids

    lines, loads, _ = (df.collect() for df in street_grids(v))
    got = {(r["plz"], r["bus"]): r for r in QUERIES["random_load_flow"](spark, FOLDER).collect()}
    assert len(got) == v.x_streets.count()
    for plz in {r["plz"] for r in lines}:
        own = [(r["from_bus"], r["to_bus"], complex(0.164, 0.08) * r["length_km"] / 2) for r in lines if r["plz"] == plz]
        demand = {r["bus"]: complex(r["p_mw"], r["q_mvar"]) for r in loads if r["plz"] == plz}
        volts = plain_voltages(own, demand, 0, 0.4)
        for bus, x in volts.items():
            row = got[(plz, bus)]
            assert row["converged"] and row["vm_pu"] == pytest.approx(abs(x) / 0.4, abs=1e-7)
            if bus:
                (z,) = (z for _, b, z in own if b == bus)
                assert row["i_ka"] == pytest.approx(abs(volts[row["parent"]] - x) / abs(z) / math.sqrt(3), abs=1e-6)
                assert row["pl_mw"] == pytest.approx(3 * row["i_ka"] ** 2 * z.real, abs=1e-9)


def test_meshed_currents_match_nodal_solution(spark, v):
    from gridwright.queries.sizing import street_grids

    loads = street_grids(v)[1].collect()
    got = QUERIES["meshed_flow"](spark, FOLDER).collect()
    assert len(got) > v.x_streets.where("source > 0").count()
    for plz in {r["plz"] for r in got}:
        own = [r for r in got if r["plz"] == plz]
        z = lambda r: complex(0.164, 0.08) * r["length_km"] / 2
        volts = plain_voltages([(r["from_bus"], r["to_bus"], z(r)) for r in own], {r["bus"]: complex(r["p_mw"], r["q_mvar"]) for r in loads if r["plz"] == plz}, 0, 0.4)
        for r in own:
            current = abs(volts[r["from_bus"]] - volts[r["to_bus"]]) / abs(z(r)) / math.sqrt(3)
            assert r["i_ka"] == pytest.approx(current, abs=1e-7)
            assert r["loading_percent"] == pytest.approx(100 * current / 0.626, abs=1e-4)
            assert r["pl_mw"] == pytest.approx(3 * current**2 * z(r).real, abs=1e-9)


def test_scripts_build_the_same_grid(spark, v):
    """What the commands say, read back, solved by hand and compared with the statistics."""
    import re

    from gridwright.queries.sizing import street_grids

    figures = {r["plz"]: r for r in QUERIES["circuit_statistics"](spark, FOLDER).collect()}
    loads = street_grids(v)[1].collect()
    rows = QUERIES["circuit_scripts"](spark, FOLDER).collect()
    assert {r["plz"] for r in rows} == set(figures)
    for r in rows:
        text = r["script"].splitlines()
        assert text[0] == "Clear" and text[1].startswith(f"New Circuit.p{r['plz']} basekv=20.0") and text[-2:] == ["CalcVoltageBases", "Solve"]
        codes = {m[1]: (float(m[2]), float(m[3])) for m in re.finditer(r"New LineCode\.(\S+) .* R1=(\S+) X1=(\S+) ", r["script"])}
        wires = re.findall(r"New Line\.\S+ phases=3 bus1=b(\d+) bus2=b(\d+) linecode=(\S+) units=km length=(\S+)", r["script"])
        demand = {int(b): complex(float(p), float(q)) / 1000 for b, p, q in re.findall(r"New Load\.\S+ .* bus1=b(\d+) kW=(\S+) kvar=(\S+)", r["script"])}
        assert codes == {"LC_NAYY_4_185": (0.164, 0.08)} or not wires
        assert len(demand) == sum(x["plz"] == r["plz"] for x in loads) and sum(t.startswith("New Transformer.") for t in text) == 1
        volts = plain_voltages([(int(a), int(b), complex(*codes[c]) * float(km)) for a, b, c, km in wires], demand, 0, 0.4)
        f = figures[r["plz"]]
        size = [abs(x) / 0.4 for x in volts.values()]
        assert f["converged"] and f["num_buses"] == len(volts) and f["num_elements"] == len(wires) / 2 + len(demand)
        assert (f["min_pu"], f["avg_pu"], f["max_pu"]) == pytest.approx((min(size), np.mean(size), max(size)), abs=1e-7)
        lost = sum((abs(volts[int(a)] - volts[int(b)]) / abs(z)) ** 2 * z.real for a, b, c, km in wires for z in [complex(*codes[c]) * float(km)])
        assert f["total_losses_kw"] == pytest.approx(1000 * lost, rel=1e-6, abs=1e-9)
        assert f["total_power_kw"] == pytest.approx(1000 * (lost + sum(d.real for d in demand.values())), rel=1e-6)


def test_newton_says_when_there_is_no_solution():
    ends, z = np.array([[0, 1]]), np.array([complex(0.5, 0.2)])
    assert network.newton(ends, z, np.array([0j, 0.01 + 0j]), 0.4)[1]
    assert not network.newton(ends, z, np.array([0j, 5.0 + 0j]), 0.4)[1]


# --- the whole plan ----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def plan(spark, v):
    from gridwright.plans.generate import demo_inputs, generate
    from gridwright.queries import sizing

    built = generate(*demo_inputs(v))
    own, sizing._plan = sizing._plan, lambda _: built  # the queries' tables come from one plan
    yield built
    sizing._plan = own


@pytest.fixture(scope="module")
def grids(plan):
    """key -> rows of each table."""
    out = defaultdict(lambda: defaultdict(list))
    for name in ("grids", "bus", "line", "load", "trafo", "ext_grid", "flow"):
        for r in plan[name].collect():
            out[tuple(r[k] for k in plan["by"])][name].append(r)
    assert plan["unreached"].count() == 0 and len(out) > 20
    return out


def test_every_building_is_served_or_listed(v, plan, grids):
    from gridwright.plans.generate import demo_inputs, with_loads

    buildings, _, _, categories = demo_inputs(v)
    loaded = {r["osm_id"]: r["homes"] for r in with_loads(buildings, categories).collect()}
    out = {r["osm_id"]: r["reason"] for r in plan["left_out"].collect()}
    assert set(out) <= set(loaded) and set(out.values()) <= {"alone"} and len(out) < 0.1 * len(loaded)
    assert sum(r["units"] for g in grids.values() for r in g["load"]) == sum(n for i, n in loaded.items() if i not in out)
    numbers = defaultdict(list)
    for plz, kcid, bcid in grids:
        numbers[(plz, kcid)].append(bcid)
    for found in numbers.values():
        old, new = sorted(-n for n in found if n < 0), sorted(n for n in found if n > 0)
        assert old == list(range(1, len(old) + 1)) and new == list(range(1, len(new) + 1))


def test_ratings_cover_their_loads(grids):
    for (_, _, bcid), grid in grids.items():
        (g,) = grid["grids"]
        zone = {r["bus"]: r["zone"] for r in grid["bus"]}
        load = plain_peak([{"type": zone[r["bus"]], "kw": r["max_p_mw"] * 1000, "homes": r["units"]} for r in grid["load"]])
        assert g["rated"] >= load * 0.999 or bcid < 0 or len(grid["load"]) < 5
        assert {r["sn_mva"] for r in grid["trafo"]} == {g["rated"] / 1000}


def tree_of(grid):
    """(parent, line into, buses below) of each bus, from the lines alone."""
    near = defaultdict(list)
    for r in grid["line"]:
        near[r["from_bus"]].append((r["to_bus"], r))
        near[r["to_bus"]].append((r["from_bus"], r))
    parent, into, order = {-1: None}, {}, [-1]
    for n in order:
        for other, r in near[n]:
            if other not in parent:
                parent[other], into[other] = n, r
                order.append(other)
    below = {n: {n} for n in order}
    for n in reversed(order):
        if parent[n] is not None:
            below[parent[n]] |= below[n]
    return parent, into, below


CABLES = {"NAYY_4_120": (0.242, 0.225, 0.08), "NAYY_4_150": (0.270, 0.208, 0.08), "NAYY_4_185": (0.313, 0.164, 0.08), "NYY_4_35": (0.159, 0.524, 0.085), "NAYY_4_50": (0.142, 0.642, 0.083), "NYY_4_70": (0.232, 0.268, 0.082)}


def fitting(load, metres, names, share):
    """(cable, number) by trying numbers from one up and cables by cross-section."""
    current = load / (400 * 0.9 * math.sqrt(3))
    for number in itertools.count(1):
        for name in sorted(names, key=lambda x: int(x.rsplit("_", 1)[1])):
            i, r, x = CABLES[name]
            drop = math.sqrt(3) * current / number * metres / 1000 * math.hypot(r, x)
            if i >= current / number and drop <= 0.4 * share + 1e-12:
                return name, number


def test_lines_carry_what_hangs_below_them(grids):
    for grid in grids.values():
        parent, into, below = tree_of(grid)
        zone = {r["bus"]: r["zone"] for r in grid["bus"]}
        load = {r["bus"]: r for r in grid["load"]}
        assert set(load) <= set(parent)
        for bus, r in into.items():
            if r["kind"] != "consumer":
                (place,) = (x["ont_vid"] for x in grid["grids"])
                under = set(parent) - below[bus] if bus == place else below[bus]
                own = [load[b] for b in under if b in load]
                homes = [{"type": zone[x["bus"]], "kw": x["max_p_mw"] * 1000, "homes": x["units"]} for x in own]
                assert r["load_kw"] == pytest.approx(plain_peak(homes), rel=1e-9)
                assert (r["std_type"], r["parallel"]) == fitting(r["load_kw"], r["length_km"] * 1000, ["NAYY_4_120", "NAYY_4_150", "NAYY_4_185"], 0.04)
            assert (r["max_i_ka"], r["r_ohm_per_km"], r["x_ohm_per_km"]) == pytest.approx(CABLES[r["std_type"]])


def test_plan_flow_matches_nodal_solution(spark, plan, grids):
    summary = {tuple(r[k] for k in plan["by"]): r for r in QUERIES["power_flow_sweep"](spark, FOLDER).collect()}
    assert set(summary) == set(grids)
    for key, grid in grids.items():
        lines = [(r["from_bus"], r["to_bus"], max(r["length_km"], 1e-9) * complex(r["r_ohm_per_km"], r["x_ohm_per_km"]) / r["parallel"]) for r in grid["line"]]
        volts = plain_voltages(lines, {r["bus"]: complex(r["p_mw"], 0) for r in grid["load"]}, -1, 0.4)
        for r in grid["flow"]:
            assert r["converged"] and r["vm_pu"] == pytest.approx(abs(volts[r["bus"]]) / 0.4, abs=1e-6)
        assert summary[key]["min_vm_pu"] == pytest.approx(min(abs(x) for x in volts.values()) / 0.4, abs=1e-6)


def test_clustering_metrics_match_plain_counts(spark, plan, grids):
    rows = {tuple(r[k] for k in plan["by"]): r for r in QUERIES["clustering_metrics"](spark, FOLDER).collect()}
    assert set(rows) == set(grids)
    for key, grid in grids.items():
        r = rows[key]
        parent, into, below = tree_of(grid)
        houses = [b["bus"] for b in grid["bus"] if "Consumer Nodebus" in b["name"]]
        zone = {b["bus"]: b["zone"] for b in grid["bus"]}
        load = {x["bus"]: x for x in grid["load"]}

        def way(bus, parent=parent):
            out = []
            while parent.get(bus) is not None:
                out.append(bus)
                bus = parent[bus]
            return out[::-1]

        far = [sum(into[n]["length_km"] for n in way(h)) for h in houses]
        assert r["no_house_connections"] == len(houses) and r["no_connection_buses"] == sum("Connection Nodebus" in b["name"] for b in grid["bus"])
        assert r["avg_trafo_dis"] == pytest.approx(np.mean(far)) and r["max_trafo_dis"] == pytest.approx(max(far))
        assert r["cable_length_km"] == pytest.approx(sum(x["length_km"] * x["parallel"] for x in grid["line"]))
        assert r["max_power_mw"] == pytest.approx(sum(x["max_p_mw"] for x in grid["load"])) and r["simultaneous_peak_load_mw"] == pytest.approx(sum(x["p_mw"] for x in grid["load"]))
        assert r["transformer_mva"] == pytest.approx(min(t["sn_mva"] for t in grid["trafo"]))

        def factor(bus, below=below, load=load, zone=zone):
            own = [load[b] for b in below[bus] if b in load]
            kw = sum(x["max_p_mw"] for x in own)
            count = [{"type": zone[x["bus"]], "kw": x["max_p_mw"], "homes": 1} for x in own]
            return plain_peak(count) / kw if kw > 0 else 1.0

        branches, ohm, react = defaultdict(float), defaultdict(float), 0.0
        for bus, x in load.items():
            path, weight = way(bus), x["max_p_mw"] * 1000 / peak_household()
            branches[path[0]] += weight
            ohm[path[0]] += weight * sum(into[n]["length_km"] * into[n]["r_ohm_per_km"] * (factor(n) or 1.0) for n in path)
            react += weight * sum(into[n]["length_km"] * into[n]["x_ohm_per_km"] for n in path)
        assert r["resistance"] == pytest.approx(sum(ohm.values())) and r["reactance"] == pytest.approx(react)
        assert r["max_vsw_of_a_branch"] == pytest.approx(max(ohm.values())) and r["max_no_of_households_of_a_branch"] == pytest.approx(max(branches.values()))


def peak_household():
    from gridwright.config import DEFAULT

    return DEFAULT.peak_load_household


def test_comparison_metrics_match_plain_counts(spark, plan, grids):
    rows = {tuple(r[k] for k in plan["by"]): r for r in QUERIES["comparison_metrics"](spark, FOLDER).collect()}
    assert set(rows) == {k for k, g in grids.items() if len(g["bus"]) >= 5}
    for key, r in rows.items():
        grid = grids[key]
        parent, into, _ = tree_of(grid)

        def far(bus, parent=parent, into=into):
            return 0.0 if parent[bus] is None else into[bus]["length_km"] + far(parent[bus])

        houses = [b["bus"] for b in grid["bus"] if "Consumer Nodebus" in b["name"]]
        assert r["graph_length"] == pytest.approx(sum(x["length_km"] for x in grid["line"]))
        assert r["graph_resistance"] == pytest.approx(sum(x["length_km"] * x["r_ohm_per_km"] / x["parallel"] for x in grid["line"]))
        assert r["avg_trafo_distance"] == pytest.approx(np.mean([far(h) for h in houses])) and r["max_trafo_distance"] == pytest.approx(max(far(h) for h in houses))
        children = defaultdict(list)
        for n, up in parent.items():
            if up is not None and n not in houses:
                children[up].append(n)
        ends = [n for n in parent if n not in houses and n != -1 and not children[n]]
        assert r["feeder_lines"] == len(ends)
        assert r["buildings_per_feeder"] == pytest.approx(len(houses) / len(ends))


def test_layers_hold_every_line_at_its_ends(spark, plan, grids):
    rows = QUERIES["gis_layers"](spark, FOLDER).collect()
    assert len(rows) == sum(len(g["line"]) for g in grids.values())
    for r in rows:
        grid = grids[tuple(r[k] for k in plan["by"])]
        at = {b["bus"]: (b["x"], b["y"]) for b in grid["bus"]}
        (line,) = (x for x in grid["line"] if x["name"] == r["name"])
        shift = 5e-6 * line["branch"]
        assert (r["from_x"], r["from_y"]) == pytest.approx((at[line["from_bus"]][0] + shift, at[line["from_bus"]][1] + shift))
        assert (r["to_x"], r["to_y"]) == pytest.approx(at[line["to_bus"]])


# --- clusters of grids -------------------------------------------------------------------------
@pytest.fixture(scope="module")
def features(v):
    f = v.x_features.select("grid_result_id", "f1", "f2").toPandas().sort_values("grid_result_id").reset_index(drop=True)
    x = f[["f1", "f2"]].to_numpy(float)
    return f, (x - x.mean(0)) / x.std(0)


def test_kmeans_is_a_fixed_point(spark, features):
    f, z = features
    out = QUERIES["kmeans_grids"](spark, FOLDER).toPandas().set_index("grid_result_id")
    label = out.loc[f["grid_result_id"], "clusters"].to_numpy()
    centres = np.array([z[label == k].mean(0) for k in range(5)])
    near = ((z[:, None] - centres[None]) ** 2).sum(2)
    assert (near[np.arange(len(z)), label] <= near.min(1) + 1e-3).all()
    marked = out[out["representative_grid"]]
    assert sorted(marked["clusters"]) == list(range(5))
    by = f.set_index("grid_result_id").loc[marked.sort_values("clusters").index, "f1"].tolist()
    assert by == sorted(by)
    for grid, k in marked["clusters"].items():
        own = f["grid_result_id"][label == k]
        gap = ((z[label == k] - centres[k]) ** 2).sum(1)
        assert own.tolist()[int(gap.argmin())] == grid


def plain_em(z, start, kind, rounds, tolerance):
    k, d = start.max() + 1, z.shape[1]
    weight, means = np.bincount(start) / len(z), np.array([z[start == j].mean(0) for j in range(k)])
    cov, before = [np.eye(d)] * k, -np.inf
    for _ in range(rounds):
        dens = np.array([[w * math.exp(-0.5 * (x - m) @ np.linalg.inv(c) @ (x - m)) / math.sqrt((2 * math.pi) ** d * np.linalg.det(c)) for w, m, c in zip(weight, means, cov, strict=True)] for x in z])
        r, like = dens / dens.sum(1, keepdims=True), np.log(dens.sum(1)).mean()
        n = r.sum(0)
        weight, means = n / n.sum(), (r.T @ z) / n[:, None]
        full = [sum(r[i, j] * np.outer(z[i] - means[j], z[i] - means[j]) for i in range(len(z))) / n[j] for j in range(k)]
        if kind == "tied":
            full = [sum(n[j] * full[j] for j in range(k)) / n.sum()] * k
        elif kind == "diag":
            full = [np.diag(np.diag(c)) for c in full]
        elif kind == "spherical":
            full = [np.eye(d) * np.diag(c).mean() for c in full]
        cov = [c + 1e-6 * np.eye(d) for c in full]
        if abs(like - before) < tolerance:
            break
        before = like
    dens = np.array([[math.log(w) - 0.5 * (x - m) @ np.linalg.inv(c) @ (x - m) - 0.5 * math.log(np.linalg.det(c)) for w, m, c in zip(weight, means, cov, strict=True)] for x in z])
    return dens.argmax(1)


@pytest.mark.parametrize("kind", ["full", "diag", "tied", "spherical"])
def test_mixtures_match_plain_em(spark, v, features, kind):
    f, z = features
    start = clustering.kmeans_grids(v.x_features, ["f1", "f2"], 3, 1).select("grid_result_id", "clusters").toPandas().set_index("grid_result_id")
    first = start.loc[f["grid_result_id"], "clusters"].to_numpy()
    got = clustering.gmm(v.x_features, ["f1", "f2"], 3, kind, rounds=12).select("grid_result_id", "clusters").toPandas().set_index("grid_result_id")
    want = plain_em(z, first, kind, 12, 1e-4)
    assert (got.loc[f["grid_result_id"], "clusters"].to_numpy() == want).mean() > 0.99


def test_counts_are_scored_like_plain_indices(spark, v, features):
    f, z = features
    scores = clustering.cluster_counts(v.x_features, ["f1", "f2"], (3, 4)).collect()
    found = {(r["algorithm"], r["k"]): (r["ch"], r["db"]) for r in scores}
    for k in (3, 4):
        label = clustering.kmeans_grids(v.x_features, ["f1", "f2"], k, 1).select("grid_result_id", "clusters").toPandas().set_index("grid_result_id").loc[f["grid_result_id"], "clusters"].to_numpy()
        means = np.array([z[label == j].mean(0) for j in range(k)])
        within = sum(((z[label == j] - means[j]) ** 2).sum() for j in range(k))
        between = sum((label == j).sum() * ((means[j] - z.mean(0)) ** 2).sum() for j in range(k))
        spread = [np.hypot(*(z[label == j] - means[j]).T).mean() for j in range(k)]
        db = np.mean([max((spread[i] + spread[j]) / np.hypot(*(means[i] - means[j])) for j in range(k) if j != i) for i in range(k)])
        assert found[("kmeans", k)] == pytest.approx((between * (len(z) - k) / (within * (k - 1)), db), rel=0.05)
    best = {r["algorithm"]: r for r in clustering.best_counts(spark.createDataFrame(scores)).collect()}
    assert set(best) == {"kmeans", *clustering.COVARIANCES}
    for name, r in best.items():
        assert (r["ch"], r["ch_k"]) == max((found[(name, k)][0], k) for k in (3, 4)) and (r["db"], r["db_k"]) == min((found[(name, k)][1], k) for k in (3, 4))


def test_factors_match_plain_formulas(spark, v):
    x = v.x_features.selectExpr("f1", "f2", "f1 + 0.1D * ca AS f3", "f2 * 0.01D + cb AS f4").toPandas().to_numpy(float)
    corr = np.corrcoef(x.T)
    values = sorted(np.linalg.svd((x - x.mean(0)) / x.std(0), compute_uv=False) ** 2, reverse=True)
    pca = QUERIES["pca_explained"](spark, FOLDER).orderBy("component").collect()
    assert [r["share"] for r in pca] == pytest.approx(list(np.array(values) / sum(values)))
    assert [r["cumulative"] for r in pca] == pytest.approx(list(np.cumsum(values) / sum(values)))
    r = QUERIES["factor_tests"](spark, FOLDER).first()
    n, p = len(x), 4
    assert r["chi_square"] == pytest.approx(-(n - 1 - (2 * p + 5) / 6) * math.log(np.linalg.det(corr))) and r["dof"] == 6
    inverse = np.linalg.inv(corr)
    pairs = [(i, j) for i in range(p) for j in range(p) if i != j]
    partial = sum(inverse[i, j] ** 2 / (inverse[i, i] * inverse[j, j]) for i, j in pairs)
    simple = sum(corr[i, j] ** 2 for i, j in pairs)
    assert r["kmo"] == pytest.approx(simple / (simple + partial))
    assert len(r["parameters"]) == max(1, sum(np.linalg.eigvalsh(corr) > 1)) and set(r["parameters"]) <= {"f1", "f2", "f3", "f4"}


def test_large_components_are_split(spark):
    from gridwright.config import Config

    config = Config(large_component=40, component_divider=20)
    rows = [(1, c, 1000 * c + i, float((i % 3) * 5000 + i), float(i % 7)) for c, n in ((1, 60), (2, 39), (3, 1)) for i in range(n)]
    got = clustering.components_to_clusters(spark.createDataFrame(rows, "plz int, component long, vid long, x double, y double"), ["plz"], config).collect()
    parts = defaultdict(set)
    for r in got:
        parts[r["kcid"]].add((r["component"], round(r["x"] / 5000)))
    assert len(got) == 99 and sorted(parts) == [1, 2, 3, 4]
    assert sorted(len(p) for k, p in parts.items() if {c for c, _ in p} == {1}) == [1, 1, 1]
    assert [k for k, p in parts.items() if {c for c, _ in p} == {2}] == [4]


def test_parts_of_a_component_come_from_a_sample(spark):
    from gridwright.config import Config

    config = Config(large_component=100, component_divider=100)
    rng = np.random.default_rng(4)
    spots = [(0.0, 0.0), (9000.0, 0.0), (0.0, 9000.0), (9000.0, 9000.0)]
    rows = [(p, 1, 1000 * p + i, float(spots[i % 4][0] + rng.integers(0, 50)), float(spots[i % 4][1] + rng.integers(0, 50))) for p in (1, 2) for i in range(400)]
    rows.append((*rows[-1][:2], 5000, *rows[-1][3:]))
    df = spark.createDataFrame(rows, "plz int, component long, vid long, x double, y double")
    for drawn in (50_000, 60):
        got = clustering.components_to_clusters(df, ["plz"], config, drawn).collect()
        assert len(got) == 801
        for p in (1, 2):
            parts = defaultdict(set)
            for r in got:
                if r["plz"] == p:
                    parts[r["kcid"]].add((round(r["x"] / 9000), round(r["y"] / 9000)))
            assert sorted(parts) == [1, 2, 3, 4] and all(len(x) == 1 for x in parts.values())


def test_centres_of_a_large_component_are_means_of_all_its_buildings(spark):
    from gridwright.config import Config

    config = Config(large_component=100, component_divider=60)
    rng = np.random.default_rng(11)
    xy = np.concatenate([rng.normal(c, 300.0, (n, 2)) for c, n in (((0, 0), 700), ((4000, 500), 250), ((1500, 3000), 90))]).round(1)
    rows = [(7, 1, i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    df = spark.createDataFrame(rows, "plz int, component long, vid long, x double, y double").repartition(5)
    got = clustering.components_to_clusters(df, ["plz"], config, 50).toPandas()
    found = clustering._centres(df.selectExpr("plz", "component", "1040L AS __n", "x", "y"), ["plz"], config).toPandas()
    assert sorted(got["vid"]) == list(range(1040)) and found["id"].nunique() == got["kcid"].nunique() == 17
    means = sorted(map(tuple, got.groupby("kcid")[["x", "y"]].mean().round(3).to_numpy()))
    assert means == sorted(map(tuple, found[["x", "y"]].round(3).to_numpy()))  # none comes from some of the buildings
    spread = lambda label, centres: ((xy - centres[label]) ** 2).sum()
    mine = found[["x", "y"]].to_numpy()
    assert spread(clustering._nearest_centre(xy, mine), mine) < 1.15 * spread(*clustering.kmeans(xy, 17, config.seed))
