"""Element tables of grids (bus, line, load, trafo, ext_grid), their documents, and the power flow."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.config import CABLES, DEFAULT, Config
from gridwright.functions import electrical as E
from gridwright.functions.hashing import uniform
from gridwright.operators.cables import consumer_cable, feeder_cable
from gridwright.operators.clustering import Loads
from gridwright.operators.groups import dealt, shared_out
from gridwright.operators.routing import Arcs, Forest, plan_branches, shortest

#: Buses beside connection points, whose number is their vertex (0 and up), and houses, which have -2 - vertex.
LV_BUS, MV_BUS = -1, -(1 << 52)

BACKENDS: dict[str, str] = {"sweep": "gridwright.operators.network:power_flow", "newton": "gridwright.operators.network:meshed_power_flow"}


def backend(name: str = "sweep"):
    """The power-flow function of a registered name."""
    import importlib

    if name.strip().lower() not in BACKENDS:
        raise KeyError(f"no backend {name!r}; there are {sorted(BACKENDS)}")
    module, function = BACKENDS[name.strip().lower()].split(":")
    return getattr(importlib.import_module(module), function)


def branch_tree(edges: DataFrame, buildings: DataFrame, grids: DataFrame, by: list[str], config: Config = DEFAULT, over: list[str] | None = None) -> DataFrame:
    """by, node, parent, branch, kind ('consumer', 'feeder', 'root_feeder', 'unreached'), metres, load_kw of each cable of a grid.

    edges: by, source, target, cost, or with ``over`` (some of ``by``) one graph for all grids of these keys, which is walked from
    each transformer until its grid's points are met; buildings: by, vid (the building's vertex), connection_point, type, kw, homes, sim (its
    allocated load); grids: by, ont_vid. Branches are planned first, then every backbone cable gets the
    simultaneous load of all that hangs below it; the short line to a connection point at the transformer's own
    place is sized for all other points. A building that the transformer does not reach gets no
    cable but a row of kind 'unreached', without a parent.
    """

    over = over or by
    more = [c for c in by if c not in over]
    names = [*by, "node", "parent", "branch", "kind", "metres", "load_kw"]

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        e, b, g = (p[p["k"] == k] for k in range(3))
        roots = {tuple(k): int(a) for *k, a in g[[*more, "a"]][::-1].itertuples(index=False)}
        arcs, rows = Arcs(*(e[c].to_numpy(t) for c, t in (("a", np.int64), ("b", np.int64), ("x", float))), np.zeros(0, np.int64)), []
        for part, own in b.groupby(more) if more else [((), b)]:
            if part in roots and len(own):
                rows += planned((*key[:-1], *part), arcs, own, roots[part])
        out = pd.DataFrame(rows, columns=[*over, *more, *names[len(by) :]])[names]
        out["parent"] = out["parent"].astype("Int64")
        return out

    def planned(key: tuple, arcs: Arcs, b: pd.DataFrame, root: int) -> list[tuple]:
        best = shortest(arcs, root, wanted={*b["a"].astype(int), *b["b"].astype(int)})
        distance, before = {n: v[0] for n, v in best.items()}, {n: v[1] for n, v in best.items()}
        met = b["a"].isin(distance) & b["b"].isin(distance)
        lost, b = b[~met], b[met]
        points = sorted(set(b["b"].astype(int)))
        at = {v: i for i, v in enumerate(points)}
        loads = Loads(points, pd.DataFrame({"vid": b["b"].astype(int), "type": b["t"], "kw": b["x"], "homes": b["y"]}))
        of = lambda nodes: loads.total([at[n] for n in nodes])
        plans = plan_branches(points, distance, before, root, of, config.cable_limit_ka, 1 / (config.nominal_v * config.band_low * E.SQRT3), config.min_shared_prefix_m)
        parent, branch_of = {}, {}
        for index, hook, nodes in plans:
            for far, near in zip(nodes, nodes[1:], strict=False):
                parent[far] = near
            if nodes[-1] != root:
                parent[nodes[-1]] = hook
            for n in nodes:
                branch_of[n] = index
        forest = Forest(points, [parent.get(n) for n in points])
        at_node = forest.index(points)
        own = np.zeros((2, len(forest.ids), loads.p.shape[1]))
        own[0, at_node], own[1, at_node] = loads.p, loads.n
        if root in at:
            own[:, at_node[at[root]]] = 0  # what stands at the transformer's own place loads no cable
        power, units = (forest.below(x) for x in own)
        rows = []
        for n, i in zip(points, at_node.tolist(), strict=True):
            up = parent.get(n, root)
            metres = 1.0 if n == root else distance[n] - distance[up] if up != root else distance[n]
            rows.append((*key, n, up, branch_of[n], "root_feeder" if up == root else "feeder", max(metres, 0.0), loads.peak(power[i], units[i])))
        for vid, group in b.groupby("a"):
            point = int(group["b"].iloc[0])
            rows.append((*key, int(vid), point, branch_of[point], "consumer", max(distance[int(vid)] - distance[point], 0.0), float(group["z"].iloc[0])))
        for vid, group in lost.groupby("a"):
            rows.append((*key, int(vid), None, -1, "unreached", 0.0, float(group["z"].iloc[0])))
        return rows

    none = F.lit(None).cast("double")
    each, put = shared_out(edges, buildings, over, more)
    alike = [F.lit(0).cast(buildings.schema[c].dataType).alias(c) for c in more]
    by_share, buildings, grids = [*by, "__share"], put(buildings), put(grids)
    parts = each.where("source is not null and target is not null and cost is not null").select(*over, *alike, "__share", F.lit(0).alias("k"), F.col("source").cast("long").alias("a"), F.col("target").cast("long").alias("b"), F.col("cost").cast("double").alias("x"), none.alias("y"), none.alias("z"), F.lit("").alias("t"))
    parts = parts.unionByName(buildings.select(*by_share, F.lit(1).alias("k"), F.col("vid").cast("long").alias("a"), F.col("connection_point").cast("long").alias("b"), F.col("kw").alias("x"), F.col("homes").cast("double").alias("y"), F.col("sim").alias("z"), F.col("type").alias("t")))
    parts = parts.unionByName(grids.select(*by_share, F.lit(2).alias("k"), F.col("ont_vid").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), none.alias("x"), none.alias("y"), none.alias("z"), F.lit("").alias("t")))
    kinds = ", ".join(f"{n} {buildings.schema[n].dataType.simpleString()}" for n in by)
    keys = [*over, "__share"]
    return dealt(parts, keys).groupBy(*keys).applyInPandas(run, f"{kinds}, node long, parent long, branch int, kind string, metres double, load_kw double")


def sized_lines(tree: DataFrame, grids: DataFrame, by: list[str], config: Config = DEFAULT) -> DataFrame:
    """by, name, from_bus, to_bus, std_type, parallel, length_km, r/x/max_i of every cable of a branch tree; unreached buildings have none. Column arithmetic only."""
    t = tree.where("kind <> 'unreached'").join(grids.select(*by, "ont_vid"), by)
    house, backbone = consumer_cable(F.col("load_kw"), F.col("metres"), F.col("parent") == F.col("ont_vid"), config), feeder_cable(F.col("load_kw"), F.col("metres"), config)
    consumer = F.col("kind") == "consumer"
    t = t.withColumn("std_type", F.when(consumer, house[0]).otherwise(backbone[0])).withColumn("parallel", F.when(consumer, house[1]).otherwise(backbone[1]))
    data = {n: (r / 1000, x / 1000, i / 1000) for n, i, r, x, *_ in CABLES}
    value = lambda k: F.element_at(F.create_map(*[F.lit(v) for n, d in data.items() for v in (n, d[k])]), F.col("std_type"))
    name = F.substring(F.concat(F.when(consumer, "Line to ").otherwise("L"), F.col("node").cast("string")), 1, 15)
    start = F.when(F.col("kind") == "root_feeder", F.lit(LV_BUS).cast("long")).otherwise(F.col("parent"))
    end = F.when(consumer, -2 - F.col("node")).otherwise(F.col("node"))
    return t.select(*by, name.alias("name"), start.alias("from_bus"), end.alias("to_bus"), "branch", "kind", "std_type", "parallel", (F.col("metres") / 1000).alias("length_km"), value(0).alias("r_ohm_per_km"), value(1).alias("x_ohm_per_km"), value(2).alias("max_i_ka"), "load_kw", F.lit(True).alias("in_service"))


def buses(lines: DataFrame, loads: DataFrame, grids: DataFrame, by: list[str], config: Config = DEFAULT) -> DataFrame:
    """by, bus, name, vn_kv, zone. LVbus is LV_BUS, MVbus MV_BUS, a connection point its vertex, a house -2 - vertex: all apart."""
    kv = config.nominal_v / 1000
    fixed = F.array(F.struct(F.lit(LV_BUS).cast("long").alias("bus"), F.lit("LVbus 1").alias("name"), F.lit(kv).alias("vn_kv")), F.struct(F.lit(MV_BUS).cast("long").alias("bus"), F.lit("MVbus 1").alias("name"), F.lit(20.0).alias("vn_kv")))
    base = grids.select(*by, F.explode(fixed).alias("b")).select(*by, "b.*").withColumn("zone", F.lit(None).cast("string"))
    points = lines.where("kind <> 'consumer'").select(*by, F.col("to_bus").alias("bus"), F.concat(F.lit("Connection Nodebus "), F.col("to_bus").cast("string")).alias("name"), F.lit(kv).alias("vn_kv"), F.lit(None).cast("string").alias("zone"))
    houses = loads.select(*by, (-2 - F.col("vertice_id")).alias("bus"), F.concat(F.lit("Consumer Nodebus "), F.col("vertice_id").cast("string")).alias("name"), F.lit(kv).alias("vn_kv"), F.col("load_type").alias("zone"))
    return base.unionByName(points).unionByName(houses)


def load_table(loads: DataFrame, by: list[str], config: Config = DEFAULT) -> DataFrame:
    """by, bus, name, p_mw, q_mvar, max_p_mw, units of each consumer bus (vertice_id, sim, installed_kw, units)."""
    return loads.select(*by, (-2 - F.col("vertice_id")).alias("bus"), F.concat(F.lit("Load "), F.col("vertice_id").cast("string")).alias("name"), (F.col("sim") / 1000).alias("p_mw"), (E.reactive_kvar(F.col("sim"), config) / 1000).alias("q_mvar"), (F.col("installed_kw") / 1000).alias("max_p_mw"), "units")


def trafos(grids: DataFrame, by: list[str]) -> DataFrame:
    """by, hv_bus, lv_bus, name, unit_kva, parallel, sn_mva: the rating is the total, whatever the units."""
    name, unit, parallel = E.transformer_build(F.col("rated"))
    return grids.select(*by, F.lit(MV_BUS).cast("long").alias("hv_bus"), F.lit(LV_BUS).cast("long").alias("lv_bus"), name.alias("name"), unit.alias("unit_kva"), parallel.alias("parallel"), (F.col("rated") / 1000).alias("sn_mva"))


def ext_grids(grids: DataFrame, by: list[str]) -> DataFrame:
    return grids.select(*by, F.lit(MV_BUS).cast("long").alias("bus"), F.lit(1.0).alias("vm_pu"), F.lit("External grid").alias("name"))


def as_document(tables: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """by, grid: one JSON document per grid with an array of rows for each element table."""
    out = None
    for name, df in tables.items():
        cols = sorted(c for c in df.columns if c not in by)
        rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        out = rows if out is None else out.join(rows, by, "full")
    return out.select(*by, F.to_json(F.struct(*tables)).alias("grid"))


def from_document(docs: DataFrame, by: list[str], name: str, schema: str, doc: str = "grid") -> DataFrame:
    """Rows of one element table of stored documents."""
    parsed = F.from_json(F.col(doc), f"{name} array<struct<{schema}>>")[name]
    return docs.select(*by, F.explode(parsed).alias("r")).select(*by, "r.*")


def nets_of_json(docs: DataFrame, doc: str, schema: str) -> DataFrame:
    """place, net of documents that hold one net, a list of nets or a map of named nets."""
    text = F.trim(F.col(doc))
    one = F.from_json(text, schema)
    many = F.from_json(text, f"array<struct<{schema}>>")
    named = F.from_json(text, f"map<string, struct<{schema}>>")
    listed = F.transform(many, lambda n, i: F.struct(i.cast("string").alias("place"), n.alias("net")))
    first = schema.split()[0].split(":")[0]
    single = F.array(F.struct(F.lit("0").alias("place"), one.alias("net")))
    mapped = F.transform(F.map_entries(named), lambda e: F.struct(e["key"].alias("place"), e["value"].alias("net")))
    nets = F.when(text.startswith("["), listed).when(F.get_json_object(text, f"$.{first}").isNotNull(), single).otherwise(mapped)
    return docs.select(*[c for c in docs.columns if c != doc], F.explode(nets).alias("n")).select(*[c for c in docs.columns if c != doc], "n.place", "n.net")


# --- power flow --------------------------------------------------------------------------------
def sweep(order: list[int], parent: dict[int, int], impedance: dict[int, complex], demand: dict[int, complex], kv: float, source_pu: float = 1.0, rounds: int = 200, tolerance: float = 1e-9):
    """(voltages per unit by bus, current in kA into each bus, converged) of a radial grid by backward and forward sweeps.

    order: buses from the root down; demand in MVA; impedance (ohm) of the line into each bus.
    """
    base = kv * source_pu
    v = {n: complex(base) for n in order}
    current: dict[int, complex] = {}
    for _ in range(rounds):
        current = {n: (demand.get(n, 0j) / v[n]).conjugate() / np.sqrt(3) for n in order}
        for n in reversed(order[1:]):
            current[parent[n]] += current[n]
        gap = 0.0
        for n in order[1:]:
            new = v[parent[n]] - np.sqrt(3) * impedance[n] * current[n]
            gap = max(gap, abs(new - v[n]))
            v[n] = new
        if not np.isfinite(gap) or min(abs(x) for x in v.values()) < 0.3 * base:
            return {n: abs(x) / kv for n, x in v.items()}, {n: abs(c) for n, c in current.items()}, False
        if gap < tolerance * kv:
            return {n: abs(x) / kv for n, x in v.items()}, {n: abs(c) for n, c in current.items()}, True
    return {n: abs(x) / kv for n, x in v.items()}, {n: abs(c) for n, c in current.items()}, False


#: Unknowns' nodes up to which what elimination has left is solved as one dense matrix.
DENSE = 128


def eliminate(n: int, i: np.ndarray, j: np.ndarray, blocks: np.ndarray, own: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x (n, 2) of a sparse system of 2 x 2 blocks: ``own`` on the diagonal, ``blocks`` at (i, j), as often at (j, i), each place once.

    In every round the nodes that have fewer neighbours than all their neighbours have (ties by a hash) are eliminated together, so
    memory and work follow the lines and what elimination adds between neighbours; few nodes, or a dense rest, are solved at once.
    """
    own, x, right, done, left = own.copy(), np.zeros((n, 2)), right.copy(), [], np.arange(n)
    rank = np.random.default_rng(0).permutation(n)
    while len(left) > DENSE and 4 * len(i) < len(left) ** 2:
        degree = np.bincount(i, minlength=n)
        key = degree * n + rank
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, i, key[j])
        gone = np.zeros(n, bool)
        gone[left[key[left] < least[left]]] = True
        out = np.flatnonzero(gone)
        inverse = np.zeros_like(own)
        inverse[out] = np.linalg.inv(own[out])
        up, down = np.flatnonzero(gone[j]), np.flatnonzero(gone[i])  # (kept, gone) and (gone, kept): no two gone ones are neighbours
        up, down = up[np.argsort(j[up], kind="stable")], down[np.argsort(i[down], kind="stable")]
        done.append((out, inverse[out], i[down], j[down], blocks[down]))
        factor = blocks[up] @ inverse[j[up]]
        np.subtract.at(right, i[up], (factor @ right[j[up], :, None])[..., 0])
        count = degree[j[up]]  # each (kept, gone) meets every (gone, kept) of the same node
        first = np.searchsorted(i[down], j[up])
        a = np.repeat(np.arange(len(up)), count)
        b = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        u, v, added = i[up][a], j[down][b], -(factor[a] @ blocks[down][b])
        same = u == v
        np.add.at(own, u[same], added[same])
        stay = ~(gone[i] | gone[j])
        u, v, added = np.concatenate([i[stay], u[~same]]), np.concatenate([j[stay], v[~same]]), np.concatenate([blocks[stay], added[~same]])
        place, at = np.unique(u * n + v, return_inverse=True)
        blocks = np.zeros((len(place), 2, 2))
        np.add.at(blocks, at, added)
        i, j, left = place // n, place % n, left[~gone[left]]
    at = np.zeros(n, np.int64)
    at[left] = np.arange(len(left))
    dense = np.zeros((len(left), 2, len(left), 2))
    dense[at[i], :, at[j], :] = blocks
    dense[np.arange(len(left)), :, np.arange(len(left)), :] = own[left]
    x[left] = np.linalg.solve(dense.reshape(2 * len(left), -1), right[left].ravel()).reshape(-1, 2)
    for out, inverse, u, v, part in reversed(done):
        rest = right[out].copy()
        np.subtract.at(rest, np.searchsorted(out, u), (part @ x[v, :, None])[..., 0])
        x[out] = (inverse @ rest[..., None])[..., 0]
    return x


def newton(ends: np.ndarray, impedance: np.ndarray, demand: np.ndarray, kv: float, source_pu: float = 1.0, rounds: int = 40, tolerance: float = 1e-10) -> tuple[np.ndarray, bool]:
    """(complex voltages in kV of all buses, converged) of any connected grid, meshed or not, by Newton's method. Bus 0 holds the source.

    ends: the two buses of each line; impedance in ohm (lines of none count as a ten-millionth); demand in MVA.
    """
    n = len(demand)
    admittance = 1 / np.where(np.abs(impedance) < 1e-7, 1e-7, impedance)
    a, b = ends[:, 0], ends[:, 1]
    place, at = np.unique(np.concatenate([a * n + b, b * n + a]), return_inverse=True)
    i, j = place // n, place % n
    y, self_y = np.zeros(len(place), complex), np.zeros(n, complex)
    np.subtract.at(y, at, np.concatenate([admittance, admittance]))
    np.subtract.at(self_y, i, y)
    inner = (i > 0) & (j > 0)
    v = np.full(n, complex(kv * source_pu))
    block = lambda by_angle, by_size: np.stack([np.stack([by_angle.real, by_size.real], -1), np.stack([by_angle.imag, by_size.imag], -1)], -2)
    for _ in range(rounds):
        current = self_y * v
        np.add.at(current, i, y * v[j])
        gap = (v * current.conj() + demand)[1:]
        if n == 1 or np.abs(gap).max() < tolerance:
            return v, True
        unit = v / np.abs(v)
        between = block(-1j * v[i] * (y * v[j]).conj(), v[i] * (y * unit[j]).conj())
        own = block(1j * v * (current - self_y * v).conj(), v * (self_y * unit).conj() + current.conj() * unit)
        try:
            step = eliminate(n - 1, i[inner] - 1, j[inner] - 1, between[inner], own[1:], -np.column_stack([gap.real, gap.imag]))
        except np.linalg.LinAlgError:
            return v, False
        size, angle = np.abs(v), np.angle(v)
        size[1:], angle[1:] = size[1:] + step[:, 1], angle[1:] + step[:, 0]
        v = size * np.exp(1j * angle)
        if not np.isfinite(v).all():
            return v, False
    return v, False


def _flow(lines: DataFrame, loads: DataFrame, roots: DataFrame, by: list[str], config: Config, reactive: bool, meshed: bool) -> DataFrame:
    kv = config.nominal_v / 1000
    q = F.col("q_mvar") if reactive else F.lit(0.0)
    none = F.lit(None).cast("double")
    parts = lines.select(*by, F.lit(0).alias("k"), F.col("from_bus").cast("long").alias("a"), F.col("to_bus").cast("long").alias("b"), (F.col("length_km") * F.col("r_ohm_per_km") / F.col("parallel")).alias("x"), (F.col("length_km") * F.col("x_ohm_per_km") / F.col("parallel")).alias("y"), (F.col("max_i_ka") * F.col("parallel")).alias("z"))
    parts = parts.unionByName(loads.groupBy(*by, "bus").agg(F.sum("p_mw").alias("p"), F.sum(q).alias("q")).select(*by, F.lit(1).alias("k"), F.col("bus").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.col("p").alias("x"), F.col("q").alias("y"), none.alias("z")))
    parts = parts.unionByName(roots.select(*by, F.lit(2).alias("k"), F.col("vid").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), none.alias("x"), none.alias("y"), none.alias("z")))

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        names = [*by, "bus", "vm_pu", "parent", "i_ka", "loading_percent", "pl_mw", "converged", *(["va_degree"] if meshed else [])]
        root = p.loc[p["k"] == 2, "a"]
        if root.empty:
            return pd.DataFrame({n: [] for n in names})
        near = defaultdict(list)
        e = p[p["k"] == 0]
        for a, b, r, x, z in zip(e["a"].astype(int), e["b"].astype(int), e["x"], e["y"], e["z"], strict=True):
            near[a].append((b, complex(r, x), z))
            near[b].append((a, complex(r, x), z))
        order, parent, impedance, limit = [int(root.min())], {}, {}, {}
        for n in order:
            for other, z, most in near[n]:
                if other not in parent and other != order[0]:
                    parent[other], impedance[other], limit[other] = n, z, most
                    order.append(other)
        d = p[p["k"] == 1]
        demand = {int(a): complex(x, y) for a, x, y in zip(d["a"], d["x"], d["y"], strict=True)}
        angle = {}
        if meshed:
            at = {n: i for i, n in enumerate(order)}
            met = [(at[a], at[b], complex(r, x)) for a, b, r, x in zip(e["a"].astype(int), e["b"].astype(int), e["x"], e["y"], strict=True) if a in at and b in at and a != b]
            v, good = newton(np.array([m[:2] for m in met], int).reshape(-1, 2), np.array([m[2] for m in met]), np.array([demand.get(n, 0j) for n in order]), kv)
            vm, angle = {n: abs(v[i]) / kv for n, i in at.items()}, {n: float(np.degrees(np.angle(v[i]))) for n, i in at.items()}
            ka = {n: abs(v[at[n]] - v[at[parent[n]]]) / max(abs(impedance[n]), 1e-7) / np.sqrt(3) if n in parent else 0.0 for n in order}
        else:
            vm, ka, good = sweep(order, parent, impedance, demand, kv)
        rows = [(*key, n, float(vm[n]), parent.get(n), float(ka[n]), float(100 * ka[n] / limit[n]) if limit.get(n) else None, float(3 * ka[n] ** 2 * impedance[n].real) if n in impedance else 0.0, good, *([angle[n]] if meshed else [])) for n in order]
        out = pd.DataFrame(rows, columns=names)
        out["parent"] = out["parent"].astype("Int64")
        return out

    kinds = ", ".join(f"{n} {lines.schema[n].dataType.simpleString()}" for n in by)
    return dealt(parts, by).groupBy(*by).applyInPandas(run, f"{kinds}, bus long, vm_pu double, parent long, i_ka double, loading_percent double, pl_mw double, converged boolean{', va_degree double' if meshed else ''}")


def power_flow(lines: DataFrame, loads: DataFrame, roots: DataFrame, by: list[str], config: Config = DEFAULT, reactive: bool = False) -> DataFrame:
    """by, bus, vm_pu, parent, i_ka, loading_percent, pl_mw, converged: a row per bus, with the line that feeds it.

    lines: by, from_bus, to_bus, length_km, r_ohm_per_km, x_ohm_per_km, parallel, max_i_ka; loads: by,
    bus, p_mw (and q_mvar if ``reactive``); roots: by, vid. For radial grids: meshes are cut by the
    breadth-first tree, see ``meshed_power_flow``.
    """
    return _flow(lines, loads, roots, by, config, reactive, False)


def meshed_power_flow(lines: DataFrame, loads: DataFrame, roots: DataFrame, by: list[str], config: Config = DEFAULT, reactive: bool = False) -> DataFrame:
    """The columns of ``power_flow`` and va_degree, by Newton's method over all lines, loops included.

    parent, i_ka, loading_percent and pl_mw are those of the line on the breadth-first tree; ``line_currents`` has all lines.
    """
    return _flow(lines, loads, roots, by, config, reactive, True)


def line_currents(lines: DataFrame, flow: DataFrame, by: list[str], config: Config = DEFAULT) -> DataFrame:
    """The lines with i_ka, loading_percent and pl_mw from the voltages at both ends of ``meshed_power_flow``; null where an end has none."""
    kv = config.nominal_v / 1000
    end = lambda p: flow.select(*by, F.col("bus").alias(f"{p}_bus"), (F.col("vm_pu") * kv * F.cos(F.radians("va_degree"))).alias(f"__{p}_e"), (F.col("vm_pu") * kv * F.sin(F.radians("va_degree"))).alias(f"__{p}_f"))
    out = lines.join(end("from"), [*by, "from_bus"], "left").join(end("to"), [*by, "to_bus"], "left")
    per = F.col("length_km") / F.col("parallel")
    ohm = F.greatest(F.hypot(per * F.col("r_ohm_per_km"), per * F.col("x_ohm_per_km")), F.lit(1e-7))
    out = out.withColumn("i_ka", F.hypot(F.col("__from_e") - F.col("__to_e"), F.col("__from_f") - F.col("__to_f")) / ohm / E.SQRT3)
    out = out.withColumn("loading_percent", F.try_divide(100 * F.col("i_ka"), F.col("max_i_ka") * F.col("parallel"))).withColumn("pl_mw", 3 * F.pow("i_ka", F.lit(2)) * per * F.col("r_ohm_per_km"))
    return out.select(*lines.columns, "i_ka", "loading_percent", "pl_mw")


def circuit_metrics(flow: DataFrame, by: list[str]) -> DataFrame:
    """Least and greatest voltage, losses, greatest loading and status of each grid."""
    m = flow.groupBy(*by).agg(F.min("vm_pu").alias("min_vm_pu"), F.max("vm_pu").alias("max_vm_pu"), F.sum("pl_mw").alias("line_losses_mw"), F.max("loading_percent").alias("max_loading_percent"), F.bool_and("converged").alias("converged"))
    return m.withColumn("power_flow_status", E.power_flow_status(F.col("converged"), F.col("min_vm_pu"), F.col("max_vm_pu")))


def random_loads(bus: DataFrame, by: list[str], low: float, high: float, power_factor: float, seed: int, gaussian: bool = False) -> DataFrame:
    """Loads of an apparent power drawn per bus from a hash of grid and bus: uniform in [low, high], or normal with mean low and deviation high."""
    u = lambda k: uniform(*by, "bus", seed, k)
    sn = F.greatest(F.lit(0.0), low + high * F.sqrt(-2 * F.log(u(0))) * F.cos(2 * np.pi * u(1))) if gaussian else low + (high - low) * u(0)
    sin = float(np.sqrt(1 - power_factor**2))
    return bus.select(*by, "bus", sn.alias("s")).where("s > 0").select(*by, "bus", (F.col("s") * power_factor).alias("p_mw"), (F.col("s") * sin).alias("q_mvar"))
