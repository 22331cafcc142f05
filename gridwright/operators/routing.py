"""Street and network graphs: topology, shortest paths, trees, feeders, branch plans.

Paths run per group (postcode, cluster, grid) in grouped maps, so groups are the unit of parallel
work and one group's edges must fit a task; components are bounded by the k-means split before.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.checkpoints import cut
from gridwright.functions import geometry as G
from gridwright.operators import hierarchy
from gridwright.operators.groups import dealt
from gridwright.operators.numbering import numbered


def topology(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices: id, x, y; ways with source, target, cost, reverse_cost) from line ends, snapped to millimetres."""
    ends = ways.select(G.start_point(F.col("line")).alias("a"), G.end_point(F.col("line")).alias("b"))
    at = lambda p: F.struct(F.round(p["x"], 3).alias("x"), F.round(p["y"], 3).alias("y"))
    points = ends.select(at(F.col("a")).alias("p")).union(ends.select(at(F.col("b")).alias("p"))).distinct().select("p.x", "p.y")
    vertices = cut(numbered(points, ["x", "y"]).select("id", "x", "y"))
    key = vertices.select(F.col("id"), F.col("x").alias("__x"), F.col("y").alias("__y"))
    out = ways.withColumn("__a", at(G.start_point(F.col("line")))).withColumn("__b", at(G.end_point(F.col("line"))))
    out = out.join(key.withColumnRenamed("id", "source"), (F.col("__a.x") == F.col("__x")) & (F.col("__a.y") == F.col("__y"))).drop("__x", "__y")
    out = out.join(key.withColumnRenamed("id", "target"), (F.col("__b.x") == F.col("__x")) & (F.col("__b.y") == F.col("__y"))).drop("__x", "__y", "__a", "__b")
    cost = G.line_length(F.col("line"))
    return vertices, out.withColumn("cost", cost).withColumn("reverse_cost", cost)


def _adjacent(edges: pd.DataFrame) -> dict[int, list[tuple[int, float]]]:
    out = defaultdict(list)
    for s, t, c in zip(edges["source"].tolist(), edges["target"].tolist(), edges["cost"].tolist(), strict=True):
        out[s].append((t, c))
        out[t].append((s, c))
    return out


def shortest(adjacent: dict | Arcs, start: int, reach: float = np.inf, wanted: set[int] | None = None) -> dict[int, tuple[float, int, int]]:
    """node -> (cost, node before, hops) of the cheapest path below ``reach``; equal costs go to the smaller node before.

    With ``wanted`` the walk ends when it has met all of these, and only they and what lies on their paths are final.
    """
    best = {start: (0.0, start, 0)}
    heap, done, left = [(0.0, start)], set(), None if wanted is None else set(wanted)
    while heap and (left is None or left):
        cost, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        if left is not None:
            left.discard(node)
        for other, c in adjacent.get(node, ()):
            new = (cost + c, node, best[node][2] + 1)
            old = best.get(other)
            if other not in done and new[0] < reach and (old is None or new[:2] < old[:2]):
                best[other] = new
                heapq.heappush(heap, (new[0], other))
    return best


class Arcs:
    """The undirected edges of a group as sorted arrays, a small share of what lists of neighbours take."""

    def __init__(self, source: np.ndarray, target: np.ndarray, cost: np.ndarray, points: np.ndarray):
        self.ids = np.unique(np.concatenate([source, target, points]))
        a, b = (np.searchsorted(self.ids, x) for x in (source, target))
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(a, kind="stable")
        self.to, self.cost = b[order], np.concatenate([cost, cost])[order]
        self.first = np.searchsorted(a[order], np.arange(len(self.ids) + 1))
        self._near: dict[int, list[tuple[int, float]]] = {}

    def get(self, node: int, default=()):
        """(neighbour, cost) of each arc that leaves a node, as ids; lists are made of those that are asked for."""
        if node not in self._near:
            i = int(np.searchsorted(self.ids, node))
            arcs = slice(self.first[i], self.first[i + 1]) if i < len(self.ids) and self.ids[i] == node else slice(0)
            self._near[node] = list(zip(self.ids[self.to[arcs]].tolist(), self.cost[arcs].tolist(), strict=True))
        return self._near[node] or default

    def nearness(self, points: np.ndarray, reach: float = np.inf) -> np.ndarray:
        """Cost from the nearest of the points (which are among the ids) to each of the ids; infinite from ``reach`` on."""
        best, wave = np.full(len(self.ids), np.inf), np.searchsorted(self.ids, points)
        best[wave] = 0.0
        while len(wave):
            of, arc = self.around(wave)
            cost, to = best[wave][of] + self.cost[arc], self.to[arc]
            near = (cost < best[to]) & (cost < reach)
            np.minimum.at(best, to[near], cost[near])
            wave = np.unique(to[near])
        return best

    def within(self, points: np.ndarray, reach: float) -> np.ndarray:
        """Nodes nearer than ``reach`` to any of the points."""
        return self.ids[np.isfinite(self.nearness(points, reach))]

    def around(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(for each arc that leaves ``nodes`` the place of its node in them, the arc)."""
        n = self.first[nodes + 1] - self.first[nodes]
        of = np.repeat(np.arange(len(nodes)), n)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.first[nodes][of]

    def walked(self, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node, cost, node before, hops) of what ``start`` reaches, as ``shortest``, in waves over the nodes that became nearer. Costs must be positive."""
        at = int(np.searchsorted(self.ids, start))
        best = np.full(len(self.ids), np.inf)
        best[at], wave = 0.0, np.array([at])
        while len(wave):
            of, arc = self.around(wave)
            cost, to = best[wave][of] + self.cost[arc], self.to[arc]
            near = cost < best[to]
            np.minimum.at(best, to[near], cost[near])
            wave = np.unique(to[near])
        reached = np.flatnonzero(np.isfinite(best))
        before = np.full(len(self.ids), len(self.ids))
        for low in range(0, len(reached), LOOKED):
            nodes = reached[low : low + LOOKED]
            of, arc = self.around(nodes)
            tight = best[nodes][of] + self.cost[arc] == best[self.to[arc]]
            np.minimum.at(before, self.to[arc[tight]], nodes[of[tight]])
        before[at] = at
        hops, jump = (before != np.arange(len(self.ids))).astype(np.int32), before.copy()
        hops[before == len(self.ids)] = 0
        while (jump[reached] != at).any():
            hops[reached] += hops[jump[reached]]
            jump[reached] = jump[jump[reached]]
        return self.ids[reached], best[reached], self.ids[before[reached]], hops[reached]


#: Nodes whose arcs are looked at together.
LOOKED = 1 << 18


def _schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def _tagged(edges: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """by, k, a, b, x: edges (k 0: source, target, cost) and points (k 1: vid) in one table, so that a group's task streams both."""
    none = F.lit(None).cast("long")
    of = edges.select(*by, F.lit(0).alias("k"), F.col("source").cast("long").alias("a"), F.col("target").cast("long").alias("b"), F.col("cost").cast("double").alias("x"))
    return of.unionByName(points.select(*by, F.lit(1).alias("k"), F.col("vid").cast("long").alias("a"), none.alias("b"), F.lit(None).cast("double").alias("x")))


def _group(batches: Iterator[pa.RecordBatch]) -> tuple[pd.DataFrame, np.ndarray]:
    """(edges: source, target, cost; distinct points, ascending) of a group of ``_tagged`` rows, whose batches become arrays one by one."""
    edges, points = [], [np.zeros(0, np.int64)]
    for batch in batches:
        k, a, b, x = (batch.column(c) for c in ("k", "a", "b", "x"))
        edge = pc.and_(pc.equal(k, 0), pc.and_(pc.is_valid(a), pc.and_(pc.is_valid(b), pc.is_valid(x))))
        edges.append([c.filter(edge).to_numpy() for c in (a, b, x)])
        points.append(a.filter(pc.and_(pc.equal(k, 1), pc.is_valid(a))).to_numpy())
    kinds = (np.int64, np.int64, float)
    columns = [np.concatenate([np.zeros(0, t), *(e[i] for e in edges)]) for i, t in enumerate(kinds)]
    good = ~np.isnan(columns[2])
    return pd.DataFrame({n: c[good] for n, c in zip(("source", "target", "cost"), columns, strict=True)}, copy=False), np.unique(np.concatenate(points))


def _batch(by: list[str], key: tuple, columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    fixed = {name: pa.repeat(value, n) for name, value in zip(by, key, strict=True)}
    return pa.RecordBatch.from_pydict({**fixed, **{c: pa.array(v) for c, v in columns.items()}})


def _lists(values: np.ndarray | pa.Array, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


def costs(edges: DataFrame, starts: DataFrame, by: list[str], targets: DataFrame | None = None, reach: float = np.inf) -> DataFrame:
    """by, start_vid, end_vid, agg_cost, before, hops from each start (by, vid) to all nodes it reaches, or to the targets (by, vid).

    Undirected. Serves one-to-many distances and consumer-to-transformer costs (starts: the transformers);
    ``cost_matrix`` serves all pairs, ``hierarchy.pair_costs`` given ones. A start without edges reaches itself. Nodes at ``reach`` or farther
    are left out and not walked past. Each start's rows leave the task before the next start is walked.
    """

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, points = _group(batches)
        least = e["cost"].min() if len(e) else 1.0
        whole = np.isinf(reach) and least > 0 and e["cost"].sum() + least > e["cost"].sum()  # every step adds to a cost, then
        arcs = Arcs(*(e[c].to_numpy() for c in ("source", "target", "cost")), points) if whole else None
        adjacent = {} if whole else _adjacent(e)
        del e
        for v in points.tolist():
            if whole:
                nodes, cost, before, hops = arcs.walked(v)
            else:
                found = shortest(adjacent, v, reach)
                nodes = np.fromiter(found, np.int64, len(found))
                cost, before, hops = (np.array(x) for x in zip(*found.values(), strict=True))
            yield _batch(by, key, {"start_vid": np.full(len(nodes), v), "end_vid": nodes, "agg_cost": cost.astype(float), "before": before.astype(np.int64), "hops": hops.astype(np.int32)})

    schema = f"{_schema(edges, by)}, start_vid long, end_vid long, agg_cost double, before long, hops int"
    out = dealt(_tagged(edges, starts, by), by).groupBy(*by).applyInArrow(run, schema)
    return out if targets is None else out.join(targets.select(*by, F.col("vid").alias("end_vid")).distinct(), [*by, "end_vid"], "left_semi").select(*out.columns)


def distances(edges: pd.DataFrame, points: np.ndarray, cells: int = hierarchy.CELLS) -> np.ndarray:
    """Distances between all points (ascending ids) over undirected edges source, target, cost; infinite where there is no way.

    The graph is contracted, and what the points reach in it going up is swept from some of them at a time: points are hubs like
    other nodes, so few of them in a large graph do not become neighbours of each other.
    """
    node, hub, cost, level = hierarchy.contracted(edges["source"].to_numpy(np.int64), edges["target"].to_numpy(np.int64), edges["cost"].to_numpy(float))
    at = hierarchy.Upward(node, hub, level).rows(points)
    return hierarchy.between(hierarchy.Sweeps(node[at], hub[at], cost[at], level[at], points), points, cells)


#: Pairs that one block of ``cost_matrix`` holds, about.
BLOCK = 1 << 14


def cost_matrix(edges: DataFrame, points: DataFrame, by: list[str], core: int = hierarchy.CORE, cells: int = hierarchy.CELLS) -> DataFrame:
    """by, start_vid, end_vid, agg_cost between all points (by, vid) of a group that reach each other, itself included.

    A group of any size is dealt to tasks by its starts; nothing holds a matrix of all its pairs. Tasks give blocks of starts and ends
    with the costs of all their pairs in one array, which Spark takes apart: a pair is no row before that.
    """

    def run(key: tuple, ends: np.ndarray, starts: np.ndarray, _: np.ndarray, sweeps: hierarchy.Sweeps) -> Iterator[pa.RecordBatch]:
        at = np.searchsorted(sweeps.ids, ends)
        at = at[np.argsort(sweeps.place[at])]
        to, step = sweeps.ids[at], sweeps.step(cells)
        for low in range(0, len(starts), step):
            some = ends[starts[low : low + step]]
            cost = sweeps.from_starts(some, at=at)
            finite = np.isfinite(cost)
            n = finite.sum(axis=1)
            if finite.all():
                cuts = np.append(np.arange(0, len(to), max(1, BLOCK // len(some))), len(to))
                starting, ending = (np.tile(some, len(cuts) - 1), np.arange(len(cuts)) * len(some)), (to, cuts)
            else:  # each end with those that reach it
                cuts = np.arange(np.count_nonzero(n) + 1)
                starting, ending = (np.broadcast_to(some, cost.shape)[finite], np.append(0, np.cumsum(n[n > 0]))), (to[n > 0], cuts)
                cost, n = cost[finite], n[n > 0]
            each = _lists(cost.ravel(), np.append(0, np.cumsum(n)))
            yield _batch(by, key, {"starts": _lists(*starting), "ends": _lists(*ending), "costs": _lists(each, cuts)})

    blocks = hierarchy.swept(edges, points, by, run, "starts array<long>, ends array<long>, costs array<array<double>>", core, cells)
    rows = blocks.select(*by, "starts", "ends", F.posexplode("costs").alias("__gw_end", "costs"))
    pairs = rows.select(*by, "starts", F.col("ends")[F.col("__gw_end")].alias("end_vid"), F.posexplode("costs").alias("__gw_start", "agg_cost"))
    return pairs.select(*by, F.col("starts")[F.col("__gw_start")].alias("start_vid"), "end_vid", "agg_cost")


def paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """by, end_vid, agg_cost, path: nodes from the group's start to each end."""

    def run(key: tuple, e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        adjacent, rows = _adjacent(e), []
        for start in sorted(set(p.loc[p["role"] == 0, "vid"].tolist())):
            best = shortest(adjacent, start)
            for end in sorted(set(p.loc[p["role"] == 1, "vid"].tolist())):
                if end in best:
                    walk = [end]
                    while walk[-1] != start:
                        walk.append(best[walk[-1]][1])
                    rows.append((*key, end, best[end][0], walk[::-1]))
        return pd.DataFrame(rows, columns=[*by, "end_vid", "agg_cost", "path"])

    points = starts.select(*by, "vid", F.lit(0).alias("role")).unionByName(ends.select(*by, "vid", F.lit(1).alias("role")))
    return dealt(edges.select(*by, "source", "target", "cost"), by).groupBy(*by).cogroup(dealt(points, by).groupBy(*by)).applyInPandas(run, f"{_schema(edges, by)}, end_vid long, agg_cost double, path array<long>")


#: Whole metres that stand for no way at all.
NO_WAY = 10**9


def metres(matrix: np.ndarray) -> np.ndarray:
    """Distances cut to whole metres."""
    return np.where(np.isfinite(matrix), matrix, NO_WAY).astype(np.int32)


# --- trees -------------------------------------------------------------------------------------
class Forest:
    """Nodes with a parent or none, in levels from the roots down."""

    def __init__(self, node, parent):
        """node, parent: of equal length; NaN or None for no parent. A parent that is no node itself is a root."""
        node, parent = pd.Series(node).astype("Int64"), pd.Series(parent).astype("Int64")
        if node.duplicated().any():
            raise RuntimeError("the parents are no forest")
        self.ids = np.union1d(node.to_numpy(np.int64), parent.dropna().to_numpy(np.int64))
        self.up = np.full(len(self.ids), -1)
        has = parent.notna().to_numpy()
        self.up[self.index(node[has])] = self.index(parent[has])
        self.depth, jump = (self.up >= 0).astype(np.int64), self.up.copy()
        for _ in range(64):
            on = np.flatnonzero(jump >= 0)
            if not len(on):
                break
            self.depth[on] += np.where(jump[on] >= 0, self.depth[jump[on]], 0)
            jump[on] = jump[jump[on]]
        else:
            raise RuntimeError("the parents are no forest")
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1) if len(order) else []

    def index(self, nodes) -> np.ndarray:
        """Places of nodes; -1 for those that are not in the forest."""
        wanted = np.asarray(nodes, np.int64)
        at = np.minimum(np.searchsorted(self.ids, wanted), max(0, len(self.ids) - 1))
        return np.where(self.ids[at] == wanted, at, -1) if len(self.ids) else np.full(len(wanted), -1)

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sums over each node and all below it."""
        out = values.copy()
        for level in reversed(self.levels[1:]):
            np.add.at(out, self.up[level], out[level])
        return out

    def above(self, values: np.ndarray) -> np.ndarray:
        """Sums over each node and all above it."""
        out = values.copy()
        for level in self.levels[1:]:
            out[level] += out[self.up[level]]
        return out


def subtree_sums(parents: DataFrame, loads: DataFrame, by: list[str], values: list[str], also: list[str] | None = None) -> DataFrame:
    """by, node, also, values: sums of ``values`` over each node's subtree, per ``also`` (a category, say), where it holds any load.

    parents: by, node, parent (root: null); loads: by, node, also..., values... . One pass over a group's levels:
    the work is the group's size times its categories, whatever its depth. A null value counts as 0.
    """
    also = also or []

    def run(key: tuple, p: pd.DataFrame, l: pd.DataFrame) -> pd.DataFrame:
        names = [*by, "node", *also, *values]
        if p.empty or l.empty:
            return pd.DataFrame({n: [] for n in names})
        forest = Forest(p["node"], p["parent"])
        kinds = l[also].drop_duplicates().reset_index(drop=True) if also else pd.DataFrame(index=[0])
        code = l[also].merge(kinds.reset_index(), on=also, how="left")["index"].to_numpy() if also else np.zeros(len(l), int)
        at = forest.index(l["node"])
        ok = at >= 0
        shape = (len(forest.ids), len(kinds))
        held = np.zeros(shape, np.int64)
        np.add.at(held, (at[ok], code[ok]), 1)
        node, kind = np.nonzero(forest.below(held))
        out = {"node": forest.ids[node], **{c: kinds[c].to_numpy()[kind] for c in also}}
        for v in values:
            column = l[v].fillna(0).to_numpy()
            own = np.zeros(shape, np.int64 if np.issubdtype(column.dtype, np.integer) else float)
            np.add.at(own, (at[ok], code[ok]), column[ok])
            out[v] = forest.below(own)[node, kind]
        found = pd.DataFrame(out)
        for name, value in zip(by, key, strict=True):
            found.insert(0, name, value)
        return found[names]

    whole = {"tinyint", "smallint", "int", "bigint"}
    sums = ", ".join(f"{v} {'long' if loads.schema[v].dataType.simpleString() in whole else 'double'}" for v in values)
    kinds = "".join(f", {_schema(loads, [c])}" for c in also)
    rows = loads.select(*by, "node", *also, *[F.col(v).cast("long" if loads.schema[v].dataType.simpleString() in whole else "double").alias(v) for v in values])
    return dealt(parents.select(*by, "node", "parent"), by).groupBy(*by).cogroup(dealt(rows, by).groupBy(*by)).applyInPandas(run, f"{_schema(parents, by)}, node long{kinds}, {sums}")


def path_sums(steps: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """by, node, values, first, second, steps: sums of ``values`` over the way from the root to each node.

    steps: by, node, parent, values... (of the step into the node; null counts as 0). first and second are
    the nodes one and two steps below the root on that way, null where it is shorter; steps is its length.
    """

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(p["node"], p["parent"])
        at = forest.index(p["node"])
        out = {"node": forest.ids}
        for v in values:
            own = np.zeros(len(forest.ids))
            own[at] = p[v].fillna(0).to_numpy(float)
            out[v] = forest.above(own)
        for depth, name in ((1, "first"), (2, "second")):
            own = np.where(forest.depth == depth, np.arange(len(forest.ids)) + 1, 0)
            place = forest.above(own)
            out[name] = pd.array(np.where(place > 0, forest.ids[np.maximum(place - 1, 0)], 0), "Int64")
            out[name][place == 0] = pd.NA
        out["steps"] = forest.depth
        found = pd.DataFrame(out)
        for name, value in zip(by, key, strict=True):
            found.insert(0, name, value)
        return found[[*by, "node", *values, "first", "second", "steps"]]

    sums = ", ".join(f"{v} double" for v in values)
    return dealt(steps.select(*by, "node", "parent", *[F.col(v).cast("double").alias(v) for v in values]), by).groupBy(*by).applyInPandas(run, f"{_schema(steps, by)}, node long, {sums}, first long, second long, steps long")


def bfs_parents(edges: DataFrame, roots: DataFrame, by: list[str]) -> DataFrame:
    """by, node, parent, hops, dist of the breadth-first tree from each group's root (by, vid); smaller nodes first."""

    def run(key: tuple, e: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        adjacent, rows = _adjacent(e), []
        for root in sorted(set(r["vid"].tolist())):
            seen, layer = {root}, [(root, None, 0, 0.0)]
            while layer:
                rows += [(*key, *x) for x in layer]
                following = []
                for node, _, hops, dist in layer:
                    for other, c in sorted(adjacent.get(node, ())):
                        if other not in seen:
                            seen.add(other)
                            following.append((other, node, hops + 1, dist + c))
                layer = following
        out = pd.DataFrame(rows, columns=[*by, "node", "parent", "hops", "dist"])
        out["parent"] = out["parent"].astype("Int64")
        return out

    return dealt(edges.select(*by, "source", "target", "cost"), by).groupBy(*by).cogroup(dealt(roots.select(*by, "vid"), by).groupBy(*by)).applyInPandas(run, f"{_schema(edges, by)}, node long, parent long, hops int, dist double")


def nearest_source(edges: DataFrame, sources: DataFrame, by: list[str]) -> DataFrame:
    """by, node, source_id, hops: the source (by, vid, place) that reaches a node in the fewest hops, earlier places first."""
    unit = edges.withColumn("cost", F.lit(1.0))
    met = costs(unit, sources, by).join(sources.select(*by, F.col("vid").alias("start_vid"), "place"), [*by, "start_vid"])
    best = Window.partitionBy(*by, "end_vid").orderBy("agg_cost", "place", "start_vid")
    return met.withColumn("__at", F.row_number().over(best)).where("__at = 1").select(*by, F.col("end_vid").alias("node"), F.col("start_vid").alias("source_id"), F.col("agg_cost").cast("int").alias("hops"))


def active_edges(lines: DataFrame, switches: DataFrame, by: list[str]) -> DataFrame:
    """Lines in service without an open line switch, as by, source, target, cost (km)."""
    opened = switches.where((F.col("et") == "l") & ~F.col("closed")).select(*by, F.col("element").alias("line_id"))
    out = lines.where(F.coalesce(F.col("in_service"), F.lit(True))).join(opened, [*by, "line_id"], "left_anti")
    return out.select(*by, F.col("from_bus").cast("long").alias("source"), F.col("to_bus").cast("long").alias("target"), F.col("length_km").cast("double").alias("cost"))


# --- feeders -----------------------------------------------------------------------------------
class Neighbours:
    """Distinct neighbours of a group's nodes in the order of its edges, as arrays: ``near[node]`` lists them, ``ends`` counts a node's edges."""

    def __init__(self, source: np.ndarray, target: np.ndarray):
        self.ids, flat = np.unique(np.concatenate([source, target]), return_inverse=True)
        a, b = np.split(flat, 2)
        self.degree = np.bincount(flat, minlength=len(self.ids))
        a, b, edge = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.arange(len(a)), 2)
        order = np.lexsort((edge, b, a))
        first = np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))[: len(order)]
        order = order[first]  # of parallel edges the first
        order = order[np.lexsort((edge[order], a[order]))]
        self.to = b[order]
        self.first = np.searchsorted(a[order], np.arange(len(self.ids) + 1))

    def at(self, node: int) -> int:
        """Place of a node, or -1."""
        i = int(np.searchsorted(self.ids, node))
        return i if i < len(self.ids) and self.ids[i] == node else -1

    def __contains__(self, node: int) -> bool:
        return self.at(node) >= 0

    def __getitem__(self, node: int) -> list[int]:
        i = self.at(node)
        return self.ids[self.to[self.first[i] : self.first[i + 1]]].tolist() if i >= 0 else []

    def ends(self, node: int) -> int:
        i = self.at(node)
        return int(self.degree[i]) if i >= 0 else 0

    def tree(self, root: int) -> np.ndarray:
        """Place of each node's parent in the breadth-first tree, earlier neighbours first; -1 for the root and what it does not reach."""
        at = self.at(root)
        parent, seen, layer = np.full(len(self.ids), -1), np.zeros(len(self.ids), bool), np.array([at])
        seen[at] = True
        while len(layer):
            n = self.first[layer + 1] - self.first[layer]
            of = np.repeat(layer, n)
            to = self.to[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[layer], n)]
            of, to = of[~seen[to]], to[~seen[to]]
            first = np.sort(np.unique(to, return_index=True)[1])
            layer = to[first]
            parent[layer], seen[layer] = of[first], True
        return parent


#: Kinds of buses that count in their own way.
HOUSE, CABINET = 1, 2


def count_feeders(near: Neighbours, root: int, kind_of, trafo: set, expand: bool = True) -> int:
    """Feeders of a grid: walk from the root past stubs to the first branching, then count what hangs on it.

    A house alone counts nothing, a distribution cabinet counts its children that are no such houses
    (one at least), anything else one. A grid with neighbours has one feeder at least.
    """
    if root not in near:
        return 0
    before, now, walked = None, root, set()
    while near.ends(now) == 1 and now not in walked:
        walked.add(now)
        before, now = now, near[now][0]
    while before is not None and near.ends(now) == 2:
        ahead = [n for n in near[now] if n != before]
        if not ahead or ahead[0] in walked:
            break
        walked.add(now)
        before, now = now, ahead[0]
    below = [n for n in near[now] if (n != before if before is not None else frozenset((now, n)) not in trafo)]
    alone = lambda node, up: kind_of(node) == HOUSE and not [x for x in near[node] if x != up]
    found = 0
    for n in below:
        if alone(n, now):
            continue
        found += max(1, sum(not alone(c, n) for c in near[n] if c != now)) if expand and kind_of(n) == CABINET else 1
    return max(found, 1) if below else 0


def count_terminal_feeders(near: Neighbours, root: int, kinds: np.ndarray, trafo: set, synthetic: bool = True) -> int:
    """Ends of the backbone's breadth-first tree below the first branching; real grids split only at cabinets. kinds: of each of the nodes."""
    if root not in near:
        return 0
    parent = near.tree(root)
    order = np.argsort(parent, kind="stable")
    order = order[parent[order] >= 0]
    first = np.searchsorted(parent[order], np.arange(len(parent) + 1))
    alone = (kinds == HOUSE) & (np.diff(first) == 0)
    now, up = near.at(root), -1
    while first[now + 1] - first[now] == 1:
        up, now = now, int(order[first[now]])
    below = [n for n in order[first[now] : first[now + 1]].tolist() if up >= 0 or frozenset((int(near.ids[now]), int(near.ids[n]))) not in trafo]
    held = order[~alone[order]]  # children that go on, by parent
    start = np.searchsorted(parent[held], np.arange(len(parent) + 1))
    ahead = np.diff(start)
    ends = ahead == 0 if synthetic else (ahead == 0) | ((kinds != CABINET) & (ahead > 1))
    found, todo = 0, np.array([n for n in below if not alone[n]], np.int64)
    while len(todo):
        found += int(ends[todo].sum())
        on = todo[~ends[todo]]
        n = ahead[on]
        todo = held[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[on], n)]
    return max(found, 1) if below else found


def feeders(edges: DataFrame, buses: DataFrame, roots: DataFrame, trafos: DataFrame, by: list[str], recursive: bool = False, synthetic: bool = True) -> DataFrame:
    """by, feeder_lines. buses: by, bus, bus_type; roots: by, vid; trafos: by, hv_bus, lv_bus."""
    kind = F.when(F.col("bus_type") == "house_connection", HOUSE).when(F.col("bus_type") == "kvs", CABINET).otherwise(0)
    row = lambda df, k, a, b, kind=F.lit(0): df.select(*by, F.lit(k).alias("k"), a.cast("long").alias("a"), b.cast("long").alias("b"), kind.alias("kind"))
    none, c = F.lit(None), F.col
    parts = row(edges, 0, c("source"), c("target")).unionByName(row(buses, 1, c("bus"), none, kind)).unionByName(row(roots, 2, c("vid"), none)).unionByName(row(trafos, 3, c("hv_bus"), c("lv_bus")))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        k = table.column("k").to_numpy()
        a, b, kind = (pc.fill_null(table.column(x), 0).to_numpy() for x in ("a", "b", "kind"))
        near = Neighbours(a[k == 0], b[k == 0])
        kinds, bus = np.zeros(len(near.ids), np.int8), np.flatnonzero(k == 1)
        at = np.minimum(np.searchsorted(near.ids, a[bus]), max(0, len(near.ids) - 1))
        known = near.ids[at] == a[bus] if len(near.ids) else np.zeros(len(bus), bool)
        kinds[at[known]] = kind[bus[known]]
        trafo = {frozenset(x) for x in zip(a[k == 3].tolist(), b[k == 3].tolist(), strict=True)}
        root, n = a[k == 2], 0
        if len(root):
            kind_of = lambda node: kinds[near.at(node)]
            n = count_terminal_feeders(near, int(root.min()), kinds, trafo, synthetic) if recursive else count_feeders(near, int(root.min()), kind_of, trafo)
        return pa.table({**{name: pa.repeat(value, 1) for name, value in zip(by, key, strict=True)}, "feeder_lines": pa.array([n], pa.int32())})

    return dealt(parts, by).groupBy(*by).applyInArrow(run, f"{_schema(edges, by)}, feeder_lines int")


def root_bus(buses: DataFrame, trafos: DataFrame, grids: DataFrame, by: list[str]) -> DataFrame:
    """by, vid: the bus named LVbus, else the transformer's low side, the external grid's bus, the first bus."""
    named = buses.groupBy(*by).agg(F.min(F.when(F.col("name").contains("LVbus"), F.col("bus"))).alias("a"), F.min("bus").alias("d"))
    low = trafos.groupBy(*by).agg(F.min("lv_bus").alias("b"))
    ext = grids.groupBy(*by).agg(F.min("bus").alias("c"))
    return named.join(low, by, "left").join(ext, by, "left").select(*by, F.coalesce("a", "b", "c", "d").cast("long").alias("vid"))


# --- branches ----------------------------------------------------------------------------------
def plan_branches(nodes: list[int], distance: dict[int, float], before: dict[int, int], root: int, load_of, limit_ka: float, ka_per_kw: float, shared_m: float) -> list[tuple[int, int, list[int]]]:
    """(index, node it is attached to, nodes from the far end to the root side) of each branch.

    The farthest node left starts a branch, which takes the nodes on its path to the root while their
    simultaneous load stays below the strongest cable's current. A branch hangs on the first planned
    node above it, or on the root if that node is nearer to it than ``shared_m`` or there is none.
    """
    left, placed, out = list(nodes), set(), []

    def up(node: int) -> list[int]:
        walk = [node]
        while walk[-1] != root and walk[-1] in before and before[walk[-1]] != walk[-1]:
            walk.append(before[walk[-1]])
        return walk

    while left:
        if len(left) == 1:
            branch, hook = [left[0]], root
        else:
            far = max(left, key=lambda n: distance[n])
            open_nodes, branch = set(left), []
            for node in up(far):
                if node not in open_nodes:
                    continue
                branch.append(node)
                if load_of(branch) * ka_per_kw >= limit_ka:
                    if len(branch) > 1:
                        branch.pop()
                    break
            hook = next((n for n in up(branch[-1])[1:] if n in placed), root)
            if hook != root and distance.get(hook, 0.0) < shared_m:
                hook = root
        out.append((len(out), hook, branch))
        placed.update(branch)
        gone = set(branch)
        left = [n for n in left if n not in gone]
    return out


def _children(p: pd.DataFrame) -> tuple[list, dict]:
    """(roots, node -> children) of a group's parents, smaller nodes first."""
    children, roots = defaultdict(list), []
    for node, parent in sorted(zip(p["node"].tolist(), p["parent"].tolist(), strict=True), key=lambda x: x[0]):
        (roots if parent is None or parent != parent else children[int(parent)]).append(node)
    return roots, children


def hierarchy_layout(parents: DataFrame, by: list[str], width: float = 1.0, drop: float = 0.2) -> DataFrame:
    """by, node, px, py: each level of a tree on a line of its own, a node's children in its share of the width."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        roots, children = _children(p)
        rows, todo = [], [(r, (i + 0.5) * width / len(roots), width / len(roots), 0) for i, r in enumerate(roots)]
        while todo:
            node, x, share, level = todo.pop()
            rows.append((*key, node, x, -level * drop))
            for i, c in enumerate(children[node]):
                part = share / len(children[node])
                todo.append((c, x - share / 2 + (i + 0.5) * part, part, level + 1))
        return pd.DataFrame(rows, columns=[*by, "node", "px", "py"])

    return parents.groupBy(*by).applyInPandas(run, f"{_schema(parents, by)}, node long, px double, py double")


def radial_layout(parents: DataFrame, by: list[str], drop: float = 0.2) -> DataFrame:
    """by, node, px, py: the levels of ``hierarchy_layout`` as circles about the root, its width as the angle."""
    turn = 2 * float(np.pi)
    flat = hierarchy_layout(parents, by, turn, drop)
    angle = F.col("px") - turn / 2
    return flat.select(*by, "node", (F.col("py") * F.cos(angle) + 0.0).alias("px"), (F.col("py") * F.sin(angle) + 0.0).alias("py"))


def spaced_layout(parents: DataFrame, by: list[str], width: float = 1.0, height: float = 1.0) -> DataFrame:
    """by, node, px, py: the nodes of each level in equal distances, in the order of a walk that takes smaller children first."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        roots, children = _children(p)
        walk, todo, total = [], [(r, 0) for r in reversed(roots)], defaultdict(int)
        while todo:
            node, level = todo.pop()
            walk.append((node, level, total[level]))
            total[level] += 1
            todo += [(c, level + 1) for c in reversed(children[node])]
        drop = height / (max(total, default=0) + 1)
        return pd.DataFrame([(*key, node, (at + 0.5) / total[level] * width, -level * drop) for node, level, at in walk], columns=[*by, "node", "px", "py"])

    return parents.groupBy(*by).applyInPandas(run, f"{_schema(parents, by)}, node long, px double, py double")


def lv_subnets(buses: DataFrame, lines: DataFrame, switches: DataFrame, trafos: DataFrame, by: list[str]) -> DataFrame:
    """by, bus, subnet ('LV_' and three digits of the transformer's bus code) of each low-voltage bus that a transformer in service reaches; the nearest by hops."""
    from gridwright.functions.text import substation

    low = buses.withColumn("code", substation(F.col("chr_name"))).where("code is not null")
    e = active_edges(lines, switches, by)
    inside = low.select(*by, F.col("bus").cast("long").alias("vid"))
    e = e.join(inside.withColumnRenamed("vid", "source"), [*by, "source"], "left_semi").join(inside.withColumnRenamed("vid", "target"), [*by, "target"], "left_semi")
    t = trafos.where(F.coalesce(F.col("in_service"), F.lit(True))).select(*by, F.col("lv_bus").cast("long").alias("vid"), F.col("trafo_id").alias("place"))
    t = t.join(low.select(*by, F.col("bus").cast("long").alias("vid"), "code"), [*by, "vid"])
    met = nearest_source(e, t, by)
    return met.join(t.select(*by, F.col("vid").alias("source_id"), "code"), [*by, "source_id"]).select(*by, F.col("node").alias("bus"), F.concat(F.lit("LV_"), F.col("code")).alias("subnet"))


def mv_buses(buses: DataFrame, trafos: DataFrame, by: list[str]) -> DataFrame:
    """Buses of the medium-voltage grid: codes with a leading 5, and high sides of transformers."""
    high = trafos.select(*by, F.col("hv_bus").alias("bus")).distinct()
    return buses.where(F.col("chr_name").startswith("5")).select(*by, "bus").unionByName(high.join(buses.select(*by, "bus"), [*by, "bus"], "left_semi")).distinct()


