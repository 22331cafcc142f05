"""Building clusters under load and distance limits, transformer places, and clusters of grids."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.checkpoints import cut
from gridwright.config import DEFAULT, RESIDENTIAL, SIM_FACTOR, Config
from gridwright.operators import hierarchy
from gridwright.operators.components import _least
from gridwright.operators.groups import broadcast_if_small, dealt, shared_out
from gridwright.operators.nearest import nearest
from gridwright.operators.numbering import numbered
from gridwright.operators.routing import NO_WAY, Arcs, metres

_CATEGORY = {**{t: "Residential" for t in RESIDENTIAL}, "Commercial": "Commercial", "Public": "Public"}


def peak(installed: dict[str, float], count: dict[str, float]) -> float:
    """Simultaneous load of installed power and units by main category."""
    return sum(p * (SIM_FACTOR[c] + (1 - SIM_FACTOR[c]) * count[c] ** -0.75) for c, p in installed.items() if p > 0 and count[c] > 0)


class Loads:
    """Installed power and units of each vertex and main category, added up for any set of vertices."""

    CATEGORIES = tuple(SIM_FACTOR)

    def __init__(self, vids: list[int], rows: pd.DataFrame):
        """rows: vid, type, kw, homes."""
        at = {v: i for i, v in enumerate(vids)}
        self.p, self.n = np.zeros((len(vids), len(self.CATEGORIES))), np.zeros((len(vids), len(self.CATEGORIES)))
        for vid, kind, kw, homes in rows[["vid", "type", "kw", "homes"]].itertuples(index=False):
            if vid in at and kind in _CATEGORY:
                j = self.CATEGORIES.index(_CATEGORY[kind])
                self.p[at[vid], j] += kw
                self.n[at[vid], j] += homes

    def peak(self, p: np.ndarray, n: np.ndarray) -> float:
        """Simultaneous load of installed power and units in the order of the categories."""
        return peak(dict(zip(self.CATEGORIES, p, strict=True)), dict(zip(self.CATEGORIES, n, strict=True)))

    def total(self, rows) -> float:
        return self.peak(self.p[rows].sum(0), self.n[rows].sum(0))


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(cluster, cluster, height, size) of each merge; new clusters are numbered from n. Equal heights merge the lowest rows first."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, name, alive = np.ones(n), list(range(n)), np.ones(n, bool)
    nearest = d.argmin(1) if n > 1 else np.zeros(n, int)
    least = d[np.arange(n), nearest] if n > 1 else np.full(n, np.inf)
    out = []
    for step in range(n - 1):
        i = int(np.where(alive, least, np.inf).argmin())
        j = int(nearest[i])
        i, j = min(i, j), max(i, j)
        a, b = sorted((name[i], name[j]))
        out.append((a, b, float(d[i, j]), int(size[i] + size[j])))
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])  # Lance-Williams, average
        d[i, :] = d[:, i] = merged
        d[i, i] = np.inf
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        name[i], alive[j] = n + step, False
        stale = np.flatnonzero(alive & ((nearest == i) | (nearest == j)))
        for k in {*stale.tolist(), i}:
            nearest[k] = d[k].argmin()
            least[k] = d[k, nearest[k]]
        better = alive & (d[i] < least)
        nearest[better], least[better] = i, d[i][better]
    return out


def cut_tree(merges: list[tuple[int, int, float, int]], n: int, clusters: int) -> list[list[int]]:
    """Members of the clusters that are left before the last ``clusters`` - 1 merges, each ascending, ordered by first member."""
    members = {i: [i] for i in range(n)}
    for step, (a, b, _, _) in enumerate(merges[: max(0, n - clusters)]):
        members[n + step] = members.pop(a) + members.pop(b)
    return sorted(sorted(m) for m in members.values())


def fits(members: list[int], distance: np.ndarray, reach: float) -> bool:
    """Whether one member is within reach of all others."""
    return len(members) <= 1 or reach <= 0 or distance[np.ix_(members, members)].max(1).min() <= reach


def accept(members: list[int], loads: Loads, distance: np.ndarray, sizes: list[int], reach: float) -> float | None:
    """Transformer size for a cluster, or None if it must be split.

    Too much load for one transformer and five members or more: split. No place within reach: split. A
    load below the largest size takes the smaller surplus of one transformer and a pair of the two
    largest with 15 % in hand. What is left keeps its load, rounded up.
    """
    load, top = loads.total(members), max(sizes)
    if load >= top and len(members) >= 5:
        return None
    if not fits(members, distance, reach):
        return None
    if load >= top:
        return float(math.ceil(load))
    single = min(k for k in sizes if k > load)
    pairs = [2 * k for k in sorted(sizes)[-2:] if 2 * k > 1.15 * load]
    return float(single if not pairs or min(pairs) > single else min(pairs))


def subtrees(merges: list[tuple[int, int, float, int]], n: int) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """(leaves in the order of the tree, the span of each cluster in it) of a linkage of n leaves."""
    children = {n + step: (a, b) for step, (a, b, _, _) in enumerate(merges)}
    size = {i: 1 for i in range(n)} | {n + step: m[3] for step, m in enumerate(merges)}
    order, span, todo = np.empty(n, np.int64), {}, [(n + len(merges) - 1 if merges else 0, 0)] if n else []
    while todo:
        node, at = todo.pop()
        span[node] = (at, at + size[node])
        if node < n:
            order[at] = node
        else:
            a, b = children[node]
            todo += [(a, at), (b, at + size[a])]
    return order, span


def building_clusters(distance: np.ndarray, vids: list[int], loads: Loads, sizes: list[int], reach: float) -> list[tuple[list[int], float]]:
    """(vertices, size) of each cluster: bisected by average linkage until each is accepted; ordered by smallest vertex.

    The halves of a cluster are its two branches in the one tree of the group, since the merges inside a
    cluster do not depend on what lies outside. A cluster that cannot be split any further (one or two
    members that are still refused) is accepted with its load rounded up.
    """
    n, out = len(vids), []
    merges = average_linkage(distance) if n > 1 else []
    order, span = subtrees(merges, n)
    todo = list(merges[-1][:2]) if merges else list(range(n))
    while todo:
        node = todo.pop()
        members = np.sort(order[slice(*span[node])])
        size = accept(members, loads, distance, sizes, reach)
        if size is None and node >= n:
            todo += merges[node - n][:2]
        else:
            out.append((sorted(vids[i] for i in members), size if size is not None else float(math.ceil(loads.total(members)))))
    return sorted(out, key=lambda c: c[0][0])


def best_place(distance: np.ndarray, kw: np.ndarray, reach: float) -> tuple[int, float, bool]:
    """(index, sum of distance times load, within reach of all others) of the point with the least sum, among those within reach if there are any; ties to the first."""
    moment, feasible = distance @ kw, distance.max(1) <= reach
    at = int(np.lexsort((np.round(moment, 6), ~feasible))[0])
    return at, float(moment[at]), bool(feasible[at])


def greenfield_clusters(edges: DataFrame, buildings: DataFrame, by: list[str], config: Config = DEFAULT, over: list[str] | None = None, core: int = hierarchy.CORE) -> DataFrame:
    """by, bcid (from 1), vid, rated, ont_vid: clusters of connection points, their sizes and the transformers' places.

    edges: by, source, target, cost, or with ``over`` (some of ``by``) one graph for all groups of these keys, which each group
    gets only as far as its points need it; buildings: by, vid, type, kw, homes, settlement_type. Distances are cut
    to whole metres. The dense matrix of a group's points is what bounds its size.
    """

    def run(key: tuple, h: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [*by, "bcid", "vid", "rated", "ont_vid"]
        if b.empty:
            return pd.DataFrame({n: [] for n in names})
        ids = np.unique(b["vid"].to_numpy(np.int64))
        sweeps = hierarchy.Sweeps(*(h[c].to_numpy() for c in ("node", "hub", "cost", "level")), ids)
        distance, kw = metres(hierarchy.between(sweeps, ids)), b.groupby("vid")["kw"].sum().to_numpy(float)
        sizes, at = list(config.capacities[int(b["settlement_type"].iloc[0])]), {v: i for i, v in enumerate(ids.tolist())}
        rows = []
        for k, (vids, size) in enumerate(building_clusters(distance, ids.tolist(), Loads(ids.tolist(), b), sizes, config.greenfield_reach_m), 1):
            own = [at[v] for v in vids]
            place = vids[best_place(distance[np.ix_(own, own)], kw[own], config.greenfield_reach_m)[0]]
            rows += [(*key, k, v, size, place) for v in vids]
        return pd.DataFrame(rows, columns=names)

    kinds = ", ".join(f"{n} {buildings.schema[n].dataType.simpleString()}" for n in by)
    own = buildings.select(*by, "vid", "type", "kw", "homes", "settlement_type")
    found = hierarchy.upward(edges, own, over or by, by, core)
    return dealt(found, by).groupBy(*by).cogroup(dealt(own, by).groupBy(*by)).applyInPandas(run, f"{kinds}, bcid int, vid long, rated double, ont_vid long")


def brownfield(costs: pd.DataFrame, loads: Loads, vids: list[int], trafos: list[int], sizes: list[int], reach: float) -> list[tuple[int, int, list[int], float]]:
    """(bcid -1, -2, ...; transformer; consumers; size): each consumer to the nearest transformer with room.

    Pairs come by cost, then consumer and transformer. A transformer is full when a consumer would lift
    its simultaneous load above the largest size; it takes no more then.
    """
    filling = Filling(loads, vids, sizes)
    for consumer, trafo, _ in costs[costs["agg_cost"] < reach].sort_values(["agg_cost", "start_vid", "end_vid"])[["start_vid", "end_vid", "agg_cost"]].itertuples(index=False):
        if filling.open(consumer, trafo) and not filling.offer(consumer, trafo) and len(filling.full) == len(trafos):
            break
    return filling.clusters()


class Filling:
    """Transformers that take one consumer after the other, until one would overload them."""

    def __init__(self, loads: Loads, vids: list[int], sizes: list[int]):
        self.loads, self.sizes, self.at = loads, sizes, {v: i for i, v in enumerate(vids)}
        self.got: dict[int, list[int]] = {}
        self.sums: dict[int, tuple] = {}
        self.full: set[int] = set()
        self.placed: set[int] = set()

    def open(self, consumer: int, trafo: int) -> bool:
        return trafo not in self.full and consumer not in self.placed and consumer in self.at

    def offer(self, consumer: int, trafo: int) -> bool:
        """Whether the transformer takes the consumer; if not, it is full from now on."""
        i, (p, n) = self.at[consumer], self.sums.get(trafo, (0.0, 0.0))
        p, n = p + self.loads.p[i], n + self.loads.n[i]
        if self.loads.peak(p, n) > max(self.sizes):
            self.full.add(trafo)
            return False
        self.sums[trafo] = p, n
        self.got.setdefault(trafo, []).append(int(consumer))
        self.placed.add(consumer)
        return True

    def clusters(self) -> list[tuple[int, int, list[int], float]]:
        """(bcid, transformer, consumers, size) by transformers."""
        load = {t: self.loads.peak(*self.sums[t]) for t in self.got}
        return [(-k, t, self.got[t], float(min((s for s in self.sizes if s > load[t]), default=max(self.sizes)))) for k, t in enumerate(sorted(self.got), 1)]


#: Metres by which sums of the same ways may differ at most, by the order of their parts.
SLACK = 1e-6


def fill(arcs: Arcs, trafos: list[int], filling: Filling, reach: float, inside: set[int] | None = None) -> None:
    """Fill transformers as the sequence of all pairs below ``reach`` (by cost, consumer, transformer) would, without making all pairs.

    Ways spread from all transformers at once, nearer ones first. A way waits at a node as long as an open transformer is nearer to
    that node, since all that lies beyond asks that one first; when it is full, what has waited goes on. So work grows with the nodes
    and with those in reach of a transformer that becomes full. With ``inside`` ways keep to these nodes.
    """
    heap = [(0.0, 0, t, t) for t in sorted(trafos)]  # (cost, 0: a way | 1: an offer, node, transformer)
    held: dict[int, dict[int, float]] = {}  # costs of the open transformers whose ways have passed a node
    waiting: dict[int, list[tuple[float, int]]] = {}
    passed: dict[int, list[int]] = {t: [] for t in trafos}
    while heap and len(filling.placed) < len(filling.at):
        cost, offer, node, trafo = heapq.heappop(heap)
        if trafo in filling.full:
            continue
        if offer:
            if filling.open(node, trafo) and not filling.offer(node, trafo):
                for u in passed.pop(trafo):
                    held[u].pop(trafo, None)
                    for c, t in waiting.pop(u, ()):
                        heapq.heappush(heap, (c, 0, u, t))
            continue
        here = held.setdefault(node, {})
        if here.get(trafo, np.inf) <= cost:
            continue
        if here and min(here.values()) < cost - SLACK:
            waiting.setdefault(node, []).append((cost, trafo))
            continue
        here[trafo] = cost
        passed[trafo].append(node)
        if node in filling.at:
            heapq.heappush(heap, (cost, 1, node, trafo))
        for other, c in arcs.get(node):
            if cost + c < reach and (inside is None or other in inside) and held.get(other, {}).get(trafo, np.inf) > cost + c:
                heapq.heappush(heap, (cost + c, 0, other, trafo))


def brownfield_nearest(edges: DataFrame, trafos: DataFrame, buildings: DataFrame, by: list[str], config: Config = DEFAULT, over: list[str] | None = None) -> DataFrame:
    """``brownfield_clusters`` of all pairs within reach, by ``fill`` instead of a table of pairs: by, bcid, trafo, vid, rated.

    edges: by, source, target, cost; trafos: by, vid; or with ``over`` (some of ``by``) one graph and its transformers for all groups of
    these keys, each of which fills them for itself. buildings: by, vid, type, kw, homes, settlement_type. A group looks no farther than
    a part of the reach at first: pairs within it come first in the sequence, so where all are placed then, the rest changes nothing.
    """
    over = over or by
    more = [c for c in by if c not in over]
    names, reach = [*by, "bcid", "trafo", "vid", "rated"], config.brownfield_reach_m

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        e, t, b = (p[p["k"] == k] for k in range(3))
        ids, rows = np.unique(t["a"].to_numpy(np.int64)), []
        arcs = Arcs(e["a"].to_numpy(np.int64), e["b"].to_numpy(np.int64), e["x"].to_numpy(float), np.concatenate([ids, b["a"].to_numpy(np.int64)]))
        for part, own in b.groupby(more) if more and len(b) else [((), b)]:
            if not len(own):
                continue
            own = own.rename(columns={"a": "vid", "x": "kw", "y": "homes", "t": "type"})
            vids, sizes = np.unique(own["vid"].to_numpy(np.int64)), list(config.capacities[int(own["s"].iloc[0])])
            loads = Loads(vids.tolist(), own)
            for far in (reach / 64, reach / 16, reach / 4, reach):
                near = arcs.within(vids, far + SLACK)
                filling = Filling(loads, vids.tolist(), sizes)
                fill(arcs, np.intersect1d(near, ids).tolist(), filling, far, set(near.tolist()))
                if len(filling.placed) == len(vids):
                    break
            rows += [(*key[:-1], *part, k, trafo, v, size) for k, trafo, vs, size in filling.clusters() for v in vs]
        return pd.DataFrame(rows, columns=[*over, *more, *names[len(by) :]])[names]

    c, none = F.col, F.lit(None)
    each, put = shared_out(edges.where("source is not null and target is not null and cost is not null").select(*over, F.lit(0).alias("k"), c("source").cast("long").alias("a"), c("target").cast("long").alias("b"), c("cost").cast("double").alias("x")).unionByName(trafos.where("vid is not null").select(*over, F.lit(1).alias("k"), c("vid").cast("long").alias("a"), none.cast("long").alias("b"), none.cast("double").alias("x"))), buildings, over, more)
    alike = [F.lit(0).cast(buildings.schema[m].dataType).alias(m) for m in more]
    parts = each.select(*over, *alike, "__share", "k", "a", "b", "x", none.cast("double").alias("y"), F.lit("").alias("t"), F.lit(0).alias("s"))
    parts = parts.unionByName(put(buildings.where("vid is not null")).select(*by, "__share", F.lit(2).alias("k"), c("vid").cast("long").alias("a"), none.cast("long").alias("b"), c("kw").cast("double").alias("x"), c("homes").cast("double").alias("y"), c("type").alias("t"), c("settlement_type").cast("int").alias("s")))
    kinds = ", ".join(f"{n} {buildings.schema[n].dataType.simpleString()}" for n in by)
    keys = [*over, "__share"]
    return dealt(parts, keys).groupBy(*keys).applyInPandas(run, f"{kinds}, bcid int, trafo long, vid long, rated double")


#: Pairs of a group up to which one task assigns them.
PAIRS = 200_000


def brownfield_clusters(costs: DataFrame, buildings: DataFrame, by: list[str], config: Config = DEFAULT, pairs: int = PAIRS) -> DataFrame:
    """by, bcid, trafo, vid, rated: consumers of existing transformers. costs: by, start_vid (consumer), end_vid (transformer), agg_cost.

    Groups of more than ``pairs`` pairs are assigned by ``brownfield_rounds``, with the same result.
    """

    def run(key: tuple, c: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [*by, "bcid", "trafo", "vid", "rated"]
        if c.empty or b.empty:
            return pd.DataFrame({n: [] for n in names})
        vids = sorted(set(b["vid"]))
        sizes = list(config.capacities[int(b["settlement_type"].iloc[0])])
        found = brownfield(c, Loads(vids, b), vids, sorted(set(c["end_vid"])), sizes, config.brownfield_reach_m)
        return pd.DataFrame([(*key, k, t, v, size) for k, t, vs, size in found for v in vs], columns=names)

    kinds = ", ".join(f"{n} {costs.schema[n].dataType.simpleString()}" for n in by)
    costs = cut(costs.where(F.col("agg_cost") < config.brownfield_reach_m))
    large = cut(costs.groupBy(*by).count().where(F.col("count") > pairs).select(*by))
    few = large.isEmpty()
    part = lambda df, how: df if few else df.join(large, by, how)
    small = dealt(part(costs, "left_anti"), by).groupBy(*by).cogroup(dealt(part(buildings, "left_anti"), by).groupBy(*by)).applyInPandas(run, f"{kinds}, bcid int, trafo long, vid long, rated double")
    return small if few else small.unionByName(brownfield_rounds(part(costs, "left_semi"), part(buildings, "left_semi"), by, config))


def brownfield_rounds(costs: DataFrame, buildings: DataFrame, by: list[str], config: Config = DEFAULT) -> DataFrame:
    """``brownfield`` for groups of any size, by rounds that decide many pairs at once.

    A pair is decided if its consumer has no earlier one and no earlier pair of its transformer is open: so in each round
    every transformer takes the front of its list, in order, up to the first consumer who still hopes for another
    one, or until a consumer would overload it, which closes it. What is decided would be so in the one
    sequence of all pairs too, since pairs in between touch neither side.
    """
    c, categories = F.col, list(SIM_FACTOR)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in _CATEGORY.items() for x in pair]), c("type"))
    named = {f"{n}{i}": F.sum(F.when(kind == name, c(x)).otherwise(0.0)).cast("double") for i, name in enumerate(categories) for n, x in (("p", "kw"), ("n", "homes"))}
    own = cut(buildings.groupBy(*by, c("vid").alias("start_vid")).agg(*[e.alias(k) for k, e in named.items()]))
    tops = {k: float(max(sizes)) for k, sizes in config.capacities.items()}
    top = cut(buildings.groupBy(*by).agg(F.min("settlement_type").alias("settlement_type")))
    table = F.create_map(*[F.lit(x) for pair in tops.items() for x in pair])
    open_ = costs.where(c("agg_cost") < config.brownfield_reach_m).groupBy(*by, "start_vid", "end_vid").agg(F.min("agg_cost").alias("agg_cost"))
    open_ = open_.join(own, [*by, "start_vid"]).join(top.select(*by, F.element_at(table, c("settlement_type")).alias("top")), by)
    zero = [F.lit(0.0).alias(f"b_{k}") for k in named]
    open_ = cut(open_.select("*", *zero))
    at, taken = Window.partitionBy(*by, "end_vid").orderBy("agg_cost", "start_vid"), []
    upto = at.rowsBetween(Window.unboundedPreceding, 0)

    def load(prefix: str) -> Column:
        parts = [F.when((c(f"{prefix}p{i}") > 0) & (c(f"{prefix}n{i}") > 0), c(f"{prefix}p{i}") * (SIM_FACTOR[x] + (1 - SIM_FACTOR[x]) * F.pow(c(f"{prefix}n{i}"), F.lit(-0.75)))).otherwise(0.0) for i, x in enumerate(categories)]
        return sum(parts, F.lit(0.0))

    while not open_.isEmpty():
        first = open_.groupBy(*by, "start_vid").agg(F.min(F.struct("agg_cost", "end_vid")).alias("z")).select(*by, "start_vid", c("z.end_vid").alias("__first"))
        front = open_.join(first, [*by, "start_vid"]).withColumn("__wait", F.max((c("__first") != c("end_vid")).cast("int")).over(upto)).where("__wait = 0")
        front = front.withColumns({f"s_{k}": c(f"b_{k}") + F.sum(k).over(upto) for k in named}).withColumn("__over", load("s_") > c("top"))
        front = cut(front.withColumn("__over", F.max(c("__over").cast("int")).over(upto)))
        got = front.where("__over = 0")
        taken.append(got.select(*by, "start_vid", "end_vid"))
        closed = front.where("__over = 1").select(*by, "end_vid").distinct()
        sums = got.groupBy(*by, "end_vid").agg(*[F.sum(k).alias(f"g_{k}") for k in named])
        left = open_.join(got.select(*by, "start_vid"), [*by, "start_vid"], "left_anti").join(closed, [*by, "end_vid"], "left_anti")
        left = left.join(sums, [*by, "end_vid"], "left").withColumns({f"b_{k}": c(f"b_{k}") + F.coalesce(f"g_{k}", F.lit(0.0)) for k in named})
        open_ = cut(left.select(*open_.columns), release=True)
    if not taken:
        return open_.select(*by, F.lit(0).alias("bcid"), c("end_vid").alias("trafo"), c("start_vid").alias("vid"), F.lit(0.0).alias("rated"))
    members = taken[0]
    for part in taken[1:]:
        members = members.unionByName(part)
    members = cut(members)
    grids = members.join(own, [*by, "start_vid"]).groupBy(*by, "end_vid").agg(*[F.sum(k).alias(f"t_{k}") for k in named]).join(top, by)
    allowed = F.element_at(F.create_map(*[x for k, sizes in config.capacities.items() for x in (F.lit(k), F.array(*[F.lit(float(s)) for s in sorted(sizes)]))]), c("settlement_type"))
    total = load("t_")
    grids = grids.withColumn("rated", F.coalesce(F.array_min(F.filter(allowed, lambda s: s > total)), F.array_max(allowed)))
    grids = grids.withColumn("bcid", -F.row_number().over(Window.partitionBy(*by).orderBy("end_vid")))
    return members.join(grids.select(*by, "end_vid", "rated", "bcid"), [*by, "end_vid"]).select(*by, "bcid", c("end_vid").alias("trafo"), c("start_vid").alias("vid"), "rated")


def promising(arcs: Arcs, points: np.ndarray, weight: np.ndarray, reach: float) -> np.ndarray:
    """Marks of the points that may have the least sum of whole metres times weight, or the least of those within ``reach`` of all others.

    arcs: no loops, each pair of nodes once; points ascending. What hangs as a tree on the rest of the graph is taken off leaf by leaf, which tells how
    the sum of distances changes along each of its arcs. Cut to metres a sum is less by the weights at most, so of the points of one
    tree those that are behind its best by more drop out. In a graph that is a forest few are left; where ways are meshed all
    points on loops stay. Being within reach of all others is held against the two ends of the longest way, which is exact in a tree.
    """
    if (weight < 0).any():
        return np.ones(len(points), bool)
    n = len(arcs.ids)
    at, own, label = np.searchsorted(arcs.ids, points), np.zeros(n), np.arange(n)
    own[at] = weight
    if len(arcs.to):
        node, least = _least(np.repeat(np.arange(n), np.diff(arcs.first)), arcs.to)
        label[node] = least
    total = np.bincount(label, own, n)[label]
    below, up, price, left, gone, waves = own.copy(), np.full(n, -1), np.zeros(n), np.diff(arcs.first), np.zeros(n, bool), []
    wave = np.flatnonzero(left == 1)
    while len(wave):
        of, arc = arcs.around(wave)
        node, to, cost = wave[of], arcs.to[arc], arcs.cost[arc]
        off = ~gone[to] & ~((left[to] == 1) & (to > node))  # of the last two of a tree the smaller one stays
        node, to, cost = node[off], to[off], cost[off]
        gone[node], up[node], price[node] = True, to, cost
        waves.append(node)
        np.add.at(below, to, below[node])
        np.subtract.at(left, to, 1)
        wave = np.unique(to[left[to] == 1])
    gain, root = np.zeros(n), np.arange(n)
    for node in reversed(waves):
        gain[node], root[node] = gain[up[node]] + price[node] * (total[node] - 2 * below[node]), root[up[node]]
    g, r, most = gain[at], root[at], total[at]
    best, slack = np.full(n, np.inf), 1e-3 + 1e-9 * np.abs(gain).max()
    np.minimum.at(best, r, g)
    kept = g - most <= best[r] + slack
    far = lambda i: arcs.nearness(points[i : i + 1])[at]
    d = far(0)
    if np.isfinite(d).all():
        a = far(int(d.argmax()))
        ends = np.maximum(a, far(int(a.argmax())))
        near = ends < math.floor(reach) + 1 + SLACK
        sure = ends < math.floor(reach) + 1 - SLACK
        if (label[~gone] == label[at[0]]).sum() == 1 and sure.any():
            near &= g - most <= g[sure].min() + slack
        kept |= near
    return kept


def greenfield_positions(edges: DataFrame, loads: DataFrame, by: list[str], reach: float = DEFAULT.greenfield_reach_m, core: int = hierarchy.CORE, cells: int = hierarchy.CELLS) -> DataFrame:
    """by, ont_vid, moment, feasible: the point with the least sum of distance times load, among those within reach of all others if there are any.

    edges: by, source, target, cost; loads: by, vid, kw. Distances are cut to whole metres. Each task weighs some of a
    group's points, those that ``promising`` leaves, against all of them; of a group's tasks only the best point goes on.
    """

    def leave(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        e, at = p[p["k"] == 0], p[p["k"] == 1].groupby("a")["x"].sum()
        e = e.groupby(["a", "b"], as_index=False)["x"].min()
        arcs = Arcs(e["a"].to_numpy(np.int64), e["b"].to_numpy(np.int64), e["x"].to_numpy(float), at.index.to_numpy(np.int64))
        vids = at.index.to_numpy(np.int64)
        kept = vids[promising(arcs, vids, at.to_numpy(float), reach)] if len(vids) else vids
        return pd.DataFrame({**{n: [v] * len(kept) for n, v in zip(by, key, strict=True)}, "vid": kept})

    def run(key: tuple, ends: np.ndarray, starts: np.ndarray, kw: np.ndarray, sweeps: hierarchy.Sweeps) -> Iterator[pa.RecordBatch]:
        at, best = np.searchsorted(sweeps.ids, ends), []
        step = max(1, cells // max(1, len(sweeps.ids)))
        for low in range(0, len(starts), step):
            some = ends[starts[low : low + step]]
            cost = sweeps.from_starts(some, at=at)
            cost = np.where(np.isfinite(cost), np.floor(cost), NO_WAY)
            moment, feasible = kw @ cost, cost.max(0) <= reach
            i = int(np.lexsort((some, np.round(moment, 6), ~feasible))[0])
            best.append((not feasible[i], round(float(moment[i]), 6), int(some[i]), float(moment[i])))
        if best:
            far, _, vid, moment = min(best)
            fixed = {name: pa.array([value]) for name, value in zip(by, key, strict=True)}
            yield pa.RecordBatch.from_pydict({**fixed, "ont_vid": pa.array([vid], pa.int64()), "moment": pa.array([moment], pa.float64()), "feasible": pa.array([not far])})

    c = F.col
    both = edges.where("source <> target and cost is not null").select(*by, F.lit(0).alias("k"), F.least("source", "target").cast("long").alias("a"), F.greatest("source", "target").cast("long").alias("b"), c("cost").cast("double").alias("x"))
    both = both.unionByName(loads.where("vid is not null").select(*by, F.lit(1).alias("k"), c("vid").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.coalesce(c("kw").cast("double"), F.lit(0.0)).alias("x")))
    kinds = ", ".join(f"{n} {loads.schema[n].dataType.simpleString()}" for n in by)
    starts = cut(dealt(both, by).groupBy(*by).applyInPandas(leave, f"{kinds}, vid long"))
    found = hierarchy.swept(edges, loads.select(*by, "vid", c("kw").alias("weight")), by, run, "ont_vid long, moment double, feasible boolean", core, cells, starts)
    first = F.min(F.struct((~F.col("feasible")).alias("far"), F.round("moment", 6).alias("m"), "ont_vid", "moment", "feasible")).alias("z")
    return found.groupBy(*by).agg(first).select(*by, "z.ont_vid", "z.moment", "z.feasible")


#: Buildings of a component up to which one task finds the centres of its parts; those of a larger one are found by many.
TOGETHER = 50_000
#: Rounds of k-means at most, and metres by which centres still move when it ends.
ROUNDS, MOVED = 100, 1e-6


def _shared(buildings: DataFrame, by: list[str]) -> DataFrame:
    """Buildings of components that have more than one, with their number (__n)."""
    return buildings.withColumn("__n", F.count("*").over(Window.partitionBy(*by, "component"))).where("__n > 1")


def _with_kcid(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (with __n, __part) and kcid: parts are numbered, not rows, so no task holds all rows of one ``by``."""
    keys = [*by, "component", "__part"]
    rows = cut(rows)
    parts = cut(numbered(rows.groupBy(*keys).agg(F.min("vid").alias("__least")), [*by, "component", "__least"], "__no"))
    agree = lambda names, mark: reduce(and_, [F.col(c).eqNullSafe(F.col(mark + c)) for c in names])
    first = parts.groupBy(*[F.col(c).alias(f"__f{c}") for c in by]).agg(F.min("__no").alias("__first"))
    kcid = parts.join(first, agree(by, "__f")).select(*[F.col(c).alias(f"__k{c}") for c in keys], (F.col("__no") - F.col("__first") + 1).cast("int").alias("kcid"))
    kept = [c for c in rows.columns if c not in ("__n", "__part")]
    return rows.join(broadcast_if_small(cut(kcid)), agree(keys, "__k")).select(*kept, "kcid")


def component_clusters(buildings: DataFrame, by: list[str]) -> DataFrame:
    """Buildings (by, component, vid) with kcid from 1 in each ``by``, in the order of components; components of one building go, none is split."""
    return _with_kcid(_shared(buildings, by).withColumn("__part", F.lit(0)), by)


def _starts(places: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, x, y: the middle places of equal shares of a component's places (keys, x, y, k: how many shares) along a curve through its square."""
    c, bits = F.col, 24
    box = places.groupBy(*keys).agg(F.min("x").alias("__x"), F.min("y").alias("__y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("__wide"))
    cell = lambda name: F.coalesce(F.floor(F.try_divide(c(name) - c(f"__{name}"), c("__wide")) * ((1 << bits) - 1)), F.lit(0)).cast("long")
    bit = lambda name, b, to: F.shiftleft(F.shiftright(c(f"__c{name}"), b).bitwiseAND(F.lit(1)), to)
    curve = sum((bit("x", b, 2 * b) + bit("y", b, 2 * b + 1) for b in range(bits)), F.lit(0).cast("long"))
    along = places.join(broadcast_if_small(cut(box)), keys).withColumns({"__cx": cell("x"), "__cy": cell("y")}).select(*keys, "x", "y", "k", curve.alias("__curve"))
    along = numbered(along, [*keys, "__curve", "x", "y"], "__no")
    size = cut(along.groupBy(*keys).agg(F.min("__no").alias("__first"), F.count("*").alias("__places")))
    at, shares = c("__no") - c("__first"), F.least("k", "__places")
    share = F.floor(at * shares / c("__places")).cast("long")
    off = F.struct(F.abs(at - (share + 0.5) * c("__places") / shares), at)
    return along.join(broadcast_if_small(size), keys).groupBy(*keys, share.alias("id")).agg(F.min_by(F.struct("x", "y"), off).alias("z")).select(*keys, "id", "z.x", "z.y")


def _centres(buildings: DataFrame, by: list[str], config: Config = DEFAULT) -> DataFrame:
    """by, component, id, x, y: centres of the parts of large components (buildings: by, component, __n, x, y), from all their buildings.

    Many tasks add up the buildings nearest to each centre, round by round, until no centre moves. The driver and each task
    hold the centres, of which there is one for ``component_divider`` buildings.
    """
    keys, spark = [*by, "component"], buildings.sparkSession
    placed = buildings.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")).dropna(subset=keys)
    k = F.greatest(F.lit(1), F.floor(F.first("__n") / config.component_divider)).alias("k")
    places = cut(placed.groupBy(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.count("*").alias("w"), k))
    kinds = {c: buildings.schema[c].dataType.simpleString() for c in keys}
    layout = ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", id long, x double, y double"
    first = _starts(places, keys).orderBy(*keys, "id").collect()  # a row for each part
    names = list(dict.fromkeys(tuple(r[: len(keys)]) for r in first))
    if not names:
        return spark.createDataFrame([], layout)
    at = {name: g for g, name in enumerate(names)}
    numbers = spark.createDataFrame([(g, *name) for g, name in enumerate(names)], "__g int, " + ", ".join(f"{c} {kind}" for c, kind in kinds.items()))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(places.join(broadcast_if_small(cut(numbers)), keys).select("__g", "x", "y", "w").repartition(spread))
    centres = [[] for _ in names]
    for r in first:
        centres[at[tuple(r[: len(keys)])]].append((r["x"], r["y"]))
    centres = [np.array(c) for c in centres]
    moving = set(range(len(names)))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast({g: centres[g] for g in moving})

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                of, x, y, w = (batch.column(c).to_numpy() for c in ("__g", "x", "y", "w"))
                for g in np.unique(of).tolist():
                    if (found := shared.value.get(g)) is None:
                        continue
                    own = np.flatnonzero(of == g)
                    label = _nearest_centre(np.column_stack([x[own], y[own]]), found)
                    part = np.column_stack([np.bincount(label, v, len(found)) for v in (w[own], w[own] * x[own], w[own] * y[own])])
                    total[g] = total[g] + part if g in total else part
            for g, part in total.items():
                some = np.flatnonzero(part[:, 0])
                yield pa.record_batch([pa.array(np.full(len(some), g, np.int32)), pa.array(some), *(pa.array(v) for v in part[some].T)], names=["g", "id", "n", "x", "y"])

        added = rows.mapInArrow(sums, "g int, id long, n double, x double, y double").groupBy("g", "id").agg(*[F.sum(c).alias(c) for c in "nxy"]).collect()  # a row for each part
        shared.unpersist()
        now = {g: centres[g].copy() for g in moving}
        for r in added:
            now[r["g"]][r["id"]] = r["x"] / r["n"], r["y"] / r["n"]
        moving = {g for g, new in now.items() if np.abs(new - centres[g]).max() > MOVED}
        for g, new in now.items():
            centres[g] = new
        if not moving:
            break
    return spark.createDataFrame([(*name, i, float(x), float(y)) for name, c in zip(names, centres, strict=True) for i, (x, y) in enumerate(c)], layout)


def components_to_clusters(buildings: DataFrame, by: list[str], config: Config = DEFAULT, together: int = TOGETHER) -> DataFrame:
    """Buildings (by, component, vid, x, y) with kcid from 1 in each ``by``; components of one building or none go.

    Components at or above the limit are split by k-means into int(n / divider) parts; ids follow the
    order of components and, inside, of the parts' smallest vertices. The centres of a component come from all of
    its buildings, in one task up to ``together`` of them and in rounds beyond; each building joins the nearest, ties to the first.
    """
    sized = _shared(buildings, by)
    small = sized.where(F.col("__n") < config.large_component).withColumn("__part", F.lit(0))
    large = sized.where(F.col("__n") >= config.large_component)

    def centres(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        _, found = kmeans(p[["x", "y"]].to_numpy(float), max(1, int(p["__n"].iloc[0] / config.component_divider)), config.seed)
        return pd.DataFrame({**dict(zip([*by, "component"], key, strict=True)), "id": np.arange(len(found)), "x": found[:, 0], "y": found[:, 1]})

    kinds = ", ".join(f"{c} {large.schema[c].dataType.simpleString()}" for c in [*by, "component"])
    of = large.select(*by, "component", "__n", "x", "y")
    found = cut(of.where(F.col("__n") <= together).groupBy(*by, "component").applyInPandas(centres, f"{kinds}, id long, x double, y double"))
    beyond = of.where(F.col("__n") > together)
    if not beyond.isEmpty():
        found = cut(found.unionByName(_centres(cut(beyond), by, config)))
    places = large.select(*by, "component", "x", "y").distinct().withColumn("id", F.xxhash64("x", "y"))
    near = nearest(places, found, 1, [*by, "component"]).select(*by, "component", "x", "y", F.col("other").cast("int").alias("__part"))
    parts = large.join(near.dropDuplicates([*by, "component", "x", "y"]), [*by, "component", "x", "y"]).select(*large.columns, "__part")
    return _with_kcid(small.unionByName(parts), by)


# --- clusters of grids -------------------------------------------------------------------------
def _nearest_centre(x: np.ndarray, centres: np.ndarray, cells: int = 1 << 19) -> np.ndarray:
    """The nearest centre of each row, some rows at a time, so that memory does not grow with rows times centres."""
    rows = max(1, cells // max(1, len(centres)))
    return np.concatenate([((x[a : a + rows, None] - centres[None]) ** 2).sum(2).argmin(1) for a in range(0, len(x), rows)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres) by k-means++ and Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(x, axis=0)))
    centres = x[[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum())]])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    labels = np.full(len(x), -1)
    for _ in range(rounds):
        now = _nearest_centre(x, centres)
        if (now == labels).all():
            break
        labels = now
        count = np.bincount(labels, minlength=k)
        sums = np.column_stack([np.bincount(labels, weights=c, minlength=k) for c in x.T])
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return labels, centres


def zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, divided by the population deviation (0 where that is 0)."""
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))
    scaled = {c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0) for c in columns}
    return out.withColumns(scaled).select(*df.columns)


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="__v").transform(zscores(df, columns))


def kmeans_grids(df: DataFrame, columns: list[str], k: int, seed: int = 0) -> DataFrame:
    """``df`` with z-scored columns and clusters: MLlib k-means over the population z-scores."""
    from pyspark.ml.clustering import KMeans

    rows = _vectors(df, columns)
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="clusters").fit(rows).transform(rows).drop("__v")


#: Kinds of covariance of a mixture, by the names of the algorithms.
COVARIANCES = {"gmm_full": "full", "gmm_diag": "diag", "gmm_tied": "tied", "gmm_sph": "spherical"}


class Mixture:
    """A Gaussian mixture in the course of expectation-maximisation; ``sums`` of parts of the rows add up."""

    def __init__(self, weight: np.ndarray, means: np.ndarray, covariance: str):
        self.weight, self.means, self.covariance = weight, means, covariance
        self.cov = np.repeat(np.eye(means.shape[1])[None], len(means), axis=0)
        self.likelihood, self.done = -np.inf, False

    def responsibility(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of each component in each row, log likelihood of each row)."""
        inverse, log_det = np.linalg.inv(self.cov), np.linalg.slogdet(self.cov)[1]
        diff = x[:, None] - self.means[None]
        log = np.log(self.weight) - 0.5 * (np.einsum("nkd,kde,nke->nk", diff, inverse, diff) + log_det + x.shape[1] * math.log(2 * math.pi))
        top = log.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(1))
        return np.exp(log - total[:, None]), total

    def sums(self, x: np.ndarray) -> np.ndarray:
        r, total = self.responsibility(x)
        return np.concatenate([r.sum(0), (r.T @ x).ravel(), np.einsum("nk,nd,ne->kde", r, x, x).ravel(), [total.sum()]])

    def update(self, total: np.ndarray, n: float, tolerance: float, ridge: float = 1e-6) -> None:
        k, d = self.means.shape
        count, first, second = total[:k] + 1e-12, total[k : k + k * d].reshape(k, d), total[k + k * d : -1].reshape(k, d, d)
        self.weight, self.means = count / count.sum(), first / count[:, None]
        cov = second / count[:, None, None] - np.einsum("kd,ke->kde", self.means, self.means)
        if self.covariance == "tied":
            cov = np.repeat(np.einsum("k,kde->de", count, cov)[None] / count.sum(), k, axis=0)
        elif self.covariance != "full":
            spread = np.einsum("kdd->kd", cov)
            spread = spread if self.covariance == "diag" else np.repeat(spread.mean(1, keepdims=True), d, axis=1)
            cov = np.einsum("kd,de->kde", spread, np.eye(d))
        self.cov = cov + ridge * np.eye(d)
        self.done, self.likelihood = abs(total[-1] / n - self.likelihood) < tolerance, total[-1] / n


def fit_mixtures(z: DataFrame, columns: list[str], models: list[Mixture], rounds: int = 100, tolerance: float = 1e-3) -> None:
    """Expectation-maximisation of all models at once: a round reads the rows once and sends a few sums a model and partition to the driver."""
    n = float(z.count())
    for _ in range(rounds):
        todo = [m for m in models if not m.done]
        if not todo or not n:
            return

        def sums(frames, todo=todo):
            out = None
            for frame in frames:
                x = frame[columns].to_numpy(float)
                if len(x):
                    part = [m.sums(x) for m in todo]
                    out = part if out is None else [a + b for a, b in zip(out, part, strict=True)]
            if out is not None:
                yield pd.DataFrame({"s": [np.concatenate(out).tolist()]})

        total = np.sum([r["s"] for r in z.mapInPandas(sums, "s array<double>").collect()], axis=0)
        at = 0
        for m in todo:
            k, d = m.means.shape
            size = k + k * d + k * d * d + 1
            m.update(total[at : at + size], n, tolerance)
            at += size


def _started(clustered: DataFrame, columns: list[str], covariance: str) -> Mixture:
    """A mixture that begins with the shares and means of clusters."""
    first = clustered.groupBy("clusters").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns]).orderBy("clusters").toPandas()
    return Mixture(first["n"].to_numpy() / first["n"].sum(), first[columns].to_numpy(float), covariance)


def gmm(df: DataFrame, columns: list[str], k: int, covariance: str = "tied", seed: int = 1, rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """``df`` with z-scored columns and clusters: a Gaussian mixture with full, diagonal, one tied or spherical covariances, started from k-means."""
    z = zscores(df, columns).cache()
    model = _started(kmeans_grids(df, columns, k, seed), columns, covariance)
    fit_mixtures(z.select(*columns), columns, [model], rounds, tolerance)

    @F.pandas_udf("int")
    def label(*cols: pd.Series) -> pd.Series:
        return pd.Series(model.responsibility(np.column_stack([c.to_numpy(float) for c in cols]))[0].argmax(1))

    return z.withColumn("clusters", label(*columns))


def representatives(clustered: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """clusters, key of the row nearest to each cluster's mean; ties to the smaller key."""
    mean = clustered.groupBy("clusters").agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    gap = sum((F.pow(F.col(c) - F.col(f"__{c}"), 2) for c in columns), F.lit(0.0))
    return clustered.join(broadcast_if_small(cut(mean)), "clusters").groupBy("clusters").agg(F.min_by(key, F.struct(gap.alias("g"), F.col(key).alias("k"))).alias(key))


def reindexed(clustered: DataFrame, chosen: DataFrame, size: DataFrame, key: str, by: str) -> DataFrame:
    """``clustered`` with clusters numbered from 0 by the representatives' ``by``, and a mark on representatives."""
    order = chosen.join(size.select(key, by), key).withColumn("__new", F.row_number().over(Window.orderBy(by, key)) - 1)
    out = clustered.join(broadcast_if_small(cut(order.select("clusters", "__new", F.col(key).alias("__rep")))), "clusters")
    return out.withColumn("clusters", F.col("__new")).withColumn("representative_grid", F.col(key) == F.col("__rep")).drop("__new", "__rep")


def scatter(df: DataFrame, label: str, columns: list[str]) -> tuple[DataFrame, Column, Column]:
    """(one row: k, n, within, between) sums of squares about cluster and overall means."""
    mean = df.groupBy(label).agg(F.count("*").alias("__n"), *[F.avg(c).alias(f"__m_{c}") for c in columns])
    mean, overall = cut(mean), df.agg(*[F.avg(c).alias(f"__o_{c}") for c in columns])
    inner = sum((F.pow(F.col(c) - F.col(f"__m_{c}"), 2) for c in columns), F.lit(0.0))
    outer = sum((F.pow(F.col(f"__m_{c}") - F.col(f"__o_{c}"), 2) for c in columns), F.lit(0.0))
    within = df.join(broadcast_if_small(mean), label).agg(F.sum(inner).alias("within"))
    between = mean.crossJoin(F.broadcast(overall)).agg(F.count("*").alias("k"), F.sum("__n").alias("n"), F.sum(F.col("__n") * outer).alias("between"))
    return between.crossJoin(within), F.col("between"), F.col("within")


def calinski_harabasz(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Calinski-Harabasz index; null with one cluster or without spread."""
    sums, between, within = scatter(df, label, columns)
    return sums.select(F.try_divide(between * (F.col("n") - F.col("k")), within * (F.col("k") - 1)).alias("ch"))


def davies_bouldin(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / distance of centres."""
    mean = cut(df.groupBy(label).agg(*[F.avg(c).alias(f"m_{c}") for c in columns]))
    gap = F.sqrt(sum((F.pow(F.col(c) - F.col(f"m_{c}"), 2) for c in columns), F.lit(0.0)))
    spread = cut(mean.join(df.join(broadcast_if_small(mean), label).groupBy(label).agg(F.avg(gap).alias("s")), label))
    a, b = spread.alias("a"), spread.alias("b")
    between = F.sqrt(sum((F.pow(F.col(f"a.m_{c}") - F.col(f"b.m_{c}"), 2) for c in columns), F.lit(0.0)))
    pairs = a.join(broadcast_if_small(b), F.col(f"a.{label}") != F.col(f"b.{label}"))  # a row for each pair of clusters
    return pairs.groupBy(F.col(f"a.{label}").alias(label)).agg(F.max(F.try_divide(F.col("a.s") + F.col("b.s"), between)).alias("r")).agg(F.avg("r").alias("db"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from their contingency table."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(pairs("n").alias("ij"), F.sum("n").alias("total"))
    one, two = (cells.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs("n").alias(x)) for c, x in ((a, "i"), (b, "j")))
    expected = F.col("i") * F.col("j") / (F.col("total") * (F.col("total") - 1) / 2)
    top = (F.col("i") + F.col("j")) / 2
    return both.crossJoin(one).crossJoin(two).select(F.when(top == expected, 1.0).otherwise((F.col("ij") - expected) / F.when(top == expected, 1.0).otherwise(top - expected)).alias("ari"))


def cluster_deviation(df: DataFrame, chosen: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Mean over clusters and parameters of the root mean square relative deviation from the representative. chosen: label, columns."""
    rep = chosen.select(label, *[F.col(c).alias(f"r_{c}") for c in columns])
    rel = [F.sqrt(F.avg(F.pow(F.try_divide(F.col(c) - F.col(f"r_{c}"), F.col(f"r_{c}")), 2))).alias(c) for c in columns]
    per = df.join(broadcast_if_small(rep), label).groupBy(label).agg(*rel)
    mean = sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)
    return per.agg(F.avg(mean).alias("deviation"))


def cluster_counts(df: DataFrame, columns: list[str], allowed: tuple[int, ...] = (3, 4, 5, 6, 7), seed: int = 1) -> DataFrame:
    """algorithm, k, ch, db for k-means and mixtures of four kinds of covariance: the scores by which a number of clusters is picked.

    All mixtures are fitted in common rounds and all labelings scored in two aggregations over the rows;
    the driver sees a row for each cluster of each model. An index is null where it is not defined.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    z = zscores(df, columns).select(*columns).repartition(parts).cache()  # a small file is one partition, and each row has a label for each model
    names, models, centres = [], [], []
    for k in allowed:
        start = kmeans_grids(df, columns, k, seed).cache()
        names.append(("kmeans", k))
        models.append(_started(start, columns, "spherical"))
        centres.append(models[-1].means)
        for name, covariance in COVARIANCES.items():
            names.append((name, k))
            models.append(_started(start, columns, covariance))
            centres.append(None)
    fit_mixtures(z, columns, [m for m, c in zip(models, centres, strict=True) if c is None])

    @F.pandas_udf("array<int>")
    def labels(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        found = [m.responsibility(x)[0].argmax(1) if c is None else _nearest_centre(x, c) for m, c in zip(models, centres, strict=True)]
        return pd.Series(list(np.column_stack(found)))

    long = z.select(*columns, F.posexplode(labels(*columns)).alias("model", "label")).cache()
    of = ["model", "label"]
    per = long.groupBy(*of).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], sum((F.var_pop(c) for c in columns), F.lit(0.0)).alias("spread"))
    gap = F.sqrt(sum((F.pow(F.col(c) - F.col(f"m_{c}"), 2) for c in columns), F.lit(0.0)))
    near = long.join(F.broadcast(per), of).groupBy(*of).agg(F.avg(gap).alias("gap"))  # a row for each cluster of each model
    rows = []
    for model, group in per.join(near, of).toPandas().sort_values(of).groupby("model"):
        n, means = group["n"].to_numpy(float), group[[f"m_{c}" for c in columns]].to_numpy(float)
        within, k = float((n * group["spread"]).sum()), len(group)
        between = float((n[:, None] * (means - (n[:, None] * means).sum(0) / n.sum()) ** 2).sum())
        ch = float(between * (n.sum() - k) / (within * (k - 1))) if k > 1 and within > 0 else None
        apart = np.sqrt(((means[:, None] - means[None]) ** 2).sum(2))
        both = group["gap"].to_numpy()[:, None] + group["gap"].to_numpy()[None]
        off = ~np.eye(k, dtype=bool)
        db = float(np.where(off, both / np.where(off, apart, 1.0), -np.inf).max(1).mean()) if k > 1 and (apart[off] > 0).all() else None
        rows.append((*names[int(model)], ch, db))
    return df.sparkSession.createDataFrame(rows, "algorithm string, k int, ch double, db double")


def best_counts(scores: DataFrame) -> DataFrame:
    """algorithm, ch_k, ch, db_k, db: the number of clusters with the greatest ch and that with the least db; ties to the smaller number."""
    best = scores.groupBy("algorithm").agg(F.max(F.struct("ch", (-F.col("k")).alias("k"))).alias("c"), F.min(F.when(F.col("db").isNotNull(), F.struct("db", "k"))).alias("d"))
    return best.select("algorithm", (-F.col("c.k")).alias("ch_k"), F.col("c.ch").alias("ch"), F.col("d.k").alias("db_k"), F.col("d.db").alias("db"))


# --- factors -----------------------------------------------------------------------------------
def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The correlation matrix, in one aggregation."""
    row = df.agg(*[F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]).first()
    out = np.eye(len(columns))
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            out[i, j] = out[j, i] = row[f"{i}_{j}"] if row[f"{i}_{j}"] is not None else 0.0
    return out


def explained_variance(corr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the principal components of z-scores, falling, and their running sum."""
    values = np.sort(np.linalg.eigvalsh(corr))[::-1]
    return values / values.sum(), np.cumsum(values) / values.sum()


def bartlett(corr: np.ndarray, n: int) -> tuple[float, int]:
    """(chi square, degrees of freedom) of the test that nothing is correlated."""
    p = len(corr)
    return -(n - 1 - (2 * p + 5) / 6) * np.linalg.slogdet(corr)[1], p * (p - 1) // 2


def kmo(corr: np.ndarray) -> float:
    """Kaiser-Meyer-Olkin measure of sampling adequacy."""
    inverse = np.linalg.pinv(corr)
    partial = -inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    off = ~np.eye(len(corr), dtype=bool)
    return float((corr[off] ** 2).sum() / ((corr[off] ** 2).sum() + (partial[off] ** 2).sum()))


def varimax(loadings: np.ndarray, rounds: int = 500, tolerance: float = 1e-8) -> np.ndarray:
    """Loadings turned so that the variance of their squares is greatest."""
    p, k = loadings.shape
    turn, before = np.eye(k), 0.0
    for _ in range(rounds):
        turned = loadings @ turn
        u, s, v = np.linalg.svd(loadings.T @ (turned**3 - turned * (turned**2).sum(0) / p))
        turn = u @ v
        if s.sum() <= before * (1 + tolerance):
            break
        before = s.sum()
    return loadings @ turn


def factor_loadings(corr: np.ndarray, k: int, rounds: int = 1000, tolerance: float = 1e-6) -> np.ndarray:
    """Maximum-likelihood factor loadings of a correlation matrix, by expectation-maximisation."""
    p = len(corr)
    noise = np.full(p, 0.5)
    values, vectors = np.linalg.eigh(corr)
    load = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 1e-6))
    for _ in range(rounds):
        weight = np.linalg.solve(load @ load.T + np.diag(noise), load).T
        second = np.eye(k) - weight @ load + weight @ corr @ weight.T
        new = corr @ weight.T @ np.linalg.inv(second)
        noise = np.maximum(np.diag(corr - new @ weight @ corr), 1e-6)
        done, load = np.abs(new - load).max() < tolerance, new
        if done:
            break
    return load


def chosen_parameters(df: DataFrame, columns: list[str]) -> list[str]:
    """The parameter with the largest turned loading on each factor; as many factors as eigenvalues above 1, one at least."""
    corr = correlations(df, columns)
    k = max(1, int((np.linalg.eigvalsh(corr) > 1).sum()))
    turned = varimax(factor_loadings(corr, k))
    return [columns[i] for i in np.abs(turned).argmax(0)]
