"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridwright.checkpoints import cut
from gridwright.operators.groups import broadcast_if_small


def _large_star(arcs: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked with the smallest of u and its neighbours."""
    both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(arcs: DataFrame) -> DataFrame:
    """arcs point from larger to smaller: u and its smaller neighbours are linked with the smallest of them."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m"))
    moved = arcs.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def _counted(arcs: DataFrame) -> tuple[DataFrame, dict]:
    """``arcs`` written out, with their number and a sum of their hashes, which are observed as they are written.

    A stage that is run again may count twice; then the sums differ and one more round is made.
    """
    seen = Observation()
    h = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    out = cut(arcs.observe(seen, F.count(F.lit(1)).alias("n"), h.alias("h")))
    return out, seen.get


#: Arcs that one task joins by itself, where that is asked for.
JOINED = 1 << 18


def _least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node it reaches over the arcs) of all nodes that are not the least themselves."""
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(flat, 2)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)  # roots are hooked under smaller roots, then paths are halved
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The arcs of a task as arcs to the least node of each of its components, a bounded number of arcs at a time."""
    held, rows = [], 0

    def packed() -> pa.RecordBatch:
        u, v = _least(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
        return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 4 * JOINED:
            yield packed()
            held, rows = [], 0
    if rows:
        yield packed()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60, joined: int = 0) -> DataFrame:
    """(node, component): each node that occurs in ``edges`` with the smallest node it can reach.

    Any orderable node type. Null ends and loops add no links, but a node of a loop is listed. An
    empty table of edges gives an empty result. Rounds grow with the logarithm of the longest path;
    each is one job that writes its arcs into the checkpoint folder and counts them on the way. With
    ``joined`` (ids are longs then) every task joins its own arcs first, and once so many arcs or fewer are left, one task joins these.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    joined = joined if ends.schema["u"].dataType.simpleString() == ends.schema["v"].dataType.simpleString() == "bigint" else 0
    nodes = ends.select("u").union(ends.select("v")).distinct()
    arcs = ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    arcs, before = _counted((arcs.mapInArrow(_joined, "u long, v long") if joined else arcs).distinct())
    for _ in range(rounds):
        if before["n"] == 0:
            break
        if before["n"] <= joined:
            arcs = cut(arcs.repartition(1).mapInArrow(_joined, "u long, v long"))
            break
        arcs, now = _counted(_small_star(_large_star(arcs)))
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(arcs.select(F.col("u").alias("node"), F.col("v").alias("m")), nodes["u"] == F.col("node"), "left").select(nodes["u"].alias("node"), F.coalesce("m", nodes["u"]).alias("component"))


def components_with(known: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) after ``edges`` are added to a graph whose components are ``known`` (node, component).

    Only the classes that new edges touch are joined: their ends stand for their components, and rounds are
    made over these few links. The rows of ``known`` are read twice and never shuffled against each other.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = ends.select(F.col("u").alias("node")).union(ends.select(F.col("v").alias("node"))).distinct()
    touched = cut(nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("old"), F.col("component").isNull().alias("fresh")))
    at = lambda c: touched.select(F.col("node").alias(c), F.col("old").alias(f"old_{c}"))
    links = ends.join(at("u"), "u").join(at("v"), "v").select(F.col("old_u").alias("src"), F.col("old_v").alias("dst"))
    moved = cut(connected_components(links, joined=JOINED).withColumnsRenamed({"node": "old", "component": "new"}))
    changed = broadcast_if_small(moved.where("old <> new"))
    kept = known.join(changed, known["component"] == changed["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    added = touched.where("fresh").join(moved, "old").select("node", F.col("new").alias("component"))
    return kept.unionByName(added)
