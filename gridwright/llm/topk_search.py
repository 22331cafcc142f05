"""Exact top-k search by inner product with multi-resolution segment statistics.

For a segment of L components with means m, m' and deviations s, s' the distance of two vectors is at
least L((m - m')^2 + (s - s')^2), so their inner product is at most L(m m' + s s'). Summed over the
segments of a resolution this bounds a pair; pairs go from coarse to fine resolutions and only those
that may still reach the query's k-th best score are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.checkpoints import cut

#: Segments at each resolution.
SEGMENTS = (1, 4, 16, 32)
#: Queries of a block, about; up to so many are broadcast. A part of the rows that meets it in one cell is PART times as large.
BLOCK, PART = 8192, 16
QUERY_TILE, ROW_TILE = 1024, 4096
SCALE = 256


def integers(lists: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """floor(SCALE * x) of the vectors that are whole and finite, by dimension: {dimension: (places, float matrix)}."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
    sizes = np.where(valid, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))[:-1]]) if len(sizes) else sizes
    for d in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == d)
        x = values[starts[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0))
        with np.errstate(over="ignore"):
            x = np.floor(SCALE * x)
        good = np.isfinite(x).all(1)
        out[d] = at[good], x[good]
    return valid, out


class Resolutions:
    """Segment sums and scaled deviations of vectors, so that one matrix product gives all bounds of a resolution."""

    def __init__(self, x: np.ndarray):
        self.x, d = x, x.shape[1]
        self.levels = []
        for n in SEGMENTS:
            if n >= d:
                break
            cuts = np.linspace(0, d, n + 1).astype(int)
            size = np.diff(cuts)
            total = np.add.reduceat(x, cuts[:-1], axis=1)
            square = np.add.reduceat(x * x, cuts[:-1], axis=1)
            spread = np.sqrt(np.maximum(square - total * total / size, 0))  # sqrt(L) times the deviation
            self.levels.append(np.column_stack([total / np.sqrt(size), spread]))

    def part(self, rows) -> Resolutions:
        out = object.__new__(Resolutions)
        out.x, out.levels = self.x[rows], [v[rows] for v in self.levels]
        return out


def _exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of the pairs as Python-exact integers, held to the range of a long."""
    if not len(qi):
        return np.zeros(0, np.int64)
    d = q.shape[1]
    most = max(np.abs(q).max(initial=0), 1.0) * max(np.abs(x).max(initial=0), 1.0) * max(d, 1)
    if most < 2**52:
        out = np.empty(len(qi), np.int64)
        for at in range(0, len(qi), 1 << 17):
            end = at + (1 << 17)
            out[at:end] = np.einsum("ij,ij->i", q[qi[at:end]], x[xi[at:end]]).astype(np.int64)
        return out
    big = [sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True)) for i, j in zip(qi, xi, strict=True)]
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in big], np.int64)


class Best:
    """The k best (score, id) of each query so far: higher scores first, then smaller ids; an id counts once."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.q, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(queries, -np.inf)  # the k-th best score known

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, q))  # ~s falls as s rises, for every long
        q, score, ids = q[order], score[order], ids[order]
        once = np.ones(len(q), bool)
        once[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])
        q, score, ids = q[once], score[once], ids[once]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kept = rank < self.k
        self.q, self.score, self.id = q[kept], score[kept], ids[kept]
        full = rank[kept] == self.k - 1
        self.least[self.q[full]] = np.maximum(self.least[self.q[full]], self.score[full])


def search(queries: Resolutions, query_ids: np.ndarray, rows: Resolutions, row_ids: np.ndarray, best: Best) -> None:
    """Offer all pairs of queries and rows to ``best``, but for those that a bound rules out and rows with the query's own id."""
    for a in range(0, len(query_ids), QUERY_TILE):
        q = queries.part(slice(a, a + QUERY_TILE))
        for b in range(0, len(row_ids), ROW_TILE):
            x = rows.part(slice(b, b + ROW_TILE))
            least = best.least[a : a + QUERY_TILE]
            open_pairs = query_ids[a : a + QUERY_TILE][:, None] != row_ids[b : b + ROW_TILE]
            qi, xi = np.nonzero(open_pairs)
            for left, right in zip(q.levels, x.levels, strict=True):
                if len(qi) * 4 > open_pairs.size:  # most are still open: bound them all by one product
                    bound = left @ right.T
                    open_pairs &= ~(bound + np.abs(bound) * 1e-9 + 0.5 < least[:, None])  # a bound that overflowed rules nothing out
                    qi, xi = np.nonzero(open_pairs)
                else:
                    bound = np.concatenate([np.einsum("ij,ij->i", left[qi[i : i + (1 << 17)]], right[xi[i : i + (1 << 17)]]) for i in range(0, len(qi), 1 << 17)] or [np.zeros(0)])
                    kept = ~(bound + np.abs(bound) * 1e-9 + 0.5 < least[qi])
                    qi, xi = qi[kept], xi[kept]
            score = _exact(q.x, x.x, qi, xi)
            kept = score >= least[qi]
            best.add(a + qi[kept], score[kept], row_ids[b : b + ROW_TILE][xi[kept]])


def _sides(ids: np.ndarray, vectors: pa.Array, k: int) -> dict[int, tuple[np.ndarray, Resolutions, np.ndarray]]:
    """By dimension the queries' ids, their resolutions, and a score that each query's k-th best reaches at least, from some of the queries themselves."""
    sides = {}
    for d, (at, x) in integers(vectors)[1].items():
        if len(at):
            start, res, first = Best(len(at), k), Resolutions(x), slice(0, 2 * QUERY_TILE)
            search(res, ids[at], res.part(first), ids[at][first], start)
            sides[d] = ids[at], res, start.least
    return sides


class Scan:
    """The best rows of a block of queries, rows offered batch by batch."""

    def __init__(self, sides: dict, k: int):
        self.sides, self.best = sides, {}
        for d, (ids, _, least) in sides.items():
            self.best[d] = Best(len(ids), k)
            self.best[d].least = least.copy()

    def offer(self, row_ids: np.ndarray, vectors: pa.Array) -> None:
        for d, (at, x) in integers(vectors)[1].items():
            if d in self.sides and len(at):
                search(self.sides[d][1], self.sides[d][0], Resolutions(x), row_ids[at], self.best[d])

    def found(self) -> Iterator[pa.RecordBatch]:
        for d, best in self.best.items():
            if len(best.q):
                yield pa.record_batch([pa.array(self.sides[d][0][best.q], pa.int64()), pa.array(best.id, pa.int64()), pa.array(best.score, pa.int64())], names=["query_id", "vec_id", "score"])


_FOUND = "query_id long, vec_id long, score long"


def _against_one_block(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(shared.value, k)
        for batch in batches:
            scan.offer(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1))
        yield from scan.found()

    return run


def _in_cells(k: int):
    """Of rows sorted by cell and then with its queries first: the best rows of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asking, scan = None, [], None
        for batch in batches:
            cells = batch.column("block").to_numpy() * (1 << 32) + batch.column("part").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if cells[a] != now:
                    if scan is not None:
                        yield from scan.found()
                    now, asking, scan = cells[a], [], None
                piece = batch.slice(a, b - a)
                if asks[a]:
                    asking.append(piece)
                    continue
                if scan is None:
                    rows = pa.Table.from_batches(asking).combine_chunks() if asking else None
                    scan = Scan(_sides(rows.column("vec_id").to_numpy(), pa.concat_arrays(rows.column("v").chunks), k) if asking else {}, k)
                    asking = []
                scan.offer(piece.column("vec_id").to_numpy(), piece.column("v"))
        if scan is not None:
            yield from scan.found()

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` marks, the k rows with the highest inner products.

    Vectors become floor(256 * x). Ties go to the smaller id; a query's own id is no candidate. Rows
    with a null id, and vectors that are null or hold a null or a component that is not finite (256
    times it included), take no part; vectors are compared with those of their own dimension. Equal rows of an id count once;
    where an id has several vectors, each may be found and each asks. Up to ``block`` queries are broadcast
    to all rows. More queries are dealt into blocks of about that many and the rows into parts, and one
    job takes each block with each part in a cell of its own, in any order and on any machine. Either way
    a block starts from exact scores among its own members, and a task holds a block of queries, a batch of rows
    and k rows a query. An empty table gives an empty result; other columns are not read.
    """
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id is not null and v is not null")
    count, queries = base.agg(F.count("*"), F.count_if("asks")).first()
    asking = base.where("asks").select("vec_id", "v")
    blocks = -(-queries // block)
    if not blocks:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if blocks == 1:
        own = asking.toArrow().combine_chunks()  # at most `block` rows
        sides = _sides(own.column("vec_id").to_numpy(), pa.concat_arrays(own.column("v").chunks), k)
        best = base.select("vec_id", "v").mapInArrow(_against_one_block(rows.sparkSession.sparkContext.broadcast(sides), k), _FOUND)
    else:
        parts = -(-count // (PART * block))
        dealt = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id(), F.lit(salt)), F.lit(n)).cast("long")
        every = lambda n, name: F.explode(F.expr(f"sequence(0L, {n - 1}L)")).alias(name)
        asks = cut(asking.withColumn("block", dealt(blocks, "q"))).select("vec_id", "v", "block", every(parts, "part"), F.lit(True).alias("asks"))
        offered = base.select("vec_id", "v", dealt(parts, "r").alias("part")).select("vec_id", "v", every(blocks, "block"), "part", F.lit(False).alias("asks"))
        cells = asks.unionByName(offered).repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", F.desc("asks"))
        best = cells.mapInArrow(_in_cells(k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
