"""Mergeable quantile summaries: an exponential hierarchy of blocks with rank-bounded points.

A group's rows fill blocks of a fixed number of rows in the order in which a task meets them. A full block
is sorted into points, each a value with bounds of its rank; two summaries of level l merge into one of
level l + 1, which is pruned: of its points enough stay that the rank between two neighbours grows by at
most 2 * e(l + 1) of the rows below. The local errors e(l) = error * 6 / (pi * l) ** 2 fall with the level and
add up to less than ``error`` however many levels there are, so the bound holds without knowing the number
of rows. Tasks build hierarchies of what they read and send those levels; hierarchies of many tasks merge
in rounds of FAN, so no task meets all of a group. Summaries of batches merge by their points alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.checkpoints import cut
from gridwright.llm.common import bucket_of, give_back, shelf, written
from gridwright.operators.quantiles import rank_counts

#: Rows of a block, and points that a finished summary may have.
BLOCK, POINTS = 1000, 1000
#: Rank error of a hierarchy as a share of its rows; a finished summary and one merged from finished ones add 1 / POINTS each.
ERROR = 0.003
#: Points that a summary keeps even where one value holds nearly all rows.
LEAST_POINTS = 20
#: Rows that a task sorts at a time, and partitions whose hierarchies meet in one task.
CHUNK, FAN = 1 << 18, 64


class Summary(NamedTuple):
    """Ascending values; below: at most so many rows are smaller, upto: at least so many are not larger. The first and the last are the extremes."""

    n: int
    x: np.ndarray
    below: np.ndarray
    upto: np.ndarray

    @classmethod
    def exact(cls, x: np.ndarray, n: np.ndarray) -> Summary:
        """Of values in any order that occur n times each."""
        values, at = np.unique(x, return_inverse=True)
        upto = np.cumsum(np.bincount(at, n, len(values)).astype(np.int64))
        return cls(int(upto[-1]), values, np.concatenate([[0], upto[:-1]]), upto)


def merged(parts: list[Summary]) -> Summary:
    """One summary of all rows; the ranks that are open between neighbours are at most the sum of those of the parts."""
    if len(parts) == 1:
        return parts[0]
    x = np.unique(np.concatenate([p.x for p in parts]))
    below, upto = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for p in parts:
        below += np.append(p.below, p.n)[np.searchsorted(p.x, x, "left")]
        upto += np.concatenate([[0], p.upto])[np.searchsorted(p.x, x, "right")]
    return Summary(sum(p.n for p in parts), x, below, upto)


def pruned(s: Summary, steps: int) -> Summary:
    """At most 2 * steps + LEAST_POINTS + 1 points, between which n / steps more ranks are open than before."""
    if len(s.x) <= LEAST_POINTS:
        return s
    at = np.maximum(np.searchsorted(s.upto, np.arange(steps + 1) * s.n // steps, "right") - 1, 0)
    spread = np.arange(LEAST_POINTS) * (len(s.x) - 1) // (LEAST_POINTS - 1)
    keep = np.unique(np.concatenate([at, np.minimum(at + 1, len(s.x) - 1), spread]))
    return Summary(s.n, s.x[keep], s.below[keep], s.upto[keep])


def finished(s: Summary, points: int = POINTS) -> Summary:
    return s if len(s.x) <= points else pruned(s, (points - LEAST_POINTS - 2) // 2)


def estimates(s: Summary, targets: np.ndarray) -> np.ndarray:
    """Places of the points whose rank is nearest to each target, by the bounds; not falling where targets rise."""
    middle = s.below + 1 + s.upto
    low = np.maximum(np.searchsorted(middle, 2 * targets, "right") - 1, 0)
    high = np.minimum(low + 1, len(s.x) - 1)
    return np.where(np.maximum(targets - s.upto[low], 0) <= np.maximum(s.below[high] + 1 - targets, 0), low, high)


class Hierarchy:
    """Blocks and levels of one group."""

    def __init__(self, block: int, error: float):
        self.block, self.error = block, error
        self.levels: dict[int, Summary] = {}
        self.open: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def rows(self, x: np.ndarray, n: np.ndarray) -> None:
        """More rows: values and how often each counts."""
        self.open.append((x, n))
        self.held += len(x)
        if self.held >= self.block:
            x, n = (np.concatenate(c) for c in zip(*self.open, strict=True))
            full = len(x) // self.block * self.block
            for a in range(0, full, self.block):
                self.add(0, Summary.exact(x[a : a + self.block], n[a : a + self.block]))
            self.open, self.held = ([(x[full:], n[full:])], len(x) - full) if full < len(x) else ([], 0)

    def add(self, level: int, s: Summary) -> None:
        while level in self.levels:
            s = merged([self.levels.pop(level), s])
            level += 1
            s = pruned(s, int(np.ceil(np.pi**2 * level**2 / (12 * self.error))))
        self.levels[level] = s

    def parts(self) -> Iterator[tuple[int, Summary]]:
        """(level, summary); what fills no block is an exact summary of level 0."""
        if self.held:
            yield 0, Summary.exact(*(np.concatenate(c) for c in zip(*self.open, strict=True)))
        yield from self.levels.items()


def _runs(table: pa.Table | pa.RecordBatch, by: list[str]) -> np.ndarray:
    """A number for each row, equal for rows with equal ``by``, nulls included."""
    out = np.zeros(table.num_rows, np.int64)
    for name in by:
        column = table.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        coded = column.dictionary_encode(null_encoding="encode")
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        out = np.unique(out * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return out


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32), pa.array(flat.astype(np.int64)))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


_COLUMNS = ["slot", "level", "n", "x", "below", "upto"]


def _batches(keys: pa.Table, by: list[str], at: np.ndarray, slot: int, level: np.ndarray, n: np.ndarray, lists: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """Rows of summaries, a few MB at a time."""
    out = pa.table([keys.column(c).take(pa.array(at)) for c in by] + [pa.array(np.full(len(at), slot, np.int32)), pa.array(level.astype(np.int32)), pa.array(n.astype(np.int64)), *lists], names=[*by, *_COLUMNS])
    yield from out.combine_chunks().to_batches(max_chunksize=1 << 14)


def _together(group: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[pa.Array]]:
    """Exact summaries of many small groups at once: (groups, total, first of each, lists of x, below, upto)."""
    order = np.lexsort((x, group))
    group, x, n = group[order], x[order], n[order]
    new = np.ones(len(x), bool)
    new[1:] = (group[1:] != group[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    group, x, n = group[at], x[at], np.add.reduceat(n, at) if len(at) else n
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    upto, sizes = np.cumsum(n), np.diff(np.append(starts, len(x)))
    upto = upto - np.repeat(upto[starts] - n[starts], sizes) if len(x) else upto
    offsets = pa.array(np.append(starts, len(x)).astype(np.int32))
    return group[starts], np.add.reduceat(n, starts) if len(starts) else n, sizes, [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (x, upto - n, upto)]


def _blocks(by: list[str], block: int, error: float):
    """Rows with x and n to summaries of what each task reads: parts of hierarchies, and one exact part of each group that fills no block."""

    def packed(table: pa.Table, slot: int) -> Iterator[pa.RecordBatch]:
        run = _runs(table, by)
        x, n = (table.column(c).to_numpy() for c in ("x", "n"))
        first = np.full(run.max() + 1, -1)
        first[run[::-1]] = np.arange(len(run))[::-1]
        many = np.bincount(run) >= block
        small = ~many[run]
        if small.any():
            group, total, _, lists = _together(run[small], x[small], n[small])
            yield from _batches(table, by, first[group], slot, np.zeros(len(group)), total, lists)
        order = np.argsort(run[~small], kind="stable")  # in the order of arrival
        of, x, n = run[~small][order], x[~small][order], n[~small][order]
        cuts = [*np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)] if len(of) else []
        for a, b in zip([0, *cuts], cuts, strict=False):
            tree = Hierarchy(block, error)
            tree.rows(x[a:b], n[a:b])
            parts = list(tree.parts())
            yield from _batches(table, by, np.full(len(parts), first[of[a]]), slot, np.array([p[0] for p in parts]), np.array([p[1].n for p in parts]), [_lists([p[1][k] for p in parts]) for k in (1, 2, 3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, slot = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                held.append(batch.slice(a, CHUNK))
                rows += held[-1].num_rows
                if rows >= CHUNK:
                    yield from packed(pa.Table.from_batches(held).combine_chunks(), slot)
                    held, rows = [], 0
                    give_back()
        if rows:
            yield from packed(pa.Table.from_batches(held).combine_chunks(), slot)

    return run


def _gathered(by: list[str], block: int, error: float, points: int, last: bool, finish: bool):
    """Parts of a group, met one after another, to fewer parts or, if ``last``, to one summary.

    Parts of level 0 are exact. A group of few rows in exact parts alone stays exact; others build a
    hierarchy, or merge by their points where the parts are finished summaries already (``finish``).
    """

    def whole(parts: list[Summary]) -> tuple[int, Summary]:
        return 1, finished(merged(parts), points)

    def grouped(table: pa.Table) -> Iterator[pa.RecordBatch]:
        run = _runs(table, by)
        starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(run))))
        level, sizes = table.column("level").to_numpy(), pc.list_value_length(table.column("x")).to_numpy()
        few = (np.bincount(group, level > 0, len(starts)) == 0) & (np.bincount(group, sizes, len(starts)) <= block)
        slot = table.column("slot")[0].as_py() // FAN
        x, below, upto = (_flat(table.column(c)) for c in ("x", "below", "upto"))
        small = np.repeat(few[group], sizes)
        if few.any():
            at, total, _, lists = _together(np.repeat(group, sizes)[small], x[small], (upto - below)[small])
            yield from _batches(table, by, starts[at], slot, np.zeros(len(at)), total, lists)
        ends, n = np.cumsum(sizes), table.column("n").to_numpy()
        for g in np.flatnonzero(~few).tolist():
            a, b = starts[g], starts[g + 1] if g + 1 < len(starts) else len(run)
            tree, done = Hierarchy(block, error), []
            for i in range(a, b):
                piece = slice(ends[i] - sizes[i], ends[i])
                if finish:
                    done.append(Summary(int(n[i]), x[piece], below[piece], upto[piece]))
                elif level[i] == 0 and sizes[i] < block:
                    tree.rows(x[piece], upto[piece] - below[piece])
                else:
                    tree.add(int(level[i]), Summary(int(n[i]), x[piece], below[piece], upto[piece]))
            parts = [whole(done or [s for _, s in tree.parts()])] if last else list(tree.parts())
            yield from _batches(table, by, np.full(len(parts), a), slot, np.array([p[0] for p in parts]), np.array([p[1].n for p in parts]), [_lists([p[1][k] for p in parts]) for k in (1, 2, 3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            codes = _runs(table, by)
            same = np.flatnonzero(codes != codes[-1])
            cut_at = same[-1] + 1 if len(same) else 0  # the last group may go on
            if cut_at:
                yield from grouped(table.slice(0, cut_at).combine_chunks())
            held = table.slice(cut_at).combine_chunks().to_batches()
            give_back()
        if held:
            yield from grouped(pa.Table.from_batches(held).combine_chunks())

    return run


def _schema(rows: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by) + ", slot int, level int, n long, x array<long>, below array<long>, upto array<long>"


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def summaries(rows: DataFrame, by: list[str], shelf: str, block: int = BLOCK, error: float = ERROR, points: int = POINTS) -> DataFrame:
    """by, level, n, x, below, upto: a summary of each group of rows that have ``by``, x (long) and n (how often the row counts).

    Level 0 marks exact summaries: groups of up to ``block`` rows are. Rank errors of the others are at most
    error + 1 / points of the group's n. ``shelf`` is the shared folder for what is sent.
    """
    parts = written(rows.select(*by, "x", "n").mapInArrow(_blocks(by, block, error), _schema(rows, by)), shelf)
    slots = (parts.agg(F.max("slot")).first()[0] or 0) + 1
    while slots > FAN:
        shared = F.expr(f"cast(slot div {FAN} as int)").alias("to")
        parts = parts.select("*", shared)
        parts = _dealt(parts, [*by, "to"]).mapInArrow(_gathered([*by, "to"], block, error, points, False, False), _schema(parts, [*by, "to"])).drop("slot").withColumnRenamed("to", "slot")
        parts, slots = written(parts, shelf), -(-slots // FAN)
    return _dealt(parts, by).mapInArrow(_gathered(by, block, error, points, True, False), _schema(parts, by)).drop("slot")


def merged_summaries(found: DataFrame, by: list[str], block: int = BLOCK, points: int = POINTS) -> DataFrame:
    """Summaries by fewer columns, from the points of finished ones alone; errors grow by 1 / points."""
    parts = found.select(*by, F.lit(0).alias("slot"), *_COLUMNS[1:])
    return _dealt(parts, by).mapInArrow(_gathered(by, block, ERROR, points, True, True), _schema(parts, by)).drop("slot")


def answers(found: DataFrame, by: list[str], parts: int = 20, least: int = 20) -> DataFrame:
    """by, exact, n, points and, in arrays over i = 1 .. parts - 1, target = ceil(i * n / parts), answer, below, upto.

    Groups of fewer than ``least`` rows have no answer. below and upto are the summary's bounds, which are
    the true counts where it is exact.
    """
    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater_equal(batch.column("n"), least))
            n, sizes = batch.column("n").to_numpy(), pc.list_value_length(batch.column("x")).to_numpy()
            flat, ends = [batch.column(c).flatten().to_numpy() for c in ("x", "below", "upto")], np.cumsum(sizes)
            targets = -(-np.arange(1, parts)[None, :] * n[:, None] // parts)
            out = []
            for i in range(batch.num_rows):
                s = Summary(int(n[i]), *(f[ends[i] - sizes[i] : ends[i]] for f in flat))
                at = estimates(s, targets[i])
                out.append([targets[i], s.x[at], s.below[at], s.upto[at]])
            yield pa.record_batch(
                [*(batch.column(c) for c in by), pc.equal(batch.column("level"), 0), pa.array(n), pa.array(sizes.astype(np.int64)), *(_lists([o[k] for o in out]) for k in range(4))],
                names=[*by, "exact", "n", "points", "target", "answer", "below", "upto"],
            )

    return found.mapInArrow(run, f"{kinds}, exact boolean, n long, points long, target array<long>, answer array<long>, below array<long>, upto array<long>")


#: Parts that the rows of a group that has answers are dealt to while they are counted.
SALTS = 64


def _one_by_one(found: DataFrame, by: list[str], *more: str) -> DataFrame:
    """A row for each i of the arrays."""
    zipped = F.arrays_zip("target", "answer", "below", "upto")
    return found.select(*by, "exact", "n", "points", F.posexplode(zipped).alias("i", "__z")).select(*by, "exact", "n", "points", (F.col("i") + 1).alias("i"), "__z.*")


def audited(rows: DataFrame, found: DataFrame, by: list[str], batch: str, folder: str) -> DataFrame:
    """by, batch, i, n, target, exact_x, points, answer, n_below, n_upto of ``answers`` of batches and of wholes (batch -1).

    An exact summary's own counts are the counts of its rows. The rows of all other groups are counted: they meet
    the names of these groups over salted keys, and their ranks come from ranges of (group, x), so a group may be
    of any size. ``by`` and ``batch`` hold no null.
    """
    key = [*by, batch]
    each = _one_by_one(found, key)
    large = written(found.where(~F.col("exact")), folder)
    salt = F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")
    names = large.select(*by).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    counted = rows.withColumn("salt", salt).join(names.hint("merge"), [*by, "salt"], "left_semi").withColumn(batch, F.explode(F.array(F.col(batch), F.lit(-1))))
    ranked = rank_counts(counted.select(*key, "x", "n"), key, "x", "n")
    met = ranked.withColumnsRenamed({"below": "lower", "upto": "upper"}).join(large.select(*key, "target", "answer").hint("merge"), key)
    hit = F.filter(F.arrays_zip(F.sequence(F.lit(1), F.size("target")).alias("i"), "target", "answer"), lambda z: ((F.col("lower") < z["target"]) & (z["target"] <= F.col("upper"))) | (z["answer"] == F.col("x")))
    met = met.select(*key, "x", "lower", "upper", F.explode(hit).alias("z")).select(*key, "x", "lower", "upper", "z.*").repartition(*key, "i")
    holds = (F.col("lower") < F.col("target")) & (F.col("target") <= F.col("upper"))
    here = F.col("answer") == F.col("x")
    true = met.groupBy(*key, "i").agg(F.max(F.when(holds, F.col("x"))).alias("exact_x"), F.max(F.when(here, F.col("lower"))).alias("n_below"), F.max(F.when(here, F.col("upper"))).alias("n_upto"))
    out = [*key, "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto"]
    known = each.where("exact").withColumns({"exact_x": F.col("answer"), "n_below": F.col("below"), "n_upto": F.col("upto")})
    return known.select(*out).unionByName(_one_by_one(large, key).join(true, [*key, "i"]).select(*out))


def shop_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, grp, batch, x, n: clicks' values by client and sale lines' item prices by brand.

    Of rows with one click_id, one counts. Lines are counted by item and batch before they meet the items.
    Rows without item, group or money, and money that is no number, are left out.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    batch = lambda c: bucket_of(F.col(c), 16).cast("int").alias("batch")
    money = lambda c: (F.floor(100 * F.col(c) + 0.5) + 1000 * F.col("batch")).cast("long").alias("x")
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e15)
    clicks = read("clicks").groupBy("click_id").agg(F.min(F.struct("ts", "arrived_at", "client_id", "value")).alias("row")).select("click_id", "row.client_id", "row.value")
    clicks = clicks.where(F.col("client_id").isNotNull() & there("value")).select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), batch("click_id"), "value")
    lines = read("sale_lines").where(F.col("item_id").isNotNull()).groupBy("item_id", batch("vendor_id")).agg(F.count("*").alias("n"))
    items = read("items").where(F.col("brand").isNotNull() & there("price")).select("item_id", F.col("brand").alias("grp"), "price")
    lines = lines.join(items.hint("merge"), "item_id").select(F.lit("price").alias("stream"), "grp", "batch", money("price"), "n")
    return clicks.select("stream", "grp", "batch", money("value"), F.lit(1).cast("long").alias("n")).unionByName(lines)


def shop_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch of every group of both streams summarised, the summaries merged into wholes, and all answers audited."""
    with shelf(spark) as folder:
        rows = written(shop_streams(spark, sf_dir), folder)
        by = ["stream", "grp"]
        batches = written(summaries(rows, [*by, "batch"], folder), folder)
        wholes = merged_summaries(batches, by).withColumn("batch", F.lit(-1))
        found = written(answers(batches.unionByName(wholes), [*by, "batch"]), folder)
        error = F.greatest(F.lit(0), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
        out = audited(rows, found, by, "batch", folder).withColumn("rank_error", error).withColumn("within", 1000 * F.col("rank_error") <= 10 * F.col("n"))
        return cut(out.select("stream", "grp", "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within"))
