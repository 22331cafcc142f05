"""Exact dedup: counting quotient filters per partition, merged by sorted remainders, then byte verification.

Each partition packs the 64-bit fingerprints of its texts into counting quotient filters, one for
each range of leading bits. Filters of one range meet in one task and merge without loss, since both
list their (quotient, remainder) pairs in order. Only fingerprints counted twice or more send their
texts on, to be compared byte for byte.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.checkpoints import cut
from gridwright.llm.common import fresh, maybe_broadcast

#: Fingerprints that a task holds before it writes its filters; merging again loses nothing.
HELD = 1 << 21
#: Fingerprints aimed at for a merged filter.
RANGE_ROWS = 500_000


class CountingQuotientFilter:
    """Multiset of ``bits``-bit numbers. The leading ``q`` bits name a home slot, the rest is kept there or further right.

    ``occupied`` marks homes that own a run, ``used`` the slots in use, ``run_end`` the last slot of
    each run; remainders of a run are sorted, and every slot in use has a counter.
    """

    def __init__(self, bits: int, q: int, occupied, used, run_end, remainders, counts):
        self.bits, self.q, self.occupied, self.used, self.run_end, self.remainders, self.counts = bits, q, occupied, used, run_end, remainders, counts

    @classmethod
    def of_sorted(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """values: distinct, ascending, uint64 below 2**bits."""
        n = len(values)
        q = min(bits, max(1, int(n * 4 // 3).bit_length()))
        home = (values >> np.uint64(bits - q)).astype(np.int64) if q < 64 else values.astype(np.int64)
        step = np.arange(n)
        slot = step + np.maximum.accumulate(home - step) if n else step  # the next free slot at or after home
        slots = max(1 << q, int(slot[-1]) + 1 if n else 0)
        marks = np.zeros((3, slots), bool)
        marks[0, home] = marks[1, slot] = True
        last = np.append(home[1:] != home[:-1], True) if n else np.zeros(0, bool)
        marks[2, slot[last]] = True
        rest = values & np.uint64((1 << (bits - q)) - 1)
        return cls(bits, q, *marks, rest, counts)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values in ascending order with their counts."""
        ends = self.run_end[self.used]
        run = np.concatenate([[0], np.cumsum(ends)[:-1]]) if len(ends) else np.zeros(0, np.int64)
        home = np.flatnonzero(self.occupied)[run.astype(np.int64)].astype(np.uint64)
        shift = self.bits - self.q
        return (home << np.uint64(shift) if shift < 64 else home * np.uint64(0)) | self.remainders, self.counts

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        parts = [f.items() for f in filters]
        values = np.concatenate([v for v, _ in parts])
        order = np.argsort(values, kind="stable")  # merges the ascending runs
        values, counts = values[order], np.concatenate([c for _, c in parts])[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
        return cls.of_sorted(values[first], np.add.reduceat(counts, first) if len(first) else counts, filters[0].bits)

    def to_bytes(self) -> bytes:
        wide = np.uint32 if not len(self.counts) or self.counts.max() < 1 << 32 else np.uint64
        marks = np.packbits(np.stack([self.occupied, self.used, self.run_end]), axis=1)
        return struct.pack("<BBBQQ", self.bits, self.q, np.dtype(wide).itemsize, len(self.used), len(self.remainders)) + marks.tobytes() + self.remainders.astype("<u8").tobytes() + self.counts.astype(wide).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        bits, q, wide, slots, n = struct.unpack_from("<BBBQQ", raw)
        at, row = struct.calcsize("<BBBQQ"), (slots + 7) // 8
        marks = np.unpackbits(np.frombuffer(raw, np.uint8, 3 * row, at).reshape(3, row), axis=1)[:, :slots].astype(bool)
        rest = np.frombuffer(raw, "<u8", n, at + 3 * row)
        counts = np.frombuffer(raw, f"<u{wide}", n, at + 3 * row + 8 * n).astype(np.uint64)
        return cls(bits, q, *marks, rest, counts)


def _filters(range_bits: int):
    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        bits = 64 - range_bits
        owner = (values >> np.uint64(bits)).astype(np.int64) if range_bits else np.zeros(len(values), np.int64)
        low = values & np.uint64((1 << bits) - 1)
        ranges, first = np.unique(owner, return_index=True)
        ends = [*first[1:], len(values)]
        raw = [CountingQuotientFilter.of_sorted(low[a:b], counts[a:b].astype(np.uint64), bits).to_bytes() for a, b in zip(first, ends, strict=True)]
        return pa.record_batch([pa.array(ranges, pa.int32()), pa.array(raw, pa.binary())], names=["range", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= HELD:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


def _repeated(range_bits: int):
    bits = 64 - range_bits

    def run(key: tuple, table: pa.Table) -> pa.Table:
        whole = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(x) for x in table.column("filter").to_pylist()])
        values, counts = whole.items()
        values, counts = values[counts > 1], counts[counts > 1]
        full = values | np.uint64(key[0].as_py() << bits) if range_bits else values
        return pa.table({"fp": full.view(np.int64), "n": counts.astype(np.int64)})

    return run


def repeated_fingerprints(rows: DataFrame, fp: str = "fp") -> DataFrame:
    """(fp, n) of the 64-bit fingerprints that ``rows`` holds more than once."""
    wanted = max(16, rows.count() // RANGE_ROWS)
    range_bits = min(20, (wanted - 1).bit_length())
    packed = rows.select(F.col(fp).alias("fp")).mapInArrow(_filters(range_bits), "range int, filter binary")
    return packed.groupBy("range").applyInArrow(_repeated(range_bits), "fp long, n long")


def _keys(text: Column) -> tuple[Column, Column, Column]:
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return whole, F.xxhash64(whole), F.sha2(whole.cast("binary"), 256)


def equal_text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprints: DataFrame | None = None) -> DataFrame:
    """(fp, sha, keep_id, group_size) of texts whose fingerprint occurs more than once, compared byte for byte.

    fingerprints: the rows' fp, if they are there already.
    """
    whole, fp, sha = _keys(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), whole.alias("whole"), fp.alias("fp"))
    repeated = cut(repeated_fingerprints(rows if fingerprints is None else fingerprints))
    same = rows.join(maybe_broadcast(repeated.select("fp")), "fp", "left_semi").groupBy("fp", "whole").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    verified = same.select("fp", F.sha2(F.col("whole").cast("binary"), 256).alias("sha"), "keep_id", "group_size").groupBy("fp", "sha").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
    unlike = F.raise_error(F.lit("two texts share fingerprint and SHA-256"))
    return cut(verified.select("fp", "sha", "keep_id", F.when(F.col("texts") > 1, unlike.cast("long")).otherwise(F.col("group_size")).alias("group_size")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the
    largest id stays (a null id is the smallest); of rows equal in id and text just one. An empty
    table gives an empty result; other columns are not read. Texts are read twice: for the digests of
    all rows, and to compare those whose fingerprints repeat.
    """
    _, fp, sha = _keys(F.col(text_col))
    keys = cut(docs.select(F.col(id_col).alias("doc_id"), fp.alias("fp"), sha.alias("sha")))
    groups = maybe_broadcast(equal_text_groups(docs, id_col, text_col, keys))
    rows = keys.join(groups, ["fp", "sha"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    first = F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy(F.lit(0)))
    out = rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "sha")
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (first == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def without_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns, whatever these are called."""
    _, fp, sha = _keys(F.col(text_col))
    f, s, k, hit = fresh(docs.columns, "__gw_fp", "__gw_sha", "__gw_keep", "__gw_in")
    groups = maybe_broadcast(equal_text_groups(docs, id_col, text_col).select(F.col("fp").alias(f), F.col("sha").alias(s), F.col("keep_id").alias(k), F.lit(True).alias(hit)))
    rows = docs.withColumns({f: fp, s: sha}).join(groups, [f, s], "left")
    single = rows.where(F.col(hit).isNull())
    chosen = rows.where(F.col(hit) & F.col(id_col).eqNullSafe(F.col(k))).dropDuplicates([id_col, s])
    return single.unionByName(chosen).drop(f, s, k, hit)
