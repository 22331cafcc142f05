"""Source divergence audit: how far the term shares of each source lie from those of other sources and of its language.

Terms are counted by (language, source, term) and dealt by a hash into blocks of one language. A block is
a dense int64 matrix of its groups by its terms, groups without a term included; the chi-square-like
distance of every ordered pair of groups is taken by broadcasting the matrix against itself, and the
matrices of partial sums are added over the blocks. Each block also holds a heap of the most diverging
terms of each group; heaps are merged by rank. With many sources the groups are dealt into blocks too,
so that a matrix stays small. Shares are integers, and all arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.checkpoints import cut
from gridwright.llm import runs
from gridwright.llm.common import maybe_broadcast, slices, words_of

#: A share is 1 plus so many times the smoothed frequency.
SCALE = 1_000_000_000
#: Documents of a language that must hold a term.
LEAST_DOCS = 3
#: Terms of a group that are listed.
MOST_TERMS = 200
#: Cells of a block's matrix, groups in one side of it, and cells that are broadcast at once.
CELLS, GROUPS, PAIR_CELLS = 1 << 17, 256, 1 << 21


def _letters() -> np.ndarray:
    """What each byte of a text becomes: ASCII letters lower case, bytes beyond ASCII as they are, all else a space."""
    table = np.full(256, ord(" "), np.uint8)
    table[128:] = np.arange(128, 256)
    for first in "aA":
        table[ord(first) : ord(first) + 26] = np.arange(ord("a"), ord("z") + 1)
    return table


_LETTERS = _letters()


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes and dictionary of the terms of each text, and the texts' offsets into the codes."""
    data, offsets = runs.texts_data(texts)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LETTERS[data]))
    return words_of(plain)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a slice of documents; a row without term for each group."""
    for batch in slices(batches, "text", 12 << 20, 1 << 14):
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        both = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
        groups, of = np.unique(both, return_inverse=True)
        codes, terms, offsets = terms_of(batch.column("text"))
        size = max(1, len(terms))
        held, n = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(offsets)) * size + codes, return_counts=True)
        cells, at = np.unique(of[held // size] * size + held % size, return_inverse=True)
        group = np.concatenate([cells // size, np.arange(len(groups))])
        named = lambda column, code: column.dictionary.take(pa.array(code))
        yield pa.record_batch(
            [
                named(lang, groups[group] // len(source.dictionary)),
                named(source, groups[group] % len(source.dictionary)),
                pa.concat_arrays([terms.cast(pa.large_string()).take(pa.array(cells % size)), pa.nulls(len(groups), pa.large_string())]).cast(pa.string()),
                pa.array(np.append(np.bincount(at, n, len(cells)).astype(np.int64), np.zeros(len(groups), np.int64))),
                pa.array(np.append(np.bincount(at, minlength=len(cells)), np.zeros(len(groups), np.int64))),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / totals), exactly while totals stay under 9 * 10**15: divided three digits at a time."""
    left, out = counts + 1, np.zeros(np.broadcast(counts, totals).shape, np.int64)
    out, left = left // totals, left % totals
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // totals, left % totals
    return out + 1


def pair_sums(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Sum over terms of floor((p - q)**2 / q) for each row p of ``own`` and q of ``other``."""
    out = np.zeros((len(own), len(other)), np.int64)
    step = max(1, PAIR_CELLS // max(1, other.size))
    for i in range(0, len(own), step):
        apart = own[i : i + step, None, :] - other[None, :, :]
        out[i : i + step] = (apart * apart // other[None, :, :]).sum(2)
    return out


_TILE = "lang string, source string, part string, item string, value long"


def _tile(most: int):
    """One block: rows without a term name its groups, the others are its cells."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda rows, c: rows.column(c).to_numpy()
        heads, cells = table.filter(pc.is_null(table["term"])), table.filter(pc.is_valid(table["term"]))
        order = np.argsort(column(heads, "place"))
        heads = heads.take(pa.array(order))
        place, side = column(heads, "place"), column(heads, "place") // GROUPS
        a, b = heads["a"][0].as_py(), heads["b"][0].as_py()
        names = heads["source"].combine_chunks()
        coded = cells["term"].combine_chunks().dictionary_encode()
        coded = coded if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks()
        term = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.zeros((len(place), len(coded.dictionary)), np.int64)
        counts[np.searchsorted(place, column(cells, "place")), term] = column(cells, "n")
        total = column(heads, "n") + column(heads, "kept")
        p = shares(counts, np.maximum(total, 1)[:, None])
        own, other = np.flatnonzero(side == a), np.flatnonzero(side == b)
        sums = pair_sums(p[own], p[other])
        first, second = np.nonzero(own[:, None] != other[None, :])
        out = [(names.take(pa.array(own[first])), "pair", names.take(pa.array(other[second])), sums[first, second])]
        if a == b and len(coded.dictionary):
            whole = np.zeros(len(coded.dictionary), np.int64)
            whole[term] = column(cells, "lang_n")
            q = shares(whole, np.maximum(column(heads, "lang_total")[0] + column(heads, "kept")[0], 1))
            for i in own.tolist():
                at = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                value = (p[i][at] - q[at]) ** 2 // q[at]
                if len(at) > most:  # the heap: all that reach the value of rank ``most``, ties included
                    keep = value >= np.partition(value, len(at) - most)[len(at) - most]
                    at, value = at[keep], value[keep]
                out.append((pa.repeat(names[i], len(at)), "term", coded.dictionary.take(pa.array(at)), value))
        lang = table["lang"][0]
        return pa.concat_tables(
            pa.table([pa.repeat(lang, len(value)).cast(pa.string()), source.cast(pa.string()), pa.repeat(part, len(value)), item.cast(pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])
            for source, part, item, value in out
        )

    return run


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: of each source the other sources of its language, and its most diverging terms.

    Nulls count as ''. Terms are runs of letters (ASCII letters lower-cased, all characters beyond ASCII),
    and a language keeps those in at least ``least_docs`` of its documents. Part 'pair' lists every other
    source, with 0 where the language keeps no term; part 'term' the ``most_terms`` terms that the source has
    more often than its language. Equal values rank by the item's bytes. A language of one source has no
    pair; repeated rows count as often as they occur; an empty table gives an empty result; other columns
    are not read.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(named(text_col).alias("text"), named(lang_col).alias("lang"), named(source_col).alias("source"))
    counted = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    counted = cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    kept = counted.where(F.col("term").isNotNull()).withColumns({"lang_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "first": F.min("source").over(term) == F.col("source")})
    kept = cut(kept.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("kept"))
    lang = Window.partitionBy("lang")
    groups = (
        counted.where(F.col("term").isNull())
        .select("lang", "source")
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["n", "lang_total", "kept"])
        .withColumns({"place": F.row_number().over(lang.orderBy("source")) - 1, "groups": F.count("*").over(lang)})
        .withColumn("sides", F.ceil(F.col("groups") / GROUPS))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") * F.least("groups", F.lit(GROUPS)) / CELLS)))
    )
    groups = cut(groups)
    own, sides = F.expr(f"cast(place div {GROUPS} as long)"), F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)
    tiles = F.array_distinct(F.concat(F.transform(sides, lambda o: F.struct(own.alias("a"), o.alias("b"))), F.transform(sides, lambda o: F.struct(o.alias("a"), own.alias("b")))))
    cells = kept.join(maybe_broadcast(groups.select("lang", "source", "place", "sides", "blocks")), ["lang", "source"])
    cells = cells.select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), F.explode(tiles).alias("tile"), "place", "term", "n", "lang_n")
    heads = groups.withColumn("tile", F.explode(tiles)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = heads.select("lang", "block", "tile", "place", "n", "source", "kept", "lang_total").unionByName(cells, allowMissingColumns=True)
    key = ["lang", "block", "a", "b"]
    found = both.select("*", "tile.a", "tile.b").drop("tile").groupBy(*key).applyInArrow(_tile(most_terms), _TILE)
    found = cut(found)
    pairs = found.where(F.col("part") == "pair").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = found.where(F.col("part") == "term").select("*", rank).where(F.col("rank") <= most_terms)
    return pairs.select("*", rank).unionByName(terms)
