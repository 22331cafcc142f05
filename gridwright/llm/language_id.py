"""Language ID by prediction by partial matching: a byte context tree for each language, statistics frozen.

A tree knows how often each byte followed each context of up to ORDER bytes. A byte that was not
seen after a context costs that context's escape and then its code in the context one byte shorter,
among the bytes not excluded already; below the empty context all bytes are alike. Counts do not
change while a text is scored, so each (context, byte) has one exact code length: those that were
seen are listed, any other is the context's escape plus the code length one byte shorter. A text's
code length is their sum, and the shortest code wins. Trees are built and looked up one language at
a time and grow with what the language's sample holds; no byte or context is merged or left out for
want of room.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.checkpoints import cut
from gridwright.llm.common import bucket_of, slices

ORDER = 3
#: Documents of each language that are learned from, about: a share of them is drawn by a hash of their ids.
LEARNED = 400
#: Times that a language's sample must hold a context of 0, 1, 2 and 3 bytes for the tree to have it.
LEAST_SEEN = (0, 1, 2, 2)
#: What stands before a text's first byte.
PAD = 10
#: Bytes whose costs are added up together.
CHUNK = 1 << 20
UNKNOWN = "und"
#: A text is explained by a language if its code takes at most MARGIN times the bits a byte that RATE_SHARE of unseen documents of the language need, and SLACK bits.
MARGIN, RATE_SHARE, SLACK = 2.0, 0.99, 256.0
#: Documents of a language, and bytes of each, from which that rate is taken; with fewer documents there is no bound.
RATED, RATED_BYTES = 20, 64


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ascending keys have the wanted ones, and whether they do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass(frozen=True)
class Tree:
    """One language's code lengths. Keys are bytes as big-endian numbers, a context before its byte, ascending."""

    seen: list[np.ndarray]  # by order: (context, byte) that occurred
    bits: list[np.ndarray]  # their code lengths
    contexts: list[np.ndarray]  # by order
    escapes: list[np.ndarray]  # bits that a byte costs that did not occur after the context, besides those one byte shorter

    @classmethod
    def of(cls, grams: np.ndarray, n: np.ndarray) -> Tree:
        """grams: runs of ORDER + 1 bytes, n: how often they occurred."""
        seen, bits, contexts, escapes = [], [], [], []
        above = np.zeros(0)
        for order in range(ORDER + 1):
            key, place = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            count = np.bincount(place, weights=n, minlength=len(key))
            context, at = np.unique(key >> 8, return_inverse=True)
            total, kinds = np.bincount(at, weights=count, minlength=len(context)), np.bincount(at, minlength=len(context))
            known = total >= LEAST_SEEN[order]
            kept = known[at]
            parent = np.full(len(key), 1 / 256) if order == 0 else above[np.minimum(np.searchsorted(seen[-1], key & ((1 << 8 * order) - 1)), max(0, len(above) - 1))]
            left = 1 - np.bincount(at, weights=parent, minlength=len(context))
            prob = count / (total + kinds)[at]
            escape = np.log2(np.maximum(left, 1e-12)) - np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1))
            seen.append(key[kept].astype(np.uint32)), bits.append(-np.log2(prob[kept]))
            contexts.append(context[known].astype(np.uint32)), escapes.append(escape[known])
            above = prob[kept]
        return cls(seen, bits, contexts, escapes)

    def code_lengths(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run after the others; runs ascending for speed only."""
        out, todo = np.zeros(len(grams)), np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            at, hit = _places(self.seen[order], grams[todo] & np.uint32((1 << 8 * (order + 1)) - 1))
            out[todo[hit]] += self.bits[order][at[hit]]
            todo = todo[~hit]
            at, hit = _places(self.contexts[order], (grams[todo] >> np.uint32(8)) & np.uint32((1 << 8 * order) - 1))
            out[todo[hit]] += self.escapes[order][at[hit]]
        out[todo] += 8.0  # every byte alike
        return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    trees: list[Tree]
    rates: np.ndarray  # most bits a byte of a text that the language explains; infinite where too little was seen to tell

    def code_lengths(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language; text i is flat[offsets[i]:offsets[i + 1]]."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        padded, lengths = _padded(flat, offsets), np.diff(offsets)
        for a in range(0, len(flat), CHUNK):
            b = min(a + CHUNK, len(flat))
            first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
            texts = np.arange(first, last)
            texts = texts[lengths[texts] > 0]
            starts = np.maximum(offsets[texts], a)
            place = np.arange(a, b) + ORDER * (np.repeat(texts, np.minimum(offsets[texts + 1], b) - starts) + 1)
            codes, runs = pd.factorize(_runs(padded, place))
            order = np.argsort(runs)
            for i, tree in enumerate(self.trees):
                cost = np.empty(len(runs))
                cost[order] = tree.code_lengths(runs[order])
                out[texts, i] += np.add.reduceat(cost[codes], starts - a)
        return out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and whether the language explains the text.

        The score is the share of 2**-bits that the best language holds; 'und', 0 and False without a letter.
        Where no language is known, nothing speaks against a text with letters.
        """
        filled = pc.fill_null(texts, "")
        lettered = pc.match_substring_regex(filled, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
        if not self.languages:
            return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), lettered
        flat, offsets = _bytes(filled)
        bits = self.code_lengths(flat, offsets)
        best = bits.argmin(1)
        share = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
        explained = lettered & (bits.min(1) - SLACK <= np.where(np.isinf(self.rates), 1e300, self.rates)[best] * np.diff(offsets))
        return np.where(lettered, np.array(self.languages, object)[best], UNKNOWN), np.where(lettered, share, 0.0), explained


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts' bytes and offsets."""
    lower = pc.utf8_lower(texts).cast(pa.large_string())
    offsets = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = np.frombuffer(lower.buffers()[2], np.uint8) if lower.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _padded(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """All texts' bytes, ORDER pads before each."""
    out = np.full(len(flat) + ORDER * (len(offsets) - 1), PAD, np.uint8)
    at = np.arange(len(flat), dtype=np.int64)
    at += ORDER * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    out[at] = flat
    return out


def _runs(padded: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each place's byte with the ORDER before it, as one number."""
    out = padded[place].astype(np.uint32)
    for k in range(1, ORDER + 1):
        out |= padded[place - k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, half, gram, n): each run of ORDER + 1 bytes, the pads before a text included, as a number. Rows without a half are of half 0."""
    for batch in slices(batches, "text", 2 << 20):
        halves = batch.column("half").to_pylist() if "half" in batch.schema.names else [0] * batch.num_rows
        keys = list(zip(batch.column("lang").to_pylist(), halves, strict=True))
        for lang, half in sorted(set(keys)):
            flat, offsets = _bytes(batch.column("text").filter(pa.array([k == (lang, half) for k in keys])))
            place = np.arange(len(flat)) + ORDER * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
            grams, n = np.unique(_runs(_padded(flat, offsets), place), return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array([half] * len(grams), pa.int32()), pa.array(grams.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "half", "gram", "n"])


def _trees(counted: DataFrame, by: list[str]) -> list:
    """Rows of ``by`` and the group's tree, pickled: a row for each language reaches the driver."""

    def run(table: pa.Table) -> pa.Table:
        tree = Tree.of(table.column("gram").to_numpy(), table.column("n").to_numpy())
        return pa.table({**{c: table.column(c).slice(0, 1) for c in by}, "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    summed = counted.groupBy(*by, "gram").agg(F.sum("n").alias("n"))
    kinds = ", ".join(f"{c} {counted.schema[c].dataType.simpleString()}" for c in by)
    return summed.groupBy(*by).applyInArrow(run, f"{kinds}, tree binary").collect()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learned: int = LEARNED, folds: int = 5, rated: bool = False) -> Model:
    """Learn from documents with text and language whose crc32(id) mod ``folds`` is not 0, about ``learned`` of each language.

    What reaches the driver is one tree a language, whatever the table's size. With ``rated`` each half of
    the sample is scored under the other half's tree, which gives the bits a byte that documents of a
    language need. Without any such document the model knows no language and predicts 'und'.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (bucket_of(F.col("doc_id"), folds) != 0))
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not per:
        return Model([], [], np.zeros(0))
    hashed = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("language sample"))
    drawn = F.shiftrightunsigned(hashed, 11) / float(1 << 53)
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in per.items() for x in (lang, min(1.0, learned / n))]), F.col("lang"))
    sample = rows.where(drawn < share).select("lang", "text", F.pmod(hashed, F.lit(2)).cast("int").alias("half"))
    sample = cut(sample) if rated else sample
    counted = cut(sample.mapInArrow(_grams, "lang string, half int, gram long, n long").groupBy("lang", "half", "gram").agg(F.sum("n").alias("n")))
    found = {r["lang"]: pickle.loads(r["tree"]) for r in _trees(counted, ["lang"])}
    rates = _rates(sample, counted) if rated else {}
    languages = sorted(found)
    return Model(languages, [found[x] for x in languages], np.array([rates.get(x, np.inf) for x in languages]))


def _rates(sample: DataFrame, counted: DataFrame) -> dict[str, float]:
    """lang -> MARGIN times the bits a byte that RATE_SHARE of the sample's documents need under the tree of the other half."""
    trees = {(r["lang"], r["half"]): pickle.loads(r["tree"]) for r in _trees(counted, ["lang", "half"])}
    shared = sample.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            langs, rates = [], []
            for lang, half, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "half", "text")), strict=True):
                tree = shared.value.get((lang, 1 - half))
                flat, offsets = _bytes(pa.array([text], pa.string()))
                if tree is not None and len(flat) >= RATED_BYTES:
                    langs.append(lang), rates.append(float(Model([lang], [tree], np.full(1, np.inf)).code_lengths(flat, offsets)[0, 0] / len(flat)))
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(rates, pa.float64())], names=["lang", "rate"])

    per = sample.mapInArrow(run, "lang string, rate double").groupBy("lang").agg(F.count("*").alias("n"), F.percentile("rate", RATE_SHARE).alias("rate"))
    return {r["lang"]: MARGIN * r["rate"] for r in per.collect() if r["n"] >= RATED}  # a row per language


def build(counted: pd.DataFrame) -> Model:
    """The model of a table of (lang, gram, n), without rates."""
    languages = sorted(counted["lang"].unique())
    of = lambda lang: counted[counted["lang"] == lang]
    return Model(languages, [Tree.of(of(x)["gram"].to_numpy(), of(x)["n"].to_numpy()) for x in languages], np.full(len(languages), np.inf))


def predictions(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``, from the whole text alone.

    lang_pred is 'und' and the score 0 where the text is null or has no letter. Rows repeat as they
    do in the input; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (bucket_of(F.col(id_col), folds) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # grows with the number of languages, not with the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            lang, score, _ = shared.value.predict(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def in_known_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has letters and a language that explains it, with all their columns.

    Rejected are texts that are null or without a letter, and those whose best language needs more bits than
    the model's rate for it allows (see MARGIN). Short texts on which languages tie stay. A model without
    rates rejects only the former.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def kept(text: pa.Array) -> pa.Array:
        parts = [shared.value.predict(part.column(0))[2] for part in slices(iter([pa.record_batch([text], names=["text"])]), "text", 1 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool), pa.bool_())

    return docs.where(kept(F.col(text_col).cast("string")))
