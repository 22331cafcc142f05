"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics of each whole text are standardised and mapped to cosines of random projections, whose
inner products approximate a Gaussian kernel. Each partition sums its share of the normal equations,
for three folds apart; their sums give the ridge weights, and the equations without a fold give
scores for that fold which the isotonic fit has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.checkpoints import cut
from gridwright.llm.common import bucket_of, slices, words_of

#: Labelled rows that are learned from, about: a share of them is drawn by a hash of their ids.
LEARNED = 20_000
FEATURES = 256
RIDGE = 1e-3
#: Statistics are clipped at so many deviations.
CLIP = 4.0
STATISTICS = (
    "log_chars", "letters", "upper", "digits", "spaces", "stops", "marks", "symbols", "non_ascii", "byte_entropy", "log_words", "word_length", "word_length_sd", "short_words",
    "distinct_words", "top_word", "repeated_next", "marked_words", "upper_words", "lines", "distinct_lines", "distinct_runs", "words_a_stop",
)


def _classes() -> np.ndarray:
    """byte -> letter, upper, digit, space, stop, mark, symbol, non-ASCII, other."""
    out = np.full(256, 8)
    out[128:] = 7
    for chars, k in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t\r\n\v\f", 3), (".,;:", 4), ("!?'\"()-", 5), ("#$%&*+/<=>@[\\]^_`{|}~", 6)):
        out[[ord(c) for c in chars]] = k
    return out


_CLASS = _classes()


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text. Null counts as empty, and an empty text has zeros."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    out = np.zeros((n, len(STATISTICS)))
    codes, dictionary, offsets = words_of(texts)
    names = dictionary.to_pylist()
    lengths = pc.utf8_length(dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    marked = np.array([not w.rstrip(".,;:").isalnum() for w in names], bool)
    upper = np.array([len(w) > 1 and w.isupper() for w in names], bool)
    for i, text in enumerate(texts.to_pylist()):
        if not text:
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        size, bins = len(raw), np.bincount(raw, minlength=256)
        kinds = np.bincount(_CLASS, weights=bins, minlength=9)
        share = bins[bins > 0] / size
        row = [np.log1p(size), (kinds[0] + kinds[1]) / size, kinds[1] / max(1, kinds[0] + kinds[1]), *kinds[2:8] / size, -(share * np.log2(share)).sum()]
        words = codes[offsets[i] : offsets[i + 1]]
        count = len(words)
        if count:
            _, times = np.unique(words, return_counts=True)
            long = lengths[words]
            row += [np.log1p(count), long.mean(), long.std(), (long <= 3).mean(), len(times) / count**0.85, times.max() / count, (words[1:] == words[:-1]).mean() if count > 1 else 0.0, marked[words].mean(), upper[words].mean()]
        else:
            row += [0.0] * 9
        lines = [x for x in text.split("\n") if x]
        runs = words[:-2].astype(np.int64) * 1_000_003 + words[1:-1] * 1_009 + words[2:] if count > 2 else words[:0]
        row += [len(lines) / size, len(set(lines)) / max(1, len(lines)), len(np.unique(runs)) / max(1, len(runs)), count / (1 + bins[ord(".")]) / 20]
        out[i] = row
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return fourier(rows, self.mean, self.deviation) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(rows), *self.steps), 0.0, 1.0)


def fourier(rows: np.ndarray, mean: np.ndarray, deviation: np.ndarray, seed: int = 7) -> np.ndarray:
    """cos(xW + b) with Gaussian W, the root of the number of statistics as kernel width, and a constant."""
    rng, d = np.random.default_rng(seed), len(mean)
    w, b = rng.normal(size=(d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip((rows - mean) / deviation, -CLIP, CLIP)
    return np.column_stack([np.cos(x @ w + b) * np.sqrt(2 / FEATURES), np.ones(len(rows))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the pooled blocks' mean x and mean y, ascending. Equal x are one block from the start."""
    at, place, count = np.unique(x, return_inverse=True, return_counts=True)
    sums = np.bincount(place, weights=y, minlength=len(at))
    blocks: list[list[float]] = []
    for a, s, n in zip(at.tolist(), sums.tolist(), count.tolist(), strict=True):
        blocks.append([s, n, a * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + t]
    return np.array([t / n for _, n, t in blocks]), np.array([s / n for s, n, _ in blocks])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(-1, len(STATISTICS))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, sums, squares) of a partition's statistics."""
    n, s, q = 0, np.zeros(len(STATISTICS)), np.zeros(len(STATISTICS))
    for batch in batches:
        x = _matrix(batch.column("x"))
        n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
    if n:
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([q.tolist()], pa.list_(pa.float64()))], names=["n", "s", "q"])


def _equations(mean: np.ndarray, deviation: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's share of the normal equations for each fold: Z'Z and Z'y side by side."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z, y = fourier(_matrix(batch.column("x")), mean, deviation), batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in np.unique(fold).tolist():
                part = z[fold == f]
                sums[f] = sums.get(f, 0) + part.T @ np.column_stack([part, y[fold == f]])
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([m.astype("<f8").tobytes() for m in sums.values()], pa.binary())], names=["fold", "equations"])

    return run


def _solved(equations: np.ndarray) -> np.ndarray:
    return np.linalg.solve(equations[:, :-1] + RIDGE * max(1.0, equations[-1, -2]) / FEATURES * np.eye(len(equations)), equations[:, -1])


def _described(rows: DataFrame, kept: list[str]) -> DataFrame:
    """The columns ``kept`` and the text's statistics x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(statistics(batch.column("text")).tolist(), pa.list_(pa.float64()))], names=[*kept, "x"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{kinds}, x array<double>")


def _sampled(labels: DataFrame, doc_id: Column, quality: Column, learned: int, folds: int) -> DataFrame:
    """(doc_id, y, fold) of about ``learned`` labelled rows outside the held-out fold, drawn by a hash of the id."""
    rows = labels.select(doc_id.alias("doc_id"), quality.cast("double").alias("y"), bucket_of(doc_id, folds).alias("fold"))
    rows = rows.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (F.col("fold") != 2))
    share = min(1.0, learned / max(1, rows.count()))
    drawn = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality sample")), 11) / float(1 << 53)
    return rows.where(drawn < share)


def fit(docs: DataFrame, labels: DataFrame, learned: int = LEARNED, folds: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from texts and labels of documents whose crc32(id) mod ``folds`` is not 2.

    About ``learned`` labelled rows are used, so all that reaches the driver has a bound: a few sums
    for each of 8 partitions, and the sample's scores. With labels of one kind only, that kind's
    value is every document's score; without labels it is 0.5.
    """
    chosen = F.broadcast(_sampled(labels, F.col(id_col), F.col(label_col), learned, folds))  # about `learned` rows
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(_described(texts.join(chosen, "doc_id").select("text", "y", "fold"), ["y", "fold"]).repartition(8))
    moments = rows.mapInArrow(_moments, "n long, s array<double>, q array<double>").collect()
    n = sum(m["n"] for m in moments)
    if not n:
        zero = np.zeros(len(STATISTICS))
        return Model(zero, zero + 1, np.zeros(FEATURES + 1), (np.array([0.0]), np.array([0.5])))
    mean = np.sum([m["s"] for m in moments], axis=0) / n
    spread = np.sqrt(np.maximum(np.sum([m["q"] for m in moments], axis=0) / n - mean**2, 0))
    deviation = np.where(spread > 1e-9, spread, 1.0)
    by_fold: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(_equations(mean, deviation), "fold long, equations binary").collect():
        by_fold[r["fold"]] = by_fold.get(r["fold"], 0) + np.frombuffer(r["equations"], "<f8").reshape(FEATURES + 1, FEATURES + 2)
    whole = sum(by_fold.values())
    weights = _solved(whole)
    without = {f: _solved(whole - m) if len(by_fold) > 1 else weights for f, m in by_fold.items()}

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, fold = fourier(_matrix(batch.column("x")), mean, deviation), batch.column("fold").to_numpy(zero_copy_only=False)
            raw = np.array([a @ without[f] for a, f in zip(z, fold.tolist(), strict=True)])
            yield pa.record_batch([pa.array(raw, pa.float64()), batch.column("y")], names=["raw", "y"])

    scored = rows.mapInArrow(unseen, "raw double, y double").toPandas()
    return Model(mean, deviation, weights, isotonic(scored["raw"].to_numpy(), scored["y"].to_numpy()))


def scores(docs: DataFrame, model: Model, threshold: float = 0.7, folds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), (bucket_of(F.col(id_col), folds) == 2).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = model.score(statistics(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, learned from ``labels``.

    A null text counts as empty, and empty texts are scored by the same model. Labels with a null id
    or value are left out, and repeated ones count as often as they occur. Rows of ``docs`` repeat as
    in the input; an empty table gives an empty result; other columns are not read.
    """
    return scores(docs, fit(docs, labels), threshold)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)

    @F.arrow_udf("boolean")
    def kept(text: pa.Array) -> pa.Array:
        parts = [model.score(statistics(b.column(0))) >= threshold for b in slices(iter([pa.record_batch([text], names=["text"])]), "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool), pa.bool_())

    return docs.where(kept(F.col(text_col).cast("string")))
