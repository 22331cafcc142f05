"""Language-model scores from a probabilistic suffix tree over words.

A context is a run of up to DEPTH tokens; its next-symbol distribution is what followed it in training
documents. Every run of training tokens is a context and every symbol that followed it counts, however rare, so the
tree is as large as the corpus and lies nowhere in whole.

Going down, a context stays a state of the tree if its distribution diverges from that of the longest shorter
state (Kullback-Leibler, in bits) by DIVERGENCE at least. A state's distribution is smoothed with that one:
of n occurrences with k different symbols, a symbol counts its own over n + k, and what is left
goes to the shorter state, down to the unigrams, in which an unknown token has its share too. A token is scored by
the longest state that the text before it ends with. A text's begin is a token of a context, too.

Contexts that end in the same word make up a subtree, and what is asked of a subtree is known from the places in the
corpus that it stands for. So places are dealt to tasks by the word before them, with the words before that one, and each task works out
its subtrees alone. A context that stands at too many places for that has its symbols counted over all chunks by a shuffle instead, and
each of its longer contexts is a subtree of its own, or has its symbols counted, too. All counts are exact.
"""

from __future__ import annotations

import gc
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridwright.checkpoints import cut
from gridwright.llm.common import bucket_of, give_back, shelf, slices, words_of, written

#: Tokens of the longest context.
DEPTH = 3
#: Nothing is left out for being rare: shares of the training tokens, and occurrences, that contexts and symbols after them must have.
CONTEXT_SHARE, PAIR_SHARE, LEAST_SEEN = 0.0, 0.0, 1
#: Bits by which a state's distribution differs from the shorter state's at least.
DIVERGENCE = 0.01
#: Bytes of the texts that make up a chunk, and places of a context up to which one task works out its subtree.
CHUNK, LOOKED = 7 << 20, 1 << 19
#: Share of all places beyond which one task does not work out a context's subtree either.
MANY = 1 / 256
#: Turns in which subtrees are worked out, so that a part of the places lies on disk at a time.
TURNS = 3
#: Bytes of a row group in files whose rows are chunks, so that a task holds a few of them and not all.
ROWS = 16 << 20
#: The token that ends a text and stands before the next.
END = 0


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, or of floats, as bytes: lowest bytes together, then the next, without those that are all 0."""
    head, body = [], []
    for name, x in arrays.items():
        real = x.dtype.kind == "f"
        width = 8 if real else (int(x.max(initial=0)).bit_length() + 7) // 8
        head.append((name, real, width, len(x)))
        body.append(np.ascontiguousarray(x, "<f8" if real else "<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    whole = pickle.dumps(head) + b"".join(body)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    whole = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    head = pickle.loads(whole)
    at, out = len(pickle.dumps(head)), {}
    for name, real, width, n in head:
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(whole, np.uint8, n * width, at).reshape(width, n).T
        out[name] = x.reshape(-1).view("<f8" if real else "<i8")
        at += n * width
    return out


def _chunks(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Documents to chunks: a row each, with the words' codes in order; and a row for each of its words, with how often training documents, and all documents, have it."""
    number = TaskContext.get().partitionId() << 32
    schema = pa.schema([*((c, pa.int64()) for c in ("chunk", "tokens", "train", "train_docs", "docs", "kinds")), ("ids", pa.list_(kind)), ("held_out", pa.list_(pa.bool_())), ("blob", pa.binary()), ("code", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("m", pa.int64())])
    for batch in slices(batches, "text", CHUNK, 1 << 16):
        codes, words, offsets = words_of(pc.ascii_lower(batch.column("text")))
        sizes = np.diff(offsets).astype(np.int64)
        learned = ~_held(batch.column("held_out"))
        row = [number, (sizes + 1).sum(), (sizes[learned] + 1).sum(), learned.sum(), len(learned), len(words)]
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        blob = _pack(sizes=sizes, codes=codes.astype(np.int64))
        yield _filled(schema, 1, **{c: pa.array([int(x)], pa.int64()) for c, x in zip(schema.names, row, strict=False)}, ids=one(batch.column("doc_id").cast(kind)), held_out=one(pa.array(~learned)), blob=pa.array([blob], pa.binary()))
        n, m = (pa.array(np.bincount(c, minlength=len(words)).astype(np.int64)) for c in (codes[np.repeat(learned, sizes)], codes))
        yield _filled(schema, len(words), chunk=pa.array(np.full(len(words), number)), code=pa.array(np.arange(len(words), dtype=np.int32)), word=words.cast(pa.string()), n=n, m=m)
        number += 1


def _filled(schema: pa.Schema, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _held(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(bool)


def _of(batch: pa.RecordBatch, name: str, row: int = 0) -> pa.Array:
    return batch.column(name)[row].values


def _numbered(bases, ends: int, docs: int):
    """A chunk with its words' numbers (by the place where a word is met first; END is 0) and counts in place of the words."""

    def run(key: tuple, chunk: pa.Table, counted: pa.Table) -> pa.Table:
        row, (chunks, base) = chunk.combine_chunks().to_batches()[0], bases.value
        at = counted["code"].to_numpy().astype(np.int64) + 1
        ids, c, m = (np.zeros(len(at) + 1, np.int64) for _ in range(3))
        ids[at] = base[np.searchsorted(chunks, counted["from_chunk"].to_numpy())] + counted["from_code"].to_numpy() + 1
        c[at], m[at] = counted["c"].to_numpy(), counted["m"].to_numpy()
        c[END], m[END] = ends, docs
        blob = _pack(**_unpack(row.column("blob")[0].as_py()), ids=ids, c=c, m=m)
        give_back()
        return pa.table({"chunk": row.column("chunk"), "ids": row.column("ids"), "held_out": row.column("held_out"), "blob": pa.array([blob])})

    return run


def _symbols(codes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """END, then each document's symbols and END; and where each document's symbols begin."""
    starts = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])
    s = np.zeros(starts[-1], ids.dtype)
    word = np.ones(len(s), bool)
    word[0], word[starts[1:] - 1] = False, False
    s[word] = ids[codes]
    return s, starts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, ascending; a place of each; which one stands at each place)."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return keys[new], order[new], which


class Root:
    """Probabilities of words by their training counts; train, kinds: all training tokens and their distinct ones."""

    def __init__(self, train: int, kinds: int):
        self.train, self.kinds = train, kinds

    def of(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.train + 0.5 * (self.kinds + 1))


def smoothed(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Probability of a symbol that followed a context n of total times, if kinds different ones did; ``above``: that after the shorter state."""
    return (n + kinds * above) / np.maximum(total + kinds, 1)


class Places:
    """The places of a chunk: the symbol at each, the words before it, and what is known of its probability."""

    def __init__(self, blob: bytes, held_out: np.ndarray, root: Root):
        x = _unpack(blob)
        self.ids, self.c, self.m, self.sizes = x["ids"], x["c"], x["m"], x["sizes"]
        s, starts = _symbols(x.pop("codes"), self.sizes, np.arange(1, len(self.ids), dtype=np.int32))
        self.starts = starts[:-1] - 1
        self.s, n = s[1:], len(s) - 1
        self.w = [s[:-1]]  # the words before each place, nearest first; all 0 beyond a text's begin
        for d in range(1, DEPTH):
            self.w.append(np.where(self.w[-1] != END, np.concatenate([np.zeros(min(d, n), s.dtype), s[: max(0, n - d)]]), END))
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes + 1)
        self.learned = ~held_out[self.doc]
        self.root = root.of(self.c)
        self.p, self.level = self.root[self.s], np.ones(n, np.int8)

    def walk(self, found: dict[int, tuple[np.ndarray, np.ndarray]], states: dict[int, dict], most: int) -> dict[str, np.ndarray] | None:
        """Go down the contexts that stand at more than ``most`` places, as far as their symbols are counted.

        found: by length, the counts of the pairs (in training and in all documents) of context and symbol that this method gave back before; states: (occurrences,
        kinds of symbols, whether it is a state) of contexts. Afterwards ``level`` is the length of a place's first context of few places, 0 if it has none. Pairs that have to be counted next are given back.
        """
        at, context, words = np.flatnonzero(self.m[self.w[0]] > most), self.w[0], len(self.ids)
        for d in range(1, DEPTH + 1):
            if not len(at):
                return None
            kinds, some, which = _distinct(context[at] if d == 1 else context[at] * words + self.w[d - 1][at])
            keys, first, pair = _distinct(which * words + self.s[at])
            of, names = keys // words, [self.ids[w[at[some]]] for w in self.w[:d]]
            if d not in found:
                blank = np.full(len(keys), -1)
                w = [names[e][of] if e < d else blank for e in range(DEPTH)]
                counts = np.bincount(pair, self.learned[at], len(keys)).astype(np.int64), np.bincount(pair, minlength=len(keys))
                return {**{f"w{e}": x for e, x in enumerate(w, 1)}, "s": self.ids[self.s[at[first]]], "n": counts[0], "m": counts[1], "above": self.p[at[first]]}
            n, m = found[d]
            total, k, state = (np.array(x) for x in zip(*(states[d].get(name, (0, 0, False)) for name in zip(*(x.tolist() for x in names), strict=True)), strict=True))
            above = self.p[at[first]]
            self.p[at] = np.where(state[of], smoothed(n, total[of], k[of], above), above)[pair]
            context, far = np.zeros(len(self.s), np.int32), np.zeros(len(self.s) + 1, bool)
            context[at] = which
            far[at[(m[pair] > most) & (self.s[at] != END)] + 1] = True  # such a pair is a context of the next place
            self.level[at] = 0
            at = at[self.w[d - 1][at] != END] if d < DEPTH else at[:0]
            self.level[at] = d + 1
            at = at[far[at]]
        return None

    def sent(self) -> tuple[np.ndarray, np.ndarray]:
        """(places that wait for the subtree of a context, a number by which subtrees are dealt); a context that no training document has changes nothing."""
        at = np.flatnonzero((self.level > 0) & ((self.level > 1) | (self.c[self.w[0]] > 0)))
        h = np.zeros(len(at), np.uint64)
        for d, w in enumerate(self.w, 1):
            h = np.where(self.level[at] >= d, (h ^ self.ids[w[at]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15), h)
            h ^= h >> np.uint64(29)
        return at, ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64)

    def blocks(self, buckets: int, turn: int, turns: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, what its places need to be scored) of all places that are sent and have their turn."""
        at, h = self.sent()
        own = h % turns == turn
        at, h = at[own], h[own] // turns % buckets
        words = len(self.ids)
        alike = h * words + self.w[0][at]  # words that are alike together, which packs well
        order = np.argsort(alike * words + self.w[1][at] if buckets * words**2 < 1 << 62 else alike)
        at, h = at[order], h[order]
        ends, low = np.append(np.flatnonzero(np.diff(h)) + 1, len(at)) if len(at) else [], 0
        for high in ends:
            own = at[low:high]
            level, s = self.level[own], self.ids[self.s[own]]
            words, some = {f"w{d}": self.ids[w[own]] for d, w in enumerate(self.w, 1)}, _distinct(s)[1]
            yield int(h[low]), _pack(**words, s=s, c=self.c[self.s[own[some]]], doc=self.doc[own].astype(np.int64), learned=self.learned[own].astype(np.int64), level=level.astype(np.int64), p=self.p[own[level > 1]])
            low = high

    def by_text(self) -> bytes:
        """What is known of each text without the places that are sent."""
        known = self.p.copy()
        known[self.sent()[0]] = 1.0
        added = lambda x: np.add.reduceat(x, self.starts) if len(self.starts) else np.zeros(0)
        return _pack(tokens=self.sizes + 1, known=added((self.c[self.s] > 0).astype(np.int64)), base=added(np.log10(self.root)[self.s]), score=added(np.log10(known)))


def _found(counted: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts of a chunk's pairs by length of the context, in the order in which they were given."""
    level, out = counted["level"].to_numpy(), {}
    k, n, m = (counted[c].to_numpy() for c in "knm")
    for d in range(1, DEPTH + 1):
        at = np.flatnonzero(level == d)
        out[d] = tuple(np.empty(len(at), np.int64) for _ in range(2))
        out[d][0][k[at]], out[d][1][k[at]] = n[at], m[at]
    return out


PAIRS = "chunk long, level int, k long, w1 long, w2 long, w3 long, s long, n long, m long, above double"


def _pairs(root: Root, states, d: int, most: int):
    """Pairs of a context of length d that stands at many places, and a symbol, of a chunk, with their counts in it."""

    def run(key: tuple, chunk: pa.Table, counted: pa.Table) -> pa.Table:
        row, found = chunk.combine_chunks().to_batches()[0], _found(counted)
        got = Places(row.column("blob")[0].as_py(), _held(_of(row, "held_out")), root).walk({e: found[e] for e in range(1, d)}, states.value, most)
        names = [x.split()[0] for x in PAIRS.split(", ")]
        n = len(got["s"]) if got else 0
        fixed = {"chunk": np.full(n, row.column("chunk")[0].as_py()), "level": np.full(n, d, np.int32), "k": np.arange(n)}
        out = pa.table({c: pa.array((fixed | (got or {})).get(c, np.zeros(0, float if c == "above" else np.int64))) for c in names})
        give_back()
        return out

    return run


def _apart(size):
    """(at, apart): parts of the divergence of contexts (rows of ``size``) from the shorter states, of some pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total, kinds = pd.MultiIndex.from_frame(size.value[["w1", "w2", "w3"]]), size.value["total"].to_numpy(), size.value["kinds"].to_numpy()
        added = np.zeros(len(total))
        for batch in batches:
            *w, n, above = (batch.column(c).to_numpy() for c in ("w1", "w2", "w3", "n", "above"))
            at = of.get_indexer(pd.MultiIndex.from_arrays(w))
            added += np.bincount(at, n * np.log2(smoothed(n, total[at], kinds[at], above) / above), len(total))
        some = np.flatnonzero(added)
        yield pa.record_batch([pa.array(some), pa.array(added[some])], names=["at", "apart"])

    return run


def _sent(root: Root, states, most: int, buckets: int, turn: int):
    """A chunk's places of this turn in blocks by bucket; in the first turn a row of what is known of its texts, with a bucket below 0."""

    def run(key: tuple, chunk: pa.Table, counted: pa.Table) -> pa.Table:
        row = chunk.combine_chunks().to_batches()[0]
        places = Places(row.column("blob")[0].as_py(), _held(_of(row, "held_out")), root)
        places.walk(_found(counted), states.value, most)
        number, out = row.column("chunk")[0].as_py(), list(places.blocks(buckets, turn, TURNS))
        none = lambda name: pa.nulls(len(out), row.column(name).type)
        sent = [pa.table({"chunk": pa.array([number] * len(out), pa.int64()), "bucket": pa.array([b for b, _ in out], pa.int64()), "ids": none("ids"), "held_out": none("held_out"), "blob": pa.array([b for _, b in out], pa.binary())})]
        if not turn:
            sent.append(pa.table({"chunk": row.column("chunk"), "bucket": pa.array([-1 - number % buckets], pa.int64()), "ids": row.column("ids"), "held_out": row.column("held_out"), "blob": pa.array([places.by_text()], pa.binary())}))
        del places, out
        give_back()
        return pa.concat_tables(sent)

    return run


def subtrees(w: list[np.ndarray], s: np.ndarray, learned: np.ndarray, level: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probabilities of symbols s after words w (nearest first), for all places of some subtrees that begin at the length ``level``; p: those after the shorter state."""
    p, words = p.copy(), 1 + max((int(x.max(initial=0)) for x in (*w, s)))
    at, context = np.arange(len(s)), np.zeros(len(s), np.int64)
    for d in range(1, len(w) + 1):
        if d > 1:
            inner = w[d - 2][at] != END
            at, context = at[inner], context[inner]
        context = _distinct(context * words + w[d - 1][at])[2]
        some = np.flatnonzero(level[at] <= d)
        keys, first, pair = _distinct(context[some] * words + s[at[some]])
        of, above = keys // words, p[at[some[first]]]
        n = np.bincount(pair, learned[at[some]], len(keys))
        total, kinds = np.bincount(of, n), np.bincount(of, n > 0)
        mine = smoothed(n, total[of], kinds[of], above)
        apart = np.bincount(of, n * np.log2(mine / above))
        state = (total > 0) & (apart >= DIVERGENCE * total)
        p[at[some]] = np.where(state[of], mine, above)[pair]
    return p


def _scored(root: Root):
    """Blocks of a bucket to sums of its places' scores by text; rows of texts go through."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.drop_columns(["bucket"])
        parts, sizes = [], []
        for blob in table["blob"]:
            x = _unpack(blob.as_py())
            p = root.of(x["c"])[_distinct(x["s"])[2]]
            p[x["level"] > 1] = x["p"]
            parts.append([*(x[f"w{d}"] for d in range(1, DEPTH + 1)), x["s"], x["doc"].astype(np.int32), x["learned"].astype(bool), x["level"].astype(np.int8), p])
            sizes.append(len(p))
        *w, s, doc, learned, level, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        score, out, low = np.log10(subtrees(w, s, learned, level, p)), [], 0
        for n in sizes:
            texts, _, which = _distinct(doc[low : low + n])
            out.append(_pack(doc=np.diff(texts, prepend=0).astype(np.int64), score=np.bincount(which, score[low : low + n], len(texts))))
            low += n
        del w, s, doc, learned, level, p, score
        give_back()
        return table.drop_columns(["bucket"]).set_column(3, "blob", pa.array(out, pa.binary()))

    return run


def _summed(train: int):
    """Texts of a chunk with the sums that buckets have for them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        texts = pc.is_valid(table["ids"])
        row = table.filter(texts).combine_chunks().to_batches()[0]
        x = _unpack(row.column("blob")[0].as_py())
        score = x["score"].copy()
        for blob in table.filter(pc.invert(texts))["blob"]:
            part = _unpack(blob.as_py())
            score[np.cumsum(part["doc"])] += part["score"]
        out = {
            "doc_id": _of(row, "ids"),
            "held_out": _of(row, "held_out"),
            "n_tokens": pa.array(x["tokens"]),
            "n_known": pa.array(x["known"]),
            "train_tokens": pa.array(np.full(len(score), train)),
            "base_score": pa.array(x["base"]),
            "score": pa.array(score),
        }
        give_back()
        return pa.table(out)

    return run


def _let_go(spark) -> None:
    """Have Spark delete the files of shuffles that are done with, which it does once the driver's objects for them are collected; the last job's are held until another ran."""
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Held-out rows, whose crc32(id as text) mod ``folds`` is ``held``, are scored and not learned from. Tokens are the
    words (ASCII letters lower-cased, cut at ASCII white space) and one end; a null text counts as empty and
    is its end alone, and a null id as the empty text. base_score is the sum of log10 of the smoothed unigrams, score that of
    the tree. Without training rows both are 0. Rows repeat and count as they do in the input; texts are whole,
    however long; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), (bucket_of(F.col(id_col), folds) == held).alias("held_out"), text)
    rows_id, kind = rows.schema["doc_id"].dataType, rows.schema["doc_id"].dataType.simpleString()
    texts = f"ids array<{kind}>, held_out array<boolean>, blob binary"
    share = lambda x: spark.sparkContext.broadcast(x)
    with shelf(spark) as folder:
        with shelf(spark) as early:
            layout = f"chunk long, tokens long, train long, train_docs long, docs long, kinds long, {texts}, code int, word string, n long, m long"
            made = written(rows.mapInArrow(lambda batches: _chunks(batches, to_arrow_type(rows_id)), layout), early)
            chunks, words = made.where("blob is not null"), made.where("blob is null").select("chunk", "code", "word", "n", "m")
            sizes = chunks.select("chunk", "tokens", "train", "train_docs", "docs", "kinds").orderBy("chunk").toPandas()  # a row for some MB of text
            tokens, train, ends, count = (int(sizes[c].sum()) for c in ("tokens", "train", "train_docs", "docs"))
            word = Window.partitionBy("word")
            counted = words.withColumns({"c": F.sum("n").over(word), "m": F.sum("m").over(word), "first": F.min(F.struct("chunk", "code")).over(word)})
            counted = written(counted.select("chunk", "code", "c", "m", F.col("first.chunk").alias("from_chunk"), F.col("first.code").alias("from_code")), early)
            root = Root(train, counted.where("chunk = from_chunk and c > 0").count() + (ends > 0))
            _let_go(spark)
            number = _numbered(share((sizes["chunk"].to_numpy(), np.cumsum(sizes["kinds"].to_numpy()) - sizes["kinds"].to_numpy())), ends, count)
            state = chunks.select("chunk", "ids", "held_out", "blob").groupBy("chunk").cogroup(counted.groupBy("chunk"))
            state = written(state.applyInArrow(number, f"chunk long, {texts}"), folder, ROWS)
        del made, chunks, words, counted
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        most = min(LOOKED, max(1, int(tokens * MANY)))
        found, states = spark.createDataFrame([], "chunk long, level int, k long, n long, m long"), {}
        own = ["w1", "w2", "w3"]
        for d in range(1, DEPTH + 1):
            _let_go(spark)
            pairs = state.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_pairs(root, share(states), d, most), PAIRS)
            pair = Window.partitionBy(*own, "s")
            pairs = written(pairs.withColumns({"n": F.sum("n").over(pair), "m": F.sum("m").over(pair), "first": F.min("chunk").over(pair) == F.col("chunk")}), folder)
            once = pairs.where("first and n > 0")
            size = once.groupBy(*own).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            size = size.toPandas()  # a row for each context of many places, of which there are few
            apart = once.select(*own, "n", "above").mapInArrow(_apart(share(size)), "at long, apart double").groupBy("at").agg(F.sum("apart").alias("apart")).collect()
            size["apart"] = 0.0
            size.loc[[r["at"] for r in apart], "apart"] = [r["apart"] for r in apart]
            states[d] = {tuple(r[:d]): (r[3], r[4], r[5] >= DIVERGENCE * r[3]) for r in size[[*own, "total", "kinds", "apart"]].itertuples(index=False)}
            found = found.unionByName(pairs.select("chunk", "level", "k", "n", "m"))
            if pairs.where((F.col("m") > most) & (F.col("s") != END)).isEmpty():
                break
        buckets, sums = max(2 * parts, -(-tokens // (LOOKED * TURNS))), None
        for turn in range(TURNS):
            _let_go(spark)
            sent = state.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_sent(root, share(states), most, buckets, turn), f"chunk long, bucket long, {texts}")
            part = written(sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_scored(root), f"chunk long, {texts}"), folder)
            sums = part if sums is None else sums.unionByName(part)
        _let_go(spark)
        layout = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return cut(sums.groupBy("chunk").applyInArrow(_summed(train), layout))
