"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of word shingles, and two documents link at a Jaccard similarity of at least
``percent`` / 100. Shingles have one global order: those that a first pass over all documents found
often come last, by their counts; all others go by their hashes. Of n shingles, a partner must share
o = ceil(n * percent / 100) at least, so in that order two linked documents share l of their first
n - o + l shingles, for any l up to o. The index holds every document's longest prefix; from the
lengths of its posting lists each document picks the l whose candidates are estimated to cost least,
and a pair is a candidate if it shares as many shingles of the l-prefixes as the smaller of its two
l; of those, what the two have left behind their prefixes must suffice for the similarity. Lists are
kept apart by size, since linked documents are of like size.

Only the classes are asked for, so links inside a class that is known already need no search. Two
rounds check documents in long lists against leaders of these and join classes; then every candidate
pair across classes is checked, with no cap. Equal sets are one node. Pairs are
verified on whole sets; a set holds 64-bit hashes of the shingles, which stand for the shingles themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.checkpoints import cut
from gridwright.llm.common import fresh, give_back, maybe_broadcast, slices, words_of
from gridwright.operators.components import connected_components

#: Longest match count that a document may pick.
MOST_MATCHES = 8
#: Shingles counted together; of those, ones met LEAST_SEEN times or more tell how frequent a shingle is.
COUNTED, LEAST_SEEN = 3 << 20, 2
#: Frequent shingles that are put last; the table of them is broadcast. Beyond it the order goes by hash, which costs time only.
FREQUENT = 400_000
#: Rounds of leaders before the full search across classes, leaders that a document is checked against in each, and the length from which lists have them.
ROUNDS, LEADERS, LONG_LIST = 2, 12, 64
#: Documents in one list of a posting, and documents of lists that are looked at together.
LIST, LOOKED = 64, 1 << 18

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[4]
    x = (x ^ (x >> np.uint64(27))) * _M[5]
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Ascending distinct 64-bit hashes of each text's word runs; with fewer words, of all its words together."""
    codes, dictionary, offsets = words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    hashed = pd.util.hash_array(dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(dictionary) else np.zeros(0, np.uint64)
    out = []
    with np.errstate(over="ignore"):
        spread = [_mixed(hashed * m + m) for m in (_M * words)[:words]]
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= words:
                run = codes[a:b]
                whole = np.zeros(b - a - words + 1, np.uint64)
                for i, table in enumerate(spread):
                    whole = whole * _M[3] + table[run[i : len(run) - words + 1 + i]]
                out.append(np.unique(_mixed(whole)))
            elif b > a:
                whole = np.uint64(b - a)
                for i, code in enumerate(codes[a:b]):
                    whole = whole * _M[3] + spread[i][code]
                out.append(_mixed(np.array([whole + _M[0]], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _counts(words: int):
    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= LEAST_SEEN
        return pa.record_batch([pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, "text"):
            found = shingles(batch.column("text"), words)
            held += found
            n += sum(map(len, found))
            if n >= COUNTED:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


def frequent_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """At most about FREQUENT shingles with the highest counts, and these, ascending by shingle."""
    counted = cut(texts.select("text").mapInArrow(_counts(words), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    step = F.floor(F.log2("n") * 8)
    least, total = None, 0
    for row in sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True):  # a row for each eighth of a doubling
        total += row["count"]
        if total > FREQUENT and least is not None:
            break
        least = row["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = counted.where(step >= least).orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    tokens = table["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], table["n"].to_numpy()[order]


def prefix(values: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(the shingles of the longest prefix in the global order, how many of them a match count of 1 takes)."""
    n = len(values)
    need = -(-percent * n // 100)
    take = n - need + min(MOST_MATCHES, need)
    order = np.arange(n)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        hit = frequent[at] == values
        if hit.any():
            order = np.lexsort((values, np.where(hit, counts[at], 1)))
    return values[order[:take]], n - need + 1


_SETS = "doc_id {kind}, fp long, sig binary, n long, base int, tokens array<long>"


def _prefixes(shared, words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        met: set[bytes] = set()
        for batch in slices(batches, "text"):
            sigs, sizes, bases, tokens = [], [], [], []
            for values in shingles(batch.column("text"), words):
                sig = hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None
                sigs.append(sig)
                sizes.append(len(values))
                if sig is None or sig in met:
                    bases.append(0), tokens.append(None)
                    continue
                if len(met) >= 1 << 20:
                    met.clear()
                met.add(sig)
                first, base = prefix(values, frequent, counts, percent)
                bases.append(base), tokens.append(first.view(np.int64))
            yield pa.record_batch([batch.column("doc_id"), batch.column("fp"), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bases, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], names=["doc_id", "fp", "sig", "n", "base", "tokens"])

    return run


def _whole_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in slices(batches, "text", 1 << 20):
            sigs, sets = [], []
            for values in shingles(batch.column("text"), words):
                sig = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
                if sig in met:
                    continue
                if len(met) >= 1 << 20:
                    met.clear()
                met.add(sig)
                sigs.append(sig), sets.append(values.view(np.int64))
            if sigs:
                yield pa.record_batch([pa.array(sigs, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["sig", "values"])

    return run


def _verified(percent: int):
    """Of rows sorted by x and then other (null first), where the row without other holds x's own set: the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.int64)
        for batch in batches:
            xs, others = batch.column("x").to_pylist(), batch.column("other").to_pylist()
            sets = batch.column("values")
            offsets, flat = sets.offsets.to_numpy(), sets.values.to_numpy(zero_copy_only=False)
            src, dst = [], []
            for i, (x, other) in enumerate(zip(xs, others, strict=True)):
                values = flat[offsets[i] : offsets[i + 1]]
                if other is None:
                    now, own = x, values.copy().view(np.uint64)
                    continue
                if x != now:
                    raise AssertionError("a set is missing")
                theirs = values.view(np.uint64)
                small, large = (own, theirs) if len(own) < len(theirs) else (theirs, own)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                same = int((large[at] == small).sum())
                if 100 * same >= percent * (len(own) + len(theirs) - same):
                    src.append(x), dst.append(other)
            yield pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
        give_back()

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst) of the pairs (x, other) whose sets are similar enough."""
    asked = pairs.select("x", "other", F.col("other").alias("node"))
    own = pairs.select("x").distinct().select("x", F.lit(None).cast("long").alias("other"), F.col("x").alias("node"))
    needed = maybe_broadcast(cut(asked.unionByName(own)))
    rows = sets.join(needed, "node").select("x", "other", "values").repartition("x").sortWithinPartitions("x", F.col("other").asc_nulls_first())
    return rows.mapInArrow(_verified(percent), "src long, dst long")


def _leader_pairs(postings: DataFrame, classes: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each document of long lists up to LEADERS documents of other classes, each drawn as the leader of a list by a hash."""
    long = postings.groupBy("token", "size").agg(F.count("*").alias("c")).where(F.col("c") >= LONG_LIST).select("token", "size")
    rows = postings.join(long, ["token", "size"]).join(classes, "node")
    rank = F.xxhash64("node", "token", F.lit(turn))
    lead = rows.groupBy("token", "size").agg(F.min(F.struct(rank.alias("r"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("class").alias("their"))).alias("lead")).select("token", "size", "lead.*")
    like = (F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m")) & (F.col("class") != F.col("their"))
    shared = rows.join(lead, ["token", "size"]).where(like).groupBy(F.col("node").alias("x"), "other").agg(F.count("*").alias("shared"))
    best = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("shared"), F.xxhash64("x", "other")))
    return shared.withColumn("at", best).where(F.col("at") <= LEADERS).select("x", "other")


def required(n: np.ndarray, m: np.ndarray, matches: np.ndarray, percent: int) -> np.ndarray:
    """Prefix shingles that two sets of n and m must share, under prefixes for ``matches``.

    Linked sets share at least percent * (n + m) / (100 + percent) shingles. Of the two prefixes the one
    that ends first in the global order leaves its set's rest, ceil(percent * n / 100) - matches
    shingles, outside; all others that are shared lie in both prefixes.
    """
    whole = -(-percent * (n + m) // (100 + percent))
    rest = -(-percent * np.maximum(n, m) // 100) - matches
    return np.maximum(matches, whole - rest)


def _fitting(percent: int):
    """Of rows that ask a list: the list's documents that may be a partner of the asking one, x.

    A pair with a class of one node is asked for at all shared tokens by the lower of its two, by class size
    (one or more nodes) and then class. Between two classes of several nodes (split) either side may lack
    tokens, and each token counts (here) on one side only. A code is the shingles that the pair must share,
    times 4, and 2 for split and 1 for here.
    """

    def fitting(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("nodes")).to_numpy(zero_copy_only=False))
        n, picked, own, many, level, main = (column(c).astype(np.int64)[row] for c in ("n", "picked", "class", "many", "level", "main"))
        ids, meta, cls = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("nodes", "meta", "classes"))
        m, several, matches = meta >> 9, meta >> 8 & 1, np.minimum(picked, meta & 15)
        split = (several == 1) & (many == 1)
        later = (several > many) | (several == many) & (cls > own)
        fits = (np.maximum(meta >> 4 & 15, level) <= matches) & (cls != own) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (later | split)
        row, ids = row[fits], ids[fits]
        here = (cls == main) | (cls > own)
        code = required(n[fits], m[fits], matches[fits], percent) * 4 + split[fits] * 2 + here[fits]
        asked, count = np.unique(row, return_counts=True)
        offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(code, pa.int32()))]
        return pa.record_batch([pa.array(column("x")[asked], pa.int64()), pa.array(np.zeros(len(asked), np.int64)), *lists], names=["x", "missed", "others", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, at = np.cumsum(pc.list_value_length(batch.column("nodes")).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOOKED, "right")))
                yield fitting(batch.slice(at, to - at))
                at = to
            del batch
            give_back()

    return run


_ASKED = "x long, missed long, others array<long>, codes array<int>"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by x with what ``_fitting`` found for it: the pairs that may share enough.

    A pair that is not split gets need 0 if it shares enough. Of split ones the shares of both sides must add
    up to need; a side that cannot reach it with the ``missed`` tokens it did not ask gives no row.
    """
    now, held, missed = None, [], 0

    def pairs() -> pa.RecordBatch:
        ids, codes = (np.concatenate(c) for c in zip(*held, strict=True))
        found, first, at, count = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
        share = np.bincount(at, weights=codes & 1, minlength=len(found)).astype(np.int64)
        need, split = codes[first] >> 2, codes[first] & 2 > 0
        good = np.where(split, (count + missed >= need) & (share > 0), count >= need)
        found, share, need = found[good], share[good], np.where(split, need, 0)[good]
        columns = [np.minimum(found, now), np.maximum(found, now), share, need]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["x", "other", "share", "need"])

    for batch in batches:
        others, codes = batch.column("others"), batch.column("codes")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(others).to_numpy(zero_copy_only=False))])
        ids, codes = others.flatten().to_numpy(zero_copy_only=False), codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for i, (x, more) in enumerate(zip(batch.column("x").to_pylist(), batch.column("missed").to_pylist(), strict=True)):
            if x != now:
                if held:
                    yield pairs()
                now, held, missed = x, [], 0
            missed += more
            if ends[i + 1] > ends[i]:
                held.append((ids[ends[i] : ends[i + 1]].copy(), codes[ends[i] : ends[i + 1]].copy()))
    if held:
        yield pairs()
    give_back()


def _cross_pairs(postings: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs across classes. A document asks the lists of its token and of like sizes, but for its class's largest share."""
    several = maybe_broadcast(cut(classes.groupBy("class").agg(F.count("*").alias("c")).where("c > 1").select("class", F.lit(1).alias("many"))))
    rows = postings.join(classes.join(several, "class", "left").withColumn("many", F.coalesce("many", F.lit(0))), "node")
    per = rows.groupBy("token", "class", "many").agg(F.count("*").alias("c"))
    mixed = per.groupBy("token").agg(F.max_by("class", F.struct("c", "many", "class")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").select("token", "main")
    rows = cut(rows.join(mixed, "token"), release=True)
    df = rows.groupBy("token", "size").agg(F.count("*").alias("df"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("df") / LIST))
    meta = F.col("n").cast("long") * 512 + F.col("many") * 256 + F.col("level") * 16 + F.col("picked")
    lists = rows.join(df, ["token", "size"]).groupBy("token", "size", part.alias("part")).agg(F.collect_list("node").alias("nodes"), F.collect_list(meta).alias("meta"), F.collect_list("class").alias("classes")).drop("part")
    asks = rows.where(F.col("class") != F.col("main")).select("token", F.col("node").alias("x"), "n", "picked", "class", "many", "level", "main", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
    met = asks.join(lists, ["token", "size"]).select("x", "n", "picked", "class", "many", "level", "main", "nodes", "meta", "classes").mapInArrow(_fitting(percent), _ASKED)
    kept = rows.where((F.col("class") == F.col("main")) & (F.col("many") == 1)).groupBy(F.col("node").alias("x")).agg(F.count("*").alias("missed"))
    kept = kept.select("x", "missed", F.array().cast("array<long>").alias("others"), F.array().cast("array<int>").alias("codes"))
    found = met.unionByName(kept).repartition("x").sortWithinPartitions("x").mapInArrow(_candidates, "x long, other long, share long, need long")
    return found.groupBy("x", "other").agg(F.sum("share").alias("share"), F.max("need").alias("need")).where("share >= need").select("x", "other")


def link_classes(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, n_shingles, component_id for every row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased; n_shingles is the number of distinct
    runs of ``words`` words (all words together if there are fewer), 0 without a word. Documents with
    100 * shared >= percent * united shingles link, and component_id is the smallest id that links
    reach, the document's own included. An empty or null text links with nothing and is alone. Equal
    rows are in one class, a null id is passed over where the class has another. fp is a 64-bit
    hash of the text, to tell rows of one id apart. An empty table gives an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(frequent_shingles(rows, words))  # FREQUENT bounds its size
    sets = cut(rows.mapInArrow(_prefixes(shared, words, percent), _SETS.format(kind=kind)))
    classes = _classes(rows, sets, words, percent)
    own = sets.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    linked = own.join(classes, "sig", "left")
    least = linked.where("class is not null").groupBy("class").agg(F.min("least").alias("reached"))
    named = linked.join(least, "class", "left").where("copies > 1 or class is not null")
    named = maybe_broadcast(cut(named.select("sig", F.coalesce("reached", "least").alias("component"), F.lit(True).alias("shared"))))
    component = F.when(F.col("shared"), F.col("component")).otherwise(F.col("doc_id"))
    return sets.select("doc_id", "fp", "sig", "n").join(named, "sig", "left").select("doc_id", "fp", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _size(n: Column, percent: int) -> Column:
    """Size class: documents that may link lie in the same one or in neighbours (the factor keeps rounding on the safe side)."""
    return F.floor(F.log(n.cast("double")) / -math.log(percent / 100) * 0.999999).cast("int") if percent < 100 else n.cast("int")


def _picked() -> Column:
    """The match count of least cost: reading the lists of its prefix, and verifying at most their sum divided by the count."""
    met = [F.sum(F.when(F.col("level") <= k, F.col("df") - 1).otherwise(0)) for k in range(1, MOST_MATCHES + 1)]
    cost = [F.struct((m + m / k * (1 + F.max("n") / 64)).alias("c"), F.lit(k).alias("k")) for k, m in enumerate(met, 1)]
    return F.array_min(F.array(*cost))["k"]


def _near(rows: DataFrame, value: Column, how) -> DataFrame:
    """(token, size, v): ``how`` over ``value`` in the lists of a token for a size class and its neighbours."""
    per = rows.groupBy("token", "size").agg(how(value).alias("v"))
    around = per.select("token", "v", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
    return around.groupBy("token", "size").agg((F.sum if how is F.count else how)("v").alias("v"))


def _shared_tokens(one: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, size, level) of prefixes, as far as another set has the token in its own prefix."""
    spread = one.select("node", "n", "base", F.posexplode("tokens").alias("at", "token"))
    level = F.greatest(F.lit(1), F.col("at") - F.col("base") + 2).cast("int")
    per = spread.select("token", "node", F.col("n").cast("int").alias("n"), level.alias("level"))
    often = per.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    return per.join(often, "token").withColumn("size", _size(F.col("n"), percent))


def _postings(rows: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, size, level, picked) of the prefixes that sets pick, without rows that can be in no candidate pair."""
    df = _near(rows, F.lit(1), F.count).where("v > 1").withColumnRenamed("v", "df")
    rows = rows.join(df, ["token", "size"])
    need = F.ceil(F.lit(percent) * F.max("n") / 100)  # a set's match count is at most what it must share
    picked = rows.groupBy("node").agg(F.least(_picked(), need).cast("int").alias("picked"))
    rows = cut(rows.join(picked, "node").where("level <= picked").drop("df"), release=True)
    # a pair needs the smaller match count of its two: a set with fewer rows than that in all lists is out
    held = rows.groupBy("node").agg(F.count("*").alias("held"))
    least = _near(rows, F.col("picked"), F.min).withColumnRenamed("v", "least")
    kept = rows.join(held, "node").join(least, ["token", "size"]).where(F.col("held") >= F.least("picked", "least"))
    return kept.drop("held", "least")


def _classes(rows: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, class) of the sets that share prefix shingles with another set."""
    one = sets.where("tokens is not null").groupBy("sig").agg(F.max(F.struct("n", "base", "fp", "tokens")).alias("s")).select("sig", "s.*")
    one = cut(one.withColumn("node", F.monotonically_increasing_id()), release=True)
    postings = cut(_postings(cut(_shared_tokens(one, percent), release=True), percent), release=True)
    nodes = cut(one.select("node", "sig", "fp").join(postings.select("node").distinct(), "node"), release=True)
    texts = rows.join(maybe_broadcast(nodes.select("fp").distinct()), "fp", "left_semi").select("text")
    whole = texts.mapInArrow(_whole_sets(words), "sig binary, values array<long>").join(maybe_broadcast(nodes.select("sig", "node")), "sig")
    whole = cut(whole.groupBy("node").agg(F.first("values").alias("values")), release=True)
    links = None
    classes = nodes.select("node", F.col("node").alias("class"))
    for turn in range(ROUNDS + 1):
        pairs = cut(_leader_pairs(postings, classes, turn, percent) if turn < ROUNDS else _cross_pairs(postings, classes, percent), release=True)
        if turn < ROUNDS and pairs.isEmpty():
            continue
        new = cut(_links(pairs, whole, percent), release=True)
        links = new if links is None else links.unionByName(new)
        found = connected_components(links).select("node", F.col("component").alias("low"))
        classes = cut(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("low", "node").alias("class")), release=True)
    return nodes.select("sig", "node").join(classes, "node").select("sig", "class")


def one_of_each_class(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class, with all their columns, whatever these are called; equal rows stay or go together."""
    found = link_classes(docs, words, percent, id_col, text_col)
    i, f = fresh(docs.columns, "__gw_id", "__gw_fp")
    gone = cut(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(i), F.col("fp").alias(f)).distinct())
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(f))
    return docs.join(maybe_broadcast(gone), same, "left_anti")
