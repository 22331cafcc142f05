"""Quantile summaries, the suffix tree and the divergence audit, held against plain versions."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridwright.llm import common, divergence, queries, suffix_tree
from gridwright.llm import quantile_summaries as qs

FOLDER = os.environ.get("GRIDWRIGHT_TESTDATA", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, extra int"


# --- quantile summaries ------------------------------------------------------------------------
def bounds_hold(s, x):
    """The extremes are kept, no bound is wrong, and how many ranks are open between neighbours at most."""
    x = np.sort(x)
    assert s.n == len(x) and s.x[0] == x[0] and s.x[-1] == x[-1]
    assert (np.diff(s.x) > 0).all() and (np.diff(s.below) >= 0).all() and (np.diff(s.upto) >= 0).all()
    assert (s.below >= np.searchsorted(x, s.x, "left")).all() and (s.upto <= np.searchsorted(x, s.x, "right")).all()
    return int((s.below[1:] - s.upto[:-1]).max()) if len(s.x) > 1 else 0


KINDS = {
    "even": lambda rng, n: rng.permutation(n),
    "ascending": lambda rng, n: np.arange(n),
    "ties": lambda rng, n: rng.integers(0, 30, n),
    "one value": lambda rng, n: np.where(rng.random(n) < 0.999, 7, rng.integers(-500, 500, n)),
    "steep": lambda rng, n: (rng.pareto(0.5, n) * 100).astype(np.int64) % 10**12,
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("n", [1, 19, 1000, 1001, 60_000])
def test_hierarchies_keep_their_bound(kind, n):
    x = KINDS[kind](np.random.default_rng(n), n).astype(np.int64)
    tree = qs.Hierarchy(qs.BLOCK, qs.ERROR)
    for a in range(0, n, 777):
        tree.rows(x[a : a + 777], np.ones(len(x[a : a + 777]), np.int64))
    whole = qs.merged([s for _, s in tree.parts()])
    open_ranks = bounds_hold(whole, x)
    assert open_ranks <= 2 * qs.ERROR * n
    done = qs.finished(whole)
    assert bounds_hold(done, x) <= 2 * (qs.ERROR + 1 / qs.POINTS) * n + 1
    distinct = len(np.unique(x))
    assert min(20, distinct) <= len(done.x) <= min(n, 2 * qs.POINTS)
    targets = -(-np.arange(1, 20) * n // 20)
    answer = done.x[qs.estimates(done, targets)]
    below, upto = np.searchsorted(np.sort(x), answer, "left"), np.searchsorted(np.sort(x), answer, "right")
    assert (np.maximum(0, np.maximum(below + 1 - targets, targets - upto)) <= (qs.ERROR + 1 / qs.POINTS) * n + 1).all()
    assert (np.diff(answer) >= 0).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-20, 20), min_size=1, max_size=60), min_size=1, max_size=6), st.integers(1, 12))
def test_merging_and_pruning_keep_true_bounds(parts, steps):
    done = [qs.pruned(qs.Summary.exact(np.array(p), np.ones(len(p), np.int64)), steps) for p in parts]
    for p, s in zip(parts, done, strict=True):
        assert bounds_hold(s, np.array(p)) <= len(p) / steps + 1
    bounds_hold(qs.merged(done), np.concatenate([np.array(p) for p in parts]))


def test_weights_count_as_rows():
    tree = qs.Hierarchy(8, 0.05)
    rng = np.random.default_rng(0)
    x, n = rng.integers(0, 1000, 500), rng.integers(1, 50, 500)
    tree.rows(x, n)
    whole = qs.merged([s for _, s in tree.parts()])
    assert bounds_hold(whole, np.repeat(x, n)) <= 2 * 0.05 * n.sum()


def grouped(rows):
    out = defaultdict(list)
    for *key, x, n in rows:
        out[tuple(key)] += [x] * n
    return {k: np.sort(v) for k, v in out.items()}


@pytest.mark.parametrize("fan", [64, 2])
def test_summaries_answers_and_audit(spark, monkeypatch, fan):
    monkeypatch.setattr(qs, "FAN", fan)
    rng = random.Random(fan)
    rows = [("hot", rng.randrange(4), rng.choice([rng.randrange(90), rng.randrange(10**6)]), rng.choice([1, 1, 5])) for _ in range(6000)]
    rows += [(f"g{rng.randrange(60)}", rng.randrange(4), rng.randrange(50), 1) for _ in range(900)]
    df = spark.createDataFrame(rows, "grp string, batch int, x long, n long").repartition(7)
    with common.shelf(spark) as folder:
        batches = common.written(qs.summaries(df, ["grp", "batch"], folder, 100, 0.02, 100), folder)
        wholes = qs.merged_summaries(batches, ["grp"], 100, 100).withColumn("batch", F.lit(-1))
        found = common.written(qs.answers(batches.unionByName(wholes), ["grp", "batch"], 10, 5), folder)
        got = qs.audited(df, found, ["grp"], "batch", folder).collect()
        held = {(r["grp"], r["batch"]): r for r in batches.unionByName(wholes).collect()}
    truth = grouped(rows)
    truth |= grouped((g, -1, x, n) for g, _, x, n in rows)
    assert set(held) == set(truth)
    for key, x in truth.items():
        s = qs.Summary(held[key]["n"], *(np.array(held[key][c]) for c in ("x", "below", "upto")))
        bounds_hold(s, x)
        if held[key]["level"] == 0:
            assert s.x.tolist() == np.unique(x).tolist()
    assert any(r["level"] > 0 for r in held.values()) and any(r["level"] == 0 for r in held.values())
    assert len(got) == 9 * sum(len(x) >= 5 for x in truth.values())
    for r in got:
        x = truth[r["grp"], r["batch"]]
        assert r["n"] == len(x) and r["target"] == -(-r["i"] * len(x) // 10) and r["exact_x"] == x[r["target"] - 1]
        assert (r["n_below"], r["n_upto"]) == (np.searchsorted(x, r["answer"], "left"), np.searchsorted(x, r["answer"], "right"))
        assert max(0, r["n_below"] + 1 - r["target"], r["target"] - r["n_upto"]) <= 0.05 * len(x)


def test_summaries_of_nothing_and_null_keys(spark):
    schema = "grp string, batch int, x long, n long"
    with common.shelf(spark) as folder:
        none = qs.summaries(spark.createDataFrame([], schema), ["grp", "batch"], folder)
        assert none.count() == 0 == qs.answers(qs.merged_summaries(none, ["grp"]), ["grp"]).count()
        some = qs.summaries(spark.createDataFrame([(None, 1, 5, 1), (None, 1, 5, 2), ("a", None, 3, 1)], schema), ["grp", "batch"], folder).collect()
    assert {(r["grp"], r["batch"], r["n"], tuple(r["x"])) for r in some} == {(None, 1, 3, (5,)), ("a", None, 1, (3,))}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_shop_quantiles_match_sorting(spark):
    import pandas as pd

    got = queries.op11_quantile_summaries(spark, FOLDER).toPandas()
    assert got["within"].all() and not got.isna().any().any()
    read = lambda t: pd.read_parquet(f"{FOLDER}/{t}.parquet")
    c, lines = read("clicks").drop_duplicates("click_id"), read("sale_lines").merge(read("items"), on="item_id")
    rows = [("value", str(int(g)), i, m) for g, i, m in zip(c["client_id"], c["click_id"], c["value"], strict=True) if g == g and m == m]
    rows += [("price", g, i, m) for g, i, m in zip(lines["brand"], lines["vendor_id"], lines["price"], strict=True) if isinstance(g, str) and m == m]
    rows = [(s, g, zlib.crc32(str(int(i)).encode()) % 16, m) for s, g, i, m in rows]
    rows = [(s, g, b, math.floor(100 * m + 0.5) + 1000 * b, 1) for s, g, b, m in rows]
    truth = grouped(rows) | grouped((s, g, -1, x, n) for s, g, _, x, n in rows)
    assert len(got) == 19 * sum(len(x) >= 20 for x in truth.values())
    for r in got.itertuples():
        x = truth[r.stream, r.grp, r.batch]
        assert r.n == len(x) and r.exact_x == x[r.target - 1] and r.target == -(-r.i * r.n // 20)
        assert (r.n_below, r.n_upto) == (np.searchsorted(x, r.answer, "left"), np.searchsorted(x, r.answer, "right"))
        assert r.rank_error == max(0, r.n_below + 1 - r.target, r.target - r.n_upto)
        assert min(20, len(np.unique(x))) <= r.points <= min(r.n, 2000)


# --- suffix tree -------------------------------------------------------------------------------
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)) + [None]


class PlainTree:
    """The same model by dictionaries of tuples; None ends a text and stands before the next."""

    def __init__(self, texts, depth):
        all_ = [w for t in texts for w in t]
        self.n, self.count = len(all_), Counter(all_)
        self.kinds = len(self.count)
        least = max(suffix_tree.LEAST_SEEN, math.ceil(suffix_tree.PAIR_SHARE * self.n))
        common_ = max(least, math.ceil(suffix_tree.CONTEXT_SHARE * self.n))
        often = {w for w, c in self.count.items() if c >= least}
        contexts, self.states = {(w,): c for w, c in self.count.items() if c >= common_}, {}
        for d in range(1, depth + 1):
            follows = defaultdict(Counter)
            for t in texts:
                run = [None, *t]
                for i in range(1, len(run)):
                    if i >= d and tuple(run[i - d : i]) in contexts and run[i] in often:
                        follows[tuple(run[i - d : i])][run[i]] += 1
            longer = {}
            for c, total in contexts.items():
                listed = {s: k for s, k in follows[c].items() if k >= least}
                longer |= {(*c, s): k for s, k in listed.items() if k >= common_ and s is not None}
                norm, own = total + len(listed), sum(listed.values())
                left, above = (norm - own) / norm, {s: self.p(c[1:], s) for s in listed}
                apart = sum(k * math.log2((k / norm + left * above[s]) / above[s]) for s, k in listed.items())
                apart += (total - own) * math.log2(left) if total > own else 0
                if apart >= suffix_tree.DIVERGENCE * total:
                    self.states[c] = (listed, norm, left)
            contexts = longer

    def p(self, before, symbol):
        for i in range(len(before)):
            if tuple(before[i:]) in self.states:
                listed, norm, left = self.states[tuple(before[i:])]
                return listed.get(symbol, 0) / norm + left * self.p(before[i + 1 :], symbol)
        return (self.count[symbol] + 0.5) / (self.n + 0.5 * (self.kinds + 1))

    def score(self, text, depth):
        run = [None, *text]
        return sum(math.log10(self.p(run[max(0, i - depth) : i], run[i])) for i in range(1, len(run)))


def texts_for_trees():
    rng = random.Random(8)
    words = ["the", "cat", "dog", "sat", "on", "a", "mat", "ran"]
    out = [" ".join(itertools.chain.from_iterable(rng.choice([("the", "cat", "sat"), ("on", "a", "mat"), ("the", "Dog", "ran"), (rng.choice(words),)]) for _ in range(rng.randrange(1, 12)))) for _ in range(160)]
    return [*out, None, "", "   ", "new words only", "The\tcat\nSAT\x0bon", "é È ok", *["the cat sat"] * 9, " ".join(["the cat sat on a mat"] * 700)]


@pytest.mark.parametrize("looked", [1 << 19, 7])
def test_scores_match_the_plain_tree(spark, monkeypatch, looked):
    monkeypatch.setattr(suffix_tree, "LOOKED", looked)
    texts = texts_for_trees() if looked > 100 else texts_for_trees()[:-1]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in suffix_tree.scores(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    plain = PlainTree([tokens(t) for i, t in enumerate(texts) if not held[i]], suffix_tree.DEPTH)
    assert len(got) == len(texts) and max(map(len, plain.states)) == 3 and (None,) in plain.states
    for i, t in enumerate(texts):
        ts, r = tokens(t), got[i]
        base = sum(math.log10((plain.count[w] + 0.5) / (plain.n + 0.5 * (plain.kinds + 1))) for w in ts)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(plain.count[w] > 0 for w in ts), plain.n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(plain.score(ts, suffix_tree.DEPTH), rel=1e-9)


def test_what_occurs_twice_is_learned(spark):
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1]
    rare = "zqa zqb zqc zqd"
    rows = [(i, rare if i in learned[:2] else f"some words of text {i}", "en", "s", 1) for i in range(60)]
    got = {r["doc_id"]: r for r in suffix_tree.scores(spark.createDataFrame(rows, DOCS)).collect()}
    r = got[learned[0]]
    assert r["n_known"] == 5 and r["score"] > r["base_score"] + 3
    plain = PlainTree([tokens(t) for i, t, *_ in rows if i in learned], suffix_tree.DEPTH)
    assert ("zqa", "zqb", "zqc") in plain.states and r["score"] == pytest.approx(plain.score(tokens(rare), suffix_tree.DEPTH), rel=1e-9)


def test_states_are_distributions():
    texts = [tokens(t) for t in texts_for_trees()]
    plain = PlainTree(texts, 3)
    for c in [(), *plain.states]:
        assert sum(plain.p(c, s) for s in [*plain.count, "never seen"]) == pytest.approx(1)


def test_scores_of_repeated_null_and_no_rows(spark):
    rows = [(None, "a b", None, None, 1), (5, "a b", "en", "s", 1), (5, "a b", "en", "s", 2), (7, None, "en", "s", 1)]
    got = suffix_tree.scores(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in got) == [(False, 1), (False, 3), (False, 3), (True, 3)]
    assert suffix_tree.scores(spark.createDataFrame([], DOCS)).count() == 0
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = suffix_tree.scores(spark.createDataFrame([(alone, "x y", "en", "s", 1)], DOCS)).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


# --- divergence --------------------------------------------------------------------------------
def plain_divergence(rows, least=3, most=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        whole = Counter(t for d in mine for t in d[2])

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, most)):
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(sorted(found, key=lambda z: (-z[0], z[1].encode())), 1) if top is None or k <= top]
    return sorted(out)


@pytest.mark.parametrize("cells, groups, most", [(1 << 17, 256, 200), (40, 2, 5), (8, 3, 1)])
def test_divergence_matches_plain_version(spark, monkeypatch, cells, groups, most):
    monkeypatch.setattr(divergence, "CELLS", cells), monkeypatch.setattr(divergence, "GROUPS", groups)
    rng = random.Random(cells)
    words = ["Alpha", "beta", "gamma", "Straße", "ÀB", "à1b", "x", "日本", "δ", "ok_ok", "don't"] + [f"{chr(97 + i)}w" for i in range(20)]
    rows = [(i, rng.choice([None, "", "123 456"]) if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "S"]), i) for i in range(120)]
    rows += [(500, "only here", "xx", "s1", 1), (501, None, "xx", "s2", 1), (502, "never three", "yy", "s1", 1), *[(600, "same same", "zz", f"t{k % 4}", 1) for k in range(9)]]
    got = divergence.divergence(spark.createDataFrame(rows, DOCS).repartition(5), most_terms=most).collect()
    assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == plain_divergence(rows, most=most)


def test_divergence_of_nothing_and_long_texts(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, "lorem ipsum " * 400_000 if i == 1 else "lorem dolor", "la", f"s{i % 2}", 1) for i in range(4)]
    got = divergence.divergence(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == plain_divergence(rows)


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(200):
        total = rng.choice([rng.randrange(1, 100), rng.randrange(1, 8 * 10**15)])
        n = rng.randrange(0, total)
        assert divergence.shares(np.array([n]), np.array([total]))[0] == 1 + 10**9 * (n + 1) // total


def test_terms_are_runs_of_letters():
    texts = ["", "AbC dÉf-1ß x", "\x00a\x7fb[c]^_`{d}", "漢字 kana", "12 !"]
    codes, terms, offsets = divergence.terms_of(pa.array(["zz", *texts]).slice(1))
    names = terms.to_pylist()
    got = [[names[c] for c in codes[a:b]] for a, b in itertools.pairwise(offsets)]
    assert got == [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER)) for t in texts]
