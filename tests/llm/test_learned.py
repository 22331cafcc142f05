"""Language ID, quality, top-k search, n-gram join and the pipeline."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from gridwright.llm import language_id, ngram_join, quality, topk_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ster", "ing", "oth", "wen"]}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


# --- language ID -------------------------------------------------------------------------------
def plain_bits(samples, text, symbols):
    """Code length of a text under contexts of up to three bytes, counted and escaped by hand."""
    seen = [defaultdict(Counter) for _ in range(4)]
    for s in samples:
        raw = [language_id.PAD] * 3 + list(s.encode())
        for i in range(3, len(raw)):
            for k in range(4):
                seen[k][tuple(raw[i - k : i])][raw[i]] += 1
    total = 0.0
    raw = [language_id.PAD] * 3 + list(text.encode())
    for i in range(3, len(raw)):
        p = {b: 1 / 256 for b in range(256)}
        for k in range(4):
            here = seen[k][tuple(raw[i - k : i])] if tuple(raw[i - k : i]) in seen[k] else None
            if here is None or sum(here.values()) < symbols[k]:
                continue
            n, d = sum(here.values()), len(here)
            left = 1 - sum(p[b] for b in here)
            p = {b: here[b] / (n + d) if b in here else d / (n + d) * p[b] / left for b in range(256)}
        total -= math.log2(p[raw[i]])
    return total


def test_code_lengths_match_plain_version():
    samples = ["abracadabra abracadabra", "cadabra abra cad"]
    batch = pa.record_batch([pa.array(samples), pa.array(["x", "x"])], names=["text", "lang"])
    counted = pa.Table.from_batches(list(language_id._grams(iter([batch])))).to_pandas().groupby(["lang", "gram"], as_index=False)["n"].sum()
    model = language_id.build(counted)
    for text in ("abra", "cad abracad", "zebra q"):
        flat, offsets = language_id._bytes(pa.array([text]))
        assert model.code_lengths(flat, offsets)[0, 0] == pytest.approx(plain_bits(samples, text, [0, 1, 2, 2]), rel=1e-4)


def test_code_lengths_hold_for_many_bytes_and_several_languages():
    rng = random.Random(7)
    letters = {"x": "aбвгдежзий", "y": "漢字仮名交じり文", "z": "".join(c for c in map(chr, range(0x21, 0x700)) if c == c.lower() == c.upper().lower())}
    samples = {lang: ["".join(rng.choice(s + " ") for _ in range(800)) for _ in range(4)] for lang, s in letters.items()}
    batch = pa.record_batch([pa.array([t for v in samples.values() for t in v]), pa.array([k for k, v in samples.items() for _ in v])], names=["text", "lang"])
    counted = pa.Table.from_batches(list(language_id._grams(iter([batch])))).to_pandas().groupby(["lang", "gram"], as_index=False)["n"].sum()
    assert counted["gram"].mod(256).nunique() > 128
    model = language_id.build(counted)
    texts = ["", samples["x"][0][:60], "漢字 abc ā", "\x00\x01 q", samples["z"][1]]
    flat, offsets = language_id._bytes(pa.array(texts))
    got = model.code_lengths(flat, offsets)
    for i, lang in enumerate(model.languages):
        for j, text in enumerate(texts):
            lower = [t.lower() for t in samples[lang]]
            assert got[j, i] == pytest.approx(plain_bits(lower, text.lower(), [0, 1, 2, 2]) if text else 0.0, rel=1e-6)


def test_code_lengths_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, "aa", rng.randrange(0, 30)) for _ in range(40)] + ["", "x" * 500, ""]
    batch = pa.record_batch([pa.array(texts[:20]), pa.array(["x"] * 20)], names=["text", "lang"])
    model = language_id.build(pa.Table.from_batches(list(language_id._grams(iter([batch])))).to_pandas().groupby(["lang", "gram"], as_index=False)["n"].sum())
    flat, offsets = language_id._bytes(pa.array(texts))
    whole = model.code_lengths(flat, offsets)
    monkeypatch.setattr(language_id, "CHUNK", 37)
    assert np.allclose(model.code_lengths(flat, offsets), whole)


def test_texts_that_no_language_explains_are_rejected(spark):
    rng = random.Random(4)
    docs = language_docs(spark, 240)
    noise = ["".join(rng.choice("bcdfghjklmnpqrstvwxz0123456789#%") for _ in range(3000)) for _ in range(5)]
    odd = spark.createDataFrame([(900 + i, t, None, None, None) for i, t in enumerate([*noise, None, "", "12 %$ 3", "ka", "zz", prose(rng, "aa", 3000)])], DOCS)
    model = language_id.fit(docs, rated=True)
    assert len(model.rates) == 2 and np.isfinite(model.rates).all()
    kept = {r["doc_id"] for r in language_id.in_known_language(docs.unionByName(odd), model).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} | {908, 909, 910}
    assert np.isinf(language_id.fit(docs.limit(12), rated=True).rates).all()
    unlearned = language_id.fit(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang"), rated=True)
    assert {r["doc_id"] for r in language_id.in_known_language(odd, unlearned).collect()} == {900, 901, 902, 903, 904, 908, 909, 910}


def language_docs(spark, n=160):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang := rng.choice(["aa", "bb"]), rng.randrange(5, 60)), lang, "s", 1) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def test_languages_are_told_apart(spark):
    docs = language_docs(spark)
    model = language_id.fit(docs)
    odd = spark.createDataFrame([(900, None, None, None, None), (901, "", "aa", "", 0), (902, "12 %$ 3", "aa", "", 0), (903, prose(random.Random(2), "bb", 9000), None, "", 0), (None, "ka lo", "aa", "", 0)], DOCS)
    got = {r["doc_id"]: r for r in language_id.predictions(docs.unionByName(odd), model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in truth)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = language_id.in_known_language(docs.unionByName(odd), model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {903} and not {900, 901, 902} & {r["doc_id"] for r in kept.collect()}


def test_language_model_ignores_held_out_and_unlabelled(spark):
    docs = language_docs(spark)
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    one, two = language_id.fit(docs), language_id.fit(docs.withColumn("text", F.when(held, F.lit("zzz qqq")).otherwise(F.col("text"))))
    assert one.languages == two.languages and len(one.trees) == 2
    for a, b in zip(one.trees, two.trees, strict=True):
        for name in ("seen", "bits", "contexts", "escapes"):
            assert all(map(np.array_equal, getattr(a, name), getattr(b, name)))
    assert language_id.fit(docs.withColumn("lang", F.lit(None).cast("string"))).languages == []
    assert [r["lang_pred"] for r in language_id.predictions(docs.limit(1), language_id.fit(docs.limit(0))).collect()] == ["und"]
    assert language_id.predictions(docs.limit(0), one).count() == 0


# --- quality -----------------------------------------------------------------------------------
def quality_docs(spark, n=320):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        text = prose(rng, "aa", rng.randrange(20, 80))
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w + "###" for w in text.split()), ("spam " * 40)])
        rows.append((i, text, "aa", "s", 1))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_is_learned(spark):
    docs, labels = quality_docs(spark)
    odd = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "", "", 0), (9002, "x" * 200000, "", "", 0), (None, "ka lo", "", "", 0)], DOCS)
    got = {r["doc_id"]: r for r in quality.quality(docs.unionByName(odd), labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i in truth)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert got[9000]["score"] == got[9001]["score"]
    good = quality.good_documents(docs, labels)
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == {i for i in truth if got[i]["predicted"]}


def test_quality_without_labels_and_documents(spark):
    docs, labels = quality_docs(spark, 12)
    assert {r["score"] for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0
    nulls = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality(docs, nulls).collect()} == {0.5}


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(0)
    x, y = rng.random(40), rng.integers(0, 2, 40).astype(float)
    at, level = quality.isotonic(x, y)
    assert (np.diff(level) >= 0).all() and (np.diff(at) > 0).all()
    o = np.argsort(x)
    want = [max(min(np.mean(y[o][i : j + 1]) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    sizes = [want.count(v) for v in dict.fromkeys(want)]
    assert level == pytest.approx(list(dict.fromkeys(want))) and sum(sizes) == 40


def test_isotonic_pools_equal_scores():
    at, level = quality.isotonic(np.array([0.3, 0.3, 0.3, 0.3]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert at.tolist() == pytest.approx([0.3]) and level.tolist() == [0.5]
    at, level = quality.isotonic(np.array([2.0, 1.0, 1.0, 2.0, 0.0]), np.array([1.0, 0.0, 1.0, 1.0, 0.0]))
    assert at.tolist() == [0.0, 1.0, 2.0] and level.tolist() == [0.0, 0.5, 1.0]


def plain_quality(texts, known, threshold=0.7):
    """Scores of all texts from (text, label, fold) rows, by the same method over one matrix."""
    stats = np.array([quality.statistics(pa.array([t]))[0] for t, _, _ in known])
    y, fold = np.array([float(v) for _, v, _ in known]), np.array([f for _, _, f in known])
    mean, sd = stats.mean(0), stats.std(0)
    sd[sd <= 1e-9] = 1.0
    z = quality.fourier(stats, mean, sd)

    def ridge(rows):
        a = z[rows].T @ z[rows]
        return np.linalg.solve(a + quality.RIDGE * max(1.0, rows.sum()) / quality.FEATURES * np.eye(a.shape[0]), z[rows].T @ y[rows])

    raw = np.empty(len(y))
    for f in set(fold.tolist()):
        raw[fold == f] = z[fold == f] @ ridge(fold != f)
    order = np.argsort(raw)
    want = [max(min(y[order][i : j + 1].mean() for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))]
    place, level = [], []
    for v in dict.fromkeys(want):
        place.append(raw[order][[w == v for w in want]].mean()), level.append(v)
    all_z = quality.fourier(np.array([quality.statistics(pa.array([t]))[0] for t in texts]), mean, sd)
    return np.clip(np.interp(all_z @ ridge(np.ones(len(y), bool)), place, level), 0, 1)


def test_quality_scores_match_plain_version(spark):
    docs, labels = quality_docs(spark, 90)
    docs = docs.withColumnsRenamed({"n_chars": "x", "source": "fold"}).withColumn("y", docs["doc_id"])
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i in truth}
    want = plain_quality([t for _, t in rows], [(t, truth[i], fold[i]) for i, t in rows if fold[i] != 2])
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(want.tolist(), abs=1e-6)


def test_repeated_labels_count_as_often_as_they_occur(spark):
    docs, labels = quality_docs(spark, 60)
    truth = [(r["doc_id"], r["quality"]) for r in labels.collect()]
    more = truth[:20] + truth[:5]
    rows, text = [(r["doc_id"], r["text"]) for r in docs.collect()], {r["doc_id"]: r["text"] for r in docs.collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i in text}
    want = plain_quality([t for _, t in rows], [(text[i], q, fold[i]) for i, q in truth + more if i in text and fold[i] != 2])
    both = labels.unionByName(spark.createDataFrame([*more, (None, 1), (truth[1][0], None)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, both).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(want.tolist(), abs=1e-5)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, len(quality.STATISTICS)))
    z = quality.fourier(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, :-1]
    d = ((np.clip(x, -4, 4)[:, None] - np.clip(x, -4, 4)[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-d / (2 * x.shape[1]))).max() < 0.3


# --- top-k search ------------------------------------------------------------------------------
def plain_top(rows, k=5):
    ok = {}
    for i, v in ((i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault((i, tuple(v)), [math.floor(256 * x) for x in v])
    out = defaultdict(list)
    for (i, a), x in ok.items():
        if i % 50 == 0:
            found = sorted({(-min(max(sum(p * q for p, q in zip(x, y, strict=True)), -(2**63)), 2**63 - 1), j) for (j, b), y in ok.items() if j != i and len(b) == len(a)})
            out[i] += found
    return {i: [(-s, j) for s, j in sorted(set(f))[:k]] for i, f in out.items()}


def test_search_matches_plain_version(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=20) / 4)]) for i in range(230)]
    rows += [(300, [0.1] * 20), (301, rows[7][1]), (302, rows[7][1]), (303, None), (304, [float("nan")] * 20), (305, [None] * 20), (350, [0.5] * 3), (351, [0.25] * 3), (400, []), (None, [1.0] * 20), (7, rows[7][1]), (450, [float("inf")] * 20), (310, [3e38] * 20), (311, [-3e38] * 20)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    for block in (8192, 3, 1):
        got = defaultdict(list)
        for r in topk_search.top_k(df, df["vec_id"] % 50 == 0, block=block).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert dict(got) == {i: f for i, f in plain_top(rows).items() if f}
    assert topk_search.top_k(df.limit(0), df["vec_id"] % 50 == 0).count() == 0


def test_bounds_are_never_below_the_product():
    rng = np.random.default_rng(5)
    a, b = np.floor(256 * rng.normal(size=(30, 37))), np.floor(256 * rng.normal(size=(40, 37)))
    for left, right in zip(topk_search.Resolutions(a).levels, topk_search.Resolutions(b).levels, strict=True):
        assert (left @ right.T + 1e-6 >= a @ b.T).all()


# --- n-gram join -------------------------------------------------------------------------------
def plain_classes(rows, words, percent):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def near_copies(seed, base_words, copies, edits):
    rng = random.Random(seed)
    base = prose(rng, "aa", base_words).split()
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = prose(rng, "bb", 1)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_classes_match_plain_version(spark, words, percent):
    rng = random.Random(8)
    common = prose(rng, "bb", 30)
    texts = [None, "", "  \n", "one", "ONE", "two words", "a b c", *near_copies(1, 120, 60, 8), *near_copies(2, 40, 25, 3), *(common + " " + prose(rng, "aa", rng.randrange(5, 200)) for _ in range(40)), *(prose(rng, "aa", 60) for _ in range(20))]
    texts += [texts[20], texts[20].upper(), texts[21].replace(" ", "\n"), common, common]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 5)) + [(5, texts[0]), (None, texts[1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, sig string")
    got = ngram_join.link_classes(df, words, percent)
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=key) == sorted(plain_classes(rows, words, percent), key=key)


def test_a_chain_is_one_class_and_one_document_stays(spark):
    base = prose(random.Random(9), "aa", 200).split()
    chain = []
    for i in range(12):
        chain.append((50 - i, " ".join([*(f"w{k}" for k in range(8 * i)), *base[8 * i :]])))
    df = spark.createDataFrame([(i, t, 3) for i, t in [*chain, (99, "alone here")]], "doc_id long, text string, fp int")
    kept = ngram_join.one_of_each_class(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {99, min(i for i, _ in chain)}


def test_two_families_linked_through_both_sides_are_one_class(spark):
    """Two large families whose bridges share one part with each: no side alone sees all that a pair of bridges shares."""
    word = lambda kind, k: f"{kind}{k}"
    u, p, q = ([word(kind, k) for k in range(n)] for kind, n in (("u", 344), ("p", 33), ("q", 33)))
    own = lambda name, n: [f"{name}o{k}" for k in range(n)]
    rows = [u + p + own(f"a{i}x", 33) for i in range(260)] + [u + q + own(f"b{i}x", 33) for i in range(240)]
    rows += [u + p + q[:20] + own("x", 4), u + p[:20] + q + own("y", 4)]
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.link_classes(df, words=1, percent=80).collect()}
    link = lambda a, b: 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))
    assert link(rows[0], rows[1]) and link(rows[0], rows[500]) and link(rows[500], rows[501]) and link(rows[501], rows[260])
    assert set(found.values()) == {0}


@pytest.mark.parametrize("seed", [3, 4])
def test_large_families_with_bridges_match_plain_version(spark, seed):
    rng = random.Random(seed)
    texts = []
    for f in range(3):
        texts += near_copies(seed * 10 + f, 90, 90, 5)
    heads = [texts[90 * f].split() for f in range(3)]
    for a, b in ((0, 1), (1, 2)):
        for share in (0.05, 0.5, 0.95):
            n = int(len(heads[a]) * share)
            texts.append(" ".join(heads[a][:n] + heads[b][n:]))
    texts += ["x " * 40000 + "y", None, " ".join(heads[0] * 300)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link_classes(df, 4, 85).collect())
    assert got == sorted(plain_classes(rows, 4, 85))


def test_one_of_each_class_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 10, 20), (2, "a b c d e f", 11, 21), (3, None, 12, 22), (4, "other words here", None, 23)], "doc_id long, text string, __gw_fp long, __GW_ID long")
    kept = ngram_join.one_of_each_class(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    assert {r["__gw_fp"] for r in kept.collect()} == {10, 12, None}


def test_classes_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.link_classes(df).count() == 0
    assert ngram_join.one_of_each_class(df).count() == 0


def test_prefixes_share_as_many_shingles_as_asked():
    rng = np.random.default_rng(6)
    frequent, counts = np.sort(rng.integers(0, 400, 60).astype(np.uint64)), rng.integers(2, 9, 60)
    frequent, at = np.unique(frequent, return_index=True)
    counts = counts[at]
    for _ in range(300):
        a = np.unique(rng.integers(0, 400, rng.integers(5, 60)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 400, 2).astype(np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        (p, base_a), (q, base_b) = (ngram_join.prefix(x, frequent, counts, 80) for x in (a, b))
        for k in range(1, ngram_join.MOST_MATCHES + 1):
            asked = ngram_join.required(np.array([len(a)]), np.array([len(b)]), np.array([k]), 80)[0]
            if k <= min(-(-80 * len(a) // 100), -(-80 * len(b) // 100)):
                assert len(np.intersect1d(p[: base_a + k - 1], q[: base_b + k - 1])) >= asked >= k


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_between_families_are_found_from_both_sides(spark, seed):
    rng = random.Random(seed)
    family = {node: 0 if node < 70 else 100 if node < 140 else 200 if node < 150 else node for node in range(170)}
    bridges, n, picked = {3: range(10), 75: range(10), 145: range(1, 11), 146: range(2, 12), 160: range(10), 161: range(10)}, 20, 8
    held = {node: set(bridges.get(node, ())) for node in family}
    for node, own in family.items():
        if node not in bridges:
            held[node] = set(rng.sample(range(5) if own == 0 else range(5, 10) if own == 100 else range(12), 4 if own < 200 else 11))
    postings = spark.createDataFrame([(t, node, n, 13, rng.randrange(1, 9), picked) for node, tokens in held.items() for t in tokens], "token long, node long, n int, size int, level int, picked int")
    classes = spark.createDataFrame(list(family.items()), "node long, class long")
    need = int(ngram_join.required(np.array([n]), np.array([n]), np.array([picked]), 80)[0])
    plain = sorted((a, b) for a in family for b in family if a < b and family[a] != family[b] and len(held[a] & held[b]) >= need)
    assert (3, 75) in plain and (3, 160) in plain
    assert sorted((min(r), max(r)) for r in ngram_join._cross_pairs(postings, classes, 80).collect()) == plain


# --- pipeline ----------------------------------------------------------------------------------
def pipeline_tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_language_stage_matches_plain_version(spark, tmp_path):
    """Every decision of the stage from code lengths counted by hand."""
    import corpus_pipeline

    rng = random.Random(21)
    rows = [(i, prose(rng, lang := rng.choice(["aa", "bb"]), rng.randrange(16, 24)), lang, "s", 1) for i in range(110)]
    noise = "".join(rng.choice("qxzjvfhdp0189#") for _ in range(700))
    odd = [None, "", "77 ... 8", "k", noise, prose(rng, "aa", 9) + " \n" + prose(rng, "bb", 9), "KA LO MI"]
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(odd)]
    folder = pipeline_tables(spark, tmp_path, rows, [(1, 1, 0)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.language_stage(spark, docs, folder)
    assert got.columns == docs.columns
    learned = [(i, t.lower(), lang) for i, t, lang, *_ in rows if lang and t and zlib.crc32(str(i).encode()) % 5]
    half = {r["doc_id"]: r["half"] for r in docs.selectExpr("doc_id", "cast(pmod(xxhash64(coalesce(cast(doc_id as string), ''), 'language sample'), 2) as int) AS half").collect()}
    need, few = [0, 1, 2, 2], {}
    for lang in ("aa", "bb"):
        rates = []
        for side in (0, 1):
            others = [t for i, t, other in learned if other == lang and half[i] != side]
            rates += [plain_bits(others, t, need) / len(t) for i, t, other in learned if other == lang and half[i] == side and len(t) >= language_id.RATED_BYTES]
        few[lang] = language_id.MARGIN * np.quantile(rates, language_id.RATE_SHARE) if len(rates) >= language_id.RATED else math.inf
    kept = set()
    for i, t, *_ in rows:
        if t and any(c.isalpha() for c in t):
            bits = {lang: plain_bits([x for _, x, other in learned if other == lang], t.lower(), need) for lang in ("aa", "bb")}
            best = min(bits, key=bits.get)
            if bits[best] - language_id.SLACK <= few[best] * len(t):
                kept.add(i)
    assert all(map(math.isfinite, few.values())) and 1004 not in kept and {1003, 1006} <= kept
    assert {r["doc_id"] for r in got.collect()} == kept


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(22)
    rows = [(i, prose(rng, lang := rng.choice(["aa", "bb"]), 30), lang, "s", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "aa", "", 0), (None, "ka lo mi", "aa", None, None), (102, rows[3][1], "aa", "s", 1), (103, rows[3][1] + " ka", "aa", "s", 1), (104, prose(rng, "aa", 40000), "aa", "s", 1)]
    labels = [(i, 1, 0) for i in range(60)] + [(None, 1, 0), (104, None, 0)]
    out = corpus_pipeline.run(spark, pipeline_tables(spark, tmp_path / "odd", rows, labels)).toPandas()
    assert not {100, 101} & set(out["doc_id"].dropna()) and 104 in set(out["doc_id"])
    assert (out.groupby("sequence_id")["length"].sum() <= 4096).all()
    nothing = corpus_pipeline.run(spark, pipeline_tables(spark, tmp_path / "none", rows[:0], labels[:0]))
    assert nothing.count() == 0 and "ids_crc32" in nothing.columns


def test_pipeline_stages_do_what_they_say(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "exact_dedup", "ngram_jaccard_join", "harmonic_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        frames.append(docs.toPandas())
    start, lang, good, exact, unlike, packed = frames
    assert all(list(f.columns) == list(start.columns) for f in frames[1:5])
    labels = pd.read_parquet(f"{folder}/labels.parquet")
    truth = dict(zip(labels["doc_id"].tolist(), labels["quality"].tolist(), strict=True))
    rows = list(zip(lang["doc_id"].tolist(), lang["text"].tolist(), strict=True))
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i, _ in rows}
    score = dict(zip((i for i, _ in rows), plain_quality([t for _, t in rows], [(t, truth[i], fold[i]) for i, t in rows if i in truth and fold[i] != 2]).tolist(), strict=True))
    near = {i for i, v in score.items() if abs(v - 0.7) < 1e-6}
    assert set(good["doc_id"]) - near == {i for i, v in score.items() if v >= 0.7} - near and len(near) < 5
    assert sorted(exact["doc_id"]) == sorted(good.groupby("text")["doc_id"].max())
    rows = list(zip(exact["doc_id"].tolist(), exact["text"].tolist(), strict=True))
    assert sorted(unlike["doc_id"]) == sorted({c for _, _, c in plain_classes(rows, 5, 80)})
    assert set(packed["doc_id"]) == set(unlike["doc_id"])
    pieces = packed.groupby("doc_id").agg(n=("length", "sum"), t=("doc_tokens", "first"))
    assert (pieces["n"] == pieces["t"]).all()
    whole = corpus_pipeline.run(spark, folder).toPandas()
    assert sorted(whole["doc_id"]) == sorted(packed["doc_id"])
