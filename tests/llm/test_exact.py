"""Exact dedup, sharding, packing, sentence pieces, URL rules and chat format against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwright.llm import chat_format, exact_dedup, packing, queries, sentence_pieces, sharding, url_filter
from gridwright.llm.exact_dedup import CountingQuotientFilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "a", "A", "x" * 30000, "x" * 30000, "ñandú é́", "don't 12\n\n3", "<|endoftext|> <s>", "😀 İstanbul ﬁ \u200b", "a\x00b", "tab\tend "]


def docs(spark, texts, first=0, **extra):
    rows = [(first + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name, v in extra.items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(v))
    return df


# --- exact dedup -------------------------------------------------------------------------------
def plain_dedup(rows):
    best, size = {}, defaultdict(int)
    for i, t in rows:
        size[t or ""] += 1
        if t is not None or True:
            best[t or ""] = max(best.get(t or "", i), i, key=lambda v: -1 if v is None else v)
    return [(i, best[t or ""], size[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]


def test_dedup_matches_plain_version(spark):
    rng = random.Random(0)
    texts = [*ODD, *(rng.choice(["one two", "one  two", "z" * rng.randrange(5)]) for _ in range(80))]
    got = exact_dedup.exact_dedup(docs(spark, texts, fp=1, kept="x", whole=2)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == sorted(plain_dedup(list(enumerate(texts))))
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_dedup_keeps_one_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c"), (3, "c")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = defaultdict(int)
    for r in got:
        kept[r["text_sha256"]] += r["kept"]
    assert len(got) == 7 and set(kept.values()) == {1}


def test_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_filter_keeps_columns_and_rows(spark):
    df = docs(spark, ["a", "b", "a", None, ""], __gw_other=5)
    got = exact_dedup.without_exact_copies(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 4]


def test_filter_keeps_the_users_columns_of_clashing_names(spark):
    df = docs(spark, ["a", "b", "a", None, ""], __gw_fp=5, __GW_SHA=6, __gw_keep=7, __gw_in=8)
    got = exact_dedup.without_exact_copies(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["__gw_fp"], r["__GW_SHA"], r["__gw_keep"], r["__gw_in"]) for r in got.collect()) == [(i, 5, 6, 7, 8) for i in (1, 2, 4)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 255) | st.integers(0, 2**20 - 1), max_size=40), min_size=1, max_size=4))
def test_filters_merge_without_loss(parts):
    filters = []
    for values in parts:
        v, n = np.unique(np.array(values, np.uint64), return_counts=True)
        filters.append(CountingQuotientFilter.from_bytes(CountingQuotientFilter.of_sorted(v, n.astype(np.uint64), 20).to_bytes()))
        assert (filters[-1].items()[0] == v).all()
    v, n = CountingQuotientFilter.merged(filters).items()
    want, counts = np.unique(np.array(sum(parts, []), np.uint64), return_counts=True)
    assert v.tolist() == want.tolist() and n.tolist() == counts.tolist()


# --- sharding ----------------------------------------------------------------------------------
@settings(max_examples=50, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_feistel_is_a_permutation_with_an_inverse(rows, seed):
    numbers = np.arange(rows)
    places = sharding.feistel(numbers, rows, seed)
    assert sorted(places.tolist()) == numbers.tolist()
    assert (sharding.feistel(places, rows, seed, inverse=True) == numbers).all()


def test_shards_are_even_and_do_not_depend_on_partitions(spark):
    df = docs(spark, [*ODD, *map(str, range(90))], size=3).unionByName(docs(spark, ["a", "a"], 3, size=3))
    one = sharding.shards(df).collect()
    two = sharding.shards(df.repartition(7)).collect()
    key = lambda rows: sorted((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in rows)
    assert key(one) == key(two)
    slots = defaultdict(list)
    for r in one:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    text = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in one if r["doc_id"] not in (3, 4)}
    for i, t in enumerate(ODD):
        if i not in (3, 4):
            assert text[i] == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))


def plain_place(number, rows, seed):
    """One number's place under the permutation, with plain integers."""
    full = (1 << 64) - 1

    def mixed(x, key):
        x = (x + key) * 0x9E3779B97F4A7C15 & full
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    half = max(1, ((max(rows, 2) - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    while True:
        left, right = number >> half, number & low
        for turn in range(1, sharding.ROUNDS + 1):
            left, right = right, left ^ (mixed(right, mixed(seed, turn)) & low)
        number = left << half | right
        if number < rows:
            return number


@pytest.mark.parametrize("count", [8, 3])
def test_shard_and_slot_match_a_plain_permutation(spark, count):
    texts = [*ODD, *(f"t{i % 17}" for i in range(70))]
    df = docs(spark, texts, place=1, row_number=2).unionByName(docs(spark, ["z", "y"], 4, place=1, row_number=2))
    rows = sorted((r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in df.collect())
    want = []
    for number, (doc, crc, size) in enumerate(rows):
        place = plain_place(number, len(rows), 20240607)
        want.append((doc, crc, size, place % count, place // count))
    assert sorted((r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in sharding.shards(df.repartition(5), count).collect()) == sorted(want)


def test_shards_of_null_ids_and_nothing(spark):
    assert sharding.shards(spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string")).count() == 2
    assert sharding.shards(docs(spark, [])).count() == 0


# --- packing -----------------------------------------------------------------------------------
def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    rng = random.Random(5)
    texts = [*ODD, *(" ".join(rng.choice(["alpha", "Beta,", "gamma's", "42", "ñu"]) for _ in range(rng.choice([3, 60, 900, 9000]))) for _ in range(40))]
    got = packing.packed(docs(spark, texts, start=1, sequence_id=2).repartition(3), path).collect()
    tokenizer = Tokenizer.from_file(path)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    waste = total = 0
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 4096
        total += at
        waste += 0 if at & (at - 1) == 0 else 4096 - at
    assert waste <= 0.02 * total


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 30) | st.integers(1, 300), max_size=120), st.sampled_from([(64, 4), (64, 64), (16, 1)]))
def test_bins_are_full_and_cuts_are_few(lengths, shape):
    capacity, least = shape
    packer, whole, out = packing.Packer(capacity, least), {}, []
    for i, n in enumerate(lengths):
        whole[i] = np.arange(i, i + n).astype("<u4").tobytes()
        out += packer.add(i, whole[i])
    done = len({p[5] for p in out})
    out += packer.finish()
    pieces, bins = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, tokens, sequence, offset in out:
        pieces[doc].append((start, length, crc, tokens))
        bins[sequence].append((offset, length))
    for i, ids in whole.items():
        at = 0
        for start, length, crc, tokens in sorted(pieces[i]):
            assert start == at and length > 0 and tokens == len(ids) // 4
            assert crc == zlib.crc32(ids[4 * at : 4 * (at + length)])
            at += length
        assert at == len(ids) // 4
    sizes = []
    for k in range(len(bins)):
        at = 0
        for offset, length in sorted(bins[k]):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(s == capacity for s in sizes[:done]) and all(s == capacity or s & (s - 1) == 0 for s in sizes)
    assert sum(s < capacity for s in sizes) <= capacity.bit_length()
    assert len(out) <= len(lengths) + len(bins)


def test_a_class_takes_a_fixed_number_of_documents():
    packer = packing.Packer(100, 10)
    out = [p for i, n in enumerate([40, 30, 45, 26, 33]) for p in packer.add(i, bytes(4 * n))]
    # 40 and 45 are of class 2, 30, 26 and 33 of class 3; 26 fills the 15 that class 2 left with its front
    assert [(p[0], p[1], p[2], p[5], p[6]) for p in out] == [(0, 0, 40, 0, 0), (2, 0, 45, 0, 40), (3, 0, 15, 0, 85)]
    assert {k: [p[0] for p in v] for k, v in packer.open.items()} == {3: [1, 4], 9: [3]}


def test_packing_of_nothing(spark):
    assert packing.packed(docs(spark, []), queries.vocabulary("word_bpe_49k.json")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from("aB é'st1.,<|>\n "), max_size=60))
def test_word_ids_are_the_tokenizers(text):
    ids = WORDS([text])[0]
    assert ids == np.array(WORDS.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_other_vocabularies_are_encoded_by_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    texts = ["Hello  World's 123", "", "a\nB  c<|x|>", "naïve – ok"]
    theirs = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    other = packing.WordIds(path)
    assert WORDS.by_words and not other.by_words and other(texts) == theirs
    pieces = packing.packed(docs(spark, texts), path, 64, 50256, 4).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == {i: len(t) // 4 + 1 for i, t in enumerate(theirs)}


WORDS = packing.WordIds(queries.vocabulary("word_bpe_49k.json"))
PIECES = sentence_pieces.MergePieces(queries.vocabulary("piece_bpe_32k.model"))


# --- sentence pieces ---------------------------------------------------------------------------
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from("aéB ▁.1\n–ł\t"), max_size=60))
def test_pieces_are_the_librarys(text):
    ids, decoded = PIECES.encode([text])[0]
    theirs = PIECES.library.encode(text, add_bos=True, add_eos=True)
    assert ids == np.array(theirs, "<u4").tobytes()
    assert decoded.decode() == PIECES.library.decode(theirs)


def test_piece_digests(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in sentence_pieces.digests(docs(spark, ODD, ids=1), path).collect()}
    for i, t in enumerate(ODD):
        ids = PIECES.library.encode(t or "", add_bos=True, add_eos=True)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(PIECES.library.decode(ids).encode()).hexdigest()
    lists = {r["doc_id"]: r for r in sentence_pieces.encoded(docs(spark, ODD), path).collect()}
    assert lists[3]["ids"] == PIECES.library.encode("a", add_bos=True, add_eos=True) and lists[0]["decoded"] == ""
    assert sentence_pieces.digests(docs(spark, []), path).count() == 0


# --- URL rules ---------------------------------------------------------------------------------
def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in rules:
        h, p = r.rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.rule) > len(best.rule)):
            best = r
    return host, path, best.rule if best else None, best.verdict if best else default


def test_url_rules_match_plain_version(spark):
    rng = random.Random(2)
    hosts = ["example.com", "EXAMPLE.com", "a.example.net", "notcom", "com", "x.org", "evil.org.com", "é.net", ""]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(['/', '', '?', '#', '/EN/'])}{rng.choice(['en/7', 'en/', 'de/8', 'es/x', 'com/en/'])}{rng.choice(['', '?a=/en/', '#x', chr(10)])}" for _ in range(400)]
    urls += [None, "", "no scheme", "a://b://c/en/", "http://x.com", "http://" + "y" * 9000 + ".com/en/"]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(df).collect()}
    for i, u in enumerate(urls):
        assert got[i] == plain_verdict(u, url_filter.RULES), u
    kept = url_filter.allowed_pages(df)
    assert kept.columns == df.columns
    assert {r["page_id"] for r in kept.collect()} == {i for i, u in enumerate(urls) if got[i][3] == "allow"}
    assert url_filter.judged(df.limit(0)).count() == 0


def test_many_rules_span_words():
    globs = [f"*.host{i}.org/a*b/**" for i in range(40)]
    automaton = url_filter.ShiftAnd(globs)
    assert automaton.words > 4
    hits = automaton.matches([b".x.host7.org/a12b/zzz", b".host7.org/a/b/", b"", b".host39.org/ab/"])
    assert hits[0].nonzero()[0].tolist() == [7] and not hits[1].any() and not hits[2].any() and hits[3].nonzero()[0].tolist() == [39]


# --- chat format -------------------------------------------------------------------------------
TALKS = {
    1: [("user", "hi"), ("assistant", "a <|end|>\n<|turn|>user\nx"), ("user", "\\n \\ <\\| <|"), ("assistant", "")],
    2: [("system", "s"), ("user", "only")],
    3: [("assistant", None), (None, "b"), ("assis\ntant", "c"), ("assistant", "end <")],
    4: [("user", "q"), ("assistant", "r")] * 150,
}


def test_chat_reads_back(spark):
    rows = [(c, i, r, t, "x") for c, turns in TALKS.items() for i, (r, t) in enumerate(turns)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string").repartition(3)
    examples = chat_format.prefix_targets(df)
    got = {r["conv_id"]: r for r in chat_format.read_back(examples).collect()}
    for c, turns in TALKS.items():
        whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
        replies = [t or "" for r, t in turns if r == "assistant"]
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256("".join(replies).encode()).hexdigest()
        assert got[c]["loss_chars"] == sum(map(len, replies))
    by = defaultdict(list)
    for r in examples.collect():
        by[r["conv_id"]].append(r)
    assert [r["loss_start"] is None for r in by[2]] == [True]
    assert len(by[4]) == 150
    for r in by[1]:
        turns = chat_format.read_turns(r["text"])
        assert turns == [(a, b) for a, b in TALKS[1][: r["n_turns"]]]
        assert chat_format.unescape(r["text"][r["loss_start"] : r["loss_end"]]) == turns[-1][1]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("<|\\\nturnend>x"), max_size=30))
def test_escaping_is_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert "<|" not in chat_format.escape(text)
    assert "\n" not in chat_format.escape_role(text) and chat_format.unescape(chat_format.escape_role(text)) == text


def test_chat_of_null_ids_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(None, None, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b")], schema)
    got = chat_format.read_back(chat_format.prefix_targets(df)).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got] == [(None, 3, 2)]
    assert chat_format.read_back(chat_format.prefix_targets(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("kind", ["smallint", "int", "decimal(12,2)", "double", "float", "string", "date", "boolean"])
def test_conversation_ids_of_any_type(spark, kind):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (0, 0, "assistant", "b"), (None, 0, "user", "c")], "k long, turn long, role string, text string")
    as_kind = "date_add(date'2020-01-01', cast(k as int))" if kind == "date" else f"cast(k as {kind})"
    rows = rows.selectExpr(f"{as_kind} AS conv_id", "turn", "role", "text", "turn AS example", "role AS loss_start")
    found = chat_format.read_back(chat_format.prefix_targets(rows))
    assert found.schema["conv_id"].dataType == rows.schema["conv_id"].dataType
    assert sorted((r["conv_id"] is not None, r["n_turns"], r["loss_chars"]) for r in found.collect()) == [(False, 1, 0), (True, 1, 1), (True, 2, 1)]


def test_conversations_with_nan_ids_are_one(spark):
    rows = spark.createDataFrame([(float("nan"), i, "assistant", "x") for i in range(3)], "conv_id double, turn long, role string, text string")
    assert [r["n_turns"] for r in chat_format.read_back(chat_format.prefix_targets(rows)).collect()] == [3]


# --- very long texts ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def long_texts():
    """Texts of 3 to 9 MB, longer than any slice: words, one endless word, two that differ in their last letter, and copies."""
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("lorem", "ipsum", "dolor", "sit", "amet's") for b in ("", "que", " 17", "é")]
    prose = " ".join(rng.choice(words) for _ in range(1_100_000))
    return [prose, prose, prose[:-1] + "z", "w" * 3_000_000, prose[:5_000_000], "short", None]


def test_long_texts_are_told_apart(spark, long_texts):
    got = exact_dedup.exact_dedup(docs(spark, long_texts)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == sorted(plain_dedup(list(enumerate(long_texts))))


def test_long_texts_are_sharded_by_their_bytes(spark, long_texts):
    got = {r["doc_id"]: r for r in sharding.shards(docs(spark, long_texts)).collect()}
    for i, t in enumerate(long_texts):
        raw = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))


def test_long_texts_are_packed_whole(spark, long_texts):
    some = [long_texts[0], long_texts[4], long_texts[5]]
    pieces = packing.packed(docs(spark, some), queries.vocabulary("word_bpe_49k.json")).collect()
    for i, t in enumerate(some):
        ids = np.array([*WORDS.tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces if r["doc_id"] == i)
        at = 0
        for start, length, crc in mine:
            assert start == at and crc == zlib.crc32(ids[4 * start : 4 * (start + length)])
            at += length
        assert at == len(ids) // 4 and {r["doc_tokens"] for r in pieces if r["doc_id"] == i} == {at}


def test_long_texts_become_pieces_whole(spark, long_texts):
    some = [long_texts[4], long_texts[3][:200_000]]
    got = {r["doc_id"]: r for r in sentence_pieces.digests(docs(spark, some), queries.vocabulary("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(some):
        ids = PIECES.library.encode(t, add_bos=True, add_eos=True)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(PIECES.library.decode(ids).encode()).hexdigest()
