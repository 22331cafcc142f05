"""Harmonic packing: lengths in reciprocal-capacity classes, a fixed number of documents to a class's bin.

What is over the capacity of a document fills bins of its own. The rest, of n tokens, is of class
k = capacity // n, of which k fit one bin; a worker keeps one open bin for each class, closes it at k
rests and never looks at other workers. The room that a closed bin has left is filled by the front of
the document that comes next, the only cut that the method makes. What a worker's open bins hold at
the end is poured into bins one after another, and the last tokens into bins whose length is a power
of two, so no sequence needs padding.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm import runs
from gridwright.llm.common import slices

#: Characters of a text that are cut into words at a time, and bytes of texts that are taken together.
LONG, TOGETHER = 4 << 20, 2 << 20
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
#: The rules of a vocabulary file that ``word_starts`` follows (fixed values of the file).
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Endings that the vocabulary file's own pre-token rule keeps together with an apostrophe (fixed values of the file).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """(kind of each byte, whether the tokenizer's rules treat it alike in every library at hand): ASCII; letters of Latin-1 lie above it."""
    kind, plain = np.full(256, _MARK, np.uint8), np.zeros(256, bool)
    plain[[9, 10, 13, *range(32, 127)]] = True
    kind[[9, 10, 13, 32]] = _SPACE
    kind[ord("0") : ord("9") + 1] = _DIGIT
    kind[ord("a") : ord("z") + 1] = _LETTER
    kind[128:] = _LETTER
    return kind, plain


_KIND, _PLAIN = _kinds()


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the runs of lower-cased plain texts begin: words, single digits, runs of marks and of spaces, and endings after an apostrophe."""
    kind = _KIND[data]
    first = np.ones(len(data), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    quote = np.flatnonzero((data == ord("'")) & first)
    ends = np.zeros(len(data) + 1, bool)
    ends[offsets] = True
    quote = quote[quote + 1 < len(data)]
    quote = quote[(kind[quote + 1] == _LETTER) & ~ends[quote + 1]]
    padded = np.append(data, np.zeros(2, np.uint8))
    for ending in ENDINGS:  # no ending begins another, so their order does not matter
        hit = quote[padded[quote + 1] == ord(ending[0])]
        if len(ending) == 2:
            hit = hit[(padded[hit + 2] == ord(ending[1])) & ~ends[hit + 2]]
        first[hit + 1] = False
        after = hit + 1 + len(ending)
        first[after[after < len(data)]] = True
    return np.flatnonzero(first)


class WordIds:
    """Ids of texts under a vocabulary, as little-endian unsigned 32-bit bytes.

    Where the file has RULES, the words of a batch are looked up once each. Under any other rules the library encodes all
    texts whole. ``checked`` holds the first of some texts against the library: a difference is an error.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        vocab, model = self.tokenizer.get_vocab(), rules["model"]
        self.by_words = all(rules[k] == v for k, v in RULES.items()) and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"] and all(t["content"].startswith("<|") for t in rules["added_tokens"])
        self.word_end = np.zeros(max(vocab.values()) + 1, bool)
        self.word_end[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of runs of letters, many to a call: each ends with the one id of it that ends a word."""
        ids = np.frombuffer(b"".join(self._whole([" ".join(words[i : i + 512]) for i in range(0, len(words), 512)])), "<u4")
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(words):
            return self._whole(words)
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _plain(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts of plain letters, by their words."""
        data, offsets = runs.texts_data(pc.utf8_lower(texts))
        starts = word_starts(data, offsets)
        codes, words = runs.coded(data, starts)
        names, kind = words.to_pylist(), _KIND[runs.first_bytes(words)]
        ids = [b""] * len(names)  # spaces have none
        for chosen, how in ((kind == _LETTER, self._words), ((kind == _DIGIT) | (kind == _MARK), self._whole)):
            at = np.flatnonzero(chosen).tolist()
            for i, found in zip(at, how([names[i] for i in at]), strict=True):
                ids[i] = found
        return runs.gathered(ids, codes, "<u4", np.searchsorted(starts, offsets))

    def _one(self, text: str) -> bytes:
        """Ids of a long text, a part at a time: no word goes across a space."""
        parts, at = [], 0
        while len(text) - at > LONG and (cut := max(text.rfind(c, at, at + LONG) for c in " \n\t\r")) > at:
            parts.append(text[at:cut])
            at = cut
        return b"".join(self._plain(pa.array([p], pa.large_string()))[0] for p in [*parts, text[at:]])

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not self.by_words:
            return self._whole(texts.to_pylist())
        data, offsets = runs.texts_data(texts)
        plain = runs.only(data, offsets, _PLAIN) & ~pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False).astype(bool)
        long = plain & (np.diff(offsets) > LONG)
        short, odd = np.flatnonzero(plain & ~long), np.flatnonzero(~plain)
        out = [b""] * len(texts)
        for at, found in ((short, self._plain(texts.take(pa.array(short)))), (odd, self._whole(texts.take(pa.array(odd)).to_pylist()))):
            for i, ids in zip(at.tolist(), found, strict=True):
                out[i] = ids
        for i in np.flatnonzero(long).tolist():
            out[i] = self._one(texts[i].as_py())
        return out

    def checked(self, texts: pa.Array) -> list[bytes]:
        out = self(texts)
        if out and out[0] != self._whole([texts[0].as_py()])[0]:
            raise RuntimeError("ids by words differ from the library's")
        return out


@functools.lru_cache(maxsize=2)
def worker_ids(path: str) -> WordIds:
    """One vocabulary per worker process, which serves the tasks after."""
    return WordIds(path)


class Packer:
    """A worker's open bins. ``add`` and ``finish`` return finished pieces: (doc, start, length, crc, tokens, sequence, offset)."""

    def __init__(self, capacity: int = 4096, least: int = 64):
        self.capacity, self.most, self.sequence = capacity, capacity // least, 0
        self.open: dict[int, list] = {}
        self.short: list = []  # the closed bin that has room left
        self.room = 0

    def _close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, tokens in pieces:
            length = len(ids) // 4
            yield doc, start, length, zlib.crc32(ids), tokens, self.sequence, offset
            offset += length
        self.sequence += 1

    def _fill(self, doc, ids: bytes, start: int, tokens: int) -> Iterator[tuple]:
        """Pieces of a bin that the front of ``ids`` makes full; the room is what then is left."""
        self.short.append((doc, start, ids[: 4 * self.room], tokens))
        self.room -= min(self.room, len(ids) // 4)
        if not self.room:
            yield from self._close(self.short)
            self.short = []

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        """ids: little-endian unsigned 32-bit."""
        n, at = len(ids) // 4, 0
        if self.room:
            at = min(n, self.room)
            yield from self._fill(doc, ids, 0, n)
        while n - at >= self.capacity:
            yield from self._close([(doc, at, ids[4 * at : 4 * (at + self.capacity)], n)])
            at += self.capacity
        if at < n:
            k = min(self.capacity // (n - at), self.most)
            pieces = self.open.setdefault(k, [])
            pieces.append((doc, at, ids[4 * at :], n))
            if len(pieces) == k:
                self.short = self.open.pop(k)
                self.room = self.capacity - sum(len(p[2]) // 4 for p in self.short)
                if not self.room:
                    yield from self._close(self.short)
                    self.short = []

    def finish(self) -> Iterator[tuple]:
        left = [*self.short, *(p for _, pieces in sorted(self.open.items()) for p in pieces)]
        self.short, self.open, self.room = [], {}, 0
        count = sum(len(p[2]) // 4 for p in left)
        for doc, start, ids, tokens in left:
            while ids:
                if not self.room:  # a new bin: the capacity, or the largest power of two that what is left fills
                    self.room = self.capacity if count >= self.capacity else 1 << (count.bit_length() - 1)
                took = min(self.room, len(ids) // 4)
                yield from self._fill(doc, ids, start, tokens)
                ids, start, count = ids[4 * took :], start + took, count - took


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
#: Sequences of a worker are numbered from its number times this.
WORKER_SEQUENCES = 1 << 40


def packed(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, least: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` names the vocabulary file on the workers; capacity and least are powers of two, and rests
    of fewer than ``least`` tokens share a class. A null text counts as empty and is its end id alone;
    long texts are cut into many pieces, every id lies in one. Each row is packed for itself, also
    where ids or texts repeat. A worker holds less than one bin for each class; sequence ids are its partition number times 2**40 and up, so they repeat
    when a lost task is run again on the same partition. An empty table gives an empty result.
    """
    if capacity & capacity - 1 or least & least - 1 or not 1 <= least <= capacity:
        raise ValueError("capacity and least must be powers of two")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = worker_ids(path), Packer(capacity, least)
        base = TaskContext.get().partitionId() * WORKER_SEQUENCES
        types, first = None, True

        def batch_of(pieces: list) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*pieces, strict=True)]
            columns[5] = [base + s for s in columns[5]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_NAMES)

        for batch in slices(batches, "text", TOGETHER):
            types = types or [batch.schema.field("doc_id").type, *[pa.int64()] * 6]
            out = []
            found = ids_of.checked(batch.column(1)) if first else ids_of(batch.column(1))  # a text of each task
            first = False
            for doc, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                out += packer.add(doc, ids + end)
            if out:
                yield batch_of(out)
        if out := list(packer.finish()):
            yield batch_of(out)

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
