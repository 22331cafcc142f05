"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs that form a piece, ordered by the piece's score
and then from the left, and merges the best until none is left. No merge can join two characters
that no piece holds side by side, so a text falls into stretches that are encoded for themselves and
remembered. Ids and decoded text of each new stretch, and of the first whole text of each batch, are checked
against the sentencepiece library.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm import runs
from gridwright.llm.common import Remembered, slices

#: Stretches that a task remembers.
REMEMBERED = 600_000
SPACE = "▁"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Bytes from which a text is cut by the pattern, piece after piece, to hold less at a time.
LONG = 16 << 20
#: Characters up to which texts are merged together, a rank beyond all others, and the pattern that takes a text as a whole.
WIDEST, NO_PAIR, WHOLE = 32, 1 << 40, "(?s).+"
_SPACE, _LETTER, _MARK, _FEED = range(4)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """(kind of each byte, whether it is ASCII below the delete sign); letters of Latin-1 lie above it."""
    kind = np.full(256, _MARK, np.uint8)
    kind[ord(" ")], kind[ord("\n")] = _SPACE, _FEED
    kind[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = _LETTER
    return kind, np.arange(256) < 127


_KIND, _PLAIN = _kinds()


class MergePieces:
    """A merge-type vocabulary with byte fallback, a dummy prefix and no text normalisation."""

    def __init__(self, path: str, checked: bool = True, remembered: int = REMEMBERED):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        kept = [i for i in range(size) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i))]
        if any(lib.is_unused(i) for i in kept) or lib.encode("a  b ", out_type=str)[0][0] != SPACE or lib.piece_to_id("<0x00>") == lib.unk_id():
            raise ValueError("not a merge-type vocabulary with byte fallback, dummy prefix and kept spaces")
        self.ids = {lib.id_to_piece(i): i for i in kept}
        self.scores = {lib.id_to_piece(i): lib.get_score(i) for i in kept}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.surfaces = [b""] * size
        for piece, i in self.ids.items():
            self.surfaces[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.surfaces[i] = bytes([b])
        self._tables()
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        self.runs = False  # whether plain texts may be cut into runs of bytes
        self.stretch = self._stretches()
        self.checked, self.known = checked, Remembered(remembered)

    def _tables(self) -> None:
        """Pieces by character, and the piece and its rank by the pieces of the two symbols that form it."""
        single = {ord(p): i for p, i in self.ids.items() if len(p) == 1}
        self.symbol_of = np.full(max((c for c in single if c < 1 << 16), default=0) + 2, -1)
        for c, i in single.items():
            if c < len(self.symbol_of):
                self.symbol_of[c] = i
        order = {score: rank for rank, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        pairs = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * len(self.surfaces) + right] = i, order[self.scores[piece]]
        keys = np.array(sorted(pairs) or [-1], np.int64)
        self.pair_keys = keys
        self.pair_pieces = np.array([pairs[k][0] if k in pairs else 0 for k in keys.tolist()], np.int64)
        self.pair_ranks = np.array([pairs[k][1] if k in pairs else NO_PAIR for k in keys.tolist()], np.int64)

    def _stretches(self) -> re.Pattern:
        """Longest runs within which a piece may reach; falls back to whole texts where the vocabulary allows more."""
        letter = re.compile(f"[{_LETTERS}]")
        kind = lambda c: "s" if c == SPACE else "l" if letter.match(c) else "n" if c == "\n" else "p" if c < "\x7f" else "x"
        joined = {kind(a) + kind(b) for piece in self.ids for a, b in zip(piece, piece[1:], strict=False)}
        if any(x[1] == "s" and x != "ss" for x in joined) or any("n" in x for x in joined):
            return re.compile(WHOLE)
        words = f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"
        if joined & {"lp", "pl"}:
            return re.compile(words)
        self.runs = True
        plain = "\x00-\x09\x0b-@[-`{-\x7e"  # ASCII but letters and the line feed
        return re.compile(f"{SPACE}*[{_LETTERS}]+(?=[{plain}{SPACE}\n]|\\Z)|{SPACE}*[{plain}]+(?=[{_LETTERS}{SPACE}\n]|\\Z)|{words}")

    def merge(self, text: str) -> list[int]:
        """Ids of text in which spaces are marked already."""
        symbols, n = list(text), len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        score, push, pop = self.scores.get, heapq.heappush, heapq.heappop
        agenda = [(-at, i, i + 1, 2) for i in range(n - 1) if (at := score(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = pop(agenda)
            one, two = symbols[left], symbols[right]
            if not one or not two or len(one) + len(two) != size:
                continue  # one of the two has been merged since
            one = symbols[left] = one + two
            symbols[right] = ""
            follows, leads = after[right], before[left]
            after[left] = follows
            if follows >= 0:
                before[follows] = left
                if (at := score(one + symbols[follows])) is not None:
                    push(agenda, (-at, left, follows, size + len(symbols[follows])))
            if leads >= 0 and (at := score(symbols[leads] + one)) is not None:
                push(agenda, (-at, leads, left, size + len(symbols[leads])))
        out: list[int] = []
        for s in filter(None, symbols):
            i = self.ids.get(s)
            out += [i] if i is not None else [self.bytes[b] for b in s.encode()]
        return out

    def merge_all(self, texts: list[str]) -> list[list[int]]:
        """``merge`` of many short texts at once: all their agendas give up their best pair together, round by round.

        Symbols of the texts that still merge lie in a matrix, a row each, and so do the ranks of the pairs that
        they form with their right neighbours. Texts with a character that is no piece, and long ones, go one by one.
        """
        out: list[list[int]] = [[]] * len(texts)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        symbols = np.where(points < len(self.symbol_of), self.symbol_of[np.minimum(points, len(self.symbol_of) - 1)], -1)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size)
        strange = np.concatenate([[0], np.cumsum(symbols < 0)])
        together = (size <= WIDEST) & (strange[ends] == strange[ends - size]) & (size > 0)
        for i in np.flatnonzero(~together).tolist():
            out[i] = self.merge(texts[i])
        low = 0
        for high in (4, 8, 16, WIDEST):
            rows = np.flatnonzero(together & (size > low) & (size <= high))
            low = high
            if len(rows):
                place = np.minimum((ends - size)[rows][:, None] + np.arange(high), len(symbols) - 1)
                found, count = self._rounds(np.where(np.arange(high) < size[rows][:, None], symbols[place], 0), size[rows])
                for i, ids, n in zip(rows.tolist(), found.tolist(), count.tolist(), strict=True):
                    out[i] = ids[:n]
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank of the piece that two symbols form, which is large if there is none; that piece)."""
        key = left.astype(np.int64) * len(self.surfaces) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], NO_PAIR), self.pair_pieces[at]

    def _rounds(self, symbols: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them) of rows of ``count`` symbols each."""
        done, out, width = count.copy(), symbols.copy(), symbols.shape[1]
        rank, piece = self._pairs(symbols[:, :-1], symbols[:, 1:])
        rank = np.where(np.arange(1, width) < count[:, None], rank, NO_PAIR)
        rank, piece = np.pad(rank, ((0, 0), (0, 1)), constant_values=NO_PAIR), np.pad(piece, ((0, 0), (0, 1)))
        rows, step = np.arange(len(symbols)), np.arange(width)
        while len(rows):
            at = rank.argmin(1)  # the best score, and of equal ones the leftmost
            here = np.arange(len(rows))
            on = rank[here, at] < NO_PAIR
            if not on.all():
                out[rows[~on]], done[rows[~on]] = symbols[~on], count[~on]
                rows, symbols, count, rank, piece, at = rows[on], symbols[on], count[on], rank[on], piece[on], at[on]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            symbols[here, at] = piece[here, at]
            source = np.minimum(step + (step > at[:, None]), width - 1)  # what stood right of the pair moves up
            symbols = np.take_along_axis(symbols, source, 1)
            after = np.minimum(step + (step >= at[:, None]), width - 1)
            rank, piece = np.take_along_axis(rank, after, 1), np.take_along_axis(piece, after, 1)
            count = count - 1
            rank[:, -1] = NO_PAIR
            for beside in (at - 1, at):  # the pairs that the new symbol forms
                ok = (beside >= 0) & (beside + 1 < count)
                i, j = here[ok], beside[ok]
                rank[i, j], piece[i, j] = self._pairs(symbols[i, j], symbols[i, j + 1])
            ended = at >= count - 1
            rank[here[ended], at[ended]] = NO_PAIR
        return out, done

    def surface(self, ids: list[int]) -> bytes:
        """Bytes that ids stand for, the mark of a first space included."""
        return b"".join(self.surfaces[i] for i in ids)

    def _learn(self, new: list[str]) -> None:
        found = self.merge_all(new)
        surfaces = [self.surface(ids) for ids in found]
        if self.checked and new:
            # a line feed in front keeps the library's dummy prefix away from the stretch
            before, cut = ("", 0) if self.stretch.pattern == WHOLE else ("\n", 2)
            theirs = self.library.encode([before + (s if before else s[1:]).replace(SPACE, " ") for s in new], num_threads=1)
            for s, ids, surface, other, back in zip(new, found, surfaces, theirs, self.library.decode(theirs, num_threads=1), strict=True):
                if other[cut:] != ids or (before + surface.decode("utf-8", "replace"))[0 if before else 1 :] != back:
                    raise AssertionError(f"the sentencepiece library and the agenda differ on {s[:80]!r}")
        for s, ids, surface in zip(new, found, surfaces, strict=True):
            self.known[s] = np.array(ids, "<u4").tobytes(), surface

    def _check(self, texts: list[str], found: list[tuple[bytes, bytes]]) -> None:
        """Hold whole texts' ids and decoded texts against the library's."""
        theirs = self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        for text, ids, back, (mine, decoded) in zip(texts, theirs, self.library.decode(theirs, num_threads=1), found, strict=True):
            if np.array(ids, "<u4").tobytes() != mine:
                raise AssertionError(f"the sentencepiece library encodes {text[:80]!r} otherwise than the agenda")
            if back.encode() != decoded:
                raise AssertionError(f"the sentencepiece library decodes the ids of {text[:80]!r} otherwise")

    def _cut(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids and surface of texts by the pattern of stretches, the dummy prefix included in both."""
        parts = [self.stretch.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self._learn(self.known.missing(set().union(*parts)))
        out = []
        for p in parts:
            found = list(map(self.known.__getitem__, p))
            out.append((b"".join([f[0] for f in found]), b"".join([f[1] for f in found])))
        return out

    def _runs(self, texts: pa.Array) -> list[tuple[bytes, bytes]]:
        """The same for texts of plain letters and marks, where stretches are runs of bytes with the spaces before them."""
        data, offsets = runs.texts_data(texts, b" ")
        kind = _KIND[data]
        first = np.ones(len(data), bool)
        first[1:] = (kind[1:] == _FEED) | (kind[:-1] == _FEED) | (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
        first[offsets[:-1]] = True
        starts = np.flatnonzero(first)
        codes, stretches = runs.coded(data, starts)
        names = [s.replace(" ", SPACE) for s in stretches.to_pylist()]
        self._learn(self.known.missing(set(names)))
        found, cuts = [self.known[s] for s in names], np.searchsorted(starts, offsets)
        return list(zip(runs.gathered([f[0] for f in found], codes, "<u4", cuts), runs.gathered([f[1] for f in found], codes, "u1", cuts), strict=True))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids with begin and end (little-endian unsigned 32-bit) and the decoded text (UTF-8)."""
        begin, end = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes()
        whole = pa.array(texts, pa.large_string())
        by_runs = np.zeros(len(texts), bool)
        if self.runs:
            data, offsets = runs.texts_data(whole)
            by_runs = runs.only(data, offsets, _PLAIN) & (np.diff(offsets) > 0) & (np.diff(offsets) < LONG)
        found = [(b"", b"")] * len(texts)
        for chosen, how in ((np.flatnonzero(by_runs), lambda at: self._runs(whole.take(pa.array(at)))), (np.flatnonzero(~by_runs), lambda at: self._cut([texts[i] for i in at]))):
            for i, one in zip(chosen.tolist(), how(chosen) if len(chosen) else [], strict=True):
                found[i] = one
        out = [(begin + ids + end, surface[1:].decode("utf-8", "replace").encode()) for ids, surface in found]  # without the dummy prefix
        if self.checked and texts:
            self._check(texts[:1], out[:1])
        return out


@functools.lru_cache(maxsize=2)
def worker_pieces(path: str, checked: bool) -> MergePieces:
    """One vocabulary per worker process, so that what it remembers serves the tasks after."""
    return MergePieces(path, checked)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", checked: bool = True) -> DataFrame:
    """doc_id, ids (array of int), decoded (string) for every row; null texts count as empty.

    ``path`` names the model on the workers. ids hold the begin and end ids; decoded is read back
    from ids. Rows repeat as they do in the input; an empty table gives an empty result; other
    columns are not read. With ``checked`` a difference from the library fails the task.
    """
    return _mapped(docs, path, id_col, text_col, checked, "ids array<int>, decoded string", _lists)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", checked: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 of what ``encoded`` gives."""
    return _mapped(docs, path, id_col, text_col, checked, "n_tokens long, ids_sha256 string, decoded_sha256 string", _hashes)


def _lists(rows: list[tuple[bytes, bytes]]) -> dict[str, pa.Array]:
    ids = [np.frombuffer(i, "<u4").astype(np.int32) for i, _ in rows]
    return {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([d.decode() for _, d in rows], pa.string())}


def _hashes(rows: list[tuple[bytes, bytes]]) -> dict[str, pa.Array]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return {"n_tokens": pa.array([len(i) // 4 for i, _ in rows], pa.int64()), "ids_sha256": pa.array([sha(i) for i, _ in rows], pa.string()), "decoded_sha256": pa.array([sha(d) for _, d in rows], pa.string())}


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, checked: bool, schema: str, columns) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(path, checked)
        for batch in slices(batches, "text"):
            found = columns(pieces.encode(batch.column("text").to_pylist()))
            yield pa.record_batch([batch.column("doc_id"), *found.values()], names=["doc_id", *found])

    return rows.mapInArrow(run, f"doc_id {kind}, {schema}")
