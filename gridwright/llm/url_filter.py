"""URL filters: glob rules as a multiword Shift-And automaton that runs all patterns at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict 'allow' or 'block' for a host with its subdomains and a path prefix, as ``host/path``."""

    verdict: str
    rule: str

    def glob(self) -> str:
        """Over '.' + host + path: '*' stands for a run without '/', '**' for any run."""
        return f"*.{self.rule}**"


#: The rules of the registered query.
RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


class ShiftAnd:
    """Bit i of a pattern's field is set while its first i literal bytes are matched.

    A step shifts every field by one under the mask of the byte read; a wildcard keeps its bit in
    place under a second mask. Fields lie side by side in 64-bit words, a shift carries from word to
    word, and one pass over a URL drives all patterns.
    """

    def __init__(self, globs: list[str]):
        starts, self.accept, bits = [], [], 0
        moves, stays = [], []
        for glob in globs:
            raw, i, at = glob.encode(), 0, bits
            starts.append(bits)
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    stays += [(at, c) for c in range(256)]
                    i += 2
                elif raw[i : i + 1] == b"*":
                    stays += [(at, c) for c in range(256) if c != ord("/")]
                    i += 1
                else:
                    at += 1
                    moves.append((at, raw[i]))
                    i += 1
            self.accept.append(at)
            bits = at + 1
        self.words = max(1, -(-bits // 64))
        self.start, self.move, self.stay = np.zeros(self.words, np.uint64), np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        for at in starts:
            self.start[at // 64] |= np.uint64(1 << at % 64)
        for table, marks in ((self.move, moves), (self.stay, stays)):
            for at, c in marks:
                table[c, at // 64] |= np.uint64(1 << at % 64)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix, texts by patterns. Memory: the texts' bytes, once more as a matrix for texts of like length."""
        lengths = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.accept)), bool)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        state, sorted_len = np.repeat(self.start[None], len(texts), 0), lengths[order]
        for i in range(int(sorted_len[0]) if len(texts) else 0):
            n = int(np.searchsorted(-sorted_len, -i, "left"))  # texts longer than i
            c, s = flat[begin[:n] + i], state[:n]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.move[c]) | (s & self.stay[c])
        for k, at in enumerate(self.accept):
            out[order, k] = (state[:, at // 64] >> np.uint64(at % 64) & np.uint64(1)).astype(bool)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path from there up to '?' or '#'. Both empty without '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest that
    fits wins (equally long: the one listed first). Without one, rule is null and the verdict is
    ``default``. A null URL or one without '://' has an empty host and path. Rows repeat as they do
    in the input; an empty table gives an empty result; other columns are not read.
    """
    ranked = sorted(rules, key=lambda r: -len(r.rule))
    automaton = ShiftAnd([r.glob() for r in ranked])
    names = np.array([*(r.rule for r in ranked), None], object)
    verdicts = np.array([*(r.verdict for r in ranked), default], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                hits = automaton.matches([f".{h}{p}".encode() for h, p in zip(part.column("host").to_pylist(), part.column("path").to_pylist(), strict=True)])
                best = np.where(hits.any(1), hits.argmax(1), len(ranked)) if len(ranked) else np.zeros(part.num_rows, np.int64)
                yield pa.record_batch([*part.columns, pa.array(names[best], pa.string()), pa.array(verdicts[best], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def allowed_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` that the rules allow, with all their columns."""
    automaton_rules = sorted(rules, key=lambda r: -len(r.rule))
    automaton = ShiftAnd([r.glob() for r in automaton_rules])
    allow = np.array([*(r.verdict == "allow" for r in automaton_rules), True])

    @F.pandas_udf("boolean")
    def passes(host: pd.Series, path: pd.Series) -> pd.Series:
        hits = automaton.matches([f".{h}{p}".encode() for h, p in zip(host, path, strict=True)])
        return pd.Series(allow[np.where(hits.any(1), hits.argmax(1), len(automaton_rules))] if len(automaton_rules) else np.ones(len(host), bool))

    return pages.where(passes(*host_and_path(F.col(url_col))))
