"""Chat formatting: every assistant turn becomes an example of its own, after all preceding turns.

An example is ``<|turn|>role\\ntext<|end|>\\n`` for each turn up to its reply. Inside texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so that markers occur only where the template puts
them; in roles a line feed becomes ``\\n`` as well. Only the reply's text lies under the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
_READ = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)
_ESCAPED = re.compile(r"\\([\\|n])")
#: Characters of examples that a task gathers before it hands on a batch.
BATCH_CHARS = 4 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def read_turns(example: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of an example."""
    return [(unescape(r), unescape(t)) for r, t in _READ.findall(example)]


def _key(conv) -> tuple:
    """What tells conversations apart: NaN is equal to itself, as it is to Spark."""
    return ("nan",) if conv != conv else (conv,)


def _expanded():
    names = ["conv_id", "example", "n_turns", "text", "loss_start", "loss_end"]
    types = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        now, of, prefix, turns, example, open_turns = None, None, "", 0, 0, 0

        def tail() -> None:
            nonlocal chars
            if open_turns:  # turns after the last reply: context only
                out.append((of, example, turns, prefix, None, None))
                chars += len(prefix)

        for batch in batches:
            types[0] = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now != _key(conv):
                    tail()
                    now, of, prefix, turns, example, open_turns = _key(conv), conv, "", 0, 0, 0
                body = escape(text)
                head = f"{prefix}{TURN}{escape_role(role)}\n"
                prefix = f"{head}{body}{END}"
                turns += 1
                open_turns += 1
                if role == "assistant":
                    out.append((conv, example, turns, prefix, len(head), len(head) + len(body)))
                    example, open_turns, chars = example + 1, 0, chars + len(prefix)
                if chars >= BATCH_CHARS or len(out) >= 4096:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, chars = [], 0
        tail()
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def prefix_targets(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, example, n_turns, text, loss_start, loss_end: an example for each assistant turn.

    Turns are taken by turn number (null first), then role and text; repeated turns stay. Null roles
    and texts count as empty; rows with a null conversation id form one conversation. Turns after the
    last reply give one more example without a loss span. Positions count code points, the span holds
    the escaped reply. Rows of a conversation stream through one task in order, so a task holds the
    text of one conversation and a batch, however many turns there are; examples of a conversation
    leave it next to each other, in order. Conversation ids may be of any type that Spark can sort and
    hash. An empty table gives an empty result; other columns are not read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_expanded(), f"conv_id {kind}, example long, n_turns long, text string, loss_start long, loss_end long")


def _read_back():
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of, longest, loss, loss_chars, chars = None, None, "", None, 0, 0

        def digest() -> tuple:
            turns, whole = read_turns(longest), hashlib.sha256()
            for role, text in turns:
                whole.update(f"{role}\n{text}\n".encode())
            return (of, len(turns), whole.hexdigest(), loss_chars, loss.hexdigest(), chars)

        for batch in batches:
            types[0] = batch.schema.field("conv_id").type
            out = []
            for conv, text, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end")), strict=True):
                if now != _key(conv):
                    if now:
                        out.append(digest())
                    now, of, longest, loss, loss_chars, chars = _key(conv), conv, "", hashlib.sha256(), 0, 0
                longest, chars = text, chars + len(text)
                if start is not None:
                    reply = unescape(text[start:end])
                    loss.update(reply.encode())
                    loss_chars += len(reply)
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if now:
            yield pa.record_batch([pa.array([c], t) for c, t in zip(digest(), types, strict=True)], names=names)

    return run


def read_back(examples: DataFrame) -> DataFrame:
    """What ``prefix_targets`` wrote, a row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Takes the operator's result as it is, each conversation's examples next to each other and in
    order. The last example holds all turns; the texts under the loss masks are joined with nothing between.
    """
    kind = examples.schema["conv_id"].dataType.simpleString()
    return examples.mapInArrow(_read_back(), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
