"""Texts cut into runs of bytes, and what belongs to each run put together again, in a few vector operations a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Two-byte letters of Latin-1 begin with this byte; of these, two are signs (fixed values of UTF-8).
LATIN, SIGNS = 0xC3, (0x97, 0xB7)


def texts_data(texts: pa.Array, before: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, ``before`` in front of each, and where each starts (and the last ends)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not before:
        return data, offsets
    out = np.empty(len(data) + len(before) * len(texts), np.uint8)
    place = np.arange(len(data))
    place += len(before) * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    out[place] = data
    starts = offsets + len(before) * np.arange(len(offsets))
    for i, b in enumerate(before):
        out[starts[:-1] + i] = b
    return out, starts


def only(data: np.ndarray, offsets: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Whether each text holds nothing but allowed single bytes (a table of 256) and the letters of Latin-1."""
    bad = ~allowed[data]
    lead = np.flatnonzero(data == LATIN)
    good = lead[~np.isin(data[lead + 1], SIGNS)]
    bad[good] = bad[good + 1] = False
    wrong = np.flatnonzero(bad)
    return np.searchsorted(wrong, offsets[1:]) == np.searchsorted(wrong, offsets[:-1])


def first_bytes(texts: pa.Array) -> np.ndarray:
    """The first byte of each of ``texts``, large strings of which none is empty."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts)]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets] if len(texts) else np.zeros(0, np.uint8)


def coded(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code of each run, the distinct runs) of runs that begin at ``starts``, the first at 0, and cover the data."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    offsets = np.append(starts, len(data)).astype(np.int64)
    runs = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    found = runs.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def gathered(values: list[bytes], codes: np.ndarray, kind: str, cuts: np.ndarray) -> list[bytes]:
    """The values of runs ``cuts[i]`` to ``cuts[i + 1]`` joined, for each i; values hold whole items of a NumPy ``kind``."""
    flat = np.frombuffer(b"".join(values), kind)
    size = np.fromiter(map(len, values), np.int64, len(values)) // flat.itemsize
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    n = size[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(ends[-1])
    place += np.repeat(first[codes] - ends[:-1], n)
    raw, at = flat[place].tobytes(), ends[cuts] * flat.itemsize
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
