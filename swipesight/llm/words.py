"""Words of whole texts as 64-bit hashes, for a batch of documents at a time inside a Spark task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes hashed at once: bounds the working memory of a task (about 45 times this), whatever the length of an Arrow batch.
BLOCK_BYTES = 1 << 19

_RANDOM = np.random.default_rng(20240501)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Flags of the bytes between words, from closed ranges."""
    flags = np.zeros(256, dtype=bool)
    for low, high in ranges:
        flags[low : high + 1] = True
    return flags


# White space 20 and 09-0D; ASCII other than digits and letters.
SPACE = separators((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """`hash` of each word, `first[d] : first[d + 1]` are the words of document d, `start`/`end` lie in `data`."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: bytes

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def _powers(step: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, step, dtype=np.uint64))])


# Powers by place in the block, and those of the inverse, which take a word back to its own first place.
_INVERSE = pow(int(_STEP), -1, 1 << 64)
_POWERS, _BACK = _powers(int(_STEP), 1 << 16), _powers(_INVERSE, 1 << 16)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for a block of n bytes, kept for the next one but for that of a very long text."""
    global _POWERS, _BACK
    if n <= len(_POWERS):
        return _POWERS, _BACK
    room = max(n, min(2 * n, 2 * BLOCK_BYTES))
    grown = _powers(int(_STEP), room), _powers(_INVERSE, room)
    if room <= 2 * BLOCK_BYTES:
        _POWERS, _BACK = grown
    return grown


def words(texts: list[bytes], between: np.ndarray = SPACE) -> Words:
    """Words of the texts with A-Z lower-cased. The separator between texts is a white space."""
    data = (b"\n".join(texts) + b"\n").lower()  # of bytes: A-Z only
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~between[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.insert(edge, 0, 0)
    start, end = edge[0::2], edge[1::2]
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    first = np.searchsorted(start, begins)
    if not len(start):
        return Words(np.zeros(0, np.uint64), first, start, end, data)
    powers, back = _powers_to(len(raw))
    with np.errstate(over="ignore"):
        value = np.where(between, np.uint64(0), _BYTE)[raw]
        value *= powers[: len(raw)]
        total = np.add.reduceat(value, start) * back[start] + (end - start).astype(np.uint64)
    return Words(mix(total), first, start, end, data)


def blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of a batch with their texts (null: empty), each range of about `BLOCK_BYTES`."""
    values = batch.column(column)
    values = values.cast(pa.binary()) if not pa.types.is_binary(values.type) else values
    low, size, texts = 0, 0, []
    for i, value in enumerate(values):
        text = value.as_py() or b""
        if texts and size + len(text) > BLOCK_BYTES:
            yield low, i, texts
            low, size, texts = i, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield low, len(values), texts


def longs(values: np.ndarray) -> pa.Array:
    """Unsigned hashes as signed 64-bit values."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Array column from concatenated values and the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), longs(values))
