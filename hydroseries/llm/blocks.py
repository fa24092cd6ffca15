"""Whole texts of Arrow batches as flat byte arrays, so that work inside a task is vectorised."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

#: Odd multipliers of the hash functions below.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text",
                block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a few megabytes of text at a time: (rows, UTF-8 bytes, offsets). A null text is empty; a longer text is a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_string())
        _, places, raw = text.buffers()
        offsets = np.frombuffer(places, np.int64, len(text) + 1, text.offset * 8)
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        start = 0
        while start < len(text):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + block_bytes, "right")) - 1)
            here = offsets[start:stop + 1]
            yield batch.slice(start, stop - start), data[here[0]:here[-1]], here - here[0]
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MULTIPLIERS[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MULTIPLIERS[2])
    return x ^ (x >> np.uint64(31))


def word_runs(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of maximal runs of word bytes; a run never crosses from one text into the next."""
    inside = word_byte[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs: a polynomial of the bytes, mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    at = np.zeros(len(length), np.int64)
    np.cumsum(length[:-1], out=at[1:])
    within = np.arange(int(length.sum())) - np.repeat(at, length)
    power = np.full(int(length.max()), MULTIPLIERS[0], np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    value = (data[within + np.repeat(starts, length)].astype(np.uint64) + np.uint64(1)) * power[within]
    return mix(np.add.reduceat(value, at) + length.astype(np.uint64) * np.uint64(MULTIPLIERS[1]))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags: True outside the given inclusive ranges."""
    out = np.ones(256, bool)
    for low, high in ranges:
        out[low:high + 1] = False
    return out


#: Bytes of words [^\x20\x09-\x0D]+.
NOT_SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
