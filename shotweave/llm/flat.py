"""Texts of a record batch as one flat byte array, and what several operators compute on it.

Everything here works inside a task on a bounded piece of a record batch. Hashes are 64-bit sums of random byte codes times powers
of an odd number, so the hash of any stretch of the array is one subtraction and one multiplication.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def release() -> None:
    """Give freed memory back to the system. Workers live on from stage to stage, and what their allocators keep adds up beside the
    memory of the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, target: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of about ``target`` text bytes; one longer text is a slice of its own. Memory is given back
    when a batch is done."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        block = np.cumsum(np.asarray(sizes, dtype=np.int64)) // target
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        del batch, sizes, block
        release()


def flat_text(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, one after another, and the row offsets; a null text is empty."""
    values = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_string())
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def byte_codes(seed: int = 0) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(1000 * (seed + 1)))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[0] = np.cumprod(up), np.cumprod(down)
    return have


def prefix_hash(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """``p`` such that :func:`stretch_hash` of any stretch of ``data`` takes two reads of it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes(seed)[data] * powers(len(data) + 1)[0][:len(data)], out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``data[start:end]`` for every pair; equal stretches have equal hashes anywhere."""
    body = (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]
    return mix(body ^ (end - start).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are not blanks, and per row the index of its first run (one more at the end)."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~is_space(data)
    inside = solid[1:-1]
    first = inside & ~solid[:-2]
    last = inside & ~solid[2:]
    rows = offsets[:-1][np.diff(offsets) > 0]
    first[rows] = inside[rows]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, … restarting for every count."""
    total = int(counts.sum())
    heads = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(heads, counts)


def gather(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows ``rows`` of (flat, offsets), one after another, and their lengths."""
    counts = offsets[rows + 1] - offsets[rows]
    return flat[np.repeat(offsets[rows], counts) + ramp(counts)], counts
