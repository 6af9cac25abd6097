"""Runs of bytes in flat texts, tables of hashed words, and lists of numbers as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from shotweave.llm.flat import prefix_hash, release, stretch_hash


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of flagged bytes; runs do not cross rows."""
    solid = np.zeros(len(inside) + 2, bool)
    solid[1:-1] = inside
    first, last = inside & ~solid[:-2], inside & ~solid[2:]
    some = np.diff(offsets) > 0
    first[offsets[:-1][some]] = inside[offsets[:-1][some]]
    last[offsets[1:][some] - 1] = inside[offsets[1:][some] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def two_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every stretch; equal stretches have equal ones wherever they lie."""
    return tuple(stretch_hash(prefix_hash(data, 2 * seed + k), start, end) for k in range(2))


class WordTable:
    """Numbers of known words, found by one hash and confirmed by the other. ``hashes`` is a function from a seed to the two hashes of
    all words; the first seed under which the first hash tells all words apart is used."""

    def __init__(self, hashes, numbers: np.ndarray):
        for self.seed in range(16):
            h, v = hashes(self.seed)
            order = np.argsort(h, kind="stable")
            if len(h) < 2 or (np.diff(h[order]) != 0).all():
                break
        else:
            raise ValueError("words repeat")
        self.h, self.v, self.numbers = h[order], v[order], numbers[order]

    def find(self, h: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Number of every word, 0 for unknown ones."""
        if not len(self.h):
            return np.zeros(len(h), self.numbers.dtype)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where((self.h[at] == h) & (self.v[at] == v), self.numbers[at], 0)


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column without nulls, one after another, and the row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


class Tally:
    """Counts by key, summed over the batches of a task; ``full`` tells when the table should be emitted to bound its memory."""

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.parts, self.size = limit, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > self.limit:
            self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([k for k, _ in self.parts])
        keys, inverse = np.unique(keys, return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, inverse, np.concatenate([c for _, c in self.parts]))
        self.parts, self.size = [(keys, counts)], len(keys)

    @property
    def full(self) -> bool:
        return self.size > self.limit // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """The sums so far; the table is empty afterwards."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._merge()
        (out,) = self.parts
        self.parts, self.size = [], 0
        release()
        return out


def list_chunks(batches: Iterator[pa.RecordBatch], column: int, target: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`flat_lists` of slices of about ``target`` numbers; one longer list is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = np.cumsum(np.asarray(batch.column(column).value_lengths(), np.int64)) // target
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield flat_lists(batch.column(column).slice(a, b - a))
