"""Packing token sequences of bounded length by the sum-of-squares rule."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.bpe import encoder, vocabulary_path
from shotweave.llm.dedup_exact import fresh
from shotweave.llm.flat import flat_text, pieces, ramp
from shotweave.llm.registry import query, table
from shotweave.session import cut_lineage

GROUP_PIECES = 8192
SEPARATOR = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every item, items placed in the given order.

    ``open_[g]`` counts the open bins with ``g`` places left. An item goes where the sum of the squared counts becomes smallest;
    of equal choices to the fullest bin, and to a new bin last. Sizes are 1 to ``capacity``.
    """
    open_ = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    number = np.empty(len(sizes), np.int64)
    offset = np.empty(len(sizes), np.int64)
    made = 0
    for i, size in enumerate(sizes.tolist()):
        gaps = open_[size:capacity]
        change = 2 * (open_[:capacity - size] - gaps) + 2
        if len(change):
            change[0] -= 1                                   # the bin closes: no smaller gap takes its place
        change[gaps == 0] = np.iinfo(np.int64).max
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and change[best] < 2 * open_[capacity - size] + 1:
            gap = size + best
            number[i] = bins[gap].pop()
            open_[gap] -= 1
        else:
            gap = capacity
            number[i] = made
            made += 1
        offset[i] = capacity - gap
        if gap > size:
            open_[gap - size] += 1
            bins[gap - size].append(int(number[i]))
    return number, offset


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every item, each placed in the fullest bin that takes it."""
    gaps: list[tuple[int, int]] = []
    number = np.empty(len(sizes), np.int64)
    offset = np.empty(len(sizes), np.int64)
    made = 0
    for i, size in enumerate(sizes.tolist()):
        k = bisect.bisect_left(gaps, (size, -1))
        if k < len(gaps):
            gap, number[i] = gaps.pop(k)
        else:
            gap, number[i] = capacity, made
            made += 1
        offset[i] = capacity - gap
        if gap > size:
            bisect.insort(gaps, (gap - size, int(number[i])))
    return number, offset


def packed(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`sum_of_squares`, and the items of the bins it leaves open packed once more by :func:`best_fit`, if that takes fewer bins.

    The rule keeps many gaps in reserve, which pays while items keep coming and costs whole bins when they end.
    """
    number, offset = sum_of_squares(sizes, capacity)
    if not len(sizes):
        return number, offset
    fill = np.bincount(number, sizes)
    loose = (fill < capacity)[number]
    again, place = best_fit(sizes[loose], capacity)
    names = np.unique(number[loose])                          # bins that are free again
    if len(again) and again.max() + 1 < len(names):
        number[loose], offset[loose] = names[again], place
    return number, offset


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``. A document is its ids and a closing separator; only longer
    ones are cut, into pieces of ``capacity`` ids of which the last may be shorter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = encoder(path)
        for part in pieces(batches, "text"):
            ids, offsets = engine.encode(*flat_text(part, "text"))
            ids = np.insert(ids, offsets[1:], SEPARATOR).astype("<u4")
            offsets = offsets + np.arange(len(offsets))
            size = np.diff(offsets)
            cuts = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), cuts)
            piece = ramp(cuts)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            at = (offsets[:-1][row] + start).tolist()
            crc = [zlib.crc32(ids[a:a + n]) for a, n in zip(at, length.tolist())]
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, PIECES)


def pack(items: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``items`` (with a column ``length`` from 1 to ``capacity``) plus ``sequence_id`` and ``offset``; other columns stay as they are.

    Items that fill a sequence are done without a shuffle. The others are dealt by a hash of their row number into groups of about
    ``group_pieces`` (so no document, however often repeated, and no length can make a group large) and every group is packed in
    one task, longest first, its open sequences packed once more at the end. A group leaves a few sequences partly empty (measured:
    under 0.1 % over the lower bound at 8192 a group), a loss that does not grow with the table.
    """
    row, deal = (fresh(name, items.columns) for name in ("_row", "_group"))
    numbered = items.withColumn(row, F.monotonically_increasing_id())
    whole = numbered.filter(F.col("length") >= capacity).select(
        *items.columns, (-F.col(row) - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    partial = numbered.filter(F.col("length") < capacity)
    groups = max(1, -(-partial.count() // group_pieces))
    kept = [*items.columns, "sequence_id", "offset"]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", row], ascending=[False, True], kind="stable")
        number, offset = packed(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = (frame[deal].to_numpy() << 32) + number
        frame["offset"] = offset
        return frame[kept]

    dealt = partial.withColumn(deal, F.pmod(F.xxhash64(row), F.lit(groups)))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    by_group = dealt.groupBy(deal).applyInPandas(one, f"{out}, sequence_id long, offset long")
    return whole.unionByName(by_group)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Packing plan of all documents: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece.

    A null or empty text is its separator alone (length 1). Rows that repeat an id are packed each. Other columns are ignored, an
    empty table gives an empty plan. Texts never shuffle, only rows of piece lengths do; those are checkpointed
    first, so numbering them gives the same numbers however often a task runs.
    """
    return pack(cut_lineage(token_pieces(docs, path, capacity, id_col, text_col)), capacity)


@query()
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), vocabulary_path("word_bpe_49k.json"))
