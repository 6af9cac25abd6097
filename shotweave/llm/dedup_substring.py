"""Removal of repeated byte strings by bucket-pointer refinement.

A suffix is pointed to by the bucket of its first q bytes. Buckets are refined by the identifiers of what stands at later offsets, in
three rounds that only pass on what the round before left undecided:

1. q-gram buckets (q = 40). Not every suffix needs an entry: a string of 100 bytes contains 61 q-grams, and the one with the smallest
   identifier (the leftmost of equals) is found at the same place in every copy of the string. These anchors are about one
   position in 31. Anchors alone in their bucket are out.
2. The anchors of a bucket are told apart by the identifier of the whole stretch their strings cover, from the first byte of the
   first to the last byte of the last. An anchor whose stretch occurs earlier has all its strings repeated; that is settled for
   up to 61 strings at once, and a repeated text needs no further round.
3. What is left are first stretches in buckets with several. Their strings are cut into blocks of up to eight neighbours, at fixed
   distances from the anchor, and blocks are refined by the identifier of the bytes all strings of the block share; blocks alone
   with theirs are out. The rest is refined down to the identifiers of the single strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.dedup_exact import split_by_ids
from shotweave.llm.flat import flat_text, mix, pieces, prefix_hash, ramp, stretch_hash
from shotweave.llm.registry import query, table
from shotweave.llm.scratch import Scratch
from shotweave.llm.skew import join_groups

WIDTH = 100
QGRAM = 40
BLOCK = 8


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, q: int = QGRAM) -> dict[str, np.ndarray]:
    """Anchors of all strings of ``width`` bytes within a row: ``row, at`` (position of the anchor in the row), ``lo`` and ``n``
    (first string start and number of strings), ``bucket`` and ``stretch`` identifiers."""
    n = len(data)
    if n < width:
        none = np.zeros(0, np.int64)
        return {k: none for k in ("row", "at", "lo", "n", "bucket", "stretch")}
    prefix = prefix_hash(data)
    grams = np.arange(n - q + 1)
    ident = stretch_hash(prefix, grams, grams + q)
    low = (ident >> np.uint64(32) << np.uint64(32)) | grams.astype(np.uint64)
    window, step = width - q + 1, 1
    while step * 2 <= window:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < window:
        low = np.minimum(low[:len(low) - (window - step)], low[window - step:])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(row[:n - width + 1] == row[width - 1:])
    if not len(start):
        return anchors(data[:0], np.zeros(1, np.int64), width, q)
    at = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.r_[True, (at[1:] != at[:-1]) | (row[start[1:]] != row[start[:-1]])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(start)])
    lo, at = start[first], at[first]
    base = offsets[row[lo]]
    return {"row": row[lo], "at": at - base, "lo": lo - base, "n": count, "bucket": ident[at].view(np.int64),
            "stretch": stretch_hash(prefix, lo, lo + count - 1 + width).view(np.int64)}


def anchor_table(docs: DataFrame, width: int, only_buckets: bool) -> DataFrame:
    """Anchors of all rows of ``docs(doc_id, text)``, or their bucket identifiers alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            a = anchors(*flat_text(piece, "text"), width)
            if only_buckets:
                yield pa.RecordBatch.from_arrays([pa.array(a["bucket"])], names=["bucket"])
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(a["bucket"]), pa.array(a["stretch"]), piece.column(0).take(pa.array(a["row"])),
                 *(pa.array(a[k].astype(np.int32)) for k in ("lo", "n", "at"))],
                names=["bucket", "stretch", "doc_id", "lo", "n", "at"])

    schema = "bucket long" if only_buckets else "bucket long, stretch long, doc_id long, lo int, n int, at int"
    return docs.mapInArrow(run, schema)


def blocks_of(docs: DataFrame, width: int) -> DataFrame:
    """Blocks of the open anchors of ``docs(doc_id, text, open)``: ``shared`` identifies the bytes that all strings of a block have
    in common and its distance from the anchor; ``strings`` are the identifiers of its strings, which start at ``lo``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            data, offsets = flat_text(piece, "text")
            prefix = prefix_hash(data)
            lists = piece.column(2)
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            items = lists.flatten()
            row = np.repeat(np.arange(piece.num_rows), np.asarray(lists.value_lengths()))
            lo, n, at = (items.field(k).to_numpy() + 0 * row for k in range(3))
            far = at - lo                                   # distance of the anchor from the first string, then falling
            first, last = far // BLOCK, (far - n + 1) // BLOCK
            per = first - last + 1
            row, lo, n, at, first = (np.repeat(x, per) for x in (row, lo, n, at, first))
            number = first - ramp(per)
            begin = np.maximum(lo, at - (number * BLOCK + BLOCK - 1))
            end = np.minimum(lo + n - 1, at - number * BLOCK)
            base = offsets[row]
            shared = stretch_hash(prefix, base + at - number * BLOCK, base + at - number * BLOCK - BLOCK + 1 + width)
            shared = mix(shared + number.astype(np.uint64))
            count = end - begin + 1
            start = np.repeat(base + begin, count) + ramp(count)
            strings = stretch_hash(prefix, start, start + width)
            yield pa.RecordBatch.from_arrays([
                pa.array(shared.view(np.int64)), piece.column(0).take(pa.array(row)), pa.array(begin.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(strings.view(np.int64))),
            ], names=["shared", "doc_id", "lo", "strings"])

    return docs.mapInArrow(run, "shared long, doc_id long, lo int, strings array<long>")


def later_copies(items: DataFrame, key: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """For ``items(key, doc_id, lo, …)``: the table of first occurrences (smallest document, then start) with the size of each
    group, and the items that are not first. Groups are pre-aggregated, hot ones joined by broadcast."""
    others = [c for c in items.columns if c not in (key, "doc_id", "lo")]
    firsts = scratch.write(items.groupBy(key).agg(F.min(F.struct("doc_id", "lo", *others)).alias("f"),
                                                  F.count(F.lit(1)).alias("size")))
    groups = firsts.filter("size > 1").select(key, "size", F.col("f.doc_id").alias("first_doc"), F.col("f.lo").alias("first_lo"))
    joined = join_groups(items, groups, [key], "size").filter("size is not null")
    return firsts, joined.filter("not (doc_id <=> first_doc and lo = first_lo)").select(items.columns)


def repeated_strings(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, copy, spans``: documents with repeated strings. ``copy`` marks exact copies of an earlier document, all of whose
    strings are repeated; for others ``spans`` lists (first start, number of starts) of their repeated strings."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digests = scratch.write(source.select("doc_id", F.sha2("text", 256).alias("digest")))
    classes = scratch.write(digests.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
                            .filter("size > 1"))
    copies = scratch.write(join_groups(digests, classes, ["digest"], "size").filter("rep is not null and doc_id != rep")
                           .select("doc_id"))
    scratch.drop(digests, classes)
    maybe, never = split_by_ids(source, copies)
    distinct = never.unionByName(scratch.write(maybe.join(copies, "doc_id", "left_anti")))

    buckets = scratch.write(anchor_table(distinct, width, True).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
                            .filter("n > 1").select("bucket"))
    items, _ = split_by_ids(anchor_table(distinct, width, False), buckets, "bucket")
    items = scratch.write(items)
    scratch.drop(buckets)

    firsts, repeats = later_copies(items, "stretch", scratch)
    marks = [scratch.write(repeats.select("doc_id", "lo", "n"))]
    scratch.drop(items)
    firsts = firsts.select("stretch", "f.*")
    several = scratch.write(firsts.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    undecided = join_groups(firsts, several, ["bucket"], "size").filter("size is not null").groupBy("doc_id").agg(
        F.collect_list(F.struct("lo", "n", "at")).alias("open"))
    undecided = scratch.write(undecided)

    maybe, _ = split_by_ids(distinct, undecided.select("doc_id"))
    blocks = scratch.write(blocks_of(maybe.join(undecided, "doc_id").select("doc_id", "text", "open"), width))
    scratch.drop(undecided, several)
    alike = scratch.write(blocks.groupBy("shared").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    strings = scratch.write(join_groups(blocks, alike, ["shared"], "size").filter("size is not null").select(
        "doc_id", F.col("lo").alias("_lo"), F.posexplode("strings").alias("k", "string")).select(
        "string", "doc_id", (F.col("_lo") + F.col("k")).alias("lo")))
    scratch.drop(blocks, alike)
    _, repeats = later_copies(strings, "string", scratch)
    marks.append(scratch.write(repeats.select("doc_id", "lo", F.lit(1).alias("n"))))
    scratch.drop(strings)
    spans = marks[0].unionByName(marks[1]).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    return scratch.write(spans.select("doc_id", F.lit(False).alias("copy"), "spans").unionByName(
        copies.select("doc_id", F.lit(True).alias("copy"), F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))))


def kept_runs(size: int, copy: bool | None, lo: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Flags of the bytes of one text that stay."""
    if copy:
        return np.full(size, size < width)
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, lo + n - 1 + width, -1)
    return np.cumsum(change[:size]) == 0


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (remaining bytes) for every row.

    A byte goes if a string of ``width`` bytes over it also starts earlier: in a document of smaller id, or earlier in the same
    one. Strings never cross documents and are judged on the input. Null texts are empty; texts under ``width`` bytes
    lose nothing. Rows repeating an id are taken as one document. Other columns are ignored; an empty table gives an empty result.
    Only texts with something to remove, or in a later round something undecided, are shuffled.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tags = repeated_strings(docs, width, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            lists = batch.column(3)
            items = lists.flatten()
            cuts = np.r_[0, np.cumsum(np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), float)))].astype(int)
            lo, n = (items.field(k).to_numpy() for k in range(2))
            out = []
            for k, (text, copy) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                raw = np.frombuffer(text.encode("utf-8"), np.uint8)
                keep = kept_runs(len(raw), copy, lo[cuts[k]:cuts[k + 1]], n[cuts[k]:cuts[k + 1]], width)
                kept = raw[keep].tobytes()
                gone = ~keep
                runs = int(gone[:1].sum() + (gone[1:] & keep[:-1]).sum())
                out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()),
                pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    maybe, never = split_by_ids(source, tags.select("doc_id"))
    some = maybe.join(tags, "doc_id", "left").mapInArrow(run, schema)
    zero = F.lit(0).cast("long")
    return some.unionByName(never.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept")))


@query()
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).drop("kept")
