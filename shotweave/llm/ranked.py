"""Ranked lexical search: documents that look alike to the items are scored once."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotweave.llm.flat import flat_text, lower_ascii, pieces
from shotweave.llm.registry import query, table
from shotweave.llm.scratch import Scratch
from shotweave.llm.spans import WordTable, flat_lists, runs_of, two_hashes

TOP = 20
PASS_BYTES = 8 << 20
ITEM_BLOCK = 64
CLASS_ROWS = 1024
LAST_ID = (1 << 63) - 1
SAFE = 1 << 53


def term_bytes() -> np.ndarray:
    """Flags of the bytes that terms are made of: letters and digits of ASCII, and everything beyond ASCII."""
    flags = np.zeros(256, bool)
    flags[128:] = True
    for a, b in ("09", "AZ", "az"):
        flags[ord(a):ord(b) + 1] = True
    return flags


def terms(data: np.ndarray, offsets: np.ndarray, seed: int = 0):
    """Two hashes and the row of every term, and the lower-cased bytes with the places of the terms."""
    data = lower_ascii(data)
    start, end, row = runs_of(term_bytes()[data], offsets)
    return *two_hashes(data, start, end, seed), row, (data, start, end)


@dataclass
class Items:
    """Queries of one pass: ids, the distinct terms of all of them, and per item (term, times)."""

    ids: list
    vocabulary: list[bytes]
    counts: list[list[tuple[int, int]]]

    @classmethod
    def of(cls, rows) -> Items:
        numbers: dict[bytes, int] = {}
        ids, counts = [], []
        for item_id, text in rows:
            data, start, end = terms(*flat_text(pa.record_batch({"t": pa.array([text], pa.string())}), "t"))[3]
            raw = data.tobytes()
            found = Counter(raw[a:b] for a, b in zip(start.tolist(), end.tolist()))
            if found:
                ids.append(item_id)
                counts.append([(numbers.setdefault(t, len(numbers)), n) for t, n in found.items()])
        return cls(ids, list(numbers), counts)

    def table(self) -> WordTable:
        data = np.frombuffer(b"".join(self.vocabulary), np.uint8)
        ends = np.cumsum([0, *map(len, self.vocabulary)])
        return WordTable(lambda seed: two_hashes(data, ends[:-1], ends[1:], seed), np.arange(1, len(self.vocabulary) + 1))


def term_bags(docs: DataFrame, words: WordTable) -> DataFrame:
    """``doc_id, n, bag``: the number of terms of every row of ``docs(doc_id, text)``, and its known terms with their counts, as an
    array of ``term, tf, term, tf, …`` by ascending term."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = known.value
        for piece in pieces(batches, "text"):
            h, v, row, _ = terms(*flat_text(piece, "text"), find.seed)
            number = find.find(h, v)
            hit = number > 0
            codes, tf = np.unique(row[hit] << 32 | number[hit] - 1, return_counts=True)
            bag = np.stack([codes & 0xFFFFFFFF, tf], axis=1).ravel().astype(np.int32)
            offsets = 2 * np.searchsorted(codes >> 32, np.arange(piece.num_rows + 1))
            yield pa.RecordBatch.from_arrays([
                piece.column(0), pa.array(np.bincount(row, minlength=piece.num_rows)),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bag))], names=["doc_id", "n", "bag"])

    return docs.mapInArrow(run, "doc_id long, n long, bag array<int>")


def bag_classes(bags: DataFrame, documents: int, length: int, top: int) -> DataFrame:
    """``bag, m, members``: documents with the same counts of known terms and the same ``m`` are one class, verified on the whole bag
    and keyed by its hash; of a class only the ``top`` smallest ids can be ranked, and a row-number limit before the shuffle
    keeps just those."""
    m = F.expr(f"75 + (25 * n * {documents}L) div {max(1, length)}L")
    keyed = bags.filter(F.size("bag") > 0).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "bag", m.alias("m"))
    keyed = keyed.withColumn("h", F.xxhash64("bag", "m"))
    key = ["h", "m", "bag"]
    first = keyed.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id"))).filter(F.col("at") <= top)
    return first.groupBy(*key).agg(F.array_sort(F.collect_list("doc_id")).alias("members")).drop("h")


def best_documents(classes: DataFrame, items: Items, weights: np.ndarray, top: int) -> DataFrame:
    """``item_id, doc_id, score``: the ``top`` rows every task finds for every item.

    Scores of a batch of classes are one matrix product for each block of items: impacts of the block's terms times their counts in
    the items. Products are exact in doubles below 2^53; a block with an item that could reach that is multiplied in 64-bit integers.
    """
    shared = classes.sparkSession.sparkContext.broadcast((items.counts, weights))

    def first(item, score, doc):
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        keep = np.arange(len(item)) - np.searchsorted(item, item) < top
        return item[keep], score[keep], doc[keep]

    def blocks(counts, weights):
        for low in range(0, len(counts), ITEM_BLOCK):
            part = counts[low:low + ITEM_BLOCK]
            term = np.array([t for c in part for t, _ in c])
            times = np.array([n for c in part for _, n in c])
            item = np.repeat(np.arange(len(part)), [len(c) for c in part])
            used, column = np.unique(term, return_inverse=True)
            bound = np.bincount(item, times * weights[term].astype(np.float64) * 1e6)
            kind = np.float64 if bound.max() < SAFE else np.int64
            matrix = np.zeros((len(used), len(part)), kind)
            matrix[column, item] = times
            yield low, used, matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights = shared.value
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        local = np.full(len(weights), -1)
        for batch in batches:
            for a in range(0, batch.num_rows, CLASS_ROWS):
                part = batch.slice(a, CLASS_ROWS)
                bag, ends = flat_lists(part.column("bag"))
                term, tf = bag[::2].astype(np.int64), bag[1::2].astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(ends) // 2)
                m = part.column("m").to_numpy()
                impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
                members, starts = flat_lists(part.column("members"))
                hits = [best]
                for low, used, matrix in blocks(counts, weights):
                    local[used] = np.arange(len(used))
                    at = local[term]
                    local[used] = -1
                    mine = at >= 0
                    values = np.zeros((part.num_rows, len(used)), matrix.dtype)
                    values[row[mine], at[mine]] = impact[mine]
                    scores = values @ matrix
                    floor = np.partition(scores, -top, axis=0)[-top] if len(scores) > top else np.zeros(scores.shape[1])
                    r, i = np.nonzero((scores > 0) & (scores >= floor))
                    # A class that is not among the first by (score, smallest member) has no member to add.
                    i, score, r = first_classes(i, scores[r, i].astype(np.int64), r, members[starts[:-1]])
                    times = starts[r + 1] - starts[r]
                    take = np.repeat(starts[r] - np.cumsum(times) + times, times) + np.arange(times.sum())
                    hits.append((np.repeat(i, times) + low, np.repeat(score, times), members[take]))
                best = first(*(np.concatenate(c) for c in zip(*hits)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in best], names=["item", "score", "doc_id"])

    def first_classes(item, score, row, smallest):
        order = np.lexsort((smallest[row], -score, item))
        item, score, row = item[order], score[order], row[order]
        keep = np.arange(len(item)) - np.searchsorted(item, item) < top
        return item[keep], score[keep], row[keep]

    found = classes.mapInArrow(run, "item long, score long, doc_id long")
    ids = F.array(*[F.lit(i).cast("long") for i in items.ids]) if len(items.ids) <= 1000 else None
    if ids is not None:
        return found.select(F.element_at(ids, (F.col("item") + 1).cast("int")).alias("item_id"), "doc_id", "score")
    names = classes.sparkSession.createDataFrame(list(enumerate(items.ids)), "item long, item_id long")
    return found.join(names, "item").select("item_id", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best rows of ``docs`` for every item, equal scores by ascending id.

    Documents are cut to the terms of the items, rows with the same counts of these terms and the same length measure form a class,
    classes are scored once, and members expand by ascending id. Each task keeps ``top`` rows an item. The items' terms go to
    every task, ``pass_bytes`` of item texts at a time: a larger item table takes several passes over the documents.

    Null texts have no terms; such documents and items have no rows in the result. Of items repeating an id the smallest text
    counts, null item ids count as an item. Documents repeating an id are ranked one by one; a null id follows all others. Other
    columns are ignored; empty tables give an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    asked = scratch.write(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
                          .groupBy("item_id").agg(F.min("text").alias("text")).filter("text IS NOT NULL"))
    size = asked.agg(F.sum(F.octet_length("text") + F.lit(8))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = []
    for number in range(passes):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number).orderBy("item_id").collect()
        part = Items.of([(r["item_id"], r["text"]) for r in rows])
        if not part.ids:
            continue
        bags = scratch.write(term_bags(source, part.table()))
        documents, length = bags.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        held = np.zeros(len(part.vocabulary), np.int64)
        in_bag = F.explode(F.filter("bag", lambda x, i: i % 2 == 0)).alias("term")
        for r in bags.select(in_bag).groupBy("term").count().collect():
            held[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
        classes = bag_classes(bags, documents, length or 0, top)
        found.append(scratch.write(best_documents(classes, part, weights, top)))
        scratch.drop(bags)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "item_id", "rank", F.nullif("doc_id", F.lit(LAST_ID)).alias("doc_id"), "score")


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '{TERM}')) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, unnest(regexp_extract_all({LOWER.format("text")}, '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
k AS (SELECT count(*) AS docs, sum(n) AS len FROM n),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, k GROUP BY term),
m AS (SELECT doc_id, 75 + (25 * n * docs) // len AS m FROM n, k),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 20""")
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
