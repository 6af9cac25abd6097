"""Near-duplicate components of documents: MinHash signatures, a multi-index join over chunks with errors, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotweave.llm.dedup_exact import split_by_ids, without
from shotweave.llm.flat import flat_text, lower_ascii, mix, pieces, prefix_hash, stretch_hash, words_of
from shotweave.llm.registry import query, table
from shotweave.llm.skew import afresh, connected_components, join_groups
from shotweave.session import cut_lineage

SHINGLE = 5
CHUNKS = 10
CHUNK_SYMBOLS = 5
CHUNK_ERRORS = 1
PAIRS_PER_TASK_KEY = 500
SKETCH_SYMBOLS = 64
SKETCH_DISTANCE = 32
PARITY_BITS = 1024
CROWD = 64


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted within the row, and the row offsets. A row with fewer words has one shingle,
    its whole sequence; a row without words has none."""
    data = lower_ascii(data)
    start, end, rows = words_of(data, offsets)
    word = stretch_hash(prefix_hash(data), start, end)
    n = len(word)
    counts = np.diff(rows)
    row = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(rows[1:], counts) - np.arange(n)          # words from here to the end of the row
    total = np.zeros(n, np.uint64)
    for j in range(width):
        part = np.zeros(n, np.uint64)
        part[:n - j] = word[j:] * np.uint64(0x9E3779B97F4A7C15 + 2 * j * 0x1000193)
        total += np.where(left > j, part, 0)
    short = np.repeat(np.minimum(counts, width), counts)
    first = np.arange(n) == np.repeat(rows[:-1], counts)
    ok = (left >= width) | (first & (short < width))
    values, row = mix(total[ok] ^ short[ok].astype(np.uint64)), row[ok]
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[new], row[new]
    return values, np.searchsorted(row, np.arange(len(counts) + 1))


def segment_reduce(op: np.ufunc, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``op`` over every row; rows without values give 0."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = op.reduceat(values, offsets[full])
    return out


def signature_keys(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of every row, one column per (chunk, set of ignored symbols), and the whole signature at four bits a symbol.

    A signature has ``CHUNKS * CHUNK_SYMBOLS`` MinHash values of 16 bits. Two signatures that differ in fewer than
    ``CHUNKS * (CHUNK_ERRORS + 1)`` of them have, by the pigeonhole principle, a chunk with at most ``CHUNK_ERRORS`` differences;
    that chunk agrees once these positions are left out, so leaving out every choice of positions finds the pair.
    """
    random = np.random.default_rng(7)
    a = random.integers(0, 1 << 63, SKETCH_SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = random.integers(0, 1 << 63, SKETCH_SYMBOLS, dtype=np.uint64)
    symbols = [(segment_reduce(np.minimum, (values ^ y) * x, offsets) >> np.uint64(40)) & np.uint64(0xFFFF)
               for x, y in zip(a, b)]
    keys = []
    for c in range(CHUNKS):
        chunk = symbols[c * CHUNK_SYMBOLS:(c + 1) * CHUNK_SYMBOLS]
        for skipped in combinations(range(CHUNK_SYMBOLS), CHUNK_ERRORS):
            packed = np.zeros(len(offsets) - 1, np.uint64)
            for j in range(CHUNK_SYMBOLS):
                if j not in skipped:
                    packed = packed << np.uint64(16) | chunk[j]
            keys.append(mix(packed + np.uint64((len(keys) + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
    sketch = []
    for w in range(0, SKETCH_SYMBOLS, 16):
        word = np.zeros(len(offsets) - 1, np.uint64)
        for symbol in symbols[w:w + 16]:
            word = word << np.uint64(4) | symbol & np.uint64(15)
        sketch.append(word)
    return np.stack(keys, 1), np.stack(sketch, 1)


def parity_sketch(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row ``PARITY_BITS`` bits as longs: whether an odd number of its shingles fall on a bit. The bits in which two rows differ
    are those of their symmetric difference, so there are never more of them than shingles in it."""
    rows = len(offsets) - 1
    at = np.repeat(np.arange(rows), np.diff(offsets)) * PARITY_BITS + (values & np.uint64(PARITY_BITS - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=rows * PARITY_BITS).reshape(rows, PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def parity_distance(x: str, y: str) -> Column:
    words = [F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(PARITY_BITS // 64)]
    return sum(words[1:], words[0])


def sketch_distance(x: str, y: str) -> Column:
    """Number of symbols in which two sketches (arrays of longs) differ."""
    total = F.lit(0)
    ones = F.lit(0x1111111111111111)
    for k in range(SKETCH_SYMBOLS // 16):
        d = F.col(x)[k].bitwiseXOR(F.col(y)[k])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        total = total + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(ones))
    return total


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, h1, h2, keys, sketch, parity``: set size, 128-bit digest of the set, index keys (none for an empty set),
    the signature and the parity sketch."""
    def longs(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            values, offsets = shingles(*flat_text(piece, "text"))
            n = np.diff(offsets)
            h1 = segment_reduce(np.add, mix(values + np.uint64(11)), offsets)
            h2 = segment_reduce(np.add, mix(values + np.uint64(12)) >> np.uint64(1), offsets)
            keys, sketch = signature_keys(values, offsets)
            lists = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(np.where(n > 0, keys.shape[1], 0))], pa.int32()),
                pa.array(keys[n > 0].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(h1.view(np.int64)),
                                              pa.array(h2.view(np.int64)), lists,
                                              longs(sketch.view(np.int64)), longs(parity_sketch(values, offsets))],
                                             names=["doc_id", "n_shingles", "h1", "h2", "keys", "sketch", "parity"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, "
                                "sketch array<long>, parity array<long>")


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, shingles array<long>`` of the given rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            values, offsets = shingles(*flat_text(piece, "text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=["doc_id", "shingles"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets have 100 * intersection >= percent * union.

    ``a`` may be the same document for many pairs: such documents are counted, the hot ones (at most 1000) get one copy of
    their set per ``PAIRS_PER_TASK_KEY`` pairs, and their pairs are dealt over the copies.
    """
    degree = (pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PAIRS_PER_TASK_KEY)
              .orderBy(F.desc("n"), "a").limit(1000)
              .select("a", F.ceil(F.col("n") / PAIRS_PER_TASK_KEY).cast("int").alias("copies")))
    salted = pairs.join(F.broadcast(degree), "a", "left").select(
        "a", "b", F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("copies"))).cast("int").alias("s"))
    copies = sets.join(F.broadcast(degree), sets["doc_id"] == degree["a"], "left").select(
        F.col("doc_id").alias("a"), F.col("shingles").alias("x"),
        F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("s"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = salted.join(right, "b").join(copies, ["a", "s"])
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("n"), (F.size("x") + F.size("y") - shared).alias("u")).filter(
        F.lit(100) * F.col("n") >= F.lit(percent) * F.col("u")).select("a", "b")


def near_components(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    1. One pass gives set digests and index keys. Documents with equal sets form classes; the smallest id stands for a class.
    2. Index keys that several representatives share are buckets. Each bucket links its members to its smallest one only. The
       distinct pairs are confirmed on the full sets and joined into components: in a bucket whose members now all lie
       in one component no further pair can change the result.
    3. In the other buckets every pair from different components whose signatures are near enough is confirmed too, so no
       candidate of the index is lost, and components are joined again. Crowded buckets are replaced by lists of rare shingles, which
       hold all pairs that can be near.

    A pair at similarity 0.75 is missed by all chunks with probability (1 - 0.633)^10, under 5 in 100 000, and less the more
    alike the texts are. Null and empty texts have no shingles and stand alone. Rows repeating an id share a component if
    their texts are linked. Other columns are ignored; an empty table gives an empty result.
    """
    rows = cut_lineage(signatures(docs, id_col, text_col))
    narrow = rows.select("doc_id", "n_shingles", "h1", "h2")
    classes = cut_lineage(narrow.filter("n_shingles > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    member = join_groups(narrow, classes, ["h1", "h2"], "size")
    extra = member.filter("rep is not null and doc_id != rep").select("doc_id")
    keyed = without(rows.select("doc_id", "keys"), extra).select("doc_id", F.explode("keys").alias("key"))
    buckets = cut_lineage(keyed.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("size"))
                          .filter("size > 1"))
    placed = cut_lineage(join_groups(keyed, buckets, ["key"], "size").filter("size is not null")
                         .select("key", "doc_id", "pivot"))
    stars = cut_lineage(placed.filter("doc_id != pivot").groupBy(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).agg(
        F.count(F.lit(1)).alias("n")).select("a", "b"))
    wanted = placed.select("doc_id").distinct()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    maybe, _ = split_by_ids(source, wanted)
    sets = cut_lineage(shingle_sets(maybe).join(wanted, "doc_id", "left_semi"))
    links = cut_lineage(confirmed(stars, sets, percent))
    labels = connected_components(links)
    more = cut_lineage(_open_pairs(placed, labels, stars, rows.select("doc_id", "n_shingles", "sketch", "parity"), sets, percent))
    if not more.isEmpty():
        links = cut_lineage(links.unionByName(confirmed(more, sets, percent)))
        labels = connected_components(links)
    classes = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", "size", F.coalesce("component", "rep").alias("class_component"))
    out = join_groups(narrow, classes, ["h1", "h2"], "size")
    out = out.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_component", "component", "doc_id").alias("component_id")
                      ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _open_pairs(placed: DataFrame, labels: DataFrame, done: DataFrame, rows: DataFrame, sets: DataFrame, percent: int,
                crowd: int | None = None) -> DataFrame:
    """Distinct pairs of bucket members in different components that were not compared yet.

    Buckets whose members all lie in one component are left out, so a group of near copies is never expanded into its pairs.
    In every other bucket the members outside its most frequent component meet all members. Where more than ``crowd`` (``CROWD``) are
    outside, as with documents that share a template, they meet under the rare shingles instead that near copies must have in
    common (:func:`rare_lists`).

    Of the pairs come only those that can still be similar. Sets with intersection I and union U have I + U shingles together and U - I in
    their symmetric difference; so at similarity p the difference is at most (1 - p) / (1 + p) of the sum of sizes, and the
    parity sketches differ in no more bits. This test loses nothing and settles sets up to about a thousand shingles. For larger
    ones the signatures must not differ in more than ``SKETCH_DISTANCE`` of ``SKETCH_SYMBOLS`` symbols (a pair at similarity 0.75
    does with probability 1e-7). Both run inside the join, so documents that merely share passages leave no rows.
    """
    named = placed.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    open_ = cut_lineage(named.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo != hi"))
    crowd = CROWD if crowd is None else crowd
    lists = named.join(open_.filter(F.col("n") <= crowd).select("key"), "key", "left_semi")
    crowded = open_.filter(F.col("n") > crowd).select("key")
    if not crowded.isEmpty():
        members = cut_lineage(named.join(crowded, "key", "left_semi").select("doc_id", "component").distinct())
        lists = lists.unionByName(rare_lists(members, sets, percent))
    lists = cut_lineage(lists)
    # The most frequent component of every list that has several.
    main = lists.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select(
        "key", F.col("main.component").alias("main"))
    left = cut_lineage(lists.join(main, "key").join(rows.dropDuplicates(["doc_id"]), "doc_id").select(
        "key", F.col("doc_id").alias("a"), F.col("component").alias("ca"), (F.col("component") != F.col("main")).alias("asks"),
        F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"), F.col("parity").alias("pa")))
    right = left.select("key", F.col("a").alias("b"), F.col("ca").alias("cb"), F.col("na").alias("nb"), F.col("sa").alias("sb"), F.col("pa").alias("pb"))
    close = ((F.col("ca") != F.col("cb"))
             & (F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
             & (F.lit(100 + percent) * parity_distance("pa", "pb") <= F.lit(100 - percent) * (F.col("na") + F.col("nb")))
             & (sketch_distance("sa", "sb") <= SKETCH_DISTANCE))
    left, right = afresh(left.filter("asks"), "key"), afresh(right, "key").withColumnRenamed("key", "other_key")
    pairs = left.join(right, (F.col("key") == F.col("other_key")) & close).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(done, ["a", "b"], "left_anti")


def rare_lists(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``key, doc_id, component``: the ``members(doc_id, component)`` under the rarest of their shingles.

    Shingles that only one component has come first, the others from rare to frequent among the members. Two sets of n or more
    shingles of which ``percent`` are common have one in common among the first ``n - ceil(n * percent / 100) + 1`` of either, so
    no such pair of two components is lost, and what a whole crowd has in common makes no list. Shingles of one component are
    only counted.
    """
    each = sets.join(members, "doc_id").select(
        "doc_id", "component", F.xxhash64("shingles").alias("text"), F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    held = cut_lineage(each.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("held")).filter("lo != hi").select("key", "held"))
    common = each.join(held, "key")
    text = Window.partitionBy("doc_id", "text")
    placed = common.withColumn("at", F.row_number().over(text.orderBy("held", "key"))).withColumn("common", F.count(F.lit(1)).over(text))
    first = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1 - (F.col("n") - F.col("common"))
    return placed.filter(F.col("at") <= first).select("key", "doc_id", "component").distinct()


def near_dedup(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each component (its smallest id), with all columns."""
    gone = near_components(docs, percent, id_col, text_col).filter("not kept").select("doc_id")
    return without(docs, gone, id_col)


@query()
def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_components(table(spark, folder, "documents"))
