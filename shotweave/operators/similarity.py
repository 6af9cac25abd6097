"""Nearest neighbours by Tanimoto distance: exact, bounded from below, or by MinHash bands.

Rows with equal fingerprints are searched once. A copy group can never
contribute more than its ``k`` smallest keys to a top-k list ordered by
(distance, key), so only those travel; the row-number limit that selects them
works before the shuffle, and a group that holds a third of the table costs no
task more than its share.

Exact search compares blocks of at most ``block_rows`` distinct queries with
blocks of at most ``block_rows`` distinct candidates, in tasks that emit only each
query's best ``k`` rows, never the pairs. Candidates are blocked by
bands of set-bit count. Since ``T(a, b) <= min(|a|, |b|) / max(|a|, |b|)``, a query
first visits its own band, and afterwards only bands that could still
beat or tie its current k-th best.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotweave.functions import fingerprints as fpx
from shotweave.plans.skew import fits_broadcast, lookup_join, skew_join
from shotweave.session import cut_lineage, task_slots

BLOCK_ROWS = 2048
BAND_RATIO = 1.15
TWO_STEP_BLOCKS = 16
FEW_BYTES = 4 << 20
FEW_ROWS = 1 << 21
SMALL_BUCKET = 256
BUCKET_BLOCKS, BUCKET_PARTS = 4, 4
WIDE_SHARE, WIDE_ROWS = 0.25, 1 << 14
LONG_LIST = 512
EARLY_LIMIT = 1000
IS_ASKED, ASKS, ASKS_AND_IS_ASKED = 0, 1, 2
GROUP = "_all"
SLACK = 1e-12
TILE_PAIRS = 131_072
TILE_ROWS, FIRST_ROWS, SLAB_ROWS, STRIP_PAIRS = 256, 512, 4096, 32_768
HITS_A_SLAB = 8
BLOCK_PARTS, MOST_BLOCK_ROWS = 16, 1 << 18
ROUGH_SLACK = 1e-6

Encoder = Callable[[pd.Series], pd.Series]


def fingerprint_table(df: DataFrame, key: str, text: str, *keep: str, n_bits: int = fpx.KEYS_BITS,
                      n_words: int = fpx.KEYS_WORDS) -> DataFrame:
    """``(key, keep…, words, popcount)``; NULL words where the text has no token."""
    words = df.select(F.col(key).alias("key"), *keep, fpx.encode_text(F.col(text), n_bits, n_words).alias("words"))
    return words.withColumn("popcount", fpx.popcount(F.col("words"), n_words))


def external_fingerprints(df: DataFrame, key: str, text: str, encode: Encoder, n_words: int) -> DataFrame:
    """As :func:`fingerprint_table` with an outside encoder: a pandas function from texts to packed bytes or None."""
    encoder = F.pandas_udf(encode, "binary")
    packed = df.select(F.col(key).alias("key"), encoder(F.col(text)).alias("_packed"))
    words = F.when(F.col("_packed").isNotNull(), fpx.bytes_to_words(F.col("_packed"), n_words))
    return packed.select("key", words.alias("words")).withColumn("popcount", fpx.popcount(F.col("words"), n_words))


def searchable(shards: DataFrame, name: str) -> DataFrame:
    """Rows of all shards but those named ``test…``."""
    return shards.filter(~F.col(name).startswith("test"))


def encodable(df: DataFrame, text: str) -> DataFrame:
    """Rows that will get a fingerprint, tested on the text so that nothing is encoded for the test."""
    return df.filter(F.lower(text).rlike(r"[\p{L}\p{N}]"))


def not_indexed(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Rows whose key the fingerprint table does not hold yet."""
    return df.join(table.select(F.col("key").alias(key)), key, "left_anti")


def pair_distances(pairs: DataFrame, distance: fpx.Distance, left: str, right: str) -> DataFrame:
    """Distance of given pairs; ``distance`` is one of the builders, or any function of two word columns."""
    return pairs.withColumn("distance", distance(F.col(left), F.col(right)))


# --- exact search -----------------------------------------------------------------------------------------------


def _encoded(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, _all, key, fp, pc)`` of the rows that have a set bit, written once.

    The filter comes after the write: before it, it would be pushed below the encoding and encode every row twice.
    """
    packed = df.select(
        *by, F.lit(0).alias(GROUP), F.col("key").cast("bigint").alias("key"),
        fpx.words_to_bytes(F.col("words")).alias("fp"),
        F.aggregate("words", F.lit(0), lambda s, w: s + F.bit_count(w)).alias("pc"),
    )
    return cut_lineage(packed).filter(F.col("pc") > 0)


def _distinct(encoded: DataFrame, by: Sequence[str], keep: int) -> DataFrame:
    """``(by, fp, pc, members)``: distinct fingerprints with their ``keep`` smallest keys."""
    order = Window.partitionBy(*by, "fp").orderBy("key")
    first = encoded
    if keep > EARLY_LIMIT:
        # The planner limits rows before the shuffle up to this number only; beyond it parts of a group are limited first.
        part = Window.partitionBy(*by, "fp", F.pmod(F.xxhash64("key"), F.lit(task_slots(encoded.sparkSession)))).orderBy("key")
        first = first.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= keep)
    first = first.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep)
    return first.groupBy(*by, "fp").agg(
        F.first("pc").alias("pc"), F.array_sort(F.collect_list("key")).alias("members")
    )


def _fresh(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, so that a table can meet itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _band(pc: Column) -> Column:
    return F.floor(F.log(pc.cast("double")) / F.log(F.lit(BAND_RATIO))).cast("int")


def _parts(rows: Column, of: Column, block_rows: int, most: int) -> Column:
    """Into how many blocks ``rows`` of a side of ``of`` rows are cut: blocks have ``block_rows`` rows, or a fixed share of the side
    if that is more. So a row is sent to as many blocks of a large table as of a small one."""
    share = F.least(of / F.lit(float(most)), F.lit(float(MOST_BLOCK_ROWS)))
    return F.ceil(rows / F.greatest(share, F.lit(float(block_rows)))).cast("int")


def _best_possible(pc: Column, block: Column) -> Column:
    """Largest similarity any candidate of a block can have."""
    return (F.when(pc < block["lo"], pc / block["lo"].cast("double"))
            .when(pc > block["hi"], block["hi"] / pc.cast("double")).otherwise(F.lit(1.0)))


def _packed(fp: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Fingerprints of one width as rows of machine words, read where Arrow holds them."""
    fp = fp.combine_chunks() if isinstance(fp, pa.ChunkedArray) else fp
    ends = np.frombuffer(fp.buffers()[1], np.int32)[fp.offset:fp.offset + len(fp) + 1]
    words = np.frombuffer(fp.buffers()[2], np.uint8)[ends[0]:ends[-1]].copy().view(np.uint32).reshape(len(fp), -1)
    return words.view(np.uint64) if words.shape[1] % 2 == 0 else words


def _first(row: np.ndarray, dist: np.ndarray, item: np.ndarray, k: int):
    """The first k per row by (distance, item)."""
    sort = np.lexsort((item, dist, row))
    row, dist, item = row[sort], dist[sort], item[sort]
    keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[keep], dist[keep], item[keep]


def _needed(row: np.ndarray, dist: np.ndarray, item: np.ndarray, times: np.ndarray, k: int):
    """Sorted fingerprints without those that k copies of strictly nearer ones push out."""
    if not len(row):
        return row, dist, item
    place, before = np.arange(len(row)), np.cumsum(times) - times
    new_row = np.r_[True, row[1:] != row[:-1]]
    new_tie = new_row | np.r_[True, dist[1:] != dist[:-1]]
    row_start = np.maximum.accumulate(np.where(new_row, place, 0))
    tie_start = np.maximum.accumulate(np.where(new_tie, place, 0))
    keep = before[tie_start] - before[row_start] < k
    return row[keep], dist[keep], item[keep]


def _places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what is true: ``np.nonzero``, which is several times slower in two dimensions, and where little is true so is
    looking at single flags and not at eight at a time."""
    flat = hit.reshape(-1)
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    if len(eights) * 16 > len(flat):
        return np.divmod(np.flatnonzero(flat), hit.shape[1])
    near = np.r_[(eights[:, None] * 8 + np.arange(8)).reshape(-1), np.arange(whole, len(flat))]
    return np.divmod(near[flat[near]], hit.shape[1])


def _common(q_bits: np.ndarray, c_bits: np.ndarray, both: Callable = np.bitwise_and) -> np.ndarray:
    """Set bits of ``both`` of every query and every candidate, from words by rows."""
    n_q, n_c = q_bits.shape[1], c_bits.shape[1]
    small = len(q_bits) * q_bits.itemsize * 8 < 256
    out = np.zeros((n_q, n_c), np.uint8 if small else np.uint16)
    rows = max(1, STRIP_PAIRS // n_c)
    words, ones = np.empty((rows, n_c), q_bits.dtype), np.empty((rows, n_c), np.uint8)
    for lo in range(0, n_q, rows):
        hi = min(lo + rows, n_q)
        for q, c in zip(q_bits, c_bits):
            both(q[lo:hi, None], c, out=words[:hi - lo])
            np.bitwise_count(words[:hi - lo], out=ones[:hi - lo])
            out[lo:hi] += ones[:hi - lo]
    return out


def _unpacked(bits: np.ndarray) -> np.ndarray:
    """Rows of machine words as rows of flags."""
    return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1)


def _three_a_column(bits: np.ndarray, real: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Candidates for :func:`_common_packed`, ``used`` bits by rows: of four candidates in a row three share a column, as digits to the
    base 256; the fourth is none."""
    out = np.empty((len(used), len(bits) // 4), np.float32)
    for lo in range(0, len(bits), SLAB_ROWS):
        flags = _unpacked(bits[lo:lo + SLAB_ROWS])[:, used]
        flags[~real[lo:lo + SLAB_ROWS]] = 0
        one, two, three = (flags[j::4].T.astype(np.float32) for j in range(3))
        out[:, lo // 4:lo // 4 + one.shape[1]] = one + 256 * two + 65536 * three
    return out


def _common_packed(q_flags: np.ndarray, c_columns: np.ndarray) -> np.ndarray:
    """Common bits of fingerprints under 256 bits, as one matrix product: sums of three digits to the base 256 stay under 2^24, so single
    precision is exact, and the bytes of a sum are the three counts."""
    return (q_flags @ c_columns).astype(np.uint32).view(np.uint8)


def _block_search(k: int):
    """Best ``k`` rows per query of one block pair, by (distance, key), after expanding copies: query row, distance, key.

    Both sides are taken in the order of their sizes, a tile of queries meets the candidates slab by slab, the slab of its own size
    first and in it the few rows next to the tile's size, so that all others meet a floor. A query's ``k``-th similarity so far is its floor for the next slab: a number of common bits that depends on the two sizes
    only. Slabs whose sizes are out of reach are left out. Wide fingerprints are folded first: bits in which two folds differ are never
    more than those in which the fingerprints do, so pairs whose folds differ too much are not compared.
    """
    def search(queries: pa.Table, candidates: pa.Table, members: pa.ListArray):
        if not queries.num_rows or not candidates.num_rows:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        starts = members.offsets.to_numpy()
        flat = members.values.to_numpy()
        smallest = flat[starts[:-1]]
        c_pc = candidates["pc"].to_numpy().astype(np.int64)
        order = np.lexsort((smallest, c_pc))
        narrow = len(_packed(candidates["fp"].slice(0, 1))[0].view(np.uint8)) * 8 < 256
        real = np.ones(len(order), bool)
        if narrow:
            # Every fourth row stands for no candidate.
            rows = np.arange(-(-len(order) // 3) * 4)
            real = (rows % 4 < 3) & (rows // 4 * 3 + rows % 4 < len(order))
            order = order[np.minimum(rows // 4 * 3 + np.minimum(rows % 4, 2), len(order) - 1)]
        c_pc, counts, starts = c_pc[order], np.diff(starts)[order], starts[:-1][order]
        # Ties go by the smallest key of a copy group.
        place = np.empty(len(order), np.int64)
        place[np.argsort(smallest[order], kind="stable")] = np.arange(len(order))
        by_place = np.argsort(place)
        q_pc = queries["pc"].to_numpy().astype(np.int64)
        asked = np.argsort(q_pc, kind="stable")
        q_pc, start_floor = q_pc[asked], queries["floor"].to_numpy()[asked]
        q_rows, c_rows = _packed(queries["fp"])[asked], _packed(candidates["fp"])[order]
        if narrow:
            used = np.flatnonzero(_unpacked(np.bitwise_or.reduce(c_rows, axis=0)[None])[0])
            c_columns = _three_a_column(c_rows, real, used)
        else:
            q_bits, c_bits = np.ascontiguousarray(q_rows.T), np.ascontiguousarray(c_rows.T)
        n_words, bits = c_rows.shape[1], c_rows.itemsize * 8
        folds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def folded(width: int) -> tuple[np.ndarray, np.ndarray]:
            if width not in folds:
                folds[width] = tuple(np.ascontiguousarray(np.bitwise_xor.reduce(side.reshape(-1, width, side.shape[1]), axis=0))
                                     for side in (q_bits, c_bits))
            return folds[width]

        edges = np.arange(0, len(c_pc), SLAB_ROWS)
        least, most = c_pc[edges], c_pc[np.minimum(edges + SLAB_ROWS, len(c_pc)) - 1]
        out = []
        for lo in range(0, len(q_pc), TILE_ROWS):
            hi = min(lo + TILE_ROWS, len(q_pc))
            size, floor = q_pc[lo:hi], start_floor[lo:hi].copy()
            best = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
            if narrow:
                q_flags = _unpacked(q_rows[lo:hi])[:, used].astype(np.float32)
            middle = size[len(size) // 2]
            away = np.maximum(np.maximum(least - middle, middle - most), 0)
            spans = [(edges[slab], min(edges[slab] + SLAB_ROWS, len(c_pc))) for slab in np.argsort(away, kind="stable")]
            left, right = spans[0]
            begin = min(max(np.searchsorted(c_pc, middle) - FIRST_ROWS // 2, left), max(right - FIRST_ROWS, left)) // 4 * 4
            end = min(begin + FIRST_ROWS, right)
            for left, right in [(begin, end), (left, begin), (end, right), *spans[1:]]:
                if left == right:
                    continue
                reach = np.minimum(np.minimum(size / c_pc[left], c_pc[right - 1] / size), 1.0)
                live = np.flatnonzero(reach >= floor - ROUGH_SLACK)
                if not len(live):
                    continue
                c_size = c_pc[left:right]
                # Sizes are sorted, so those of a kind are neighbours.
                kind_edges = np.r_[0, np.flatnonzero(np.diff(c_size)) + 1, len(c_size)]
                kinds = c_size[kind_edges[:-1]]
                total = size[live][:, None] + kinds
                need = np.ceil((floor[live] / (1 + floor[live]))[:, None] * total - ROUGH_SLACK).astype(np.int64)

                def compared(test: Callable, values: np.ndarray, limit: np.ndarray) -> np.ndarray:
                    out = np.empty(values.shape, bool)
                    for j, (a, b) in enumerate(zip(kind_edges[:-1], kind_edges[1:])):
                        test(values[:, a:b], limit[:, j:j + 1], out=out[:, a:b])
                    return out

                row = None
                width = int(2 ** np.ceil(np.log2(max(1.0, 4 * np.median(total - 2 * need) / bits))))
                if n_words > 8 and n_words % width == 0 and 2 * width <= n_words:
                    q_fold, c_fold = folded(width)
                    differ = _common(q_fold[:, lo:hi][:, live], c_fold[:, left:right], np.bitwise_xor)
                    row, cand = _places(compared(np.less_equal, differ, np.clip(total - 2 * need, 0, 65535).astype(np.uint16)))
                    if len(row) * 8 > differ.size:
                        row = None
                    else:
                        both = np.concatenate([np.bitwise_count(q_bits[:, lo + live[row[i:i + STRIP_PAIRS]]] & c_bits[:, left + cand[i:i + STRIP_PAIRS]]).sum(
                            axis=0, dtype=np.int64) for i in range(0, len(row), STRIP_PAIRS)] or [np.empty(0, np.int64)])
                if row is None:
                    if narrow:
                        shared = _common_packed(q_flags[live], c_columns[:, left // 4:right // 4])
                    else:
                        shared = _common(q_bits[:, lo:hi][:, live], c_bits[:, left:right])
                    top = np.iinfo(shared.dtype).max
                    hit = compared(np.greater_equal, shared, np.clip(need, 0, top).astype(shared.dtype))
                    if np.count_nonzero(hit) > HITS_A_SLAB * k * len(live) and right - left > k:
                        # Single precision with some slack selects a superset of each query's best k; doubles then decide.
                        rough = shared.astype(np.float32)
                        rough /= (size[live][:, None] + c_size).astype(np.float32) - rough
                        kth = np.partition(rough, right - left - k, axis=1)[:, right - left - k]
                        hit &= rough >= (kth - np.float32(ROUGH_SLACK))[:, None]
                    row, cand = _places(hit)
                    stands = real[left + cand]
                    row, cand = row[stands], cand[stands]
                    both = shared[row, cand].astype(np.int64)
                if not len(row):
                    continue
                row = live[row]
                similarity = both / (size[row] + c_size[cand] - both)
                wanted = similarity >= floor[row]
                row, dist, cand = row[wanted], 1.0 - similarity[wanted], place[left + cand[wanted]]
                best = _first(*(np.concatenate(part) for part in zip(best, (row, dist, cand))), k)
                kth = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
                floor[best[0][kth]] = np.maximum(floor[best[0][kth]], 1.0 - best[1][kth] - SLACK)
            row, dist, cand = best[0], best[1], by_place[best[2]]
            row, dist, cand = _needed(row, dist, cand, counts[cand], k)
            times = counts[cand]
            take = np.repeat(starts[cand] - np.cumsum(times) + times, times) + np.arange(times.sum())
            row, dist, key = _first(np.repeat(row, times), np.repeat(dist, times), flat[take], k)
            out.append((asked[row + lo], dist, key))
        return tuple(np.concatenate(part) for part in zip(*out))

    return search


def _bucket_kernel(k: int, bucket: Sequence[str], inner: Sequence[str], floor: float = 0.0, placed: bool = False):
    """Best ``k`` rows of every asking row among the asked rows of its bucket; rows come sorted by bucket, a bucket that
    reaches into the next batch waits for it."""
    def first(row: np.ndarray, dist: np.ndarray, key: np.ndarray) -> np.ndarray:
        sort = np.lexsort((key, dist, row))
        return sort[np.arange(len(row)) - np.searchsorted(row[sort], row[sort]) < k]

    def starts(table: pa.Table) -> np.ndarray:
        new = np.ones(table.num_rows, bool)
        new[1:] = False
        for name in bucket:
            values = table[name].combine_chunks()
            new[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def search(table: pa.Table, runs: np.ndarray):
        bits = np.frombuffer(b"".join(table["fp"].to_pylist()), np.uint32).reshape(table.num_rows, -1)
        bits = bits.view(np.uint64) if bits.shape[1] % 2 == 0 else bits
        size, side = table["pc"].to_numpy().astype(np.int64), table["_side"].to_numpy()
        place = table["_place"].to_numpy().astype(np.int64) if placed else None
        run = np.repeat(np.arange(len(runs)), np.diff(np.r_[runs, table.num_rows]))
        asking, asked = np.flatnonzero(side != IS_ASKED), np.flatnonzero(side != ASKS)
        low = np.searchsorted(run[asked], np.arange(len(runs)))
        count = np.diff(np.r_[low, len(asked)])[run[asking]]
        members = table["members"].combine_chunks()
        ends, keys = members.offsets.to_numpy(), members.values.to_numpy()
        tiles = np.cumsum(count) // (8 * TILE_PAIRS)
        for tile in np.unique(tiles):
            mine = tiles == tile
            n, at = count[mine], low[run[asking[mine]]]
            row = np.repeat(asking[mine], n)
            cand = asked[np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())]
            if placed:
                # Where a pair's first common bit makes the bucket, no more bits than those after it can be shared.
                possible = np.minimum(size[row] - place[row], size[cand] - place[cand])
                hopeful = possible >= floor / (1 + floor) * (size[row] + size[cand]) - ROUGH_SLACK
                row, cand = row[hopeful], cand[hopeful]
            shared = np.zeros(len(row), np.int64)
            for word in range(bits.shape[1]):
                shared += np.bitwise_count(bits[row, word] & bits[cand, word])
            similarity = shared / (size[row] + size[cand] - shared)
            near = similarity >= floor
            row, cand, dist = row[near], cand[near], 1.0 - similarity[near]
            best = first(row, dist, keys[ends[cand]])
            row, dist, cand = row[best], dist[best], cand[best]
            times = ends[cand + 1] - ends[cand]
            take = np.repeat(ends[cand] - np.cumsum(times) + times, times) + np.arange(times.sum())
            row, dist, key = np.repeat(row, times), np.repeat(dist, times), keys[take]
            best = first(row, dist, key)
            columns = [table[name].combine_chunks().take(pa.array(row[best])) for name in [*inner, "fp"]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dist[best]), pa.array(key[best])],
                                             names=[*inner, "fp", "distance", "key"])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            runs = starts(table)
            if len(runs) > 1:
                yield from search(table.slice(0, runs[-1]).combine_chunks(), runs[:-1])
                table = table.slice(runs[-1]).combine_chunks()
            rest = table
        if rest is not None and rest.num_rows:
            yield from search(rest.combine_chunks(), starts(rest))

    return run


def _topk_kernel(k: int, by: Sequence[str]):
    """:func:`_block_search` of a pair of groups."""
    search = _block_search(k)

    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        q_rows, dist, keys = search(queries, candidates, candidates["members"].combine_chunks())
        columns = {b: queries[b].combine_chunks().take(pa.array(q_rows)) for b in by}
        columns["fp"] = queries["fp"].combine_chunks().take(pa.array(q_rows))
        columns["distance"] = pa.array(dist)
        columns["key"] = pa.array(keys)
        return pa.table(columns)

    return run


def _layout(queries: DataFrame, candidates: DataFrame, by: Sequence[str], block_rows: int, most: int = BLOCK_PARTS) -> DataFrame:
    """``(by, _blocks, _q_parts)``: how each search group is cut into blocks.

    One row per search group, with at most a few dozen bands.
    """
    bands = candidates.withColumn("_band", _band(F.col("pc"))).groupBy(*by, "_band").agg(
        F.count(F.lit(1)).alias("n"), F.min("pc").alias("lo"), F.max("pc").alias("hi")
    )
    listed = bands.groupBy(*by).agg(F.collect_list(F.struct(F.col("_band").alias("band"), "lo", "hi", "n")).alias("_bands"),
                                    F.sum("n").alias("_n"))
    blocks = F.transform("_bands", lambda b: F.struct(b["band"].alias("band"), b["lo"].alias("lo"), b["hi"].alias("hi"), b["n"].alias("n"),
                                                      _parts(b["n"], F.col("_n"), block_rows, most).alias("parts")))
    rows = F.count(F.lit(1))
    asked = queries.groupBy(*by).agg(_parts(rows, rows, block_rows, most).alias("_q_parts"))
    return cut_lineage(listed.select(*by, blocks.alias("_blocks")).join(asked, list(by)))


def _search_blocks(queries: DataFrame, candidates: DataFrame, layout: DataFrame, by: Sequence[str], k: int,
                   visit: Callable[[Column], Column]) -> DataFrame:
    """Top-k rows of every (query, visited block): ``(by, fp, distance, key)``.

    ``queries(by, fp, pc, floor)`` and ``candidates(by, fp, pc, members)`` are distinct.
    ``layout`` is broadcast if its measured size allows, so a group of any size is not gathered by its key.
    """
    by = list(by)
    banded = candidates.withColumn("_band", _band(F.col("pc")))
    if fits_broadcast(layout):
        laid_q, laid_c = (side.join(F.broadcast(layout), by) for side in (queries, banded))
    else:
        laid_q, laid_c = (skew_join(side, layout, by, ["fp"]) for side in (queries, banded))
    q = (
        laid_q
        .withColumn("_q", F.pmod(F.xxhash64("fp"), F.col("_q_parts")).cast("int"))
        .withColumn("_block", F.explode(F.filter("_blocks", visit)))
        .withColumn("_band", F.col("_block.band"))
        .withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_block.parts") - 1)))
        .select(*by, "_band", "_q", "_c", "fp", "pc", "floor")
    )
    own = F.filter("_blocks", lambda b: b["band"] == F.col("_band"))[0]["parts"]
    c = (
        laid_c
        .withColumn("_c", F.pmod(F.xxhash64("fp"), own).cast("int"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_q_parts") - 1)))
        .select(*by, "_band", "_q", "_c", "fp", "pc", "members")
    )
    grid = [*by, "_band", "_q", "_c"]
    tasks = task_slots(queries.sparkSession)
    types = dict(queries.dtypes)
    schema = ", ".join(f"`{b}` {types[b]}" for b in by) + ", fp binary, distance double, key bigint"
    return (
        _fresh(q).repartition(tasks, *grid).groupBy(*grid)
        .cogroup(_fresh(c).repartition(tasks, *grid).groupBy(*grid))
        .applyInArrow(_topk_kernel(k, by), schema)
    )


def _best_rows(hits: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """``(by, fp, hits)`` with the first k of each query's block results as an array; a result that several blocks give counts once."""
    order = Window.partitionBy(*by, "fp").orderBy("distance", "key")
    first = hits.withColumn("_n", F.dense_rank().over(order)).filter(F.col("_n") <= k)
    return first.groupBy(*by, "fp").agg(F.array_sort(F.collect_set(F.struct("distance", "key"))).alias("hits"))


def _exact(queries: DataFrame, candidates: DataFrame, by: Sequence[str], k: int, floor: float, block_rows: int,
           two_steps: bool | None) -> DataFrame:
    """Best k rows per distinct query, as :func:`_best_rows`. Queries may bring a column ``floor`` of their own."""
    own_floor = F.col("floor") if "floor" in queries.columns else F.lit(float(floor))
    start = queries.select(*by, "fp", "pc", own_floor.alias("floor"))
    layout = _layout(start, candidates, by, block_rows)

    def within_reach(block: Column) -> Column:
        return _best_possible(F.col("pc"), block) >= F.col("floor") - SLACK

    if two_steps is None:
        largest = layout.agg(F.max(F.aggregate("_blocks", F.lit(0).cast("bigint"), lambda n, b: n + b["n"]))).head()[0]
        two_steps = floor == 0.0 and (largest or 0) > TWO_STEP_BLOCKS * block_rows
    if not two_steps:
        return _best_rows(_search_blocks(start, candidates, layout, by, k, within_reach), by, k)
    own = lambda block: block["band"] == _band(F.col("pc"))
    seeds = cut_lineage(_best_rows(_search_blocks(start, candidates, layout, by, k, own), by, k))
    worst = F.lit(1.0) - F.element_at("hits", -1)["distance"]
    reached = F.greatest(F.lit(float(floor)), F.when(F.size("hits") >= k, worst - SLACK).otherwise(F.lit(float(floor))))
    raised = start.drop("floor").join(seeds, [*by, "fp"], "left").select(
        *by, "fp", "pc", F.coalesce(reached, F.lit(float(floor))).alias("floor")
    )
    rest = _search_blocks(raised, candidates, layout, by, k, lambda b: within_reach(b) & ~own(b))
    found = seeds.select(*by, "fp", F.inline("hits")).unionByName(rest)
    return _best_rows(found, by, k)


def _per_row(encoded: DataFrame, best: DataFrame, by: Sequence[str], k: int, exclude_self: bool,
             out_by: Sequence[str]) -> DataFrame:
    """Back from distinct fingerprints to query rows: ``(query_id, by, rank, key, distance)``."""
    rows = encoded.withColumnRenamed("key", "query_id")
    joined = skew_join(rows, best, [*by, "fp"], ["query_id"])
    hits = F.filter("hits", lambda h: h["key"] != F.col("query_id")) if exclude_self else F.col("hits")
    return joined.select("query_id", *out_by, F.posexplode(F.slice(hits, 1, k)).alias("_pos", "_hit")).select(
        "query_id", *out_by, (F.col("_pos") + 1).alias("rank"), F.col("_hit.key").alias("key"),
        F.col("_hit.distance").alias("distance"),
    )


def nearest(queries: DataFrame, candidates: DataFrame | None, k: int, by: Sequence[str] = (),
            min_similarity: float = 0.0, block_rows: int = BLOCK_ROWS, two_steps: bool | None = None) -> DataFrame:
    """Exact k nearest candidates of every query: ``(query_id, by, rank, key, distance)``, rank from 1.

    Both sides have ``key`` (bigint), the ``by`` columns and ``words``; a query sees only
    candidates of its own ``by`` values. With ``candidates=None`` the
    queries search each other and skip themselves. Order is (distance, key). Fingerprints without a set
    bit have no neighbours. With ``min_similarity`` only candidates at least
    that similar count, and blocks that cannot hold one are never visited.

    Work is quadratic in the *distinct* fingerprints of a group unless the
    floor prunes it; for whole-corpus search without a floor use :func:`nearest_lsh`.
    """
    inner = [*by, GROUP]
    exclude_self = candidates is None
    keep = k + 1 if exclude_self else k
    q_rows = _encoded(queries, by)
    c_rows = q_rows if exclude_self or candidates is queries else _encoded(candidates, by)
    c = cut_lineage(_distinct(c_rows, inner, keep))
    q = c if exclude_self else cut_lineage(_distinct(q_rows, inner, 1))
    best = _exact(q, c, inner, keep, min_similarity, block_rows, two_steps)
    return _per_row(q_rows, best, inner, k, exclude_self, by)


def nearest_few(queries: DataFrame, candidates: DataFrame, k: int, max_queries: int | None = None) -> DataFrame:
    """Exact :func:`nearest` for a query side that is small: ``(query_id, rank, key, distance)``.

    The queries' fingerprints go to every task, at most ``FEW_BYTES`` of them and so many that their results stay under ``FEW_ROWS`` rows a
    task (``max_queries`` replaces both; beyond it :func:`nearest` takes over). Each task reads its candidates once, slice by slice, and
    carries every query's ``k``-th similarity on as the floor of the next slice, so the corpus is neither written nor
    shuffled; only ``queries * k`` rows per task are.
    """
    packed = queries.select(F.col("key").cast("bigint").alias("key"), fpx.words_to_bytes(F.col("words")).alias("fp")).filter("fp IS NOT NULL")
    if max_queries is None:
        width = packed.select(F.octet_length("fp")).first()
        max_queries = min(FEW_BYTES // max(1, width[0] if width else 1), FEW_ROWS // k)
    rows = packed.limit(max_queries + 1).collect()
    if len(rows) > max_queries:
        return nearest(queries, candidates, k)
    ids = np.array([r["key"] for r in rows], np.int64)
    prints = pa.array([bytes(r["fp"]) for r in rows], pa.binary())
    search = _block_search(k)

    def sizes(fp: pa.Array) -> np.ndarray:
        return np.bitwise_count(np.frombuffer(b"".join(fp.to_pylist()), np.uint8).reshape(len(fp), -1)).sum(axis=1, dtype=np.int64)

    def run(batches):
        asked = np.flatnonzero(sizes(prints) > 0) if len(prints) else np.zeros(0, np.int64)
        asking = prints.take(pa.array(asked))
        q_pc = sizes(asking) if len(asked) else np.zeros(0, np.int64)
        floor = np.zeros(len(asked))
        best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows if len(asked) else 0, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                c_pc = sizes(part.column(1))
                some = np.flatnonzero(c_pc)
                keys = part.column(0).take(pa.array(some))
                members = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1), pa.int32()), keys)
                found = search(pa.table({"fp": asking, "pc": q_pc, "floor": floor}),
                               pa.table({"fp": part.column(1).take(pa.array(some)), "pc": c_pc[some]}), members)
                row, dist, key = (np.concatenate(x) for x in zip(best, found))
                order = np.lexsort((key, dist, row))
                row, dist, key = row[order], dist[order], key[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                best = row[place < k], dist[place < k], key[place < k]
                floor[row[place == k - 1]] = 1.0 - dist[place == k - 1] - SLACK
        yield pa.RecordBatch.from_arrays([pa.array(ids[asked[best[0]]]), pa.array(best[2]), pa.array(best[1])],
                                         names=["query_id", "key", "distance"])

    corpus = candidates.select(F.col("key").cast("bigint").alias("key"), fpx.words_to_bytes(F.col("words")).alias("fp")).filter(
        "fp IS NOT NULL")
    hits = corpus.mapInArrow(run, "query_id bigint, key bigint, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "key")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "key", "distance")


# --- MinHash bands ----------------------------------------------------------------------------------------------


def bit_orders(n_bits: int, n_hashes: int, seed: int = 0) -> np.ndarray:
    """One permutation of the bits per hash function: rank of md5 of ``seed:function:bit``."""
    orders = np.empty((n_hashes, n_bits), dtype=np.int32)
    for h in range(n_hashes):
        digests = [hashlib.md5(f"{seed}:{h}:{b}".encode()).hexdigest() for b in range(n_bits)]
        orders[h, np.argsort(digests)] = np.arange(n_bits)
    return orders


def _bytes(fp: pa.Array) -> np.ndarray:
    words = np.frombuffer(b"".join(fp.to_pylist()), dtype=">u4").reshape(len(fp), -1)
    return words.astype("<u4").view(np.uint8)


def _flags(fp: pa.Array, n_bits: int) -> np.ndarray:
    return np.unpackbits(_bytes(fp), axis=1, bitorder="little")[:, :n_bits].astype(bool)


def _first_places(orders: np.ndarray) -> np.ndarray:
    """Smallest place in every order of the bits of a byte: ``[byte of the print, its value, order]``; the number of bits where it has none."""
    n_hashes, n_bits = orders.shape
    values = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)
    table = np.full((-(-n_bits // 8), 256, n_hashes), n_bits, np.uint8)
    for bit in range(n_bits):
        part = table[bit // 8]
        part[values[:, bit % 8]] = np.minimum(part[values[:, bit % 8]], orders[:, bit].astype(np.uint8))
    return table


def _min_places(fp: pa.Array, orders: np.ndarray, table: np.ndarray | None) -> np.ndarray:
    """Place of every print's first set bit in every order, prints by rows."""
    if table is None:
        on = _flags(fp, orders.shape[1])
        return np.stack([np.where(on, order, len(order)).min(axis=1) for order in orders], axis=1)
    values = _bytes(fp)
    first = table[0][values[:, 0]]
    for i in range(1, len(table)):
        np.minimum(first, table[i][values[:, i]], out=first)
    return first


def _band_keys(n_bits: int, bands: int, rows: int, seed: int):
    orders = bit_orders(n_bits, bands * rows, seed)
    exact = (n_bits + 1) ** rows < 1 << 63
    table = _first_places(orders) if n_bits < 256 else None

    @F.arrow_udf("array<bigint>")
    def band_keys(fp: pa.Array) -> pa.Array:
        keys = np.zeros((len(fp), bands), np.uint64)
        for lo in range(0, len(fp), BLOCK_ROWS):
            first = _min_places(fp.slice(lo, BLOCK_ROWS), orders, table).astype(np.uint64)
            for i in range(bands * rows):
                band = keys[lo:lo + BLOCK_ROWS, i // rows]
                band *= np.uint64(n_bits + 1 if exact else 0x9E3779B97F4A7C15)
                band += first[:, i]
        ends = pa.array(np.arange(len(fp) + 1) * bands, pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(keys.ravel().view(np.int64)))

    return band_keys


def certain_similarity(bands: int, rows: int, certainty: float) -> float:
    """Smallest similarity that a band shows with probability ``certainty``: where ``1 - (1 - s**rows)**bands`` reaches it."""
    return (1.0 - (1.0 - certainty) ** (1.0 / bands)) ** (1.0 / rows)


def nearest_lsh(queries: DataFrame, candidates: DataFrame | None, k: int, by: Sequence[str] = (),
                n_bits: int = fpx.KEYS_BITS, n_words: int = fpx.KEYS_WORDS, bands: int = 16, rows: int = 8,
                seed: int = 0, block_rows: int = BLOCK_ROWS, certainty: float = 0.95,
                small_rows: int = TWO_STEP_BLOCKS * BLOCK_ROWS) -> DataFrame:
    """:func:`nearest` with a certified share of approximation: every true neighbour is found with probability ``certainty`` at least.

    Tanimoto similarity of bit sets is their Jaccard similarity, so a candidate of similarity s shares a MinHash band with the query
    with probability ``1 - (1 - s**rows)**bands``. A query stops after the bands if it has ``k`` hits and the last of them is at least as
    similar as :func:`certain_similarity`: nearer ones were then seen with that probability too. Less similar hits cannot stop a query, so
    that similarity is the floor inside buckets. All other queries go to the exact search. Groups of at most
    ``small_rows`` distinct candidates are searched exactly from the start, as that is cheaper than their bands.

    Buckets of up to ``SMALL_BUCKET`` rows are compared where they were sorted together; larger ones go through the block
    search, which emits top-k rows instead of pairs and splits any bucket over tasks. No bucket is capped.

    Fingerprints with most bits set share nearly all bands, and a pair is met in each. A query whose large buckets hold more than
    ``WIDE_SHARE`` of all candidates together, if there are more than ``WIDE_ROWS``, is therefore searched once in all of them above that floor. If its hits are too few, bands
    would not have shown more; if all of them share a band with it, bands would have shown the same; the few others go to their buckets.
    """
    inner = [*by, GROUP]
    exclude_self = candidates is None
    keep = k + 1 if exclude_self else k
    q_rows = _encoded(queries, by)
    c_rows = q_rows if exclude_self or candidates is queries else _encoded(candidates, by)
    c = cut_lineage(_distinct(c_rows, inner, keep))
    q = c.drop("members") if exclude_self else cut_lineage(_distinct(q_rows, inner, 1).drop("members"))
    large = c.groupBy(*inner).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > small_rows).select(*inner)
    all_large = small_rows <= 0
    if not all_large:
        large = cut_lineage(large)
    if not all_large and large.isEmpty():
        return _per_row(q_rows, _exact(q, c, inner, keep, 0.0, block_rows, None), inner, k, exclude_self, by)

    def of_large(side: DataFrame) -> DataFrame:
        return side if all_large else lookup_join(side, large, inner, ["fp"], "left_semi")

    asking = None if exclude_self else of_large(q)
    band_keys = _band_keys(n_bits, bands, rows, seed)

    def listed(marked: DataFrame) -> DataFrame:
        return marked.select("*", F.posexplode("_marks").alias("_lsh", "_bucket")).drop("_marks")

    enough = certain_similarity(bands, rows, certainty)

    def at_once(wide: DataFrame) -> DataFrame:
        found = cut_lineage(_exact(wide, c, inner, keep, enough - SLACK, block_rows, False))
        met = found.filter(F.size("hits") >= keep).select(*inner, "fp", F.inline("hits"))
        prints = _fresh(c_rows.select(*inner, "key", F.col("fp").alias("_fp")))
        same = F.exists(F.zip_with(band_keys("fp"), band_keys("_fp"), lambda a, b: a == b), lambda x: x)
        # A key of several rows settles nothing unless all of them share a band.
        doubtful = met.join(prints, [*inner, "key"], "left").filter(~F.coalesce(same, F.lit(False))).select(*inner, "fp").distinct()
        none = wide.join(found, [*inner, "fp"], "left_anti").select(*inner, "fp", F.array().cast(dict(found.dtypes)["hits"]).alias("hits"))
        return found.join(doubtful, [*inner, "fp"], "left_anti").unionByName(none)

    seen = _bucket_search(asking, of_large(c), inner, keep, band_keys("fp"), listed, block_rows, enough - SLACK, at_once=at_once)
    last = F.element_at("hits", keep)["distance"]
    done = cut_lineage(seen.filter((F.size("hits") >= keep) & (last <= F.lit(1.0 - enough))))
    left = cut_lineage(q.join(done.select(*inner, "fp"), [*inner, "fp"], "left_anti").select(*inner, "fp", "pc"))
    best = done.unionByName(_exact(left, c, inner, keep, 0.0, block_rows, None))
    return _per_row(q_rows, best, inner, k, exclude_self, by)


def _bucket_search(q: DataFrame | None, c: DataFrame, inner: Sequence[str], keep: int, marks: Column,
                   listed: Callable[[DataFrame], DataFrame], block_rows: int, floor: float = 0.0,
                   small_bucket: int | None = None, placed: bool = False, at_once: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The first ``keep`` rows that share a bucket, per query that shares any, as :func:`_best_rows`; without ``q`` the candidates ask.

    ``marks`` is the array of a row's buckets, which is written with the row; ``listed`` repeats the row for each of them
    ``(_lsh, _bucket)`` and, if ``placed``, adds ``_place``, the number of set bits before the one that makes the bucket. Only rows of at
    least the similarity ``floor`` count. ``at_once`` may answer queries ``(inner, fp, pc)`` whose large buckets hold more than ``WIDE_SHARE``
    of all candidates; those it leaves out are searched in their buckets like all others.
    """
    tasks = task_slots(c.sparkSession)
    all_c = c

    def keyed(side: DataFrame) -> DataFrame:
        return listed(cut_lineage(side.repartition(tasks, "fp").withColumn("_marks", marks)))

    c = keyed(c)
    both = q is None
    q = c.drop("members") if both else keyed(q)
    bucket = [*inner, "_lsh", "_bucket"]
    sizes = c.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    if not both:
        sizes = sizes.unionByName(q.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")))
    limit = small_bucket or SMALL_BUCKET
    large = cut_lineage(sizes.filter(F.col("_n") > limit).select(*bucket).distinct())
    place = ["_place"] if placed else []
    rows = c.select(*bucket, "fp", "pc", "members", *place, F.lit(ASKS_AND_IS_ASKED if both else IS_ASKED).alias("_side"))
    if not both:
        asks = F.lit(None).cast(c.schema["members"].dataType).alias("members")
        rows = rows.unionByName(q.select(*bucket, "fp", "pc", asks, *place, F.lit(ASKS).alias("_side")))
    some = not large.isEmpty()
    small = (lookup_join(rows, large, bucket, ["fp"], "left_anti") if some else rows).dropna(subset=list(inner))
    types = dict(c.dtypes)
    schema = ", ".join(f"`{name}` {types[name]}" for name in inner) + ", fp binary, distance double, key bigint"
    hits = small.repartition(tasks, *bucket).sortWithinPartitions(*bucket).mapInArrow(_bucket_kernel(keep, bucket, inner, floor, placed), schema)
    if some:
        hot_q, hot_c = (lookup_join(side, large, bucket, ["fp"], "left_semi") for side in (q, c))
        hot_q = hot_q.select(*bucket, "fp", "pc", F.lit(floor).alias("floor"))
        settled = None
        if at_once:
            many = all_c.groupBy(*inner).agg(F.count(F.lit(1)).alias("_all_n")).filter(F.col("_all_n") > WIDE_ROWS)
            of_bucket = hot_c.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).join(many, list(inner))
            share = skew_join(hot_q, of_bucket, bucket, ["fp"]).groupBy(*inner, "fp", "pc").agg(F.sum(F.col("_n") / F.col("_all_n")).alias("_share"))
            wide = cut_lineage(share.filter(F.col("_share") > WIDE_SHARE).select(*inner, "fp", "pc"))
            if not wide.isEmpty():
                settled = cut_lineage(at_once(wide))
                hot_q = hot_q.join(settled.select(*inner, "fp"), [*inner, "fp"], "left_anti").select(hot_q.columns)
        # There are many buckets, so each is cut into few blocks: rows are sent to fewer, and more of them meet a raised floor.
        layout = _layout(hot_q, hot_c, bucket, BUCKET_BLOCKS * block_rows, BUCKET_PARTS)
        from_large = _search_blocks(hot_q, hot_c, layout, bucket, keep,
                                    lambda b: _best_possible(F.col("pc"), b) >= F.lit(floor - SLACK))
        hits = hits.unionByName(from_large.select(*inner, "fp", "distance", "key"))
        if settled is not None:
            rest = hits.join(settled.select(*inner, "fp"), [*inner, "fp"], "left_anti")
            return _best_rows(rest, inner, keep).unionByName(settled)
    return _best_rows(hits, inner, keep)


# --- prefixes of rare bits --------------------------------------------------------------------------------------


def bits_by_frequency(distinct: DataFrame, n_bits: int) -> np.ndarray:
    """Bit numbers, rarest first, ties by number. Every task returns one row of ``n_bits`` counts."""
    def run(batches):
        counts = np.zeros(n_bits, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                counts += _flags(batch.column(0).slice(lo, BLOCK_ROWS), n_bits).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_bits)), pa.array(counts)], names=["bit", "n"])

    counts = distinct.select("fp").mapInArrow(run, "bit long, n long").groupBy("bit").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(n_bits, np.int64)
    for r in counts:
        n[r["bit"]] = r["n"]
    return np.lexsort((np.arange(n_bits), n))


def nearest_within(queries: DataFrame, candidates: DataFrame | None, k: int, min_similarity: float, by: Sequence[str] = (),
                   n_bits: int = fpx.CIRCULAR_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """:func:`nearest` with a floor, through an inverted index on rare bits; exact.

    Bits are ordered from rare to frequent. Two sets of similarity t and sizes of at least n share a bit among the first
    ``n - ceil(t * n) + 1`` of either, so a row is listed under these bits only. Inside a list the sizes and the place of the bit bound what
    a pair can share before its bits are compared. For wide, sparse fingerprints; where most
    bits are set, as in 166-bit prints of long texts, the bands of :func:`nearest` visit fewer pairs.

    The lists are measured first. They get longer with the table, as there are never more than ``n_bits``, and a pair is met in each list
    that both are in. Once one has more than ``LONG_LIST`` rows, all rows are compared in the blocks of :func:`nearest` instead, each pair
    at most once and only where folds of the two prints are near enough; no row is repeated for its bits and no list is cut.
    """
    inner = [*by, GROUP]
    exclude_self = candidates is None
    keep = k + 1 if exclude_self else k
    q_rows = _encoded(queries, by)
    c_rows = q_rows if exclude_self or candidates is queries else _encoded(candidates, by)
    c = cut_lineage(_distinct(c_rows, inner, keep))
    q = None if exclude_self else cut_lineage(_distinct(q_rows, inner, 1).drop("members"))
    order = bits_by_frequency(c, n_bits)

    @F.arrow_udf("array<struct<bit:bigint,place:int>>")
    def prefix(fp: pa.Array) -> pa.Array:
        ranks, places, lengths = [], [], []
        for lo in range(0, len(fp), BLOCK_ROWS):
            on = _flags(fp.slice(lo, BLOCK_ROWS), n_bits)[:, order]
            size = on.sum(axis=1)
            length = size - np.ceil(min_similarity * size - ROUGH_SLACK).astype(np.int64) + 1
            place = on.cumsum(axis=1, dtype=np.int32)
            row, rank = np.nonzero(on & (place <= length[:, None]))
            ranks.append(rank)
            places.append(place[row, rank] - 1)
            lengths.append(np.bincount(row, minlength=len(on)))
        ends = pa.array(np.r_[0, np.cumsum(np.concatenate(lengths))], pa.int32()) if lengths else pa.array([0], pa.int32())
        items = pa.StructArray.from_arrays([pa.array(np.concatenate(ranks or [[]]), pa.int64()),
                                            pa.array(np.concatenate(places or [[]]), pa.int32())], names=["bit", "place"])
        return pa.ListArray.from_arrays(ends, items)

    def listed(marked: DataFrame) -> DataFrame:
        rows = marked.select("*", F.explode("_marks").alias("_p")).drop("_marks")
        return rows.select("*", F.lit(0).alias("_lsh"), F.col("_p.bit").alias("_bucket"), F.col("_p.place").alias("_place")).drop("_p")

    def longest(side: DataFrame) -> int:
        lists = side.select(*inner, F.explode(prefix("fp")).alias("_p")).groupBy(*inner, "_p.bit").count()
        return lists.agg(F.max("count")).head()[0] or 0

    if any(longest(side) > LONG_LIST for side in (c, q) if side is not None):
        best = _exact(c if exclude_self else q, c, inner, keep, float(min_similarity), block_rows, False)
    else:
        best = _bucket_search(q, c, inner, keep, prefix("fp"), listed, block_rows, float(min_similarity), LONG_LIST, True)
    return _per_row(q_rows, best, inner, k, exclude_self, by)


# --- quality of a search ----------------------------------------------------------------------------------------


def self_recall(table: DataFrame, search: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """``queries, recall, same``: how many rows have a first neighbour in their own table, the share whose neighbour is the row itself,
    and the share whose neighbour has an equal fingerprint (of a copy group only the smallest key finds itself).

    The default search is exact and only looks at equal fingerprints, as a row is at distance 0 of itself.
    """
    top = search(table, table, 1) if search else nearest(table, table, 1, min_similarity=1.0)
    return top.agg(
        F.count(F.lit(1)).alias("queries"), F.avg((F.col("key") == F.col("query_id")).cast("double")).alias("recall"),
        F.avg((F.col("distance") == 0.0).cast("double")).alias("same"),
    )


def recall(found: DataFrame, exact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of exact neighbour rows that another search also returns."""
    keys = ["query_id", *by, "key"]
    marked = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("_hit")), keys, "left")
    return marked.agg(F.avg(F.coalesce(F.col("_hit"), F.lit(0)).cast("double")).alias("recall"))


def with_payload(neighbours: DataFrame, entities: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                 hot_from: DataFrame | None = None) -> DataFrame:
    """Attach string or label of each neighbour; a key that is everybody's neighbour is salted."""
    return skew_join(neighbours, entities.select("key", *by, *columns), [*by, "key"], ["query_id"], hot_from=hot_from)
