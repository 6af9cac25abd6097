"""Nearest vectors by collision counting over single random projections."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotweave.llm.registry import query, table
from shotweave.llm.skew import join_groups
from shotweave.llm.spans import flat_lists
from shotweave.session import cut_lineage

PROJECTIONS = 64
COLLISIONS = 36
CERTAINTY = 0.98
STEP = 1.5
SHARD_ROWS = 16_384
BLOCK_QUERIES = 1024


def reach(projections: int, collisions: int, certainty: float) -> float:
    """Half window, as a multiple of a distance, in which a vector that far away collides often enough with probability ``certainty``.

    A projection of the difference is normal with the distance as its deviation, so one projection collides with probability
    ``2 * Phi(half / distance) - 1`` and the number of collisions is binomial.
    """
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        some = sum(math.comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(collisions, projections + 1))
        low, high = (p, high) if some < certainty else (low, p)
    return NormalDist().inv_cdf((1 + high) / 2)


class SortedProjections:
    """One sorted array per random direction over the vectors of a shard."""

    def __init__(self, vectors: np.ndarray, projections: int):
        self.vectors = vectors
        directions = np.random.default_rng(97).standard_normal((projections, vectors.shape[1]))
        self.directions = directions
        values = directions @ vectors.T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.order, axis=1)

    def nearest(self, asked: np.ndarray, k: int, collisions: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the vectors verified for one query, at least the ``k`` nearest of them.

        Windows around the query's projections grow by ``STEP``; each round counts only what the wider windows add. A vector with
        enough collisions is verified by its true distance. The search ends when the half window is ``factor`` times the ``k``-th
        distance, so that vectors as near as that one would have been seen, or when the windows hold everything.
        """
        n = len(self.vectors)
        centre = self.directions @ asked
        counts = np.zeros(n, np.int64)
        place = np.array([np.searchsorted(v, c) for v, c in zip(self.values, centre)])
        low, high = place.copy(), place.copy()
        # The first windows hold about a tenth of the shard on the median projection.
        side = max(1, n // 20)
        ends = self.values[np.arange(len(place)), np.minimum(place + side, n - 1)]
        half = float(np.median(np.abs(ends - centre))) or float(np.abs(self.values).max()) or 1.0
        seen = np.zeros(n, bool)
        at, dist = np.zeros(0, np.int64), np.zeros(0)
        while True:
            rings = []
            for j, (v, c) in enumerate(zip(self.values, centre)):
                a, b = np.searchsorted(v, c - half), np.searchsorted(v, c + half, side="right")
                rings += [self.order[j, a:low[j]], self.order[j, high[j]:b]]
                low[j], high[j] = a, b
            counts += np.bincount(np.concatenate(rings), minlength=n)
            new = np.flatnonzero((counts >= collisions) & ~seen)
            seen[new] = True
            at = np.r_[at, new]
            dist = np.r_[dist, np.sqrt(((self.vectors[new] - asked) ** 2).sum(axis=1))]
            wanted = factor * np.partition(dist, k - 1)[k - 1] if len(dist) >= k else math.inf
            if half >= wanted or len(at) == n:
                return at, dist
            half = min(half * STEP, max(wanted, half))


def _kernel(k: int, projections: int, collisions: int, certainty: float):
    factor = reach(projections, collisions, certainty)

    def matrix(side: pa.Table) -> np.ndarray:
        values, _ = flat_lists(side["e"])
        return values.astype(np.float64).reshape(side.num_rows, -1)

    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and rows.num_rows:
            index = SortedProjections(matrix(rows), projections)
            members, starts = flat_lists(rows["members"])
            for gid, asked in zip(queries["gid"].to_pylist(), matrix(queries)):
                at, dist = index.nearest(asked, min(k, rows.num_rows), collisions, factor)
                near = np.lexsort((members[starts[at]], dist))[:k]
                at, dist = at[near], dist[near]
                times = starts[at + 1] - starts[at]
                ids = np.concatenate([members[starts[i]:starts[i + 1]] for i in at])
                dist = np.repeat(dist, times)
                first = np.lexsort((ids, dist))[:k]
                found.append((np.full(len(first), gid), ids[first], dist[first]))
        columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"gid": columns[0].astype(np.int64), "vec_id": columns[1].astype(np.int64), "score": columns[2]})

    return run


def usable(vector: Column) -> Column:
    """Vectors that are there, hold finite numbers only, and not just zeros."""
    def finite(x: Column) -> Column:
        return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x)

    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def nearest_vectors(vectors: DataFrame, asked: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
                    projections: int = PROJECTIONS, collisions: int = COLLISIONS, certainty: float = CERTAINTY,
                    shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row for which ``asked`` holds its ``k`` nearest other rows by Euclidean distance,
    ties to the smaller id; all rows, if fewer.

    Every usable row is indexed. Rows are dealt by hash into shards of about ``shard_rows`` vectors, queries into blocks; each
    (shard, block) pair is one group that builds the shard's sorted projections and returns ``k + 1`` rows a query, so nothing is
    broadcast and no group grows with the table. A neighbour is found with probability ``certainty`` at least.

    Equal vectors are searched once: a copy group can only add its ``k + 1`` smallest ids, and a row-number limit before the
    shuffle keeps just those, so a vector that a third of the rows hold costs no task more than its share. Vectors are
    compared with those of the same length. Null ids and vectors that are null, zero or hold null or non-finite numbers take
    no part; of rows repeating an id the smallest vector counts. Other columns are ignored; an empty table gives an empty result.
    """
    keep = k + 1
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e"), asked.alias("asked"))
    rows = cut_lineage(source.filter(F.col("vec_id").isNotNull() & usable(F.col("e"))).groupBy("vec_id").agg(
        F.min("e").alias("e"), F.max("asked").alias("asked")))
    order = Window.partitionBy("e").orderBy("vec_id")
    few = rows.select("vec_id", "e").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)
    classes = cut_lineage(few.groupBy("e").agg(F.min("vec_id").alias("gid"), F.array_sort(F.collect_list("vec_id")).alias("members")))
    queries = rows.filter("asked").select("vec_id", "e")
    asking = cut_lineage(queries.groupBy("e").agg(F.count(F.lit(1)).alias("size")).join(classes.drop("members"), "e"))
    shards = max(1, -(-classes.count() // shard_rows))
    blocks = max(1, -(-asking.count() // block_queries))
    tasks = min(shards * blocks, 8 * vectors.sparkSession.sparkContext.defaultParallelism)
    grid = ["width", "shard", "block"]

    def own(parts: int) -> Column:
        return F.pmod(F.xxhash64("gid"), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = asking.select("gid", "e", F.size("e").alias("width"), own(blocks).alias("block"), every(shards).alias("shard"))
    right = classes.select("gid", "e", "members", F.size("e").alias("width"), own(shards).alias("shard"), every(blocks).alias("block"))
    found = (left.repartition(tasks, *grid).groupBy(*grid).cogroup(right.repartition(tasks, *grid).groupBy(*grid))
             .applyInArrow(_kernel(keep, projections, collisions, certainty), "gid long, vec_id long, score double"))
    first = Window.partitionBy("gid").orderBy("score", "vec_id")
    best = found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= keep).groupBy("gid").agg(
        F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("hits"))
    answers = cut_lineage(asking.select("gid", "e", "size").join(best, "gid").drop("gid"))
    each = join_groups(queries.withColumnRenamed("vec_id", "query_id"), answers, ["e"], "size")
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    both = exact.join(found, ["query_id", "vec_id"], "left_semi").count()
    return both / max(1, exact.count())


@query()
def op12_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_vectors(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)
