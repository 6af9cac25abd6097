"""Exact ranks and running totals that never put a whole group into one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotweave.session import cut_lineage, task_slots


def hash_order(seed: int | str, *ids: str | Column) -> Column:
    """Reproducible random sort key: md5 of ``seed:id``; the same in any engine with md5."""
    parts = [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def hash_uniform(seed: int | str, *ids: str | Column) -> Column:
    """Uniform number in [0, 1) from the first 8 hex digits of :func:`hash_order`."""
    head = F.substring(hash_order(seed, *ids), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16**8))


def hash_pick(size: Column, seed: int | str, *ids: str | Column) -> Column:
    """Index in ``0 .. size-1`` chosen by hash."""
    head = F.substring(hash_order(seed, *ids), 1, 8)
    return (F.conv(head, 16, 10).cast("bigint") % size).cast("int")


def hash_rank(df: DataFrame, ids: Sequence[str], seed: int | str, by: Sequence[str] = (),
              rank: str = "rank", total: str = "total") -> DataFrame:
    """Add the position of each row in hash order inside its group, and the group's size.

    ``ids`` must be unique inside a group. The hash is uniform, so its first
    hex digits cut every group, however large, into even and ordered buckets.
    Row numbers are taken inside (group, bucket) and shifted by the number of rows
    in the group's earlier buckets: one shuffle of the rows, plus a
    partially aggregated count pass. The bucket is one struct column, so the
    window and the join share that shuffle, and a null group is a group.
    """
    by, ids = list(by), list(ids)
    digits = max(1, math.ceil(math.log(4 * task_slots(df.sparkSession), 16)))
    hashed = df.withColumn("_h", hash_order(seed, *ids)).withColumn(
        "_k", F.struct(F.struct(F.lit(0).alias("_all"), *by).alias("g"), F.substring("_h", 1, digits).alias("b"))
    )
    counts = hashed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_k.g")
    earlier = group.orderBy("_k.b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "_k", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias(total)
    )
    local = Window.partitionBy("_k").orderBy("_h", *ids)
    ranked = hashed.withColumn("_local", F.row_number().over(local)).join(shifts, "_k")
    return ranked.withColumn(rank, F.col("_before") + F.col("_local")).select(*df.columns, rank, total)


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Running sums in sorted order inside each group, spread over all tasks.

    ``sums`` maps a value column to the output column for its inclusive
    running sum. ``(by, order)`` must be unique. Rows are
    range-partitioned on ``(by, order)``, so a hot group covers several
    partitions; windows run inside (group, partition) pieces, and each piece is
    shifted by the totals of the group's earlier pieces. The range-partitioned
    rows are checkpointed, so both passes see the same cuts.
    """
    by, order = list(by), list(order)
    pieces = cut_lineage(
        df.repartitionByRange(*by, *order).withColumn("_piece", F.spark_partition_id())
    )
    pieces = pieces.withColumn("_k", F.struct(F.struct(F.lit(0).alias("_all"), *by).alias("g"), "_piece"))
    totals = pieces.groupBy("_k").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy("_k.g").orderBy("_k._piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_k", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_s_{c}") for c in sums])
    local = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = pieces
    for c in sums:
        within = within.withColumn(f"_l_{c}", F.sum(c).over(local))
    joined = within.join(shifts, "_k")
    return joined.select(*df.columns, *[(F.col(f"_l_{c}") + F.col(f"_s_{c}")).alias(o) for c, o in sums.items()])


def dense_renumber(df: DataFrame, key: str, new: str) -> DataFrame:
    """Number the distinct keys 0, 1, 2, … in key order."""
    ones = df.select(key).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(ones, [], [key], {"_one": "_rank"})
    return ranked.select(key, (F.col("_rank") - 1).alias(new))
