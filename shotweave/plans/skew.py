"""Joins whose left side may hold a third of its rows under one key, and checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 10_000
LOOKUP_ROWS = 200_000
LOOKUP_BYTES = 64 << 20
KEY_ROWS = 4_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """Keys with at least ``min_rows`` rows and more than 1 in ``HOT_SHARE`` of all: by arithmetic fewer than ``HOT_SHARE`` rows
    (keys, ``_rows``), so safe to collect and to broadcast, and none is left out."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= min_rows)
    total = df.count()
    return counts.filter(F.col("_rows") * HOT_SHARE > total)


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread_on: Sequence[str] = (), how: str = "inner",
              min_rows: int | None = None, hot_from: DataFrame | None = None) -> DataFrame:
    """Equi-join of a left side that may hold a third of its rows under one key.

    Without ``min_rows`` it is the plain join: both sides are shuffled, and the adaptive planner splits partitions that turn out
    large, for every ``how`` named below. Nothing runs while the query is built.

    With ``min_rows`` hot left keys are counted first (in ``hot_from``, a written table with the same key frequencies,
    where ``left`` is costly), each is dealt over one salt per ``min_rows`` rows by ``spread_on``, and its right rows are repeated
    per salt; for joins that the planner cannot split, such as those whose other side is already in place. ``how`` is
    ``inner``, ``left``, ``left_semi`` or ``left_anti``; left rows with a NULL key match nothing and skip the join.
    """
    on = list(on)
    if min_rows is None:
        return left.join(right, on, how)
    listed = hot_keys(left if hot_from is None else hot_from, on, min_rows)
    rows = listed.collect()
    if not rows:
        return left.join(right, on, how)
    known = reduce(and_, [F.col(k).isNotNull() for k in on])
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, listed.schema).select(
        *on, F.ceil(F.col("_rows") / min_rows).cast("int").alias("_salts")))
    salted_left = left.filter(known).join(hot, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_on), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_right = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    joined = salted_left.join(salted_right, on + ["_salt"], how).drop("_salt")
    if how in ("inner", "left_semi"):
        return joined
    return joined.unionByName(left.filter(~known), allowMissingColumns=True)


def fits_broadcast(df: DataFrame, max_rows: int = LOOKUP_ROWS, max_bytes: int = LOOKUP_BYTES) -> bool:
    """Measure a table before it is broadcast; reading stops one row past the limit, two numbers reach the driver."""
    size = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("bytes")
    ).head()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def lookup_join(left: DataFrame, table: DataFrame, on: Sequence[str], spread_on: Sequence[str], how: str = "inner",
                hot_from: DataFrame | None = None, max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Join with a side that is usually small: broadcast if its measured size allows, else :func:`skew_join`.

    With few keys on the left (tasks, groups, properties) this matters twice: the
    left rows are not shuffled, and none of the few keys becomes one task. A side of nothing but numeric keys may have ``KEY_ROWS`` rows:
    texts that it selects are then not shuffled for it.
    """
    if fits_broadcast(table, max_rows):
        return left.join(F.broadcast(table), list(on), how)
    return skew_join(left, table, on, spread_on, how, hot_from=hot_from)
