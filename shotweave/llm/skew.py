"""Joins and graph steps that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.session import cut_lineage

HOT_GROUPS = 1000
LEAST_PARTS, ROWS_A_PART = 8, 50_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Left join of ``rows`` to ``groups`` (one row per key, ``size`` = its number of rows in ``rows``).

    Groups with more than a thousandth of the grouped rows, at most 1000 by arithmetic, are broadcast; the keys left for
    the shuffled join are all small. ``groups`` is read twice, its size is measured first.
    """
    keys = list(keys)
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) * HOT_GROUPS > total
    values = [c for c in groups.columns if c not in keys]
    seen = rows.join(F.broadcast(groups.filter(large)), keys, "left")
    hot = seen.filter(F.col(size).isNotNull())
    rest = seen.filter(F.col(size).isNull()).drop(*values).join(groups.filter(~large), keys, "left")
    return hot.unionByName(rest.select(hot.columns))


def afresh(df: DataFrame, key: str) -> DataFrame:
    """The same rows without their known placement by ``key`` (a long): the next join then shuffles both sides, and the adaptive
    planner can split a hot key, which it does only between two shuffles."""
    return df.withColumn(key, F.col(key) + F.lit(0))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``edges(a, b)`` (a checkpoint or table, it is read in every round); the component is its
    smallest node.

    Every round takes the smallest label of the neighbours and then the label of that label, so distances halve; the number of
    rounds grows with the logarithm of the longest path. Labels are checkpointed once a round. Minima are pre-aggregated, joins
    on hot nodes can be split by the adaptive planner. Every round shuffles six times, and a task leaves files in each; what a round
    shuffles and writes comes from as many tasks as the number of edges calls for, not from one for each shuffle partition.
    """
    parts = max(LEAST_PARTS, -(-edges.count() // ROWS_A_PART))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(parts)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")).coalesce(parts)
    while True:
        near = afresh(both, "a").join(afresh(labels, "node").withColumnRenamed("node", "a"), "a").coalesce(parts)
        low = near.groupBy(F.col("b").alias("node")).agg(F.min("component").alias("low"))
        step = labels.join(low, "node", "left").select(
            "node", F.least("component", "low").alias("component"), F.col("component").alias("old")).coalesce(parts)
        up = step.select(F.col("node").alias("component"), F.col("component").alias("top"))
        jumped = cut_lineage(afresh(step, "component").join(afresh(up, "component"), "component", "left").select(
            "node", F.least("component", F.coalesce("top", "component")).alias("component"), "old").coalesce(parts))
        labels = jumped.select("node", "component")
        if jumped.filter("component != old").isEmpty():
            return labels
