"""Data-quality checks that return counts instead of failing on one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_checks(rows: DataFrame, assigned: DataFrame, key: str, group: Sequence[str] = ()) -> DataFrame:
    """One row: total rows, rows without a split, rows with more than one, groups spread over several splits."""
    per_key = assigned.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    joined = rows.select(key).join(per_key, key, "left")
    report = joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_n").isNull()).alias("missing"),
        F.count_if(F.col("_n") > 1).alias("overlapping"),
    )
    if not group:
        return report
    leaks = (assigned.groupBy(*group).agg(F.min("split").alias("_lo"), F.max("split").alias("_hi"))
             .agg(F.count_if(F.col("_lo") != F.col("_hi")).alias("leaking_groups")))
    return report.withColumn("leaking_groups", leaks.scalar())


def same_rows(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows found on one side only, compared as multisets."""
    a, b = left.select(*columns), right.select(*columns)
    count = F.count(F.lit(1))
    return (a.exceptAll(b).agg(count.alias("left_only"))
            .withColumn("right_only", b.exceptAll(a).agg(count.alias("n")).scalar()))


def violations(df: DataFrame, **rules) -> DataFrame:
    """One row with the number of rows that break each named rule; an unknown (NULL) outcome counts as broken."""
    return df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
