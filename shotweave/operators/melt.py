"""Wide tables to long ones, column kinds, label masks and cleaning reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotweave.functions import cleaning
from shotweave.functions.labels import FLOAT_KIND, INT_KIND, MISSING, TEXT_KIND, plain_text


def melt_labels(wide: DataFrame, ids: Sequence[str], tasks: Sequence[str], missing: int = 0) -> DataFrame:
    """Label matrix to ``(ids, task, label)``, measured cells only."""
    long = wide.unpivot(list(ids), list(tasks), "task", "label")
    return long.filter(F.col("label").isNotNull() & (F.col("label") != missing))


def melt_properties(wide: DataFrame, ids: Sequence[str], properties: Sequence[str]) -> DataFrame:
    """Property table to ``(ids, key, value)`` with text values; nulls and empty lists dropped."""
    texts = wide.select(*ids, *[property_text(wide, p).alias(p) for p in properties])
    long = texts.unpivot(list(ids), list(properties), "key", "value")
    return long.filter(F.col("value").isNotNull() & (F.col("value") != "[]"))


def property_text(df: DataFrame, name: str) -> Column:
    """Text of a property, doubles without loss and without exponent. NaN is a missing value."""
    kind = dict(df.dtypes)[name]
    text = plain_text(df, name)
    return F.when(~F.isnan(name), text) if kind in ("double", "float") else text


def column_kinds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(key, kind)`` per column: int if every value is whole, else float if every value is a number, else str.

    One pass with map-side combine over the wide table; a column without values is int.
    """
    types, checks = dict(df.dtypes), []
    for i, name in enumerate(columns):
        whole, number = _value_checks(F.col(name), types[name])
        present = F.col(name).isNotNull() & (number_of(F.col(name), types[name]) != float("nan"))
        checks += [
            F.coalesce(F.bool_and(F.when(present, whole)), F.lit(True)).alias(f"i{i}"),
            F.coalesce(F.bool_and(F.when(present, number)), F.lit(True)).alias(f"f{i}"),
        ]
    kinds = [
        F.struct(
            F.lit(name).alias("key"),
            F.when(F.col(f"i{i}"), INT_KIND).when(F.col(f"f{i}"), FLOAT_KIND).otherwise(TEXT_KIND).alias("kind"),
        )
        for i, name in enumerate(columns)
    ]
    return df.agg(*checks).select(F.inline(F.array(*kinds)))


def number_of(value: Column, data_type: str) -> Column:
    """The value as a double, 0 where it is none; only to tell NaN (a missing value in any form) from the rest."""
    if data_type in ("float", "double"):
        return value.cast("double")
    if data_type == "string":
        return F.coalesce(value.try_cast("double"), F.lit(0.0))
    return F.lit(0.0)


def _value_checks(value: Column, data_type: str) -> tuple[Column, Column]:
    """Whether a value is whole, and whether it is a number. Typed columns are not taken through text."""
    if data_type in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return F.lit(True), F.lit(True)
    if data_type in ("float", "double") or data_type.startswith("decimal"):
        return value % 1 == 0, F.lit(True)
    number = value.cast("string").try_cast("double")
    return F.coalesce(number % 1 == 0, F.lit(False)), number.isNotNull()


def masked_labels(entities: DataFrame, labels: DataFrame, key: str, tasks: Sequence[str]) -> DataFrame:
    """One row per entity and task, the sentinel where the label is not measured."""
    wide = entities.select(key).join(labels.select(key, *tasks), key, "left")
    masked = wide.select(key, *[F.coalesce(F.col(t), F.lit(MISSING)).alias(t) for t in tasks])
    return masked.unpivot([key], list(tasks), "task", "label")


def drop_masked(long: DataFrame) -> DataFrame:
    return long.filter(F.col("label") != MISSING)


def expand_tasks(df: DataFrame, key: str, labels: str) -> DataFrame:
    """One row per entity and task of a label array, with the position it has in the task-replicated table.

    Row ``id`` of task ``t`` sits at ``id + t * n`` where n is the number of entities.
    """
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.select(key, F.posexplode(labels).alias("task_id", "label")).withColumn(
        "pos_id", F.col(key) + F.col("task_id") * n
    )


def split_valid(df: DataFrame, text: str, **limits) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the rejected rows as a side table."""
    checked = df.withColumn("_valid", F.coalesce(cleaning.is_valid(F.col(text), **limits), F.lit(False)))
    return checked.filter("_valid").drop("_valid"), checked.filter("not _valid").drop("_valid")


def clean(df: DataFrame, text: str, weight: str, **limits) -> DataFrame:
    """Add the largest component, its size and the reject reason."""
    best = cleaning.largest_component(F.col(text))
    sized = df.withColumn("_best", best)
    return sized.select(
        *df.columns,
        F.col("_best.component").alias("component"),
        F.coalesce(F.col("_best.size"), F.lit(0)).alias("size"),
    ).withColumn("reason", cleaning.reject_reason(F.col(text), F.col("size"), F.col(weight), **limits))


def reject_histogram(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def union_all(*frames: DataFrame) -> DataFrame:
    """Append disjoint row sets."""
    return reduce(DataFrame.unionByName, frames)
