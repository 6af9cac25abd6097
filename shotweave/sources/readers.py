"""Scans of the pipeline's file formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave import catalog
from shotweave.sources.shards import listing

Hook = Callable[[DataFrame], DataFrame]

INSTRUCTION_SCHEMA = "instruction string, input string, output string"


def benchmark_csv(spark: SparkSession, path: str, dataset: str, pre_filter: Hook | None = None,
                  pre_transform: Hook | None = None) -> DataFrame:
    """``(smiles, y)`` of a downstream data set: its string column and its label columns as array<double>.

    Columns are taken by position; blank labels are NULL; quoted text may hold commas. The hooks are functions of the whole table
    and become part of its plan: first the filter, then the change.
    """
    _, _, smiles_at, y_from, y_to = catalog.dataset_entry(dataset)
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    names = raw.columns
    labels = [F.col(f"`{c}`").try_cast("double") for c in names[y_from:y_to]]
    rows = raw.select(F.col(f"`{names[smiles_at]}`").alias("smiles"), F.array(*labels).alias("y"))
    for hook in (pre_filter, pre_transform):
        rows = rows.transform(hook) if hook else rows
    return rows


def property_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide property table as text; kinds are inferred per column by ``column_kinds``."""
    return spark.read.csv(path, header=True, quote='"', escape='"')


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headerless tab-separated table."""
    return spark.read.csv(path, sep="\t", schema=schema)


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def instructions(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines instruction rows; partition folders such as ``shot=4`` become columns."""
    return spark.read.schema(INSTRUCTION_SCHEMA).json(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def prompt_catalog(spark: SparkSession, path: str, augmented: bool = False) -> DataFrame:
    """Prompt catalogue file (nested JSON, comments allowed) as one row per variant."""
    nested = catalog.AUGMENTED_SCHEMA if augmented else catalog.CATALOG_SCHEMA
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", nested, {"allowComments": "true"}).alias("nested"))
    return (catalog.explode_augmented if augmented else catalog.explode_catalog)(parsed, "nested")


def shards(spark: SparkSession, folder: str, *columns: str, max_shards: int | None = None) -> DataFrame:
    """Parquet shards with ``shard`` (file name without ending), ``first_key`` from the name, and ``key``; the first ``max_shards`` files
    in the order of their names.

    The first key is the number before ``-``, or the one after the last ``_``. A row's key is
    the first key plus its position in the file.
    """
    if max_shards is None:
        table = spark.read.option("pathGlobFilter", "*.parquet").parquet(folder)
    else:
        table = spark.read.parquet(*[path for _, path in listing(spark, folder, max_shards)])
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", "")
    first = F.when(name.contains("_"), F.regexp_extract(name, r"_(\d+)$", 1)).otherwise(
        F.regexp_extract(name, r"^(\d+)-", 1)
    )
    picked = columns or table.columns
    return table.select(
        *picked, name.alias("shard"), first.try_cast("bigint").alias("first_key"),
        (first.try_cast("bigint") + F.col("_metadata.row_index")).alias("key"),
    )
