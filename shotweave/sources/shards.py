"""Shuffled row shards: Parquet files named by the positions they hold, written in one permutation and read by position."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.plans.ranking import hash_rank
from shotweave.plans.skew import lookup_join

ROWS_PER_SHARD = 1_000_000


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def first_key(name: str) -> int | None:
    """First key of a shard by its file name: the number before ``-``, or the one after the last ``_``."""
    found = re.search(r"_(\d+)\.parquet$", name) if "_" in name else re.match(r"(\d+)-", name)
    return int(found[1]) if found else None


def listing(spark: SparkSession, folder: str, max_shards: int | None = None) -> list[tuple[int | None, str]]:
    """``(first key, path)`` of the Parquet files of a folder in the order of their names, at most ``max_shards`` of them."""
    system, path = _file_system(spark, folder)
    files = sorted((f.getPath().getName(), f.getPath().toString()) for f in system.listStatus(path) if f.isFile())
    files = [(first_key(name), full) for name, full in files if name.endswith(".parquet")]
    return files[:max_shards]


def write_shuffled(df: DataFrame, key: str, folder: str, rows_per_shard: int = ROWS_PER_SHARD, seed: int = 0) -> None:
    """Write the rows in random order, ``rows_per_shard`` to a file, as ``<first>-<last>.parquet``.

    Two passes: positions come from md5 order in even hash buckets, then rows are dealt by position into shards of one size, so
    no file depends on a sample and each is one task's work. ``key`` must be unique. Files are written aside and renamed into
    place; ``_SUCCESS`` comes last.
    """
    spark = df.sparkSession
    placed = hash_rank(df, [key], seed, rank="_pos", total="_total").withColumn("_pos", F.col("_pos") - 1)
    placed = placed.withColumn("_shard", F.expr(f"_pos div {int(rows_per_shard)}"))
    total = df.count()
    shards = max(1, -(-total // rows_per_shard))
    aside = f"{folder}/_aside-{uuid.uuid4().hex}"
    dealt = placed.drop("_total").repartition(shards, "_shard").sortWithinPartitions("_shard", "_pos").drop("_pos")
    dealt.write.partitionBy("_shard").parquet(aside)
    system, path = _file_system(spark, folder)
    target = spark._jvm.org.apache.hadoop.fs.Path
    width = len(str(total))
    for shard in range(shards if total else 0):
        (file,) = [f.getPath() for f in system.listStatus(target(f"{aside}/_shard={shard}")) if f.getPath().getName().endswith(".parquet")]
        first, last = shard * rows_per_shard, min(total, (shard + 1) * rows_per_shard) - 1
        system.rename(file, target(path, f"{first:0{width}d}-{last:0{width}d}.parquet"))
    system.delete(target(aside), True)
    system.create(target(path, "_SUCCESS"), True).close()


def at_positions(spark: SparkSession, folder: str, keys: DataFrame, key: str, *columns: str,
                 max_shards: int | None = None) -> DataFrame:
    """``keys`` with the ``columns`` of the rows at their keys, in a folder of shards.

    The first keys of the listing cut the keys into intervals; only files whose interval holds a wanted key are read. File names are
    on the driver, keys are not: one number per shard comes back. Keys outside all shards have no row.
    """
    files = [(first, path) for first, path in listing(spark, folder, max_shards) if first is not None]
    files.sort()
    bounds = np.array([first for first, _ in files], np.int64)

    @F.arrow_udf("int")
    def shard_of(wanted: pa.Array) -> pa.Array:
        places = np.searchsorted(bounds, wanted.to_numpy(zero_copy_only=False).astype(np.float64), side="right") - 1
        return pa.array(places, pa.int32())

    wanted = keys.filter(F.col(key).isNotNull()).select(shard_of(F.col(key).cast("long")).alias("_shard")).distinct()
    needed = sorted(r[0] for r in wanted.collect() if r[0] >= 0)
    if not needed:
        table = spark.read.parquet(files[0][1]).limit(0) if files else None
        if table is None:
            raise FileNotFoundError(f"no shards in {folder}")
    else:
        table = spark.read.parquet(*[files[i][1] for i in needed])
    name = F.col("_metadata.file_name")
    first = F.when(name.contains("_"), F.regexp_extract(name, r"_(\d+)\.parquet$", 1)).otherwise(F.regexp_extract(name, r"^(\d+)-", 1))
    rows = table.select((first.cast("bigint") + F.col("_metadata.row_index")).alias(key), *columns)
    distinct = keys.select(F.col(key).cast("bigint").alias(key)).distinct()
    found = lookup_join(rows, distinct, [key], [], "left_semi")
    return keys.withColumn(key, F.col(key).cast("bigint")).join(found, key)
