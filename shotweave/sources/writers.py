"""Sinks. Folders are partitioned by the columns that the flat files carry in their names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 2_000_000


def parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ("assayid",), mode: str = "overwrite") -> None:
    """Statistics stay on, so filters reach the files. Only partitions that occur in ``df`` are replaced.

    Rows stay where they are: a hot partition value is written by all tasks that hold it.
    """
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE)
    writer.partitionBy(*partition_by).parquet(path)


def fingerprints(table: DataFrame, path: str, partition_by: Sequence[str] = ("dataset", "task_id"),
                 mode: str = "overwrite") -> None:
    """Fingerprint table sorted by popcount inside each task's files, so popcount ranges prune row groups."""
    columns = [c for c in partition_by if c in table.columns]
    clustered = table.sortWithinPartitions(*columns, "popcount")
    writer = clustered.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*columns) if columns else writer).parquet(path)


def instructions(df: DataFrame, path: str, partition_by: Sequence[str] = ("shot", "dataset", "task_id"),
                 mode: str = "overwrite", numbers: bool = False) -> None:
    """JSON lines with ``instruction, input, output``; with ``numbers`` (regression) the output is a JSON number."""
    columns = [c for c in partition_by if c in df.columns]
    output = F.col("output").cast("double").alias("output") if numbers else "output"
    rows = df.select(*columns, "instruction", "input", output)
    writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE)
    (writer.partitionBy(*columns) if columns else writer).json(path)


def tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, sep="\t", header=False)


def scores(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Score table (one row per task) as one CSV file."""
    df.repartition(1).write.mode(mode).csv(path, header=True)


def load_or_create(spark: SparkSession, path: str, create: Callable[[], DataFrame]) -> DataFrame:
    """Read a persisted split, or create and persist it first.

    A new table is written aside and published by one rename that fails if the target is there. Of several creators one wins; the
    others drop their own and read the winner's. A folder without success marker is an attempt that broke off and is replaced.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    done = hadoop.Path(target, "_SUCCESS")
    if not system.exists(done):
        aside = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
        create().write.parquet(aside.toString())
        if not _publish(spark, system, aside, target) and not system.exists(done):
            system.delete(target, True)
            _publish(spark, system, aside, target)
        system.delete(aside, True)
    return spark.read.parquet(path)


def _publish(spark: SparkSession, system, aside, target) -> bool:
    """Rename ``aside`` to ``target``; false if that is taken."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(system.makeQualified(aside), system.makeQualified(target), none)
    except Py4JJavaError as error:
        taken = ("FileAlreadyExistsException", "FileNotFoundException", "IOException")
        if error.java_exception.getClass().getSimpleName() not in taken or not system.exists(target):
            raise
        return False
    return True
