"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "shotweave") -> SparkSession:
    """A session for tests and benchmarks. On a cluster the caller's own session is used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor, so a
    missing setting is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shotweave-checkpoint-")
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def task_slots(spark: SparkSession) -> int:
    """Number of partitions that keeps the cluster busy in a CPU-bound stage."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *columns: str, scan: DataFrame | None = None) -> DataFrame:
    """Shuffle ``df`` over all cores only if its scan (``scan``, where ``df`` is a selection from that table) has fewer splits than cores.

    A table of many files or row groups already has enough splits and is
    returned as it is; one small file with an expensive per-row expression
    is not worth running on one core.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    if (df if scan is None else scan).rdd.getNumPartitions() >= 4 * slots:
        return df
    return df.repartition(slots, *columns) if columns else df.repartition(slots)
