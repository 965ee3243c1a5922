"""Session settings and lineage cutting, in one place."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when the split costs another shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Set by ``tune`` only, for the jobs over tables.
SIZES = {
    # Tasks of few megabytes, so that sorts stay in memory however large the input is; AQE merges the small ones.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.files.maxPartitionBytes": "32MB",
    # Rows in buckets of their listing are joined on more columns where they lie.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(master: str | None = None, app: str = "quotegrain", **extra: str) -> SparkSession:
    """Session for tests and benchmarks; on a cluster the submitter passes its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> None:
    """Runtime settings the jobs rely on, for a session somebody else made."""
    for key in SETTINGS:
        if key.startswith("spark.sql.adaptive."):
            spark.conf.set(key, SETTINGS[key])
    for key, value in SIZES.items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    folder of its own, since there every task runs on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = os.environ.get("QUOTEGRAIN_LOCAL_DIR") or tempfile.mkdtemp(prefix="quotegrain-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and keeps iterative plans short."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def in_buckets(df: DataFrame, by: list[str], buckets: int, deal: bool = True) -> DataFrame:
    """``df`` staged as a columnar table in buckets of ``by``, which later windows and joins over these columns read without a shuffle.

    A key's rows are one task's, so it is for keys that are known not to be hot. ``deal=False``: the rows lie in their buckets already.
    """
    spark, name = df.sparkSession, f"quotegrain_staged_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/quotegrain-staged/{name}"
    rows = df.repartition(buckets, *by) if deal else df
    # A task's rows are one bucket's: it opens one file and need not sort by bucket first.
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    set_before = spark.conf.get(writers)
    spark.conf.set(writers, "2")
    try:
        rows.write.option("path", path).bucketBy(buckets, *by).saveAsTable(name)
    finally:
        spark.conf.set(writers, set_before)
    return spark.table(name)


def in_files(df: DataFrame) -> DataFrame:
    """``df`` staged as columnar files, for rows that several results read."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quotegrain-staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when a scan has fewer partitions than there are cores, before row work that is
    heavy on the processor. A large input has more partitions than that and passes through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
