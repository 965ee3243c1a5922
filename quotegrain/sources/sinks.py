"""Writers: versioned state, append-only history, evidence, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegrain.functions.hashing import sha256_text


def write_version(df: DataFrame, root: str, version: str, partition_by: str | None = None) -> str:
    """Write a whole new version of a table; readers move when the pointer does."""
    path = f"{root}/version={version}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


def point_to(spark: SparkSession, root: str, version: str) -> None:
    """Publish ``version``. A one-line file, written last, so a failed job leaves the old version current."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(hadoop, True)
    try:
        out.writeBytes(version)
    finally:
        out.close()


def current_version(spark: SparkSession, root: str) -> str | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    return spark.read.text(f"{root}/CURRENT").first()["value"]


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/version={current_version(spark, root)}")


def append_history(history: DataFrame, path: str) -> None:
    """Change rows, partitioned by month and clustered by offer inside a file."""
    rows = history.withColumn("month", F.date_format("observed_at", "yyyy-MM"))
    rows.sortWithinPartitions("month", "listing_id", "observed_at").write.mode("append").partitionBy(
        "month"
    ).parquet(path)


def evidence_path(source: Column, key_hash: Column, body_hash: Column) -> Column:
    return F.concat(source, F.lit("/"), F.substring(key_hash, 1, 20), F.lit("-"), body_hash, F.lit(".json"))


def evidence_rows(blobs: DataFrame) -> DataFrame:
    """(source, key, body) to content-addressed rows; the same key and body give the same path."""
    hashed = blobs.withColumns({"key_hash": sha256_text(F.col("key")), "body_hash": sha256_text(F.col("body"))})
    return hashed.withColumn("path", evidence_path(F.col("source"), F.col("key_hash"), F.col("body_hash")))


def new_evidence(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append: one per path, not stored yet."""
    return incoming.dropDuplicates(["path"]).join(stored.select("path"), "path", "left_anti")


def evidence_conflicts(rows: DataFrame) -> DataFrame:
    """Paths whose stored body does not have the hash the path names, or that hold two bodies."""
    named = F.regexp_extract("path", r"-([0-9a-f]{64})\.json$", 1)
    checked = rows.select("path", sha256_text(F.col("body")).alias("actual"), named.alias("named")).distinct()
    return checked.groupBy("path").agg(
        F.count(F.lit(1)).alias("bodies"), F.bool_and(F.col("actual") == F.col("named")).alias("hash_ok")
    ).where("bodies > 1 OR NOT hash_ok")


def write_report(report: DataFrame, path: str) -> None:
    """Small aggregate as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def replace_children(
    quotes: DataFrame, path: str, parent: str, spark: SparkSession, buckets: int = 256, documents: DataFrame | None = None
) -> None:
    """Replace every child row of the documents in ``quotes``, and clear those of ``documents`` that have none there.

    Documents hash into a fixed number of folders. The folders touched are rewritten whole: their
    other documents are kept, those replaced go. Rewritten rows are staged first, so no folder is read while it is
    overwritten. Only a path that does not exist counts as a first write; a failed read stops the job.
    """
    from quotegrain.session import cut_lineage

    bucket = F.pmod(F.xxhash64(parent), F.lit(buckets))
    fresh = quotes.withColumn("bucket", bucket)
    replaced = quotes.select(parent)
    if documents is not None:
        replaced = replaced.unionByName(documents.select(parent))
    replaced = replaced.distinct()
    if not _exists(spark, path):
        cut_lineage(fresh).write.mode("append").partitionBy("bucket").parquet(path)
        return
    touched = replaced.select(bucket.alias("bucket")).distinct()
    stored = spark.read.parquet(path)
    kept = stored.join(touched, "bucket", "left_semi").join(replaced, parent, "left_anti")
    merged = cut_lineage(kept.unionByName(fresh))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    # A folder whose last document went has no rows to overwrite it with.
    left = {r["bucket"] for r in merged.select("bucket").distinct().collect()}
    for row in touched.collect():
        if row["bucket"] not in left:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={row['bucket']}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
