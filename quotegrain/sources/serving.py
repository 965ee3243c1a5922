"""Stored current state that the serving queries read: one row per offer with its listing and source, bucketed by medication.

An ingest ends by writing this table; queries of one medication, of an exact quantity or of the cheapest offer read it without
replaying observations, and group or join by medication without a shuffle. Listings without offers have one row whose offer columns
are null. The table is written once per state of its input: its name carries the sizes and times of the input files, so a changed
input is a new table and an old one is never read by mistake.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegrain.plans import offers as plan
from quotegrain.session import shared_dir
from quotegrain.sources.bridge import VIEWS

#: Bytes of input per bucket.
BUCKET_BYTES = 32 << 20
LEAST_BUCKETS = 8


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(hadoop))


def write(offers: DataFrame, listings: DataFrame, sources: DataFrame, name: str, path: str, buckets: int) -> None:
    """Save the enriched offers as table ``name`` with files under ``path``, one file per bucket.

    ``offers`` as they are observed; what follows from an offer itself is added once the rows lie in their buckets, so that it is never shuffled.
    """
    held = plan.listings_with_offers(offers.withColumn("_offered", F.lit(True)), listings, sources).repartition(buckets, "medication_id")
    added = [c for c in held.columns if c not in offers.columns]
    full = offers.sparkSession.sql(VIEWS["b_offer_rows"].replace("FROM b_offers", f", {', '.join(added)} FROM {{held}}"), held=held)
    derived = [c for c in full.columns if c not in held.columns]
    rows = full.withColumns({c: F.when(F.col("_offered"), F.col(c)) for c in derived}).drop("_offered")
    rows.write.option("path", path).bucketBy(buckets, "medication_id").sortBy("medication_id").saveAsTable(name)


def rows(t) -> DataFrame:
    """The stored rows of a folder of tables, written on first use in an application."""
    spark = t.spark
    files = _files(spark, f"{t.folder}/lineitem.parquet")
    mark = hashlib.sha256(repr((t.folder, files, spark.sparkContext.applicationId)).encode()).hexdigest()[:16]
    name = f"quotegrain_serving_{mark}"
    if not spark.catalog.tableExists(name):
        size = sum(length for _, length, _ in files)
        path = f"{shared_dir(spark).rstrip('/')}/quotegrain-serving/{mark}"
        write(t.offers, t.listings, t.sources, name, path, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))
    return spark.table(name)
