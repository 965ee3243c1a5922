"""Observations as a stream: each micro-batch runs the batch jobs against the state that the one before published.

The state lies in key buckets (``streaming.buckets``), so a batch reads and rewrites the buckets of its own listings only. A retried
batch reads the same release and writes the same folders again, so a lost executor or a restart changes nothing. The jobs inside are
the batch operators, which stay in the JVM and split a hot listing over many tasks; per-offer change detection and expiry keep one small row
per offer in the same kind of state (``streaming.keyed``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quotegrain.plans import ingest
from quotegrain.session import cut_lineage, shared_dir
from quotegrain.streaming.buckets import BucketedState


def new_root(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _version(root: str, table: str, batch_id: int) -> str:
    return f"{root}/{table}/batch={batch_id}"


def run(stream: DataFrame, root: str, handle, available_now: bool = True) -> StreamingQuery:
    """Start ``handle(batch, batch_id)`` per micro-batch with its progress under ``root``."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_table(spark: SparkSession, root: str, table: str, schema=None) -> DataFrame:
    return spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")


def ingest_state(root: str, offer_key: list[str], **settings) -> BucketedState:
    return BucketedState(root, {"listings": ingest.LISTING, "offers": [*ingest.LISTING, *offer_key]}, ingest.LISTING, **settings)


def ingest_stream(store: BucketedState, offer_key: list[str], number, order: list[str] | None = None):
    """Handler for the full ingest. ``number(batch)`` adds seq, the arrival number within the listing.

    With ``order`` it leaves seq out, and the rows are numbered in that order by the shuffle that stages them.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if store.done(spark, batch_id):
            return
        rows = number(batch)
        # The batch is read twice: for the sizes of its listings, which every count and state lookup uses, and to stage it.
        sizes = cut_lineage(ingest.listing_sizes(rows))
        buckets = store.touched(sizes)
        before = store.before(spark, batch_id)
        stored = (store.rows(spark, before, name, buckets, sizes) for name in ("listings", "offers"))
        done = ingest.apply(rows, offer_key, *stored, keep=True, order=order, sizes=sizes)
        done.history.write.mode("overwrite").parquet(_version(store.root, "history", batch_id))
        done.decisions.where("outcome <> 'accepted'").select(*ingest.LISTING, "observed_at", "outcome").write.mode(
            "overwrite"
        ).parquet(_version(store.root, "quarantine", batch_id))
        # Published last: a batch without its release runs again as a whole.
        store.write(spark, batch_id, {"listings": done.listings, "offers": done.offers}, buckets)

    return handle


def dedupe_replays(stream: DataFrame, key: str, time: str, horizon: str) -> DataFrame:
    """First copy of a request or evidence key; the watermark bounds how long a key is remembered."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def daily_runs(stream: DataFrame, time: str, offset: str, lateness: str, key: str) -> DataFrame:
    """Runs per tumbling day window from an anchor offset, split by whether they met the two-hour deadline.

    Runs past the deadline are counted apart, not dropped.
    """
    slot = F.window(time, "1 day", "1 day", offset)
    in_time = F.col(time) < F.col("slot.start") + F.expr("INTERVAL 2 HOURS")
    return (
        stream.withWatermark(time, lateness)
        .withColumn("slot", slot)
        .groupBy("slot", key)
        .agg(F.count(F.lit(1)).alias("runs"), F.count_if(in_time).alias("in_time"))
    )
