"""Keyed stream operators: price changes per offer and offers that leave the fresh set.

State is one small row per offer in key buckets (``streaming.buckets``). A micro-batch puts the stored rows before its own, judges all offers at
once with windows in the JVM, and publishes the offers that it changed as deltas; no offer costs a call of its own. A batch that runs again after
a failure reads the state before it and writes the same folders, and one that had published does nothing, so a restarted query goes on where
the last finished batch ended. One offer's rows of one micro-batch are sorted in one task, on disk when they are many.
"""

from __future__ import annotations

import datetime as dt
import time as clock
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quotegrain.session import cut_lineage
from quotegrain.streaming.buckets import BucketedState


@dataclass(frozen=True)
class Keyed:
    """A stream and its step: ``step(batch, stored)`` gives the output rows and the changed rows of the state."""

    rows: DataFrame
    keys: list[str]
    step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]
    #: Whether the step looks at offers that have no row in the batch.
    all_offers: bool = False


def with_stored(own: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows of a batch and the ``stored`` ones, told apart by ``_old``."""
    own = own.withColumn("_old", F.lit(False))
    return own if stored is None else own.unionByName(stored.withColumn("_old", F.lit(True)), allowMissingColumns=True)


def changes(stream: DataFrame, keys: list[str], arrival: list[str], time: str, state: list[str], keep_ms: int | None = None) -> Keyed:
    """(kind, keys, arrival, time, state): ``change`` rows of the history and ``late`` rows, which change nothing.

    Equal times pass. Nulls are values of a state; rows without a time pass. With ``keep_ms`` an offer not seen for so long (processing time) is
    forgotten and its next row is a first sighting.
    """
    columns = list(dict.fromkeys([*keys, *arrival, time, *state]))
    held = [f"_s{k}" for k in range(len(state))]

    def step(batch: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        now = round(clock.time() * 1000)
        if stored is not None:
            stored = (stored if keep_ms is None else stored.where(F.col("_seen") > now - keep_ms)).select(*keys, "_time", *held)
        own = batch.select(*columns, F.col(time).alias("_time"), *(F.col(c).alias(s) for c, s in zip(state, held, strict=True)))
        first = [F.col("_old").desc(), *(F.asc_nulls_first(c) for c in arrival)]
        ordered = Window.partitionBy(*keys).orderBy(*first)
        before = F.max("_time").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = with_stored(own, stored).withColumns({
            "_late": F.coalesce(before > F.col("_time"), F.lit(False)), "_newest": F.max("_time").over(whole), "_met": F.bool_or(~F.col("_old")).over(whole)})
        # Late rows are a run of their own, so the neighbours of a row in time are rows in time.
        run = Window.partitionBy(*keys, "_late").orderBy(*first)
        differs = reduce(or_, (~F.col(s).eqNullSafe(F.col(f"_previous.{s}")) for s in held), F.col("_previous").isNull())
        rows = rows.withColumns({"_previous": F.lag(F.struct(*held)).over(run), "_last": F.lead(F.lit(True)).over(run).isNull() & ~F.col("_late")})
        kind = F.when(F.col("_old"), None).when(F.col("_late"), "late").when(differs, "change")
        judged = cut_lineage(rows.withColumn("_kind", kind).where("_kind IS NOT NULL OR (_last AND _met)").drop("_previous"))
        output = judged.where("_kind IS NOT NULL").select(F.col("_kind").alias("kind"), *columns)
        kept = judged.where("_last").select(*keys, F.col("_newest").alias("_time"), *held, F.lit(now).alias("_seen"))
        return output, kept

    return Keyed(stream.select(*columns), keys, step)


def expiries(stream: DataFrame, keys: list[str], time: str, window: dt.timedelta, delay: str, until: str | None = None) -> Keyed:
    """(keys, last checked, expired_at): offers that left the fresh set, when the stream's time passed the moment.

    An offer is fresh while its newest check is at most ``window`` old and before its own end (``until``, if any). The time of the stream is
    ``delay`` behind its newest row. A check that arrives after the offer had left brings it back, and it can leave again;
    a check that comes in time moves the moment. Rows without a time are left out. Times count in milliseconds. Output does not depend on
    where batches are cut.
    """
    moment = F.unix_millis(F.col(time).cast("timestamp"))
    forever = F.lit(1 << 62)
    end = F.coalesce(F.unix_millis(F.col(until).cast("timestamp")), forever) if until else forever
    length = round(window.total_seconds() * 1000)

    def step(batch: DataFrame, stored: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        # First moment at which the check is too old, or the offer's own end; what is over before it was seen was never fresh.
        leaves = F.least(F.col("checked") + length + 1, F.col("until"))
        own = batch.where("checked IS NOT NULL").withColumn("leaves", leaves).withColumn("gone", F.col("leaves") <= F.col("checked"))
        both = with_stored(own, stored)
        reached = both.agg(F.unix_millis(F.timestamp_millis(F.max("checked")) - F.expr(f"INTERVAL {delay}"))).first()[0]
        offer = Window.partitionBy(*keys)
        newest = F.max(F.when(F.col("_old"), F.col("checked"))).over(offer)
        run = offer.orderBy(F.col("_old").desc(), "checked", "until")
        # A check older than the stored one changes nothing.
        rows = both.withColumn("_newest", newest).where("_newest IS NULL OR checked >= _newest").withColumn("_next", F.lead("checked").over(run))
        left = ~F.col("gone") & (F.col("leaves") <= F.coalesce("_next", F.lit(reached)))
        judged = rows.withColumns({"_left": left, "_last": F.col("_next").isNull()}).where("_left OR (_last AND NOT _old)")
        judged = cut_lineage(judged.select(*keys, "checked", "leaves", "gone", "_left", "_last"))
        output = judged.where("_left").select(*keys, F.timestamp_millis("checked").alias(time), F.timestamp_millis("leaves").alias("expired_at"))
        return output, judged.where("_last").select(*keys, "checked", "leaves", (F.col("gone") | F.col("_left")).alias("gone"))

    return Keyed(stream.select(*keys, moment.alias("checked"), end.alias("until")), keys, step, True)


def to_files(found: Keyed, root: str, **trigger) -> StreamingQuery:
    """Append the output under ``root``, until the input is used up unless another trigger is given. A batch has a folder of its own, which
    a second run of it overwrites; state and progress lie beside it.
    """
    store = BucketedState(f"{root}/state", {"offers": found.keys}, found.keys)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if store.done(spark, batch_id):
            return
        buckets = list(range(store.buckets))
        met = buckets if found.all_offers else store.touched(batch)
        output, changed = found.step(batch, store.rows(spark, store.before(spark, batch_id), "offers", met))
        output.write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")
        # Published last: a batch without its release runs again as a whole.
        store.write(spark, batch_id, {"offers": changed}, buckets)

    writer = found.rows.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/progress")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
