"""Streaming jobs run over the tables as file streams of several micro-batches until the input is used up."""

import datetime as dt

from pyspark.sql import functions as F

from quotegrain.catalog import query
from quotegrain.catalog.history import STATE_SQL, nest_row
from quotegrain.plans.history import STATE
from quotegrain.sources import releases
from quotegrain.sources.bridge import FRESH_DAYS, VIEWS
from quotegrain.sources.tables import ARRIVAL_ORDER, OFFER_KEY
from quotegrain.streaming import ingest as streaming
from quotegrain.streaming import keyed


#: Micro-batches that a table arrives in, and more of them for the ingest, whose state is folded on the way.
PARTS, MORE_PARTS = 4, 5
#: Rows of one arriving file.
FILE_ROWS = 500_000


def table_stream(t, name, order, parts=PARTS):
    """One table as a file stream that arrives in ``parts`` micro-batches, by ranges of the number ``order``."""
    path = streaming.new_root(t.spark, "arrivals")
    rows = t.table(name)
    low, high = rows.agg(F.min(order), F.max(order)).first()
    low, high = low or 0, high or 0
    part = F.least(F.floor((F.coalesce(order, F.lit(low)) - low) * parts / F.lit(high - low + 1)), F.lit(parts - 1))
    sizes = dict(rows.groupBy(part.alias("part")).count().collect())
    # Every part has equally many files, so that a micro-batch is one part; with fewer rows than that a file could stay away.
    files = max(1, min(-(-max(sizes.values(), default=0) // FILE_ROWS), min(sizes.get(k, 0) for k in range(parts)) // 1000))
    for k in range(parts):
        rows.where(part == k).repartition(files).write.mode("append").parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def observation_stream(t, order=None, parts=PARTS):
    """Observation rows as a stream: the bridge text over the streamed lines, in arrival order unless another is given."""
    text = VIEWS["b_observations"].replace("FROM lineitem", "FROM {lines}")
    return t.spark.sql(text, lines=table_stream(t, "lineitem", F.col("l_orderkey") if order is None else order, parts))


def changes_and_late_rows(t):
    """Output of the keyed change stream over all micro-batches."""
    root = streaming.new_root(t.spark, "changes")
    keyed.to_files(keyed.changes(observation_stream(t), OFFER_KEY, ARRIVAL_ORDER, "observed_at", STATE), root).awaitTermination()
    return t.spark.read.parquet(f"{root}/rows")


@query("stream_price_changes", "STR-02", oracle="""
WITH a AS (SELECT *, MAX(observed_at) OVER (PARTITION BY listing_id, quantity ORDER BY l_orderkey, l_linenumber, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM b_observations),
k AS (SELECT * FROM a WHERE newest IS NULL OR newest <= observed_at),
c AS (SELECT *, ROW_NUMBER() OVER w AS rn, LAG(price_cents) OVER w AS pp, LAG(availability) OVER w AS pa, LAG(active) OVER w AS pv FROM k WINDOW w AS (PARTITION BY listing_id, quantity ORDER BY l_orderkey, l_linenumber, l_suppkey))
SELECT listing_id, quantity, observed_at, l_orderkey, price_cents, availability, active FROM c
WHERE rn = 1 OR price_cents IS DISTINCT FROM pp OR availability IS DISTINCT FROM pa OR active IS DISTINCT FROM pv""")
def stream_price_changes(t):
    rows = changes_and_late_rows(t).where("kind = 'change'")
    return rows.select("listing_id", "quantity", "observed_at", "l_orderkey", "price_cents", "availability", "active")


@query("stream_ingest", "STR-01", oracle=f"""
WITH RECURSIVE {STATE_SQL}
SELECT listing_id, quantity, price_cents, availability, active, observed_at AS last_checked_at FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY listing_id, quantity ORDER BY seq DESC) AS rn FROM kept) x WHERE rn = 1""")
def stream_ingest(t):
    store = streaming.ingest_state(streaming.new_root(t.spark, "ingest"), ["quantity"])
    # Rows are nested where they are staged; a count reads flat ones.
    handle = streaming.ingest_stream(store, ["quantity"], nest_row, [*ARRIVAL_ORDER, "observed_at"])
    streaming.run(observation_stream(t, parts=MORE_PARTS), store.root, handle).awaitTermination()
    offers = store.rows(t.spark, releases.load(t.spark, store.root), "offers")
    return offers.select(
        "listing_id", "quantity", "price_cents", "availability", "active", F.col("observed_at").alias("last_checked_at")
    )


@query("stream_late_rows", "STR-03", oracle="""
WITH a AS (SELECT *, MAX(observed_at) OVER (PARTITION BY listing_id, quantity ORDER BY l_orderkey, l_linenumber, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM b_observations)
SELECT CAST(COUNT(*) AS BIGINT) AS late_rows FROM a WHERE newest > observed_at""")
def stream_late_rows(t):
    """Rows that the change stream refused as late, over all its micro-batches."""
    return changes_and_late_rows(t).agg(F.count_if(F.col("kind") == "late").alias("late_rows"))


@query("stream_expiries", "STR-06", oracle=f"""
WITH o AS (SELECT DISTINCT listing_id, quantity, observed_at FROM b_observations WHERE observed_at IS NOT NULL),
n AS (SELECT *, LEAD(observed_at) OVER (PARTITION BY listing_id, quantity ORDER BY observed_at) AS following, MAX(observed_at) OVER () - INTERVAL 1 DAY AS reached FROM o)
SELECT listing_id, quantity, observed_at, observed_at + INTERVAL {FRESH_DAYS} DAY + INTERVAL 1 MILLISECOND AS expired_at FROM n
WHERE COALESCE(following, reached) > observed_at + INTERVAL {FRESH_DAYS} DAY""")
def stream_expiries(t):
    """Every time an offer left the fresh set, while observations arrived in the order of their days."""
    stream = observation_stream(t, F.unix_date(F.to_date("l_shipdate")))
    root = streaming.new_root(t.spark, "expiries")
    keyed.to_files(keyed.expiries(stream, OFFER_KEY, "observed_at", dt.timedelta(days=FRESH_DAYS), "1 day"), root).awaitTermination()
    rows = t.spark.read.parquet(f"{root}/rows")
    return rows.select("listing_id", "quantity", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("observed_at", "expired_at")))


@query("stream_dedupe", "STR-04", oracle="""
SELECT event_type, COUNT(*) AS kept FROM events GROUP BY event_type""")
def stream_dedupe(t):
    """Every request once, and every third one a second time in the same or a later micro-batch."""
    again = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    path = streaming.new_root(t.spark, "replays")
    rows = t.events.select(F.col("event_id").alias("request_key"), "event_type", F.col("ts").cast("timestamp").alias("ts"), F.explode(again).alias("copy"))
    for part in (rows.where("copy = 0 OR request_key % 2 = 0"), rows.where("copy = 1 AND request_key % 2 = 1")):
        part.repartition(2).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    first = streaming.dedupe_replays(stream, "request_key", "ts", "400 days")
    root = streaming.new_root(t.spark, "dedupe")
    done = first.writeStream.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).format("parquet").start(f"{root}/rows")
    done.awaitTermination()
    return t.spark.read.parquet(f"{root}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@query("stream_daily_runs", "STR-05", oracle="""
SELECT user_id % 2 AS source_id, date_trunc('day', ts - INTERVAL 6 HOUR) + INTERVAL 6 HOUR AS window_start, COUNT(*) AS runs,
  COUNT(*) FILTER (WHERE ts < date_trunc('day', ts - INTERVAL 6 HOUR) + INTERVAL 8 HOUR) AS in_time FROM events GROUP BY ALL""")
def stream_daily_runs(t):
    rows = table_stream(t, "events", F.col("event_id")).select((F.col("user_id") % 2).alias("source_id"), F.col("ts").cast("timestamp").alias("ts"))
    counted = streaming.daily_runs(rows, "ts", "6 hours", "2 days", "source_id")
    root = streaming.new_root(t.spark, "daily")

    def keep(batch, batch_id):
        flat = batch.select("source_id", F.col("slot.start").cast("timestamp_ntz").alias("window_start"), "runs", "in_time")
        flat.write.mode("overwrite").parquet(f"{root}/counts/batch={batch_id}")

    writer = counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = streaming.read_table(t.spark, root, "counts")
    # Update mode writes a window again when it grows; the newest batch holds its count.
    return rows.groupBy("source_id", "window_start").agg(
        F.max_by("runs", "batch").alias("runs"), F.max_by("in_time", "batch").alias("in_time")
    )
