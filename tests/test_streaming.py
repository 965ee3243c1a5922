"""Streams over several files agree with one batch, restart, and cost what their batches hold."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from quotegrain.plans import history, ingest
from quotegrain.sources import releases
from quotegrain.streaming import ingest as streaming
from quotegrain.streaming import keyed
from quotegrain.streaming.buckets import BucketedState
from tests import test_ingest

SCHEMA = "k string, seq long, at timestamp_ntz, price long"


def add_file(spark, folder, part, schema=SCHEMA):
    spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def made_rows(seed, count=90):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(rng.choice(["a", "b", "c", None]), i, start + dt.timedelta(hours=i + rng.choice([0, 0, -4])), rng.choice([1, 1, 2, None])) for i in range(count)]


def model(rows):
    newest, last, want, late = {}, {}, set(), set()
    for k, seq, at, price in rows:
        if k in newest and newest[k] > at:
            late.add((k, seq))
            continue
        newest[k] = at
        if k not in last or last[k] != price:
            want.add((k, seq))
        last[k] = price
    return want, late


def test_changes_over_batches_and_a_restart(spark, tmp_path):
    """Four files and a stop after two: rows of a batch come unsorted, the state goes on where it was, and the batch job agrees."""
    rows, folder, root = made_rows(5), str(tmp_path / "in"), str(tmp_path / "out")
    shuffled = random.Random(1)
    parts = [rows[i : i + 23] for i in range(0, 90, 23)]
    for part in parts:
        shuffled.shuffle(part)
    for run in (parts[:2], parts[2:]):
        for part in run:
            add_file(spark, folder, part)
        keyed.to_files(keyed.changes(source(spark, folder), ["k"], ["seq"], "at", ["price"]), root).awaitTermination()
    found = spark.read.parquet(f"{root}/rows").collect()
    want, late = model(rows)
    assert sorted((r["k"] or "", r["seq"]) for r in found if r["kind"] == "change") == sorted((k or "", s) for k, s in want)
    assert sorted((r["k"] or "", r["seq"]) for r in found if r["kind"] == "late") == sorted((k or "", s) for k, s in late) and late
    batch = history.late_rows(spark.createDataFrame(rows, SCHEMA), ["k"], ["seq"], "at").where("NOT late")
    twin = history.price_changes(batch, ["k"], ["seq"], ["price"])
    assert {(r["k"], r["seq"]) for r in twin.collect()} == want


def test_forgotten_offers_are_seen_again(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    day = dt.datetime(2024, 1, 1)
    for seq in (1, 2):
        add_file(spark, folder, [("a", seq, day, 5)])
        keyed.to_files(keyed.changes(source(spark, folder), ["k"], ["seq"], "at", ["price"], keep_ms=1), root, once=True).awaitTermination(60)
    assert spark.read.parquet(f"{root}/rows").count() == 2


def test_expiries_equal_the_rule_at_every_batch_end(spark, tmp_path):
    """At the end of each batch the offers that are out are those whose newest check is too old, or over, at the watermark."""
    rng = random.Random(9)
    window, start = dt.timedelta(days=3), dt.datetime(2024, 1, 1)
    schema = "k string, at timestamp_ntz, until timestamp_ntz"
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    seen, left = {}, {}
    for batch in range(5):
        part = []
        for day in range(batch * 4, batch * 4 + 4):
            for k in "abcdefgh":
                if rng.random() < 0.25:
                    at = start + dt.timedelta(days=day)
                    part.append((k, at, at + dt.timedelta(days=rng.choice([1, 2])) if rng.random() < 0.3 else None))
        part.append(("clock", start + dt.timedelta(days=batch * 4 + 3), None))
        rng.shuffle(part)
        add_file(spark, folder, part, schema)
        stream = keyed.expiries(source(spark, folder, schema), ["k"], "at", window, "0 seconds", "until")
        keyed.to_files(stream, root).awaitTermination()
        for k, at, until in sorted(part, key=lambda r: (r[1], r[2] or dt.datetime.max)):
            seen[k] = (at, until)
        now = start + dt.timedelta(days=batch * 4 + 3)
        out = {k for k, (at, until) in seen.items() if at < now - window or (until is not None and until <= now)}
        for r in spark.read.parquet(f"{root}/rows").select("k", F.col("at").cast("timestamp_ntz").alias("at")).collect():
            left[r["k"]] = max(left.get(r["k"], r["at"]), r["at"])
        # Out by the stream: its newest check has left.
        assert {k for k, (at, _) in seen.items() if left.get(k) == at} == out
    assert len(left) > 4


def observed(spark, rows):
    return spark.createDataFrame(rows, test_ingest.SCHEMA)


def test_bucketed_ingest_equals_one_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [r for i in range(12) for r in test_ingest.sequence(rng, i, 12, ["a"] if i % 3 else ["a", "a", "b"])]
    store = streaming.ingest_state(str(tmp_path / "state"), ["quantity"], buckets=4, fold=2)
    handle = streaming.ingest_stream(store, ["quantity"], lambda batch: batch)
    for batch_id in range(6):
        part = observed(spark, [r for r in rows if r[1] // 2 == batch_id and (batch_id % 2 == 0 or r[0] % 4)])
        handle(part, batch_id)
        if batch_id == 3:
            handle(part, batch_id)  # a retry after publishing changes nothing
    used = [r for r in rows if (r[1] // 2) % 2 == 0 or r[0] % 4]
    one = ingest.apply(observed(spark, used), ["quantity"])
    columns = ["listing_id", "quantity", *ingest.STATE, "observed_at"]
    release = releases.load(spark, store.root)
    got = store.rows(spark, release, "offers").select(*columns)
    assert release.number == 6 and got.exceptAll(one.offers.select(*columns)).isEmpty() and got.count() == one.offers.count()
    written = streaming.read_table(spark, store.root, "history")
    assert written.count() == one.history.count()
    assert all(len(folders) <= 3 for folders in release.tables["offers"].values())


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_bytes_follow_the_batch_and_failed_batches_leave_the_old_state(spark, tmp_path):
    store = BucketedState(str(tmp_path / "state"), {"t": ["k"]}, ["k"], buckets=32, fold=3)
    store.write(spark, 0, {"t": spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))}, list(range(32)))
    whole = size(f"{store.root}/t/batch=0")
    for batch_id in range(1, 8):
        rows = spark.createDataFrame([(7, f"new {batch_id}"), (9, "x")], "k long, v string")
        touched = store.touched(rows)
        store.write(spark, batch_id, {"t": rows}, touched)
        # A folded batch writes the touched buckets, any other the two rows.
        assert size(f"{store.root}/t/batch={batch_id}") < whole * (len(touched) / 32 * 1.3 if batch_id % 3 == 0 else 0.01)
    now = store.rows(spark, releases.load(spark, store.root), "t")
    assert now.count() == 200_000 and now.where("k = 7").first()["v"] == "new 7"
    # Files without a release: a reader does not see them, and the batch runs again.
    rows = spark.createDataFrame([(7, "lost")], "k long, v string")
    rows.withColumn("_batch", F.lit(8)).write.parquet(f"{store.root}/t/batch=8/bucket=0")
    assert not store.done(spark, 8) and store.rows(spark, releases.load(spark, store.root), "t").where("v = 'lost'").isEmpty()
    store.write(spark, 8, {"t": spark.createDataFrame([(7, "kept")], "k long, v string")}, store.touched(rows))
    assert store.rows(spark, releases.load(spark, store.root), "t").where("k = 7").first()["v"] == "kept"


def test_of_two_writers_one_wins(spark, tmp_path):
    root = str(tmp_path / "tables")
    first = releases.replace(spark, root, {"a": spark.range(1), "b": spark.range(2)}, None)
    second = releases.replace(spark, root, {"a": spark.range(10)}, first)
    assert releases.load(spark, root) == second
    with pytest.raises(releases.Conflict):
        releases.replace(spark, root, {"b": spark.range(20)}, first)
    now = releases.load(spark, root)
    assert (releases.read(spark, now, "a").count(), releases.read(spark, now, "b").count()) == (10, 2)
    assert all(n.isdigit() for n in releases.names(spark, f"{root}/releases") if not n.endswith(".crc"))


def test_many_offers_cost_no_call_each(spark, tmp_path):
    """F1 to F3: keyed steps are windows of the JVM; five batches, the last of which folds, keep one state per offer, null keys too."""
    rows, folder, root = made_rows(11, 120), str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[i : i + 20] for i in range(0, 120, 20)):
        add_file(spark, folder, part)
    found = keyed.changes(source(spark, folder), ["k"], ["seq"], "at", ["price"])
    step = found.step(spark.createDataFrame(rows, SCHEMA), None)
    plan = step[0]._jdf.queryExecution().toString()
    assert "TransformWithState" not in plan and "Python" not in plan
    keyed.to_files(found, root).awaitTermination()
    want, late = model(rows)
    got = spark.read.parquet(f"{root}/rows").collect()
    assert {(r["k"], r["seq"]) for r in got if r["kind"] == "change"} == want and {(r["k"], r["seq"]) for r in got if r["kind"] == "late"} == late
    assert len(got) == len(want) + len(late)
    release = releases.load(spark, f"{root}/state")
    held = BucketedState(f"{root}/state", {"offers": ["k"]}, ["k"]).rows(spark, release, "offers").collect()
    assert sorted(r["k"] or "" for r in held) == ["", "a", "b", "c"]


def test_parts_of_a_table_arrive_one_by_one(spark, tmp_path):
    """A part with fewer rows than files is still a micro-batch of its own."""
    from quotegrain.catalog import streams
    from quotegrain.sources.tables import Tables

    spark.createDataFrame([(0,), (30,), (31,), (32,), (60,), (61,), (99,)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    stream = streams.table_stream(Tables(spark, str(tmp_path)), "events", F.col("event_id"))
    streaming.run(stream, str(tmp_path / "out"), lambda batch, _: seen.append(sorted(r[0] for r in batch.collect()))).awaitTermination()
    assert seen == [[0], [30, 31, 32], [60, 61], [99]]


def test_a_batch_is_read_twice_and_numbered_where_it_is_staged(spark, tmp_path):
    """sizes and staging are all that reads the batch, whatever state lies there; rows numbered by the staging shuffle end as one batch does."""
    rng = random.Random(8)
    rows = [r for i in range(9) for r in test_ingest.sequence(rng, i, 10, ["a"] if i % 3 else ["a", "a", "b"])]
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        read.add(1)
        return True

    store = streaming.ingest_state(str(tmp_path / "state"), ["quantity"], buckets=4, fold=2)
    handle = streaming.ingest_stream(store, ["quantity"], lambda batch: batch.where(seen("place")), ["place"])
    for batch_id in range(5):
        part = [r for r in rows if r[1] // 2 == batch_id]
        random.Random(batch_id).shuffle(part)
        before = read.value
        handle(observed(spark, part).withColumnRenamed("seq", "place").repartition(3), batch_id)
        assert read.value - before == 2 * len(part)
    one = ingest.apply(observed(spark, rows), ["quantity"])
    columns = ["listing_id", "quantity", *ingest.STATE, "observed_at"]
    release = releases.load(spark, store.root)
    got = store.rows(spark, release, "offers").select(*columns)
    assert got.exceptAll(one.offers.select(*columns)).isEmpty() and got.count() == one.offers.count()
    names = ["listing_id", *ingest.IDENTITY, "observed_at", "needs_review"]
    listings = store.rows(spark, release, "listings").select(*names)
    assert listings.exceptAll(one.listings.select(*names)).isEmpty() and listings.count() == one.listings.count()
    assert streaming.read_table(spark, store.root, "history").count() == one.history.count()
