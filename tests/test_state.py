"""Stored state: serving table, comparison by digests, re-keying as one release, decisions in time."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quotegrain.catalog import QUERIES, load_all
from quotegrain.functions import hashing
from quotegrain.operators import fingerprint
from quotegrain.plans import ingest, matching, rekey
from quotegrain.sources import releases, serving
from quotegrain.sources.tables import Tables
from tests.test_ingest import DAY

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cheapest_observed", "medication_offers", "result_outcome"])
def test_serving_queries_read_stored_state(spark, name):
    """No raw line is read again, and the stored rows are not shuffled."""
    load_all()
    text = plan_of(QUERIES[name](spark, SMALL))
    assert "lineitem" not in text and "quotegrain_serving" in text
    # Joined in place: by its buckets, or with the other side sent to it.
    assert "Bucketed: true" in text or "BroadcastHashJoin" in text


def test_serving_table_is_written_once_and_holds_listings_without_offers(spark):
    t = Tables(spark, SMALL)
    one, two = serving.rows(t), serving.rows(t)
    assert one.select("listing_id").distinct().count() == t.listings.count() == two.select("listing_id").distinct().count()
    assert one.where("offer_id IS NOT NULL").count() == t.offer_rows.count()


@pytest.mark.parametrize("seed", [1, 2])
def test_differences_by_buckets(spark, seed):
    r = random.Random(seed)
    before = [(r.randint(0, 60), r.choice([None, 1, 2])) for _ in range(300)]
    after = [x for x in before if r.random() > 0.05] + [(r.randint(0, 80), 3) for _ in range(5)]
    schema = "k long, v int"
    a, b = spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)
    for by in (None, ["k"]):
        got = sorted(map(str, fingerprint.differences(a, b, by, buckets=16).collect()))
        want = a.exceptAll(b).withColumn("side", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("side", F.lit("added")))
        assert got == sorted(map(str, want.collect())) and got


def test_one_changed_row_costs_one_bucket(spark):
    old = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    new = old.withColumn("v", F.when(F.col("k") == 77, -1).otherwise(F.col("v")))
    assert fingerprint.differing(old, new, ["k"], ["k", "v"], 256).count() == 1
    assert fingerprint.differing(old, old.repartition(7), ["k"], ["k", "v"], 256).count() == 0
    assert {(r["k"], r["side"]) for r in fingerprint.differences(old, new, ["k"], 256).collect()} == {(77, "removed"), (77, "added")}


DOCUMENTS = [
    '{"b":1,"a":"x"}', ' { "a b" : 1.50 , "a" : null, "a!": -0 } ', '{"a":1,"a":2}', '{"a":"q\\"x"}', '{"é":"ü","z":true}', "{}", "[3, 1]", '{"a":{"c":1e5,"b":[]}}',
    '"t"', "12.0", "nope", "", '{"a":01}', '{"a":1,}', None, '{"a":NaN}', '{"k":"a,b:c}"}', '{"\\u0041":1,"B":2}', '{"a":1}\n', '{"a":"x\ty"}',
]


def test_canonical_json(spark):
    """Built-in and Python branches agree with one reader; numbers stay as written."""
    def want(raw):
        try:
            json.loads(raw, parse_constant=lambda c: 1 / 0)
        except (TypeError, ValueError, ZeroDivisionError):
            return None
        keep = lambda s: {"#": s}
        def out(v):
            if isinstance(v, dict) and set(v) == {"#"}:
                return v["#"]
            if isinstance(v, dict):
                return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + out(v[k]) for k in sorted(v)) + "}"
            return "[" + ",".join(map(out, v)) + "]" if isinstance(v, list) else json.dumps(v, ensure_ascii=False)
        return out(json.loads(raw, parse_float=keep, parse_int=keep))

    df = spark.createDataFrame([(k, d) for k, d in enumerate(DOCUMENTS)], "k int, d string")
    got = {r["k"]: r["c"] for r in df.select("k", hashing.canonical_json(F.col("d")).alias("c")).collect()}
    assert got == {k: want(d) for k, d in enumerate(DOCUMENTS)}


def test_offer_key_and_metadata(spark):
    df = spark.createDataFrame([(30, None, 'a"b')], "q long, s string, l string")
    key = df.select(hashing.offer_key(F.col("q"), F.col("s"), F.col("l"), F.lit("cash"), F.lit("USD")).alias("k")).first()["k"]
    assert json.loads(key) == ["30", None, 'a"b', "cash", "USD"]
    maps = df.select(F.create_map(F.lit("a"), F.lit("1"), F.lit("x"), F.lit("2")).alias("base"), F.create_map(F.lit("a"), F.lit("3")).alias("over"))
    assert maps.select(hashing.merged_map(F.col("base"), F.col("over"), ["x"]).alias("m")).first()["m"] == {"a": "3"}
    assert maps.select(hashing.merged_map(F.lit(None).cast("map<string,string>"), F.col("over")).alias("m")).first()["m"] == {"a": "3"}


def test_canonical_identity_in_ingest(spark):
    """Linking, rechecks, another key, a decision without one, and observations nobody decided on, against one after the other."""
    rng = random.Random(11)
    rows, want, links = [], {}, {}
    for listing in range(12):
        name, linked, newest = None, None, None
        for seq in range(25):
            at = DAY + dt.timedelta(hours=seq + rng.choice([0, 0, -6]))
            own = rng.choice(["a", "a", "a", "b"])
            status, key = rng.choice([(None, None), ("verified", "k1"), ("verified", "k1"), ("verified", "k2"), ("needs_review", None)])
            problem = "invalid_observation_run" if rng.random() < 0.1 else None
            rows.append((listing, seq, at, own, status, key, problem))
            if problem:
                want[listing, seq] = problem
            elif newest is not None and newest > at:
                want[listing, seq] = "older_observation"
            elif (name is not None and name != own) or (linked is not None and status is not None and key != linked):
                want[listing, seq] = "identity_conflict"
            else:
                want[listing, seq] = "accepted"
                name, newest = own, at
                if linked is None and status == "verified":
                    linked = key
        links[listing] = linked
    df = spark.createDataFrame(rows, "listing_id long, seq long, observed_at timestamp_ntz, source_name string, decision_status string, decision_key string, problem string").select(
        "*", *(F.lit(None).cast("string").alias(c) for c in ("sold_as", "content_quantity", "content_unit", "brand_name")))
    got = {(r["listing_id"], r["seq"]): r["outcome"] for r in ingest.decide(df).collect()}
    assert got == want and set(want.values()) == {"accepted", "older_observation", "identity_conflict", "invalid_observation_run"}
    whole = df.select("*", F.lit(1).cast("long").alias("run_id"), F.lit(True).alias("complete"), F.array().cast(
        "array<struct<quantity:long,price_cents:long,availability:string,active:boolean,terms:string,valid_until:timestamp_ntz>>").alias("offers"))
    early, late = whole.where("seq < 9"), whole.where("seq >= 9")
    one = ingest.apply(early, ["quantity"])
    two = ingest.apply(late, ["quantity"], one.listings.cache(), one.offers.cache())
    assert {r["listing_id"]: r["canonical_key"] for r in two.listings.collect()} == links
    assert {(r["listing_id"], r["seq"]): r["outcome"] for r in two.decisions.collect()} == {k: v for k, v in want.items() if k[1] >= 9}


def test_decisions_of_their_time(spark):
    obs = spark.createDataFrame([(1, s, DAY + dt.timedelta(days=s)) for s in range(5)] + [(2, 9, DAY)], "p long, seq long, observed_at timestamp_ntz")
    made = spark.createDataFrame([(1, DAY + dt.timedelta(days=1), "verified", "k1"), (1, DAY + dt.timedelta(days=3, hours=1), "needs_review", None)], "p long, observed_at timestamp_ntz, decision_status string, decision_key string")
    for limit in (None, 2):
        got = ingest.decided_as_of(obs, made, ["p"], ["seq"], limit).collect()
        assert sorted((r["p"], r["seq"], r["decision_status"], r["decision_key"]) for r in got) == [
            (1, 0, None, None), (1, 1, "verified", "k1"), (1, 2, "verified", "k1"), (1, 3, "verified", "k1"), (1, 4, "needs_review", None), (2, 9, None, None)]


def test_a_failed_run_publishes_its_status_only(spark, tmp_path):
    load_all()
    from quotegrain.catalog import rekey as catalog

    t = Tables(spark, SMALL)
    root, first = catalog.released(t)
    gone = catalog.decisions(t).where("false")
    event = rekey.apply_and_publish(spark, root, gone, "run-1").first()
    now = releases.load(spark, root)
    assert event["status"] == "failed" and event["problems"] == "listing_decision_missing" and now.number == first.number + 1
    assert {k: v for k, v in now.tables.items() if k != "runs"} == {k: v for k, v in first.tables.items() if k != "runs"}
    assert rekey.run_status(releases.read(spark, now, "runs"), "run-1").first()["status"] == "failed"


def test_scored_search_meets_the_rarest_run(spark):
    """Against every pair of a query and a name; short queries, queries nobody holds, several equal ones."""
    r = random.Random(6)
    names = ["".join(r.choice("abc ") for _ in range(r.randint(0, 9))) for _ in range(60)]
    catalog = spark.createDataFrame([(k, n, r.choice(["", "ab", "cab b", None])) for k, n in enumerate(names)], "medication_id long, name string, brand_name string")
    asked = ["a", "ab", "abc", "ca b", "zz", "cab", "cab", "c", " ", "bcab"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = matching.scored_search(catalog, queries, 5).collect()
    texts = {x["medication_id"]: (" ".join((x["name"] or "").split()), " ".join((x["brand_name"] or "").split()), x["name"]) for x in catalog.collect()}
    want = []
    for k, q in enumerate(asked):
        q = " ".join(q.split())
        rows = []
        for i, (n, b, name) in texts.items():
            score = 0 if n == q else 1 if n.startswith(q) else 2 if b == q else 3 if b.startswith(q) else 4 if q in n else 5 if q in b else None
            if q and score is not None:
                rows.append((score, name, i))
        want += [(k, i, score, place) for place, (score, name, i) in enumerate(sorted(rows)[:5], 1)]
    assert sorted((x["query_id"], x["medication_id"], x["score"], x["place"]) for x in got) == sorted(want)
