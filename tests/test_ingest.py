"""Batch ingest against a sequential Python model on random observation sequences."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quotegrain.plans import ingest

DAY = dt.datetime(2024, 1, 1)
SCHEMA = (
    "listing_id long, seq long, observed_at timestamp_ntz, run_id long, complete boolean, source_name string, "
    "sold_as string, content_quantity long, content_unit string, brand_name string, offers array<struct<quantity:long,"
    "price_cents:long,availability:string,active:boolean,terms:string,valid_until:timestamp_ntz>>"
)


def sequence(rng, listing, length, names):
    rows = []
    for seq in range(length):
        offers = [
            (q, rng.choice([None, 100, 200]), rng.choice(["in_stock", "unknown"]), rng.random() < 0.9, None, None)
            for q in (30, 60, 90) if rng.random() < 0.6
        ] or [(30, 100, "in_stock", True, None, None)]
        rows.append((
            listing, seq, DAY + dt.timedelta(hours=seq + rng.choice([0, 0, 0, -5, 3])), seq, rng.random() < 0.5,
            rng.choice(names), "bottle", rng.choice([1, 1, None]), "tablet", rng.choice(["x", None]), offers,
        ))
    return rows


def model(rows):
    """One observation after the other, as a person would do it."""
    outcomes, stored, newest, state, history = {}, {}, {}, {}, []
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        listing, seq, at, _, complete, *identity, offers = row
        known = stored.get(listing)
        if known is not None and newest[listing] > at:
            outcomes[listing, seq] = "older_observation"
            continue
        if known is not None and any(a is not None and b is not None and a != b for a, b in zip(known, identity)):
            outcomes[listing, seq] = "identity_conflict"
            continue
        outcomes[listing, seq] = "accepted"
        stored[listing], newest[listing] = identity, at
        incoming = {o[0]: o[1:] for o in offers}
        if complete:
            for (owner, quantity), (old, _) in list(state.items()):
                if owner == listing and quantity not in incoming and old[2]:
                    incoming[quantity] = (old[0], old[1], False, old[3], old[4])
        for quantity, new in incoming.items():
            before = state.get((listing, quantity))
            if before is None or before[0] != new:
                history.append((listing, quantity, seq, *new[:3]))
            state[listing, quantity] = (new, at)
    return outcomes, state, history


def check(done, rows):
    outcomes, state, history = model(rows)
    assert {(r["listing_id"], r["seq"]): r["outcome"] for r in done.decisions.collect()} == outcomes
    got = sorted((r["listing_id"], r["quantity"], r["seq"], r["price_cents"], r["availability"], r["active"]) for r in done.history.collect())
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=order) == sorted(history, key=order)
    assert {(r["listing_id"], r["quantity"]): (r["price_cents"], r["availability"], r["active"], r["observed_at"]) for r in done.offers.collect()} == {
        k: (v[0][0], v[0][1], v[0][2], v[1]) for k, v in state.items()
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    data = [r for i in range(15) for r in sequence(rng, i, rng.randint(1, 14), ["a"] if i % 3 else ["a", "a", "b"])]
    return data + sequence(rng, 99, 90, ["a", "b", "c"])


def test_matches_the_model(spark, rows):
    check(ingest.apply(spark.createDataFrame(rows, SCHEMA), ["quantity"]), rows)


def test_hot_listing_is_split(spark, rows):
    check(ingest.apply(spark.createDataFrame(rows, SCHEMA), ["quantity"], rows_per_task=40), rows)


def test_many_identity_changes_of_one_listing(spark):
    """As many jobs for 50,000 changes as for 50, and the outcomes of the model."""
    def jobs(count, group):
        rng = random.Random(count)
        data = [(1, k, DAY + dt.timedelta(hours=k + rng.choice([0, 0, -9, 4])), rng.choice("abc"), rng.choice(["x", "y", None])) for k in range(count)]
        df = spark.createDataFrame(data, "listing_id long, seq long, observed_at timestamp_ntz, source_name string, brand_name string").select(
            "*", *(F.lit(None).cast("string").alias(c) for c in ("sold_as", "content_quantity", "content_unit")))
        spark.sparkContext.setJobGroup(group, group)
        got = {r["seq"]: r["outcome"] for r in ingest.decide(df).select("seq", "outcome").collect()}
        spark.sparkContext.setJobGroup("", "")
        want, stored, newest = {}, None, None
        for _, seq, at, name, brand in data:
            agrees = stored is None or (stored[0] == name and (stored[1] is None or brand is None or stored[1] == brand))
            want[seq] = "older_observation" if newest is not None and newest > at else "accepted" if agrees else "identity_conflict"
            if want[seq] == "accepted":
                stored, newest = (name, brand), at
        assert got == want and len(set(want.values())) == 3
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(50, "few") == jobs(50_000, "many")


def test_two_batches_equal_one(spark, rows):
    cut = 6
    first = [r for r in rows if r[1] < cut]
    second = [r for r in rows if r[1] >= cut]
    one = ingest.apply(spark.createDataFrame(first, SCHEMA), ["quantity"])
    listings, offers = one.listings.cache(), one.offers.cache()
    two = ingest.apply(spark.createDataFrame(second, SCHEMA), ["quantity"], listings, offers)
    _, state, history = model(rows)
    assert {(r["listing_id"], r["quantity"]): (r["price_cents"], r["availability"], r["active"]) for r in two.offers.collect()} == {
        k: v[0][:3] for k, v in state.items() if k[0] in {r[0] for r in rows}
    }
    assert one.history.count() + two.history.count() == len(history)
