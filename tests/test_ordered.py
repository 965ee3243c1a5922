"""The skew-safe operators against plain Python, with a hot key cut into many slices."""

import random

import pytest
from pyspark.sql import functions as F

from quotegrain.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for seq in range(300):
        # One key holds most rows; positions repeat, so ties must not be torn apart.
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        # Some positions are null, and many rows share one.
        day = None if seq % 10 == 0 else 50 if 100 < seq < 160 else seq // 3
        data.append((key, day, seq, rng.choice([None, 1, 2, 3, 4, 5])))
    return data, spark.createDataFrame(data, "k string, day long, seq long, v long").cache()


def by_key(data):
    groups = {}
    for row in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("limit", [5, 40, 1_000_000])
def test_neighbours(rows, limit):
    data, df = rows
    got = ordered.neighbours(df, ["k"], ["day", "seq"], ["v", "seq"], "prev", "next", limit)
    found = {r["seq"]: (r["prev"], r["next"]) for r in got.collect()}
    assert len(found) == len(data)
    for group in by_key(data).values():
        for i, row in enumerate(group):
            prev, nxt = found[row[2]]
            assert (prev and (prev["v"], prev["seq"])) == ((group[i - 1][3], group[i - 1][2]) if i else None)
            assert (nxt and nxt["seq"]) == (group[i + 1][2] if i + 1 < len(group) else None)


@pytest.mark.parametrize("limit", [5, 1_000_000])
def test_running_max_and_last_value(rows, limit):
    data, df = rows
    order = ["day", "seq"]
    tops = {r["seq"]: r["m"] for r in ordered.running_max(df, ["k"], order, F.col("v"), "m", limit).collect()}
    last = {r["seq"]: r["x"] for r in ordered.last_value(df, ["k"], order, F.col("v"), "x", limit).collect()}
    ahead = {r["seq"]: r["x"] for r in ordered.last_value(df, ["k"], order, F.col("v"), "x", limit, True).collect()}
    for group in by_key(data).values():
        for i, row in enumerate(group):
            before = [r[3] for r in group[:i] if r[3] is not None]
            after = [r[3] for r in group[i + 1:] if r[3] is not None]
            assert tops[row[2]] == (max(before) if before else None)
            assert last[row[2]] == (before[-1] if before else None)
            assert ahead[row[2]] == (after[0] if after else None)


@pytest.mark.parametrize("limit", [5, 1_000_000])
def test_rank(rows, limit):
    data, df = rows
    got = {r["seq"]: r["rank"] for r in ordered.rank_rows(df, ["k"], ["day", "seq"], "rank", limit).collect()}
    for group in by_key(data).values():
        assert [got[r[2]] for r in group] == list(range(1, len(group) + 1))


def test_hot_key_is_split(rows):
    _, df = rows
    sliced, small = ordered.with_slices(df, ["k"], ["day", "seq"], 20)
    sizes = {r["_slice"]: r["count"] for r in sliced.where("k = 'hot'").groupBy("_slice").count().collect()}
    assert small and len(sizes) >= 10 and max(sizes.values()) <= 20
    assert sliced.where("k <> 'hot' AND _slice > 0 AND NOT _hot").count() == 0


def test_key_of_distinct_positions_leaves_no_large_task(spark):
    """One key with a third of all rows, every position its own: no slice is much over the limit, and the plan shuffles by slice."""
    limit = 2_000
    df = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), (F.col("id") * 7919 % 90_001).alias("at"), (F.col("id") % 11).alias("v"))
    sliced, _ = ordered.with_slices(df, ["k"], ["at"], limit)
    sizes = [r["count"] for r in sliced.where("k = -1").groupBy("_slice").count().collect()]
    assert sum(sizes) == 30_000 and max(sizes) < 2 * limit
    got = ordered.neighbours(df, ["k"], ["at"], ["v"], rows_per_task=limit)
    plain = ordered.neighbours(df, ["k"], ["at"], ["v"], rows_per_task=None)
    assert got.exceptAll(plain).isEmpty() and got.count() == plain.count()
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in text and "_slice" in text.split("hashpartitioning(k", 1)[1].split(")")[0]


def test_small_keys_are_planned_as_plain_windows(rows):
    _, df = rows
    assert ordered.with_slices(df, ["k"], ["day", "seq"], 1_000_000) is None
    text = ordered.neighbours(df, ["k"], ["day", "seq"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_latest_and_earliest(rows):
    data, df = rows
    late = {r["k"]: r["seq"] for r in ordered.latest(df, ["k"], ["day", "seq"]).collect()}
    first = {r["k"]: r["seq"] for r in ordered.earliest(df, ["k"], ["day", "seq"]).collect()}
    for key, group in by_key(data).items():
        assert late[key] == group[-1][2] and first[key] == group[0][2]
