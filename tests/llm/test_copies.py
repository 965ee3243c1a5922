"""Substring dedup and SimHash against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from quotegrain.llm import simhash, substring_dedup

from tests.llm import brute, fixtures


def pairs(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = fixtures.documents(seed)
    got = substring_dedup.substring_dedup(fixtures.frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter(brute.substring_dedup(pairs(rows)))
    assert any(r["n_removed"] for r in got)
    for r in got:
        assert sum(b - a for a, b in r["removed"]) == r["n_removed"]


def test_substring_dedup_of_many_small_overlaps(spark):
    """A small alphabet makes windows that start at every offset to a block."""
    r = random.Random(5)
    rows = [{"doc_id": k, "text": " ".join(r.choice("ab") for _ in range(r.randint(0, 60))), "lang": None, "source": None, "n_chars": 0} for k in range(60)]
    got = substring_dedup.substring_dedup(fixtures.frame(spark, rows)).collect()
    assert Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got) == Counter(brute.substring_dedup(pairs(rows)))


def test_packed_hashes_come_back():
    r = np.random.default_rng(3)
    key = np.sort(r.integers(0, 2**64, 500, dtype=np.uint64))
    key = (key & ~np.uint64(3)) | r.integers(0, 4, 500).astype(np.uint64)
    back = substring_dedup._unpacked(substring_dedup._packed(key))
    want = ((key >> np.uint64(18)) << np.uint64(2)) | (key & np.uint64(3))
    assert set(want.tolist()) <= set(back.tolist())


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = fixtures.documents(seed)
    got = simhash.near_duplicates(fixtures.frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute.near_duplicates(pairs(rows)))


@pytest.mark.parametrize("block", [4096, 8])
def test_links_join_what_brute_force_joins(spark, block, monkeypatch):
    """Clusters, chains and strangers; with short lists the second step compares block by block."""
    monkeypatch.setattr(simhash, "LIST_BLOCK", block)
    r = random.Random(7)
    prints = [r.getrandbits(64) for _ in range(40)] + [0]
    for _ in range(3):
        at = r.getrandbits(64)
        for _ in range(30):
            at ^= sum(1 << b for b in r.sample(range(64), r.randint(0, 5)))
            prints.append(at)
    hub = r.getrandbits(64)
    prints += [hub ^ (1 << k) for k in range(64)]
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = simhash.grouped(df, 4).collect()
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    groups = {}
    for row in roots:
        groups.setdefault(row["root"], set()).add(row["fp"] % 2**64)
    want = {}
    for p in prints:
        want.setdefault(root(p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_one_of_each_group_stays(spark):
    rows = fixtures.documents()
    docs = fixtures.frame(spark, rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    groups = {(c, f) if c is None else c for d, f, c in brute.near_duplicates(pairs(rows))}
    assert set(got.values()) == {1} and {g for g in groups if not isinstance(g, tuple)} == set(got) - {None}


def test_empty_tables(spark):
    assert substring_dedup.substring_dedup(fixtures.empty(spark)).collect() == []
    assert simhash.near_duplicates(fixtures.empty(spark)).collect() == []
    assert simhash.one_of_each(fixtures.empty(spark)).collect() == []
