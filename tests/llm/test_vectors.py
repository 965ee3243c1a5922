"""Vector codes against plain Lloyd rounds over Python numbers."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from quotegrain.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // 16)) * 16
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    w = width // 16
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    chosen = list(first.values())[:64]
    books = [[v[p * w : p * w + w] for v in chosen] for p in range(16)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        met = defaultdict(list)
        for _, v, _ in kept:
            for p in range(16):
                x = v[p * w : p * w + w]
                met[p, nearest(p, x)[1]].append(x)
        for (p, k), xs in met.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, lab in kept:
        got = [nearest(p, v[p * w : p * w + w]) for p in range(16)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), min(sum(d for d, _ in got), vectors.MOST), lab))
    totals = Counter()
    for _, _, e, lab in out:
        totals[lab] += e
    return Counter((i, c, e, min(totals[lab], vectors.MOST), digest) for i, c, e, lab in out)


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA) if rows else spark.createDataFrame([], SCHEMA)
    return df.repartition(3).select("*", F.lit("x").alias("code"), F.lit(1).alias("cell"), F.lit(None).alias("vector"))


def rows_of(n, dim, seed, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, dim))
    rows = [(int(i) * 3, [float(np.float32(x)) for x in centres[i % 20] + r.normal(size=dim) * 0.2 * spread], int(i % 5)) for i in r.permutation(n)]
    return rows


@pytest.mark.parametrize("block", [4096, 40])
def test_codes(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = rows_of(400, 64, 1)
    rows += [(9000 + k, rows[0][1], 1) for k in range(60)]  # many copies of one vector, which make equal entries and ties
    rows += [(7, None, 1), (8, [None] * 64, 1), (10, [float("nan")] + [0.0] * 63, 2), (11, [float("inf")] * 64, None), (12, [0.0] * 64, None), (13, [-0.001] * 64, None)]
    rows += [rows[3], rows[3], (None, rows[4][1], 2), (14, rows[5][1][:40], 3), (15, [], 3)]
    assert Counter(map(tuple, vectors.vector_codes(frame(spark, rows)).collect())) == plain(rows)


@pytest.mark.parametrize("n", [1, 5, 70])
def test_few_vectors_and_odd_lengths(spark, n):
    rows = rows_of(n, 37, n)
    assert Counter(map(tuple, vectors.vector_codes(frame(spark, rows)).collect())) == plain(rows)


def test_numbers_beyond_longs(spark):
    r = random.Random(3)
    rows = [(k, [float(np.float32(r.uniform(-1, 1) * 10 ** r.randint(0, 30))) for _ in range(16)], k % 2) for k in range(90)]
    assert Counter(map(tuple, vectors.vector_codes(frame(spark, rows)).collect())) == plain(rows)


def test_nothing_to_code(spark):
    for rows in ([], [(1, None, 1), (2, [float("nan")], 1)]):
        found = vectors.vector_codes(frame(spark, rows))
        assert found.collect() == [] and found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_trees_agree_with_every_pair():
    """Integers on a small grid, where ties are common, and spread ones, where whole nodes are taken."""
    r = np.random.default_rng(5)
    for n, spread in ((1, 4), (17, 4), (3000, 6), (3000, 400)):
        parts = r.integers(-spread, spread, (vectors.PARTS, n, 4))
        entries = r.integers(-spread, spread, (vectors.PARTS, 64, 4))
        order = vectors.grown(parts, vectors.LEAF)
        placed = np.take_along_axis(parts, order[:, :, None], 1)
        got = vectors.assigned(placed, vectors.Codebooks(entries))
        want = ((placed[:, :, None] - entries[:, None]) ** 2).sum(3).argmin(2)
        assert (got.entry == want).all()
        assert (got.counts == np.array([np.bincount(w, minlength=64) for w in want])).all()
        for p in range(vectors.PARTS):
            for k in range(64):
                assert (got.sums[p, k] == placed[p][want[p] == k].sum(0)).all()
