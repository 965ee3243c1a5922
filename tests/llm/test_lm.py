"""The language model against a plain version, and the hash arrays under it."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from quotegrain.llm import arrays, lm

from tests.llm import fixtures


def plain(rows, order):
    """Scores from dictionaries of tuples, straight from the formulas."""
    def tokens(text):
        return ["<s>"] * (order - 1) + [w for w in ((text or "").encode().lower().split())] + ["</s>"]

    def out(doc_id):
        return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0

    training = [tokens(r["text"]) for r in rows if not out(r["doc_id"])]
    counts = {order: Counter(tuple(t[i - order + 1 : i + 1]) for t in training for i in range(order - 1, len(t)))}
    seen = Counter(w for t in training for w in t[order - 1 :])
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: lm.discounts(*(sum(c == n for c in counts[k].values()) for n in (1, 2, 3, 4))) for k in counts}
    after = {k: defaultdict(list) for k in counts}
    for k, found in counts.items():
        for g, c in found.items():
            after[k][g[:-1]].append(c)

    def p(w, context, k):
        if k == 0:
            return 1 / (len(seen) + 1)
        own = context[len(context) - k + 1 :]
        lower = p(w, context, k - 1)
        successors = after[k].get(own)
        if not successors:
            return lower
        cut = lambda c: d[k][min(c, 3) - 1]
        c = counts[k].get((*own, w), 0)
        return ((c - cut(c) if c else 0) + sum(map(cut, successors)) * lower) / sum(successors)

    n, v = sum(seen.values()), len(seen)
    for r in rows:
        t = tokens(r["text"])
        places = range(order - 1, len(t))
        yield (
            r["doc_id"], out(r["doc_id"]), len(places), sum(t[i] in seen for i in places), n,
            sum(math.log10((seen[t[i]] + 0.1) / (n + 0.1 * (v + 1))) for i in places),
            sum(math.log10(p(t[i], tuple(t[i - order + 1 : i]), order)) for i in places),
        )


def same(got, want):
    key = lambda r: tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r[:5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5:] == pytest.approx(w[5:], rel=1e-9) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order, monkeypatch):
    """Many small shards and flushes, so that runs meet from several places."""
    monkeypatch.setattr(lm, "SHARD_BYTES", 60_000)
    rows = fixtures.documents()
    same(lm.language_model(fixtures.frame(spark, rows), order).collect(), plain(rows, order))


def test_probabilities_sum_to_one(spark):
    docs = fixtures.frame(spark, fixtures.documents()[:5])
    model = lm.train(docs, 3)
    words = sorted({w for r in docs.collect() for w in (r["text"] or "").encode().lower().split()})
    codes = lm.WordHash()
    scorer = lm.Scorer(model)
    context = words[5], words[6]
    for lead in ([], [context[0]], list(context), [b"never", context[1]]):
        total = 0.0
        for w in [*words, b"unseen", None]:
            stream = np.concatenate([np.full(2, lm.START), codes.codes(lead + ([w] if w else [])), np.array([] if w else [lm.END], np.uint64)])
            total += 10 ** scorer.tokens(stream)[2][-1]
        assert total == pytest.approx(1)


def test_empty_and_untrained(spark):
    assert lm.language_model(fixtures.empty(spark)).collect() == []
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    rows = [{"doc_id": held, "text": "a b", "lang": None, "source": None, "n_chars": 3}]
    assert [tuple(r) for r in lm.language_model(fixtures.frame(spark, rows)).collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]


@pytest.mark.parametrize("bits", [0, 3])
def test_arrays_find_what_was_saved(tmp_path, bits):
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 64, 5000, dtype=np.uint64))
    keys = np.unique(np.r_[keys, keys[:50] ^ np.uint64(1 << 20)])  # some share the first array's bits
    values = r.integers(1, 100_000, len(keys))
    for s in np.unique(arrays.shard_of(keys, bits)):
        at = arrays.shard_of(keys, bits) == s
        arrays.save(str(tmp_path), "t", int(s), bits, keys[at], {"v": values[at], "none": values[at] * 0})
    table = arrays.HashArrays(str(tmp_path), "t", bits)
    others = r.integers(0, 1 << 64, 5000, dtype=np.uint64)
    found, (v, none) = table.find(np.r_[keys, others], ["v", "none"])
    assert found[: len(keys)].all() and not found[len(keys) :].any()
    assert (v[: len(keys)] == values).all() and not none.any()
    assert [c.tolist() for c in arrays.unpack(arrays.pack([keys, values]))] == [keys.tolist(), values.tolist()]
