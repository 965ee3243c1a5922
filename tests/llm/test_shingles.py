"""The near-copy stage against brute-force Jaccard similarity."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quotegrain.llm import common, shingles

from tests.llm import brute, fixtures


def kept_ids(rows):
    """The least id of each group that all pairs at 0.8 or more join."""
    sets = {}
    for x in rows:
        words = brute.WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x["text"] or ""))
        sets.setdefault(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)) if words), []).append(x["doc_id"])
    parent = {s: s for s in sets}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    links = 0
    for a, b in combinations(sets, 2):
        both = len(a & b)
        if 5 * both >= 4 * len(a | b):
            parent[root(a)] = root(b)
            links += 1
    least = {}
    for s, ids in sets.items():
        least.setdefault(root(s), []).extend(i for i in ids if i is not None)
    return {min(ids) for ids in least.values() if ids}, links


def edited(r, text, share):
    words = text.split()
    for _ in range(r.randint(1, max(1, int(share * len(words))))):
        words[r.randrange(len(words))] = r.choice(("changed", "other", "new"))
    return " ".join(words)


@pytest.mark.parametrize("block", [4096, 8])
def test_stage_joins_what_brute_force_joins(spark, tmp_path, monkeypatch, block):
    """Near copies around the limit, a common line, a large group; with short lists the pairs are made block by block."""
    monkeypatch.setattr(shingles, "LIST_BLOCK", block)
    monkeypatch.setattr(shingles, "SHARD_BYTES", 100_000)
    monkeypatch.setattr(shingles, "FLUSH", 2_000)
    r = random.Random(8)
    line = fixtures.prose(r, 15)
    made = [x["text"] for x in fixtures.documents(5)]
    for k in range(60):
        text = fixtures.prose(r, r.randint(8, 200)) + " " + line
        made += [text, edited(r, text, 0.04), edited(r, edited(r, text, 0.01), 0.02)]
    hub = fixtures.prose(r, 120)
    made += [edited(r, hub, 0.02) for _ in range(60)]
    rows = [{"doc_id": k, "text": t, "lang": "en", "source": "s", "n_chars": 1} for k, t in enumerate(made)]
    docs = fixtures.frame(spark, rows)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = Counter(x["doc_id"] for x in out.collect())
    want, links = kept_ids(rows)
    assert links > 150 and set(got.values()) == {1} and set(got) == want


def test_heads_of_similar_sets_share_what_is_asked():
    """Any two similar sets share the least number among their first shingles, under any order of them."""
    r, least, met = random.Random(9), shingles.LeastShared(), 0
    for _ in range(2000):
        n = r.randint(1, 80)
        a = r.sample(range(10_000), n)
        b = [x + 10_000 if r.random() < r.choice((0.02, 0.1)) else x for x in a] + r.sample(range(30_000, 40_000), r.choice((0, 0, n // 8)))
        a, b = set(a), set(b)
        if 5 * len(a & b) >= 4 * len(a | b):
            met += 1
            p, q = (set(sorted(s)[: shingles.head_size(len(s))]) for s in (a, b))
            assert len(p & q) >= max(least[len(a)], least[len(b)]) >= 1
    assert met > 300


def test_sketches_never_rule_out_a_similar_pair():
    r = np.random.default_rng(4)
    for n in (1, 5, 40, 300, 3000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = a.copy()
        b[: n // 10] = r.integers(0, 1 << 63, n // 10).astype(np.uint64)
        b = np.unique(b)
        if shingles.similar(a, b):
            assert shingles._possible(np.array([len(a)]), len(b), shingles.sketch(a)[None], shingles.sketch(b))[0]
    other = np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64))
    assert not shingles._possible(np.array([300]), 300, shingles.sketch(np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64)))[None], shingles.sketch(other))[0]


def test_texts_of_their_own_have_no_lists(spark):
    """Shared passages that are a small part of texts propose nothing."""
    r = random.Random(3)
    passage = fixtures.prose(r, 60)
    rows = [{"doc_id": k, "text": fixtures.prose(r, 300) + " " + passage + " " + fixtures.prose(r, 300), "lang": "en", "source": "s", "n_chars": 1} for k in range(40)]
    texts = fixtures.frame(spark, rows).selectExpr("doc_id AS own_id", "doc_id AS own_hash", "text")
    assert shingles.prints(texts).where("size(kept) > 0").count() == 0


def test_simhash_proposes_first(spark, tmp_path, monkeypatch):
    """the stage takes SimHash's links, tested on the whole sets; a group of near copies costs at most two pairs a set."""
    r = random.Random(12)
    hub = fixtures.prose(r, 400)
    words = hub.split()
    # Sets with one more word at the end, and texts of the same set: close fingerprints, equal ones among them.
    made = [hub + " " + " ".join(f"x{k}" for _ in range(3)) for k in range(40)] + [hub, hub, " ".join(words[:250]), fixtures.prose(r, 60)]
    rows = [{"doc_id": k, "text": t, "lang": "en", "source": "s", "n_chars": 1} for k, t in enumerate(made)]
    docs = fixtures.frame(spark, rows)
    texts = docs.selectExpr("doc_id AS own_id", "doc_id AS own_hash", "text")
    prints = common.staged(shingles.prints(texts))
    pairs = shingles.near_prints(prints).collect()
    sets = prints.select("fp").distinct().count()
    assert 20 <= len(pairs) <= 2 * sets and len({(p["a"], p["b"]) for p in pairs}) == len(pairs)
    asked, real = [], shingles.verified
    monkeypatch.setattr(shingles, "verified", lambda p, t: asked.append(real(p, t)) or asked[-1])
    out = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    want, _ = kept_ids(rows)
    assert {x["doc_id"] for x in out.collect()} == want
    # Its links alone, before any list is paired, join the copies.
    assert asked[0].count() >= 20


def group(r, m):
    """Texts of one template, each pair of them a little above or below the limit."""
    words = fixtures.prose(r, 400).split()
    return [" ".join(r.choice("abcdefgh") * 9 if r.random() < 0.018 else w for w in words) for _ in range(m)]


@pytest.mark.parametrize("piece", [1 << 21, 2_000])
def test_rows_grow_with_the_group_and_not_with_its_square(spark, monkeypatch, piece):
    """sets of one template that stay apart give rows in proportion to their number, however many lists they share; no link is lost."""
    monkeypatch.setattr(shingles, "PIECE", piece)
    counts = []
    for m in (30, 120):
        made = group(random.Random(21), m)
        texts = fixtures.frame(spark, [{"doc_id": k, "text": t, "lang": "en", "source": "s", "n_chars": 1} for k, t in enumerate(made)])
        texts = texts.selectExpr("doc_id AS own_id", "doc_id AS own_hash", "text")
        rows = common.staged(shingles.prints(texts))
        entries = common.staged(shingles.open_entries(shingles.list_entries(rows).withColumn("comp", F.col("fp"))))
        links = [tuple(x) for x in shingles.linked(entries, texts).collect()]
        sets = {shingles.set_key(own): own for own in (shingles.shingles(t.encode(), common.WordHash()) for t in made)}
        similar = [p for p in combinations(sets, 2) if shingles.similar(sets[p[0]], sets[p[1]])]
        counts.append((entries.select("shingle", "fp").distinct().count(), len(links)))

        def groups(pairs):
            parent = {k: k for k in sets}

            def root(k):
                while parent[k] != k:
                    k = parent[k]
                return k

            for a, b in pairs:
                parent[root(a)] = root(b)
            found = {}
            for k in sets:
                found.setdefault(root(k), set()).add(k)
            return {frozenset(v) for v in found.values()}

        assert len(similar) > m and groups(links) == groups(similar)
    (few, few_links), (many, many_links) = counts
    # Four times the sets are sixteen times the pairs.
    assert 0 < few and many <= 8 * few and many_links <= 8 * few_links
