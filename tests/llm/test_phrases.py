"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter as TallyOf
from collections import defaultdict

import numpy as np
import pytest
from quotegrain.llm import phrases

from tests.llm import fixtures


def plain(rows, least, top):
    counts, totals = defaultdict(TallyOf), TallyOf()
    for r in rows:
        lang = r["lang"] if r["lang"] is not None else "und"
        text = (r["text"] or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and inside(q) and 100 * b >= 80 * a for q, b in candidates.items()):
                continue
            score, _, left, right = min((2000000 * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def texts(seed, n=150):
    """Few words, so that runs repeat; set phrases, separators of every kind, odd white space."""
    r = random.Random(seed)
    sets = ["New York city hall", "ice cream", "as soon as possible", "naïve bayes", "É è ok", "a\x1cb c"]
    rows = []
    for k in range(n):
        parts = [r.choice(sets) if r.random() < 0.2 else r.choice("the of a river Stone ÄÖ x y window".split(" ")) for _ in range(r.randint(0, 40))]
        text = "".join(p + r.choice((" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "! ", ";")) for p in parts)
        rows.append({"doc_id": k, "text": text, "lang": r.choice(("en", "en", "de", None, "x\ny")), "source": None, "n_chars": len(text)})
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations(spark, seed, monkeypatch):
    """Containers that burst and tries that spill all the time, over several prefix partitions."""
    monkeypatch.setattr(phrases, "BURST", 6)
    monkeypatch.setattr(phrases, "HELD", 200)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 5_000)
    rows = texts(seed) + fixtures.documents(seed)[-8:]
    got = sorted(map(tuple, phrases.collocations(fixtures.frame(spark, rows), least=5, top=25).collect()))
    assert got == plain(rows, 5, 25) and len({g[0] for g in got}) == 4


def test_defaults_and_empty(spark):
    rows = fixtures.documents()
    assert sorted(map(tuple, phrases.collocations(fixtures.frame(spark, rows)).collect())) == plain(rows, 30, 2000)
    assert phrases.collocations(fixtures.empty(spark)).collect() == []


@pytest.mark.parametrize("width", [2, 4])
def test_trie_counts_what_a_table_counts(monkeypatch, width):
    """Through bursts on every level, and out again in one spill."""
    monkeypatch.setattr(phrases, "BURST", 20)
    monkeypatch.setattr(phrases, "HELD", 10**9)
    r = np.random.default_rng(2)
    counter = phrases.Counter(width, 2, 0)
    ids = counter.of("x")
    words = [ids[b"w%d" % k] for k in range(3000)]
    runs = r.choice(words[:6] + words[-3:], (width, 4000))
    rest = sum(runs[k].astype(np.int64) << phrases.BITS * (width - 1 - k) for k in range(1, width))
    for at in np.array_split(np.arange(4000), 7):
        assert list(counter.add(runs[0][at], rest[at])) == []
    want = TallyOf(zip(*runs.tolist(), strict=True))
    assert counter.held == len(want)
    code = counter.code(np.arange(len(counter.words)))
    (batch,) = counter.spill(0)
    first, *others, count = phrases.unpack(batch["run"][0].as_py())
    got = dict(zip(zip(np.cumsum(first, dtype=np.uint64).tolist(), *(o.tolist() for o in others), strict=True), count.tolist(), strict=True))
    assert got == {tuple(int(code[i]) for i in row): n for row, n in want.items()} and counter.held == 0
