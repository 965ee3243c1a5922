"""The corpus pipeline against a plain version of each stage's decision."""

import random
import re
from collections import Counter

import corpus_pipeline
from quotegrain.llm import mixing

from tests.llm import brute, fixtures
from tests.llm.test_shingles import kept_ids


def tables(spark, folder):
    r = random.Random(31)
    rows = fixtures.documents(3)
    items = [(k, fixtures.prose(r, 40) + " " + fixtures.prose(r, 9).title()) for k in range(5)]
    labels = []
    for k in range(200, 500):
        words = fixtures.prose(r, r.randint(25, 70)).split()
        bad = k % 6 == 0
        if bad:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(("scumbag", "worthless", "moronic")))
        if k % 50 == 7:
            words.insert(10, items[k % 5][1])
        if k % 40 == 9:
            words.insert(5, "write to ann.lee@mail.example.com or +1 (269) 555-3296")
        rows.append({"doc_id": k, "text": " ".join(words), "lang": "en", "source": f"s{k % 3}", "n_chars": len(" ".join(words))})
        labels.append((k, int(bad)))
    spark.createDataFrame([tuple(x.values()) for x in rows], fixtures.SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_pipeline(spark, tmp_path):
    rows, items = tables(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # 1. The made-up insults decide.
    left = [x for x in rows if not re.search("scumbag|worthless|moronic", x["text"] or "")]
    # 2. The smallest id of each group of near copies, by brute force over all pairs of sets.
    ids, links = kept_ids(left)
    assert links
    left = list({x["doc_id"]: x for x in left if x["doc_id"] in ids}.values())
    # 3. and 4.
    leaked = {d for d, _ in brute.bm25_leaks([(x["doc_id"], x["text"]) for x in left], items)}
    assert leaked
    left = [x for x in left if x["doc_id"] not in leaked]
    clean = {}
    for x in left:
        text = x["text"]
        for kind, a, b in sorted(brute.base_pii(text), key=lambda s: -s[1]):
            text = text[:a] + f"[{kind.upper()}]" + text[b:]
        clean[x["doc_id"]] = text
    assert sum(t != x["text"] for x, t in zip(left, clean.values(), strict=True)) >= 5
    # 5. Every kept document that the mix takes, whole unless its source's target ends in it.
    sized = brute.mix([(d, x["source"], clean[d]) for x in left for d in [x["doc_id"]]])
    target = {}
    for x, (_, _, _, t) in zip(left, sized, strict=True):
        target[x["source"]] = t
    words = Counter()
    for r in out:
        body = brute.WORD.findall(r["text"])
        assert len(body) == r["mix_words"] > 0
        if r["text"] != clean[r["doc_id"]]:
            assert body == brute.WORD.findall(clean[r["doc_id"]])[: r["mix_words"]]
        words[r["source"]] += r["mix_words"]
    assert all(abs(words[s] - t) <= 1 for s, t in target.items())
    at = [r["mix_position"] for r in out]
    assert at == sorted(at)
    assert [c for c in out[0].asDict()][:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = fixtures.frame(spark, fixtures.documents(4))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, fixtures.empty(spark), str(tmp_path)).collect() == []


def test_without_labels_nothing_goes(spark, tmp_path):
    """An empty labels table, or labels of one kind, teach nothing, and the stage passes every document on."""
    docs = fixtures.frame(spark, fixtures.documents(4))
    for labels in ([], [(k, 1) for k in range(60)], [(k, 0) for k in range(60)]):
        path = tmp_path / f"{len(labels)}-{sum(x for _, x in labels)}"
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, str(path)).count() == docs.count()


def test_schedules_keep_their_mean():
    assert all(abs((a + b) / 2 - 1) < 1e-9 for a, b in mixing.SCHEDULE)
