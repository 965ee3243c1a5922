"""Operators that judge one text at a time, against plain versions, truth by construction or held-out accuracy."""

import math
import random
from collections import Counter

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from quotegrain.llm import common, compression, decontamination, language, mixing, pii, tokens, toxicity
from quotegrain.llm.common import crc_mod

from tests.llm import brute, fixtures

ROWS = fixtures.documents()
PAIRS = [(r["doc_id"], r["text"]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.frame(spark, ROWS)


# Decontamination


def items(r):
    made = [(k, fixtures.prose(r, r.randint(15, 60)) + " " + fixtures.prose(r, 8).title() + ".") for k in range(12)]
    return made + [(50, "tiny one"), (51, ""), (52, None), (53, fixtures.prose(r, 90, "de")), (54, made[3][1])]


def test_leaks(spark):
    r = random.Random(11)
    tests = items(r)
    rows = [dict(x) for x in ROWS]
    for k, (_, t) in enumerate(tests):
        if t:
            at = rows[k]["text"].split()
            rows[k]["text"] = " ".join(at[:20] + [t.upper() if k % 2 else t] + at[20:])
    cut = tests[5][1].split()
    rows[30]["text"] += " " + " ".join(cut[: len(cut) // 2])
    rows[31]["text"] += " a tiny one here"
    df = spark.createDataFrame(tests, "item_id long, text string")
    got = decontamination.leaks(fixtures.frame(spark, rows), df).collect()
    want = brute.bm25_leaks([(x["doc_id"], x["text"]) for x in rows], tests)
    assert {(x["doc_id"], x["item_id"]) for x in got} == want
    assert {(k, i) for k, (i, t) in enumerate(tests) if t} | {(31, 50)} <= want and not any(d == 30 for d, _ in want)
    clean = decontamination.without_leaks(fixtures.frame(spark, rows), df)
    assert Counter(x["doc_id"] for x in clean.collect()) == Counter(x["doc_id"] for x in rows if not brute.bm25_leaks([(0, x["text"])], tests))


def test_leaks_with_many_indexes_and_long_items(spark, docs, monkeypatch):
    r = random.Random(12)
    tests = [*items(r), (60, fixtures.prose(random.Random(3), 700))]
    df = spark.createDataFrame(tests, "item_id long, text string")
    rows = [dict(x) for x in ROWS]
    rows[2]["text"] += " " + tests[-1][1]
    frame = fixtures.frame(spark, rows)
    whole = sorted(tuple(x)[:2] for x in decontamination.leaks(frame, df).collect())
    monkeypatch.setattr(decontamination, "SHARD", 3)
    monkeypatch.setattr(decontamination, "TOGETHER", 2)
    assert sorted(tuple(x)[:2] for x in decontamination.leaks(frame, df).collect()) == whole
    assert (2, 60) in whole


def test_items_without_id(spark, docs):
    """Items without item_id, and repeated ones, are indexed like any other."""
    tests = items(random.Random(12))
    rows = [dict(x) for x in ROWS]
    rows[2]["text"] += " " + tests[0][1]
    df = spark.createDataFrame([(None, tests[0][1]), (None, tests[1][1]), tests[0], tests[0], (None, None)], "item_id long, text string")
    got = decontamination.leaks(fixtures.frame(spark, rows), df).collect()
    assert Counter(x["item_id"] for x in got if x["doc_id"] == 2) == {None: 1, tests[0][0]: 2}


def test_leaks_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(docs, none).collect() == []
    assert decontamination.without_leaks(docs, none).count() == docs.count()
    assert decontamination.leaks(fixtures.empty(spark), spark.createDataFrame(items(random.Random(1)), "item_id long, text string")).collect() == []


def test_cut_and_edited_copies_of_every_item_leak():
    """Short answers among them: a copy that stops at 80 % of the words, and one with any single word changed."""
    r = random.Random(17)
    tests = [(k, fixtures.prose(r, r.randint(11, 50)) + ". " + fixtures.prose(r, r.randint(1, 9)).title() + ".") for k in range(40)]
    bodies = [decontamination.terms(t) for _, t in tests]
    df = Counter(w for b in bodies for w in set(b))
    index = decontamination.Index.build(tests, df, len(bodies), sum(map(len, bodies)) / len(bodies))
    around = [fixtures.prose(r, 30, "de").split(), fixtures.prose(r, 30, "de").split()]
    for k, body in enumerate(bodies):
        copies = [body[: math.ceil(0.8 * len(body))], body[: math.ceil(0.9 * len(body))]]
        copies += [[*body[:at], "zzz", *body[at + 1 :]] for at in range(len(body))]
        assert all(k in found for found in index.asked([around[0] + c + around[1] for c in copies])), body
        assert not any(k in found for found in index.asked([around[0] + body[: len(body) // 2] + around[1]]))


# Language ID


def test_language_on_held_out_rows(docs):
    got = {r["doc_id"]: r for r in language.language_id(docs).where("doc_id is not null").collect()}
    for row in ROWS:
        if row["doc_id"] is None:
            continue
        r = got[row["doc_id"]]
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in row["text"] or ""):
            assert r["lang_pred"] == "und" and r["score"] == 0
        elif row["lang"] and len(row["text"]) > 100:
            assert r["lang_pred"] == row["lang"]
    held = {r["doc_id"] for r in docs.where(crc_mod("doc_id", 4) == 2).collect()}
    assert {d for d, r in got.items() if r["held_out"]} == held


def test_rank_distance_by_hand():
    model = language.Profiles.build([("x", 97, 0), ("x", 98, 1), ("y", 98, 0), ("y", 99, 5)])
    import numpy as np

    own = np.array([98, 100], np.uint64)
    assert model.distances(own).tolist() == [1 + language.RANKS, 0 + language.RANKS]


def test_grams_are_counted():
    keys, counts = language.grams("Ab, ab!")
    have = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    a, b, s = ord("a"), ord("b"), 32
    pack = lambda *c: sum(x << 21 * (len(c) - 1 - k) for k, x in enumerate(c))
    assert have == {a: 2, b: 2, pack(s, a): 2, pack(a, b): 2, pack(b, s): 2, pack(s, a, b): 2, pack(a, b, s): 2, pack(b, s, a): 1}


def test_language_of_nothing(spark):
    assert language.language_id(fixtures.empty(spark)).collect() == []


# Personal data


def test_base_spans(spark):
    texts = [
        "a@b.co, x.y@z.example.org. ip 1.2.3.4.5 999.1.1.1 007.8.9.10 +1 (269) 555-3296 4111 1111 1111 1111", "card 4111-1111-1111-1112 5 4111111111111111", None, "",
        "+49 30 123456-7 and +1 2 üé@x.y ä 10.0.0.1", "0" * 3000 + ".1.2.3",
    ]
    rows = [{"doc_id": k, "text": t, "lang": None, "source": None, "n_chars": 0} for k, t in enumerate(texts)] + ROWS
    got = pii.personal_data(fixtures.frame(spark, rows)).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(brute.personal_data([(r["doc_id"], r["text"]) for r in rows]))
    for r in got:
        if r["doc_id"] == 1 and "card" in r["spans"]:
            assert "card:27:43" in r["spans"].split(",")  # inside a longer run that fails as a whole


def test_detector_on_held_out_insertions():
    bodies = [fixtures.prose(random.Random(k), 150) for k in range(160)]
    model = pii.train([r for k, b in enumerate(bodies[:120]) for r in pii.lessons(b, k)])
    right = found = true = 0
    for k, b in enumerate(bodies[120:]):
        made, truth = pii.labelled(b, 1000 + k)
        got = set(model.spans(made))
        assert set(pii.base_spans(made)) <= got
        right, found, true = right + len(got & truth), found + len(got), true + len(truth)
    assert right / found > 0.97 and right / true > 0.85


def test_a_spelled_out_address_alone_is_found():
    """No '@' and no 'dot' anywhere else in the text."""
    for address in ("jane.roe (at) example.com", "jane [at] example.org", "jane at example.org"):
        assert ("email", 6, 6 + len(address)) in pii.proposals(f"write {address}, please")
    bodies = [fixtures.prose(random.Random(k), 150) for k in range(120)]
    model = pii.train([r for k, b in enumerate(bodies) for r in pii.lessons(b, k)])
    for name in ("jane", "bob.roe", "carl17"):
        text = f"some words before mail {name} (at) example.com and after"
        at = text.index(name)
        assert model.spans(text) == [("email", at, text.index(" and"))]


def test_redaction(docs):
    assert pii.redacted("x a@b.co y", [("email", 2, 8)]) == "x [EMAIL] y"
    out = pii.redact(docs)
    assert out.columns == docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for r in out.collect():
        was = before[r["doc_id"]]
        assert r["text"] == was["text"] and r["n_chars"] == was["n_chars"]


# Compression


def test_compression_counts(docs):
    got = compression.compression_quality(docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter(brute.compression_base(PAIRS))
    assert all(not (r["base_failed"] and r["kept"]) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["kept"] for k in range(40))


def test_compression_rejects_repetition_and_noise():
    import base64
    import zstandard

    press = zstandard.ZstdCompressor(level=compression.LEVEL)
    noise = base64.b85encode(random.Random(1).randbytes(6000))
    r = random.Random(2)
    for body, fine in (
        (fixtures.prose(r, 400).encode(), True), (b"ab cd ef gh ij kl mn op qr st " * 100, False), (noise, False), (fixtures.prose(r, 30).encode(), True),
        (fixtures.prose(r, 3000).encode() + noise, True),
    ):
        assert compression.in_band(len(body), *compression.ratios(body, press)) == fine, body[:40]


def test_compression_of_mixtures():
    """Blocks of base64 and of repeats in prose are rejected at a part of the text, wherever they stand and however long it is."""
    import base64
    import zstandard

    press = zstandard.ZstdCompressor(level=compression.LEVEL)
    r = random.Random(6)
    known = ["".join(r.choice(("the", "an", "ri", "o", "ent", "sh", "ing", "ou", "er", "st", "le", "wa")) for _ in range(r.randint(1, 3))) for _ in range(400)]
    for size in (700, 1500, 4096, 10240, 20480, 40960):
        prose = " ".join(r.choice(known) for _ in range(size)).encode()
        assert compression.in_band(size, *compression.ratios(prose[:size], press))
        for part in (0.5, 0.7, 0.9):
            cut = size - int(part * size)
            made = base64.encodebytes(r.randbytes(size))[: size - cut], (b"click here to read more and sign up now. " * (size // 40 + 1))[: size - cut]
            for block in made if part > 0.5 else made[:1]:
                for at in (0, cut // 2, cut):
                    body = prose[:at] + block + prose[at:cut]
                    assert len(body) == size and not compression.in_band(size, *compression.ratios(body, press)), (size, part, at)
    tail = fixtures.prose(r, 400).encode()[:1100] + base64.encodebytes(r.randbytes(900))[:900]
    assert compression.ratios(tail, press)[1:] == (4, 2)
    assert compression.ratios(tail[:1900], press)[1] == 4  # the last chunk ends with the text


def test_compression_of_nothing(spark):
    assert compression.compression_quality(fixtures.empty(spark)).collect() == []


# Toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(4)
    lexicon = ["scum", "idiot", "moron", "worthless", "trash", "trasher", "pathétic"]
    words = lexicon + ["".join(r.choice("scumidotrahe") for _ in range(r.randint(1, 9))) for _ in range(400)]
    for w in lexicon * 12:
        k = r.randrange(len(w))
        words.append(r.choice((w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "o" + w[k + 1 :], w[:k] + "t" + w[k:])))
    words = [w for w in words if w]
    probe = toxicity.Automaton(lexicon)
    codes, starts, ends, _, _ = toxicity.laid_words([" ".join(words)])
    at, _, cost = probe.run(codes, starts, ends)
    got = dict(zip(at.tolist(), cost.tolist(), strict=True))
    for k, w in enumerate(words):
        best = min((d for d, x in ((edits(w, x), x) for x in lexicon) if d == 0 or (d == 1 and len(x) >= toxicity.FUZZY_FROM)), default=None)
        assert got.get(k) == best, w


def test_quotation_is_told_from_abuse():
    probe = toxicity.Automaton(["idiot", "moron"])
    x = toxicity.features(["you idiot and moron", 'the word "idiot" is old', "plain words", "", "an idi0t"], probe)
    at = toxicity.FEATURES.index
    assert x[0, at("exact")] > 0 and x[0, at("clustered")] > 0 and x[0, at("quoted")] == 0
    assert x[1, at("quoted")] > 0 and x[1, at("exact")] == 0
    assert not x[2].any() and not x[3].any() and x[4, at("fuzzy")] > 0


def toxic_table(spark):
    r = random.Random(21)
    rows, labels = [], []
    for k in range(400):
        words = fixtures.prose(r, r.randint(10, 60)).split()
        bad = k % 5 == 1
        if bad:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(("scumbag", "worthless", "moronic")))
        rows.append({"doc_id": k, "text": " ".join(words), "lang": "en", "source": "s", "n_chars": 1})
        if k % 3:
            labels.append((k, int(bad)))
    rows += [{"doc_id": k, "text": t, "lang": None, "source": None, "n_chars": 0} for k, t in ((900, None), (901, ""), (None, "fine words"))]
    return rows, spark.createDataFrame([*labels, (901, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_table(spark)
    docs = fixtures.frame(spark, rows)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    for r in got:
        assert r["predicted"] == int(r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 5 == 1)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got)


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, none).collect()
    assert len({r["score"] for r in found}) == 1 and all(r["score"] < 0.5 and r["predicted"] == 0 for r in found)


# Tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_token_counts_and_cache(spark, docs, tmp_path, name):
    cache = str(tmp_path / "cache")
    want = Counter(brute.token_counts(PAIRS, public_tokenizers.path(name)))
    got = tokens.token_counts(docs, cache, name)
    assert Counter(tuple(r) for r in got.collect()) == want
    first = spark.read.parquet(cache).count()
    assert first == len({b" ".join((t or "").encode().split()) for _, t in PAIRS})
    again = tokens.token_counts(docs, cache, name)
    assert Counter(tuple(r) for r in again.collect()) == want
    assert spark.read.parquet(cache).count() == first
    more = fixtures.frame(spark, [*ROWS, {"doc_id": 7000, "text": "a new text", "lang": None, "source": None, "n_chars": 1}])
    tokens.token_counts(more, cache, name)
    assert spark.read.parquet(cache).count() == first + 1
    assert tokens.token_counts(fixtures.empty(spark), str(tmp_path / "none"), name).collect() == []


def test_pieces_have_the_tokens_of_the_whole():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, parts = Tokenizer.from_file(path), tokens.Counter(path)
    r = random.Random(9)
    marks = ["'s", "'T", "''d", "it's", " ", "\n", "\x1c", "\x85", " ", "é", "é", "ΑΣ", "<|endoftext|>", "<|", "12", "_a", "...", "日本", "İ", "\x00", "Ab", "!'s"]
    for _ in range(300):
        text = "".join(r.choice(marks) for _ in range(r.randint(0, 12)))
        assert parts.count([text.encode()]) == [len(whole.encode(text, add_special_tokens=False).ids)], repr(text)


# Mixing


def test_mix(docs):
    got = mixing.mix(docs).collect()
    want = Counter(brute.mix([(r["doc_id"], r["source"], r["text"]) for r in ROWS]))
    assert Counter((r["doc_id"], r["size"], r["source_size"], r["target"]) for r in got) == want
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_slices_do_not_change_the_mix(spark, docs):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    whole = Counter(map(tuple, mixing.mix(docs).collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert Counter(map(tuple, mixing.mix(docs).collect())) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_positions_follow_the_schedule(spark):
    """By time t a source has been read for its share of the integral of its schedule."""
    rows = [{"doc_id": k, "text": "w " * 20, "lang": None, "source": "abc"[k % 3], "n_chars": 1} for k in range(600)]
    out = mixing.training_order(fixtures.frame(spark, rows)).collect()
    at = [r["mix_position"] for r in out]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    for k, source in enumerate("abc"):
        own = [(r["mix_position"], r["mix_words"]) for r in out if r["source"] == source]
        total = sum(w for _, w in own)
        early, late = mixing.SCHEDULE[k]
        a, b = 2 * early / (early + late), 2 * late / (early + late)
        for t in (0.25, 0.5, 0.75):
            assert abs(sum(w for p, w in own if p < t) / total - (a * t + (b - a) * t * t / 2)) < 0.02
        assert all(len(r["text"].split()) == r["mix_words"] for r in out if r["source"] == source)


def test_cut_texts_keep_their_words(spark):
    """A cut reading of a text that begins with white space, clashing columns, alike rows and rows without id."""
    rows = [{"doc_id": k, "text": "\n\n\tuno dos tres cuatro cinco seis siete", "lang": None, "source": "a", "n_chars": 1} for k in range(5)]
    rows += [{"doc_id": 9, "text": "x y z", "lang": None, "source": "b", "n_chars": 2}] * 4
    rows += [{"doc_id": None, "text": f"p{k} q r", "lang": None, "source": "b", "n_chars": 2} for k in range(6)]
    docs = fixtures.frame(spark, rows).withColumn("mix_words", F.lit("mine")).withColumn("mix_epoch", F.lit(None).cast("string"))
    found = mixing.training_order(docs)
    assert len(found.columns) == len(set(found.columns)) and set(mixing.ADDED) <= set(found.columns)
    out = found.collect()
    assert any(r["mix_words"] < 7 and r["source"] == "a" for r in out)
    for r in out:
        assert brute.WORD.findall(r["text"]) == "uno dos tres cuatro cinco seis siete".split()[: r["mix_words"]] if r["source"] == "a" else len(r["text"].split()) == r["mix_words"]
    mixed = Counter()
    for r in mixing.mix(docs).collect():
        mixed[r["doc_id"]] += r["taken"]
    taken = Counter()
    for r in out:
        taken[r["doc_id"]] += r["mix_words"]
    assert taken == Counter({k: n for k, n in mixed.items() if n})


def test_shares_hold_at_any_size():
    """The share of a sample is taken from all bits of the hash: 4,000 of four billion rows are not none."""
    for limit, n in ((4_000, 4_000_000_001), (600, 600_000_001), (100, 100_000_001), (100, 10**13)):
        share = (common.highest(limit, n) + (1 << 63)) / (1 << 64)
        assert share * n == pytest.approx(limit, rel=1e-6)
    assert common.highest(100, 50) == (1 << 63) - 1 and common.highest(100, 0) < 0


def test_mix_of_nothing(spark):
    assert mixing.mix(fixtures.empty(spark)).collect() == []
    assert mixing.training_order(fixtures.empty(spark)).collect() == []


def test_fill():
    assert mixing.fill([10, 10, 10], [5, 2, 1], 1.5, 2.0) == [20.0, pytest.approx(50 / 3), pytest.approx(25 / 3)]
    assert mixing.fill([0, 4], [5, 2], 1.5, 2.0) == [0.0, 6.0]
    assert mixing.fill([], [], 1.5, 2.0) == []


def test_sql_twins(spark, tmp_path):
    """The registered SQL texts on the small table, with nulls and repeated rows but for the null id, which SQL sorts otherwise."""
    import duckdb

    from quotegrain.llm import queries

    rows = [r for r in ROWS if r["doc_id"] is not None][:-1]
    fixtures.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    rng = random.Random(6)
    vectors = [(k, [rng.gauss(0, 1) for _ in range(32)], k % 3 if k % 5 else None) for k in range(100)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    for name, text in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, str(tmp_path))
        cursor = con.execute(text)
        at = [[d[0] for d in cursor.description].index(c) for c in df.columns]
        assert Counter(map(tuple, df.collect())) == Counter(tuple(r[k] for k in at) for r in cursor.fetchall()), name


def test_the_mix_is_taken_by_its_schedule(spark, tmp_path, docs):
    """the words that op10 returns are those of readings that the schedule makes due, so its plan computes their times."""
    from quotegrain.llm import queries

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op10_mixing(spark, str(tmp_path))
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT" in plan and "early" in plan
    rows = mixing.mix(docs)
    want = rows.groupBy("source").agg(F.sum("taken").alias("n")).where("n > 0").collect()
    got = mixing.readings(rows).groupBy("source").agg(F.sum("words").alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {r["source"]: r["n"] for r in want} and want


def test_the_query_reads_its_training_order(spark, tmp_path, docs):
    """op10 makes the order of all readings, counts ``taken`` from it and returns rows as they are first read; plain Python gives the times."""
    from quotegrain.llm import queries

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    made = []
    was = mixing.ordered
    mixing.ordered = lambda *a: made.append(was(*a)) or made[-1]
    try:
        found = queries.op10_mixing(spark, str(tmp_path)).collect()
    finally:
        mixing.ordered = was
    rows = mixing.mix(docs).collect()
    want = Counter((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in rows)
    assert Counter(map(tuple, found)) == want
    # Without nulls and repeats of an id, a row's place is that of its document.
    ids = Counter(r["doc_id"] for r in rows)
    at = {r["doc_id"]: r["position"] for r in rows}
    first = [at[r["doc_id"]] for r in found if r["doc_id"] is not None and ids[r["doc_id"]] == 1]
    times = [t for t in first if t is not None]
    assert times == sorted(times) and first[len(times):] == [None] * (len(first) - len(times))
    order = made[0].collect()
    for r in order:
        x = next(x for x in rows if (x["source"], x["start"], x["doc_id"]) == (r["source"], r["start"], r["doc_id"]) and x["size"] > 0)
        a = 2 * x["early"] / (x["early"] + x["late"])
        asked = (r["epoch"] * x["source_size"] + r["start"]) / x["target"]
        due = min(1.0, 2 * asked / (a + max(0.0, a * a + 4 * (1 - a) * asked) ** 0.5))
        assert r["position"] == pytest.approx(due, abs=1e-12) and r["words"] > 0
    assert sum(r["words"] for r in order) == sum(r["taken"] for r in rows) and any(r["epoch"] for r in order)
