"""Small tables with copies, edits, empty and long texts, nulls, repeated rows, and columns whose names clash with the operators' own."""

from __future__ import annotations

import random

VOCABULARY = {
    "en": "the of and river stone window market letter winter garden silver morning paper bridge candle orchard".split(),
    "de": "der die und straße fenster größe brücke wasser schnee garten öffnung spiegel zeitung küche".split(),
}


def prose(r: random.Random, n: int, lang: str = "en") -> str:
    words = [r.choice(VOCABULARY[lang]) + r.choice(("", "", "", "s", "ing", "er", "ly")) + r.choice(("", "", "x", "q", "zu", "ka", "mo")) for _ in range(n)]
    return " ".join(w + ("." if k % 11 == 10 else "") for k, w in enumerate(words))


def documents(seed: int = 1) -> list[dict]:
    """Rows (doc_id, text, lang, source, n_chars) and clashing extras."""
    r = random.Random(seed)
    texts = [(prose(r, r.randint(30, 160), lang := r.choice(("en", "de"))), lang) for _ in range(40)]
    passage = prose(r, 40)
    texts += [(prose(r, 30) + " " + passage + " " + prose(r, 20), "en") for _ in range(6)]
    base = prose(r, 200)
    texts += [(base, "en"), (base, "en")]
    for k in (20, 90, 150):
        words = base.split()
        words[k] = "changed"
        texts.append((" ".join(words), "en"))
    texts += [("", "en"), ("   \n\t ", None), (None, "de"), ("one", "en"), ("A\x0bB\x1cC D  e", None), (prose(r, 12), "en"), ((passage + "\n") * 30, "en")]
    texts += [("1234 , 99 !!", "en"), (prose(r, 15_000), "en"), ("Straße ÄÖÜ <|endoftext|> it's 'tis ﬁn don't 12", "de")]
    rows = [
        {"doc_id": k, "text": t, "lang": lang, "source": None if k % 9 == 4 else f"s{k % 4}", "n_chars": None if t is None else len(t)}
        for k, (t, lang) in enumerate(texts)
    ]
    rows.append(dict(rows[3]))
    rows.append({"doc_id": None, "text": rows[5]["text"], "lang": None, "source": None, "n_chars": None})
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows: list[dict]):
    """With columns that the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([tuple(x[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for x in rows], SCHEMA)
    return df.repartition(3).select("*", F.lit(1).alias("chunk"), F.lit("x").alias("fp"), F.lit(2).alias("size"), F.lit(None).alias("row"), F.lit(0.5).alias("score"))


def empty(spark):
    return frame(spark, [])
