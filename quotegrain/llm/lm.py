"""Interpolated modified Kneser-Ney language model, counted in Spark and memory-mapped by the workers that score.

Tasks count the runs of ``order`` tokens of their texts and deal them by hash to shards. A shard adds up its runs, writes them as
a sorted hash array and passes two things down to the shards of one order less: each run without its first token (a continuation) and
each run without its last (a context with its total and how many of its successors were seen once, twice, more often). So
every order is one shuffle of distinct runs, pre-aggregated on both sides, with no group by context: a hot word is spread over all
shards, and only its sums meet. What goes through the driver is one row of sums per order. Runs are told apart by 64 bits.

A text is ``order - 1`` start marks, its words, one end. P_k(w | context) = max(count - D, 0) / total + gamma * P_(k-1)(w | shorter
context), with D by count (1, 2, 3 or more) from the counts of counts of the order, gamma = what the discounts set free, and below
order 1 the uniform 1 / (V + 1); the words never seen share the one beyond V. Contexts never seen fall to the shorter one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrain.llm.arrays import HashArrays, new_folder, pack, save, shard_of, smallest, unpack
from quotegrain.llm.common import WordHash, crc_mod, each_batch, mixed, raw, staged

#: Order of the registered query.
ORDER = 2
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Codes of the start mark and the end; no word holds white space.
START, END = (np.uint64(xxhash.xxh64_intdigest(mark)) for mark in (b" ", b"\n"))
#: Bytes of text whose runs make up one shard, and tokens that a task counts before it passes them on.
SHARD_BYTES, FLUSH = 24_000_000, 3_000_000
#: Values of a run: times seen or continued, as a context the sum of its successors' counts and how many have count 1, 2, more; times seen.
VALUES = ["count", "total", "ones", "twos", "more", "seen"]
ROWS = "shard int, data binary, n1 long, n2 long, n3 long, n4 long, grams long, total long, more long, seen long, types long"


@dataclass(frozen=True)
class Model:
    """What a worker needs besides the files; a few numbers per order."""

    folder: str
    bits: int
    order: int
    tokens: int  # N of the training texts
    types: int  # V
    discounts: tuple[tuple[float, float, float], ...]  # per order from 1
    lowest: tuple[int, int, int, int]  # total, ones, twos, more of the empty context


def keys_of(words: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(words[0]), np.uint64)
    for column in words:
        out = out * BASE + column
    return mixed(out)


def merged_runs(words: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct runs in the order of their keys with summed values."""
    keys = keys_of(words)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, words, values
    return keys[first], [w[order[first]] for w in words], [np.add.reduceat(v[order].astype(np.int64), first) for v in values]


def _dealt(words: list[np.ndarray], values: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes]]:
    """(shard, packed runs); within a shard by first word, which packs well."""
    keys, words, values = merged_runs(words, values)
    shards = shard_of(keys, bits)
    order = np.lexsort((words[0], shards))
    cuts = np.flatnonzero(np.r_[True, shards[order][1:] != shards[order][:-1]]) if len(order) else []
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)] if len(cuts) else [], strict=True):
        at = order[a:b]
        steps = np.diff(words[0][at], prepend=np.uint64(0))
        yield int(shards[at[0]]), pack([steps, *(w[at] for w in words[1:]), *(smallest(v[at]) for v in values)])


def stream_of(texts: list[bytes], codes: WordHash, order: int) -> np.ndarray:
    """Codes of the texts end to end, each led by start marks and closed by the end."""
    lead, tail = np.full(order - 1, START), np.array([END])
    parts = [x for t in texts for x in (lead, codes.codes(t.lower().split()), tail)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _rows(dealt: list[tuple[int, bytes]], **sums: int) -> pa.RecordBatch:
    """Packed runs and, if given, one row of sums without data."""
    names = ROWS.replace(" int", "").replace(" binary", "").replace(" long", "").split(", ")
    extra = int(bool(sums))
    cols = [pa.array([s for s, _ in dealt] + [None] * extra, pa.int32()), pa.array([d for _, d in dealt] + [None] * extra, pa.binary())]
    cols += [pa.array([None] * len(dealt) + [sums[c]] * extra, pa.int64()) for c in names[2:]] if extra else [pa.nulls(len(dealt), pa.int64())] * len(names[2:])
    return pa.RecordBatch.from_arrays(cols, names=names)


def _counted(order: int, bits: int):
    """Texts to packed runs of ``order`` tokens."""

    def flush(parts: list[np.ndarray]):
        stream = np.concatenate(parts)
        n = len(stream) - order + 1
        words = [stream[k : k + n] for k in range(order)]
        ends = words[-1] != START
        words = [w[ends] for w in words]
        ones = np.ones(len(words[0]), np.uint8)
        return _rows(list(_dealt(words, [ones, *[np.zeros_like(ones)] * 4, ones], bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, parts, size = WordHash(), [], 0
        for batch in batches:
            parts.append(stream_of(raw(batch["text"]), codes, order))
            size += len(parts[-1])
            if size >= FLUSH:
                yield flush(parts)
                parts, size = [], 0
        if size:
            yield flush(parts)

    return run


def _level(k: int, bits: int, folder: str):
    """Adds up the runs of ``k`` tokens of one shard, stores them, passes continuations and contexts down."""

    def run(group: pa.Table) -> pa.Table:
        blobs = [unpack(d) for d in group["data"].to_pylist()]
        words = [np.concatenate([np.cumsum(b[0], dtype=np.uint64) if c == 0 else b[c] for b in blobs]) for c in range(k)]
        values = [np.concatenate([b[k + c].astype(np.int64) for b in blobs]) for c in range(len(VALUES))]
        keys, words, values = merged_runs(words, values)
        count, seen = values[0], values[5]
        stored = dict(zip(VALUES, values, strict=True))
        if k > 1:
            stored.pop("seen")
        save(folder, f"runs{k}", int(group["shard"][0].as_py()), bits, keys, stored)
        dealt = []
        if k > 1:
            on = count > 0
            count, seen, words = count[on], seen[on], [w[on] for w in words]
            one, none = np.ones(len(count), np.int64), np.zeros(len(count), np.int64)
            dealt += _dealt(words[1:], [one, none, none, none, none, seen], bits)
            dealt += _dealt(words[:-1], [none, count, count == 1, count == 2, count > 2, none], bits)
        n = [int((count == c).sum()) for c in (1, 2, 3, 4)]
        sums = {"grams": int((count > 0).sum()), "total": int(count.sum()), "more": int((count > 2).sum()), "seen": int(seen.sum()), "types": int((seen > 0).sum())}
        return pa.Table.from_batches([_rows(dealt, n1=n[0], n2=n[1], n3=n[2], n4=n[3], **sums)])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more; plain halves where the counts of counts do not give them."""
    out = []
    for k, (n, more) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * (n1 / (n1 + 2 * n2)) * more / n if n1 and n2 and n else k / 2
        out.append(min(float(k), max(k / 20, d)))
    return out[0], out[1], out[2]


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Counts every text of ``docs``(text), null as empty, and stores the model in the shared folder."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    bits = max(0, (-(-size // SHARD_BYTES) - 1).bit_length())
    folder = new_folder(spark, "lm")
    rows = texts.mapInArrow(_counted(order, bits), ROWS)
    found = []
    for k in range(order, 0, -1):
        rows = staged(rows.where("data IS NOT NULL").select("shard", "data").groupBy("shard").applyInArrow(_level(k, bits, folder), ROWS))
        found.append(rows.where("data IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns[2:])).first())
    lowest = found[-1]
    return Model(
        folder, bits, order, int(lowest["seen"]), int(lowest["types"]), tuple(discounts(r["n1"], r["n2"], r["n3"], r["n4"]) for r in reversed(found)),
        (int(lowest["total"]), int(lowest["n1"]), int(lowest["n2"]), int(lowest["more"])))


class Scorer:
    """Probabilities of the tokens of a stream; one per task, which maps the files that it meets."""

    def __init__(self, model: Model):
        self.model = model
        self.tables = [HashArrays(model.folder, f"runs{k}", model.bits) for k in range(1, model.order + 1)]

    def tokens(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(times seen in training, base log10, model log10) per place of the stream; start marks have no meaning there."""
        m, size = self.model, len(stream)
        p = np.full(size, 1 / (m.types + 1))
        total, ones, twos, more = (np.full(size, float(x)) for x in m.lowest)
        seen = np.zeros(size)
        for k, table in enumerate(self.tables, 1):
            if size < k:
                break
            d1, d2, d3 = m.discounts[k - 1]
            keys = keys_of([stream[c : size - k + 1 + c] for c in range(k)])
            _, got = table.find(keys, VALUES)
            # Values of the run that ends at each place; the first places have none.
            count, *context, times = (np.r_[np.zeros(k - 1), v] for v in got)
            if k == 1:
                seen = times
            taken = np.where(count > 2, d3, np.where(count > 1, d2, d1))
            kept = np.where(count > 0, count - taken, 0.0)
            free = d1 * ones + d2 * twos + d3 * more
            p = np.where(total > 0, (kept + free * p) / np.where(total > 0, total, 1), p)
            # The run that ends one place earlier is the context of the next order.
            total, ones, twos, more = (np.r_[np.zeros(1), v[:-1]] for v in context)
        base = np.log10((seen + 0.1) / (m.tokens + 0.1 * (m.types + 1)))
        return seen, base, np.log10(p)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, scorer = WordHash(), Scorer(model)

        def score(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = raw(batch["text"])
            stream = stream_of(texts, codes, model.order)
            seen, base, own = scorer.tokens(stream)
            real = stream != START
            ends = np.flatnonzero(stream == END)
            starts = np.r_[0, ends[:-1] + 1]
            sums = [np.add.reduceat(np.where(real, v, 0), starts) for v in (1, seen > 0, base, own)]
            cols = [pa.array(np.asarray(s, kind)) for s, kind in zip(sums, (np.int64, np.int64, np.float64, np.float64), strict=True)]
            return pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *cols], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        yield from each_batch(score)(batches)

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of every row of ``docs``(doc_id, held_out, text)."""
    rows = docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scored(model), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def language_model(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of all ``docs``(doc_id, text) by a model of those whose crc32(doc_id) mod 10 is not 0.

    Null and empty texts are the end alone. Rows without doc_id are held out. Repeated rows are counted and scored as often as they
    occur. Without training texts every token has probability one. Other columns are ignored; no rows give no rows.
    """
    rows = docs.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "text")
    model = train(rows.where("NOT held_out"), order)
    found = scores(rows, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
