"""Benchmark decontamination: a BM25 inverted index of test items, asked by every training passage with block-max WAND.

Items are the indexed documents, passages the queries. Impacts are scaled by an item's score against itself, so a score is the share
of the item that a passage holds and one threshold serves all items. A passage is dropped as soon as the upper bounds of its
terms stay below the threshold; then blocks of items are, by their block maxima; what is left is scored document at a time with
pivoting. Every item above the threshold comes back and is verified: word runs of its question and of its answer must both
stand in the text, or runs of nearly the whole item, since a short answer is soon lost to a cut or a changed word. Passages overlap by half, so every run of ``STRIDE`` words lies whole in one.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrain.llm.arrays import get, new_folder, put
from quotegrain.llm.common import each_batch, texts

#: Words between passage starts, which are twice as long; longer items are indexed in parts of that length.
STRIDE = 128
K1, B = 1.2, 0.75
#: Share of an item's own score, and of the words of question and answer in common runs, that count as a leak.
SCORE, OVERLAP = 0.6, 0.5
#: Share of all words of an item in common runs that counts whichever of them are its answer.
WHOLE = 0.75
RUN = 3
#: Items with fewer words must stand in the text word for word.
SHORT = 8
#: Items of one index and indexes that one pass over the texts asks; more items make more passes. Entries of one block.
SHARD, TOGETHER = 500, 8
BLOCK = 2
WORDS = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.?!\n])\s+")


def terms(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer: the last sentence is the answer, or the last third of a single one."""
    parts = [w for w in map(terms, SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def overlap(part: list[str], runs: set[tuple], width: int = RUN) -> float:
    """Share of the words of ``part`` that its runs found in ``runs`` cover; an empty part is held by any text."""
    if not part:
        return 1.0
    width = min(width, len(part))
    covered = set()
    for k in range(len(part) - width + 1):
        if tuple(part[k : k + width]) in runs:
            covered.update(range(k, k + width))
    return len(covered) / len(part)


@dataclass
class Index:
    """Postings of one shard of items, by block of ``BLOCK`` entries. An entry is an item or a part of a long one."""

    items: list[int | None]
    bodies: list[tuple[list[str], list[str]]]
    entry_item: list[int] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)
    postings: list[tuple[list[int], list[float]]] = field(default_factory=list)
    upper: np.ndarray | None = None
    block_max: np.ndarray | None = None

    @classmethod
    def build(cls, rows: list[tuple[int, str]], df: dict[str, int], n_entries: int, average: float) -> Index:
        """From (item_id, text), with the document frequencies, entries and mean length of the whole collection."""
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        index = cls([i for i, _ in rows], [question_answer(t) for _, t in rows])
        weights: dict[str, list[tuple[int, float]]] = {}
        for k, (_, text) in enumerate(rows):
            for part in parts(text):
                entry = len(index.entry_item)
                index.entry_item.append(k)
                impact = {}
                for w in set(part):
                    tf = part.count(w)
                    idf = math.log(1 + (n_entries - df[w] + 0.5) / (df[w] + 0.5))
                    impact[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(part) / average))
                whole = sum(impact.values())
                for w, x in impact.items():
                    weights.setdefault(w, []).append((entry, x / whole))
        for w in sorted(weights):
            index.vocabulary[w] = len(index.postings)
            index.postings.append(([e for e, _ in weights[w]], [x for _, x in weights[w]]))
        blocks = -(-len(index.entry_item) // BLOCK)
        index.block_max = np.zeros((len(index.postings), max(1, blocks)), np.float32)
        for t, (ids, xs) in enumerate(index.postings):
            np.maximum.at(index.block_max[t], np.array(ids) // BLOCK, np.array(xs, np.float32))
        index.upper = index.block_max.max(axis=1) if len(index.postings) else np.zeros(0, np.float32)
        return index

    def wand(self, tids: list[int], blocks: np.ndarray, threshold: float = SCORE) -> dict[int, float]:
        """Entries whose score is ``threshold`` or more. Lists advance to the pivot, where the upper bounds first reach the
        threshold; a pivot whose block bound stays below it moves on to the next block."""
        lists = [self.postings[t] for t in tids]
        at = [0] * len(lists)
        tops = [float(self.upper[t]) for t in tids]
        found = {}
        slack = threshold - 1e-5
        open_ = list(range(len(lists)))
        while True:
            open_ = sorted((k for k in open_ if at[k] < len(lists[k][0])), key=lambda k: lists[k][0][at[k]])
            bound, pivot = 0.0, None
            for k in open_:
                bound += tops[k]
                if bound >= slack:
                    pivot = lists[k][0][at[k]]
                    break
            if pivot is None:
                return found
            to = pivot
            if blocks[pivot // BLOCK] < slack:
                to = (pivot // BLOCK + 1) * BLOCK
            elif lists[open_[0]][0][at[open_[0]]] == pivot:
                score = 0.0
                for k in open_:
                    if lists[k][0][at[k]] != pivot:
                        break
                    score += lists[k][1][at[k]]
                if score >= threshold - 1e-9:
                    found[pivot] = score
                to = pivot + 1
            for k in open_:
                if lists[k][0][at[k]] >= to:
                    break
                at[k] = bisect_left(lists[k][0], to, at[k])

    def asked(self, words: list[list[str]]) -> list[dict[int, tuple[float, float, float]]]:
        """For the words of each text the verified items: item ordinal -> (score, question overlap, answer overlap), the best passage of each."""
        out: list[dict[int, tuple[float, float, float]]] = [{} for _ in words]
        for doc, start, entry, score in self._retrieved(words):
            k = self.entry_item[entry]
            question, answer = self.bodies[k]
            size = len(question) + len(answer)
            region = words[doc][max(0, start - size) : start + 2 * STRIDE + size]
            if size < SHORT:
                q = a = overlap(question + answer, _runs(region, size), size)
                held = q >= 1.0
            else:
                runs = _runs(region, RUN)
                q, a = (overlap(p, runs if len(p) >= RUN else _runs(region, len(p))) for p in (question, answer))
                held = (q >= OVERLAP and a >= OVERLAP) or overlap(question + answer, runs) >= WHOLE
            if held and score > out[doc].get(k, (0.0,))[0]:
                out[doc][k] = (score, q, a)
        return out

    def _retrieved(self, words: list[list[str]]):
        """(text, passage start, entry, score) of every entry at or above the threshold."""
        if not self.postings:
            return
        get = self.vocabulary.get
        sizes = np.array([len(w) for w in words], np.int64)
        tids = np.fromiter((get(w, -1) for doc in words for w in doc), np.int64, int(sizes.sum()))
        segments = -(-sizes // STRIDE)
        base = np.cumsum(segments) - segments
        place = np.arange(len(tids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        segment = np.repeat(base, sizes) + place // STRIDE
        known = tids >= 0
        tids, segment, place = tids[known], segment[known], place[known]
        second = place >= STRIDE
        n = len(self.postings)
        pairs = np.sort(np.concatenate([segment * n + tids, (segment[second] - 1) * n + tids[second]]))
        if not len(pairs):
            return
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
        passage, term = pairs // n, pairs % n
        first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        last = np.r_[first[1:], len(pairs)]
        slack = SCORE - 1e-4
        for k in np.flatnonzero(np.add.reduceat(self.upper[term], first) >= slack):
            own = term[first[k] : last[k]]
            blocks = self.block_max[own].sum(axis=0)
            if blocks.max() < slack:
                continue
            at = int(passage[first[k]])
            doc = int(np.searchsorted(base, at, side="right")) - 1
            for entry, score in self.wand(own.tolist(), blocks).items():
                yield doc, (at - int(base[doc])) * STRIDE, entry, score


def _runs(words: list[str], width: int) -> set[tuple]:
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if width else set()


def parts(text: str) -> list[list[str]]:
    """Entries of an item: its words, cut where it is longer than a stride."""
    words = terms(text)
    return [words[k : k + STRIDE] for k in range(0, len(words), STRIDE)]


def indexes(items: DataFrame) -> tuple[str, list[int]]:
    """Builds the indexes over ``items``(item_id, text) in tasks, about SHARD items each: their folder and numbers.

    Null and empty texts are in none. Document frequencies are of the whole collection, so results do not depend on the number of indexes.
    """
    from pyspark.sql.types import ArrayType, StringType

    rows = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    shards = max(1, -(-rows.count() // SHARD))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    cut = F.udf(lambda t: parts(t), ArrayType(ArrayType(StringType())), useArrow=True)
    entries = rows.select("shard", F.explode(cut("text")).alias("words"))
    total = entries.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean")).first()
    folder = new_folder(items.sparkSession, "benchmark")
    if not total["n"]:
        return folder, []
    counts = entries.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    used = entries.select("shard", F.explode(F.array_distinct("words")).alias("term")).distinct().join(counts, "term")
    n, mean = total["n"], total["mean"]

    def build(own: pa.Table, terms_of: pa.Table) -> pa.Table:
        if own.num_rows:
            df = dict(zip(terms_of["term"].to_pylist(), terms_of["df"].to_pylist(), strict=True))
            made = Index.build([(i, t) for i, t in zip(own["item_id"].to_pylist(), own["text"].to_pylist(), strict=True) if terms(t)], df, n, mean)
            put(folder, f"index-{own['shard'][0].as_py()}", pickle.dumps(made))
        return own.select(["shard"]).slice(0, 1)

    made = rows.groupBy("shard").cogroup(used.select(F.col("shard").alias("of"), "term", "df").groupBy("of")).applyInArrow(build, "shard long").collect()
    return folder, sorted(r["shard"] for r in made)


def _loaded(folder: str, shards: list[int]) -> list[Index]:
    return [pickle.loads(get(folder, f"index-{s}")) for s in shards]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row per row of ``docs``(doc_id, text) and item that it leaks.

    Null and empty texts leak nothing. Repeated documents and items, and items without item_id, each give their rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = None
    folder, shards = indexes(items)
    for group in _passes(shards):
        part = rows.mapInArrow(_leaks_of(folder, group), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _passes(shards: list[int]) -> list[list[int]]:
    """Indexes that one pass asks together; one pass at least."""
    return [shards[k : k + TOGETHER] for k in range(0, max(1, len(shards)), TOGETHER)]


def _leaks_of(folder: str, shards: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _loaded(folder, shards)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [terms(t) for t in texts(batch["text"])]
            ids = batch["doc_id"].to_pylist()
            rows = [(doc, index.items[k], *found[k]) for index in group for doc, found in zip(ids, index.asked(words), strict=True) for k in sorted(found)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        yield from each_batch(one)(batches)

    return run


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that leak no item, all columns as they are."""
    folder, shards = indexes(items)
    for group in _passes(shards):
        docs = docs.mapInArrow(_clean_of(folder, group), docs.schema)
    return docs


def _clean_of(folder: str, shards: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _loaded(folder, shards)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [terms(t) for t in texts(batch["text"])]
            clean = [True] * len(words)
            for index in group:
                clean = [c and not f for c, f in zip(clean, index.asked(words), strict=True)]
            return batch.filter(pa.array(clean, pa.bool_()))

        yield from each_batch(one)(batches)

    return run
