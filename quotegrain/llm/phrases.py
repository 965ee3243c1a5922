"""Phrase collocations, counted in HAT-tries that spill sorted runs.

A task counts runs of one to four words in a trie over word ids whose containers are hash tables: at first one for a range of words,
which bursts into one per word, which bursts into one per next word, whenever it is full. When a task holds too much, the largest
subtrees leave it whole, as sorted runs. Runs are dealt by a hash of their leading words and merged per prefix partition, so every count
is complete in one place and a hot first word is spread by what follows it.

There are two passes. The first counts words and pairs; pairs that occur often enough are stored as sorted hash arrays. The second
maps these and counts three and four words only where every pair in them is frequent, since no run is more frequent than its parts: that
leaves out nothing which could be a candidate. Words are told apart by 64 bits of their hash between tasks; the texts of frequent
words come back by it. Scores, covers and ranks are DataFrame operations over the frequent runs.
"""

from __future__ import annotations

from array import array
from collections import _count_elements  # counts a list into a dict, in C
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotegrain.llm.arrays import HashArrays, new_folder, pack, save, shard_of, smallest, unpack
from quotegrain.llm.common import raw, staged
from quotegrain.llm.lm import keys_of, merged_runs

#: A candidate's least count, the words of the longest, phrases per language, and the share of its count at which a longer one covers it.
LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
#: Ends of pieces, all written as the first of them.
ENDS = b".,;:!?\n\x0b\x0c\r"
PIECES = bytes.maketrans(ENDS, ENDS[:1] * len(ENDS))
#: Entries of a container that bursts, and of a trie that spills half of them.
BURST, HELD = 32_768, 1_000_000
#: Bits of a word id, and of the range of words that one container of the root holds in the pass over pairs.
BITS, RANGE = 21, 10
LOW = (1 << BITS) - 1
SHARD_BYTES = 32_000_000
RUNS = "part int, run binary, langs array<string>, lang_of binary, words binary"
COUNTS = "lang string, word string, codes array<long>, f long"


# --- the trie -----------------------------------------------------------------------------------------------------


class Node:
    """Children by the leading bits of a run; a child is a container (rest of the run -> count) or, once burst, a node.

    ``shifts``: where the next levels cut the rest; a container below the last one never bursts.
    """

    __slots__ = ("children", "shifts")

    def __init__(self, shifts: tuple[int, ...]):
        self.children: dict[int, dict | Node] = {}
        self.shifts = shifts

    def add(self, lead: np.ndarray, rest: np.ndarray) -> int:
        """Counts runs, sorted by ``lead``; returns the new entries."""
        if not len(lead):
            return 0
        cuts = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
        new = 0
        for at, a, b in zip(lead[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(lead)], strict=True):
            child = self.children.get(at)
            if child is None:
                child = self.children[at] = {}
            if type(child) is dict:
                before = len(child)
                _count_elements(child, rest[a:b].tolist())
                new += len(child) - before
                if len(child) > BURST and self.shifts:
                    self.children[at] = self._burst(child)
            else:
                new += child.add(*child.split(rest[a:b], self.shifts[0]))
        return new

    @staticmethod
    def split(rest: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Leading bits and what follows them, sorted by those."""
        lead = rest >> shift
        order = np.argsort(lead, kind="stable")
        return lead[order], (rest & ((1 << shift) - 1))[order]

    def _burst(self, container: dict[int, int]) -> Node:
        node, shift = Node(self.shifts[1:]), self.shifts[0]
        low = (1 << shift) - 1
        for rest, n in container.items():
            node.children.setdefault(rest >> shift, {})[rest & low] = n
        return node

    def entries(self) -> int:
        return sum(len(c) if type(c) is dict else c.entries() for c in self.children.values())

    def flat(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """All runs below child ``at`` as the numbers that this node's containers hold, and their counts."""
        child = self.children[at]
        if type(child) is dict:
            return np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
        parts = [(k << self.shifts[0], child.flat(k)) for k in child.children]
        return np.concatenate([lead | rests for lead, (rests, _) in parts]), np.concatenate([counts for _, (_, counts) in parts])


class Counter:
    """Trie of one task over runs of up to ``width`` words, with the words behind its ids."""

    def __init__(self, width: int, prefix: int, bits: int):
        self.width, self.prefix, self.bits = width, prefix, bits
        # Runs of two fit one number with a range of first words; longer ones hang below their first word.
        self.range = RANGE if width == 2 else 0
        self.shifts = tuple(BITS * k for k in range(width - 1 if self.range else width - 2, 0, -1))
        self.langs: list[str] = []
        self.clear()

    def clear(self) -> None:
        self.root, self.held = Node(self.shifts), 0
        self.ids: dict[str, Ids] = {}
        self.words: list[bytes] = [b""]
        self.lang_of = array("L", [0])
        self.codes = array("Q", [0])

    def of(self, lang: str) -> Ids:
        if lang not in self.ids:
            self.ids[lang] = Ids(self, lang)
        return self.ids[lang]

    def code(self, ids: np.ndarray) -> np.ndarray:
        return np.array(self.codes, np.uint64)[ids]

    def add(self, first: np.ndarray, rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts runs: ids of their first words, and the others ``BITS`` bits each in one number, none as zero."""
        if self.range:
            lead, rest = first >> self.range, (first & ((1 << self.range) - 1)) << BITS | rest
        else:
            lead = first
        order = np.argsort(lead, kind="stable")
        self.held += self.root.add(lead[order], rest[order])
        if len(self.words) > LOW // 2:
            yield from self.spill(0)
            self.clear()
        elif self.held > HELD:
            yield from self.spill(self.held // 2)

    def spill(self, left: int) -> Iterator[pa.RecordBatch]:
        """Takes subtrees out, the largest first, until at most ``left`` entries are held."""
        sizes = {k: len(c) if type(c) is dict else c.entries() for k, c in self.root.children.items()}
        leads, rests, counts = [], [], []
        for at in sorted(sizes, key=sizes.__getitem__, reverse=True):
            if self.held <= left:
                break
            rest, count = self.root.flat(at)
            leads.append(np.full(len(rest), at))
            rests.append(rest)
            counts.append(count)
            del self.root.children[at]
            self.held -= sizes[at]
        if not leads:
            return
        lead, rest = np.concatenate(leads), np.concatenate(rests)
        if self.range:
            ids = [lead << self.range | rest >> BITS, rest & LOW]
        else:
            ids = [lead, *(rest >> BITS * k & LOW for k in range(self.width - 2, -1, -1))]
        yield from self._runs(ids, np.concatenate(counts))

    def _runs(self, ids: list[np.ndarray], count: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One sorted run per prefix partition; texts go with the words that stand alone."""
        codes = np.array(self.codes, np.uint64)
        words = [codes[i] for i in ids]
        part = shard_of(keys_of(words[: self.prefix]), self.bits)
        order = np.lexsort((*words[::-1], part))
        cuts = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
            at = order[a:b]
            run = [np.diff(words[0][at], prepend=np.uint64(0)), *(w[at] for w in words[1:]), smallest(count[at])]
            alone = ids[0][at][ids[1][at] == 0].tolist()
            texts = b"\n".join([self.words[i] for i in alone])
            cols = [
                pa.array([int(part[at[0]])], pa.int32()), pa.array([pack(run)]), pa.array([self.langs], pa.list_(pa.string())),
                pa.array([pack([np.array([self.lang_of[i] for i in alone], np.uint32)])]), pa.array([zstandard.compress(texts, 1)]),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "run", "langs", "lang_of", "words"])


class Ids(dict):
    """Word of one language -> id; a piece's end is 0."""

    def __init__(self, counter: Counter, lang: str):
        super().__init__({ENDS[:1]: 0})
        self.counter = counter
        if lang not in counter.langs:
            counter.langs.append(lang)
        self.lang, self.seed = counter.langs.index(lang), lang.encode() + b"\n"

    def __missing__(self, word: bytes) -> int:
        c = self.counter
        out = self[word] = len(c.words)
        c.words.append(word)
        c.lang_of.append(self.lang)
        # Zero is no word.
        c.codes.append(xxhash.xxh64_intdigest(self.seed + word) or 1)
        return out


# --- passes -------------------------------------------------------------------------------------------------------


def _stream(batch: pa.RecordBatch, counter: Counter) -> np.ndarray:
    """Word ids of the texts of a batch; 0 ends a piece."""
    parts = []
    for lang, text in zip(batch["lang"].to_pylist(), raw(batch["text"]), strict=True):
        words = text.lower().translate(PIECES).replace(ENDS[:1], b" " + ENDS[:1] + b" ").split()
        words.append(ENDS[:1])
        parts.append(np.fromiter(map(counter.of(lang).__getitem__, words), np.int64, len(words)))
    return np.concatenate(parts)


def _short_runs(bits: int):
    """Words and pairs of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(2, 2, bits)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = _stream(batch, counter)
            pair = (ids[:-1] > 0) & (ids[1:] > 0)
            words = ids[ids > 0]
            yield from counter.add(np.r_[words, ids[:-1][pair]], np.r_[np.zeros(len(words), np.int64), ids[1:][pair]])
        yield from counter.spill(0)

    return run


def _long_runs(bits: int, folder: str):
    """Three and four words of the texts in which every pair is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, pairs = Counter(LONGEST, 3, bits), HashArrays(folder, "pairs", bits)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.r_[_stream(batch, counter), np.zeros(LONGEST, np.int64)]
            codes = counter.code(ids)
            good = np.zeros(len(ids), bool)
            at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            good[at] = pairs.find(keys_of([codes[at], codes[at + 1]]), [])[0]
            three = np.flatnonzero(good[:-1] & good[1:])
            four = three[good[three + 2]]
            rest = ids[three + 1] << 2 * BITS | ids[three + 2] << BITS
            more = ids[four + 1] << 2 * BITS | ids[four + 2] << BITS | ids[four + 3]
            yield from counter.add(np.r_[ids[three], ids[four]], np.r_[rest, more])
        yield from counter.spill(0)

    return run


def _merged(bits: int, folder: str, least: int):
    """Merges the runs of one prefix partition: frequent ones, the texts of frequent words, the words of each language (no codes),
    and frequent pairs as a hash array."""

    def run(group: pa.Table) -> pa.Table:
        unpacked = [unpack(d) for d in group["run"].to_pylist()]
        words = [np.concatenate([np.cumsum(r[0], dtype=np.uint64) if k == 0 else r[k] for r in unpacked]) for k in range(len(unpacked[0]) - 1)]
        keys, words, (count,) = merged_runs(words, [np.concatenate([r[-1].astype(np.int64) for r in unpacked])])
        sizes = sum((w > 0).astype(np.int64) for w in words)
        often = count >= least
        pair = often & (sizes == 2)
        if pair.any():
            save(folder, "pairs", int(group["part"][0].as_py()), bits, keys[pair], {})
        of = dict(zip(words[0][sizes == 1].tolist(), count[sizes == 1].tolist(), strict=True))
        texts, totals = {}, {}
        for r, langs, lang_of, text in zip(unpacked, group["langs"].to_pylist(), group["lang_of"].to_pylist(), group["words"].to_pylist(), strict=True):
            alone = r[1] == 0
            if not alone.any():
                continue
            own, (which,) = np.cumsum(r[0], dtype=np.uint64)[alone], unpack(lang_of)
            for k, n in enumerate(np.bincount(which, r[-1][alone], len(langs)).astype(np.int64).tolist()):
                totals[langs[k]] = totals.get(langs[k], 0) + n
            for code, k, word in zip(own.tolist(), which.tolist(), zstandard.decompress(text).split(b"\n"), strict=True):
                if of[code] >= least:
                    texts[code] = (langs[k], word.decode())
        kept = np.flatnonzero(often & (sizes > 1))
        codes = [w[kept].view(np.int64).tolist() for w in words]
        listed = [[c for c in row if c] for row in zip(*codes, strict=True)]
        signed = lambda code: code - (1 << 64) if code >= 1 << 63 else code
        rows = [(lang, None, None, n) for lang, n in totals.items() if n]
        rows += [(lang, word, [signed(code)], of[code]) for code, (lang, word) in texts.items()]
        rows += [(None, None, row, n) for row, n in zip(listed, count[kept].tolist(), strict=True)]
        kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64()]
        cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]
        return pa.Table.from_arrays(cols, names=["lang", "word", "codes", "f"])

    return run


def frequent_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, f): runs of one to four words found ``least`` times or more; phrase null: all words of the language."""
    spark = docs.sparkSession
    # Runs are rows of up to some megabytes.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (-(-size // SHARD_BYTES) - 1).bit_length())
    folder = new_folder(spark, "pairs")

    def counted(runs):
        return staged(texts.mapInArrow(runs, RUNS).groupBy("part").applyInArrow(_merged(bits, folder, least), COUNTS))

    short = counted(_short_runs(bits))
    runs = short.where("size(codes) > 1").unionByName(counted(_long_runs(bits, folder)).where("size(codes) > 1"))
    totals = short.where("codes IS NULL").groupBy("lang").agg(F.sum("f").alias("f"))
    alone = short.where("size(codes) = 1").select("lang", "word", F.col("codes")[0].alias("code"), "f")
    # Every word of a frequent run is frequent, so its text is among these.
    spelled = runs.select("codes", "f", F.posexplode("codes").alias("place", "code")).join(alone.select("lang", "word", "code"), "code")
    spelled = spelled.groupBy("codes").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.first("f").alias("f"))
    return (
        totals.select("lang", F.lit(None).cast("string").alias("phrase"), F.lit(0).cast("long").alias("words"), "f")
        .unionByName(alone.select("lang", F.col("word").alias("phrase"), F.lit(1).cast("long").alias("words"), "f"))
        .unionByName(spelled.select("lang", "phrase", F.size("codes").cast("long").alias("words"), "f")))


# --- candidates ---------------------------------------------------------------------------------------------------


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of every language of ``docs``(text, lang).

    Null texts are empty, null languages are ``und``. Repeated rows count as often as they occur. Ties are settled by count and phrase.
    A language without candidates has no rows, so has an empty table. Other columns are ignored.
    """
    found = staged(frequent_runs(docs, least))
    totals = found.where("phrase IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    runs = found.where("phrase IS NOT NULL")
    spans = runs.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = spans.select("lang", "phrase", F.col("f").alias("a"), "w", "words", F.explode(F.expr("sequence(1, int(words) - 1)")).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("first"), F.expr("array_join(slice(w, cut + 1, int(words) - cut), ' ')").alias("rest"))
    part = runs.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("best"))
    inside = spans.where("words > 2").select("lang", "w", "words", "f", F.explode(F.expr("sequence(2, int(words) - 1)")).alias("size")).select(
        "lang", "w", "words", "f", "size", F.explode(F.expr("sequence(1, int(words) - size + 1)")).alias("at")).select(
        "lang", F.expr("array_join(slice(w, at, size), ' ')").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer").cast("decimal(19,0)") < F.lit(COVER) * F.col("best.a").cast("decimal(19,0)")))
    kept = kept.select("lang", "phrase", "best.*")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase")))
    ranked = kept.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
