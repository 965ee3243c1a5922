"""Toxicity from a lexicon trie met by Levenshtein automata, scored in context windows.

The lexicon is learned: words that stand in many different contexts of toxic documents and hardly in others. Its trie is
intersected with the automaton that allows ``edits`` changes; the product is made deterministic as words ask for it and runs over
all words of a batch at once. Each hit is then read in its window: quotation marks around it and other hits near it.
A logistic model over the sums of exact, misspelled, quoted and clustered hits gives the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrain.llm.common import crc_mod, each_batch, hash_share, staged, texts

#: About how many labelled documents teach, and the most words a lexicon holds.
SAMPLE = 12_000
#: Intercept of a model that was taught nothing.
UNTAUGHT = -3.0
#: Toxic contexts that a word needs for each other context, and contexts for each of its toxic occurrences.
LIFT, VARIETY = 4.0, 0.2
#: How unlikely a word's toxic contexts must be by chance, over all words.
CHANCE = 0.01
#: Shortest word that may be misspelled, and words on each side of a hit that count as its window.
FUZZY_FROM, WINDOW = 5, 6
QUOTES = "\"“”„«»‹›"
DEAD = 0


@lru_cache(1)
def _word_chars() -> np.ndarray:
    """Whether a code point belongs to a word: letters, digits, and signs that stand in for letters."""
    return np.array([chr(c).isalnum() or chr(c) in "@$" for c in range(0x110000)])


@lru_cache(1)
def _quote_chars() -> np.ndarray:
    return np.isin(np.arange(0x110000), [ord(c) for c in QUOTES])


def laid_words(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased texts laid end to end, each followed by a line feed; word starts, ends, owners; text ends."""
    lowered = [t.lower() + "\n" for t in batch]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    word = _word_chars()[codes]
    edge = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.cumsum([len(t) for t in lowered])
    return codes, starts, ends, np.searchsorted(bounds, starts, side="right"), bounds


class Automaton:
    """Trie of the lexicon times the Levenshtein automaton, made deterministic on demand.

    A state is a set of (trie node, edits so far). State 0 is dead.
    """

    def __init__(self, words: list[str], edits: int = 1):
        self.words, self.edits = words, edits
        self.children: list[dict[int, int]] = [{}]
        self.end: list[int] = [-1]
        for k, word in enumerate(words):
            at = 0
            for c in map(ord, word):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.end.append(-1)
                at = self.children[at][c]
            self.end[at] = k
        letters = sorted({ord(c) for w in words for c in w})
        self.letters = np.array(letters, np.uint32)
        self.longest = max(map(len, words), default=0) + edits
        self.shortest = max(1, min(map(len, words), default=1) - edits)
        self.states: list[frozenset] = [frozenset()]
        self.ids = {self.states[0]: DEAD}
        self.match, self.cost = [-1], [0]
        self.table = np.full((1024, len(letters) + 1), -1, np.int32)
        self.table[DEAD] = DEAD
        self.start = self._id({(0, 0)})

    def _id(self, reached: set) -> int:
        """State of a set, closed under skipped letters of the lexicon; of two ways to a node the cheaper stays."""
        best: dict[int, int] = {}
        todo = list(reached)
        while todo:
            node, spent = todo.pop()
            if best.get(node, self.edits + 1) <= spent:
                continue
            best[node] = spent
            if spent < self.edits:
                todo += [(child, spent + 1) for child in self.children[node].values()]
        state = frozenset(best.items())
        if state in self.ids:
            return self.ids[state]
        at = self.ids[state] = len(self.states)
        self.states.append(state)
        ended = [(spent, self.end[n]) for n, spent in state if self.end[n] >= 0 and self._allowed(self.end[n], spent)]
        cost, word = min(ended, default=(0, -1))
        self.match.append(word)
        self.cost.append(cost)
        if at >= len(self.table):
            self.table = np.vstack([self.table, np.full_like(self.table, -1)])
        return at

    def _allowed(self, word: int, spent: int) -> bool:
        return not spent or len(self.words[word]) >= FUZZY_FROM

    def _step(self, state: int, letter: int) -> int:
        c = int(self.letters[letter]) if letter < len(self.letters) else -1
        reached = set()
        for node, spent in self.states[state]:
            if c in self.children[node]:
                reached.add((self.children[node][c], spent))
            if spent < self.edits:
                reached.add((node, spent + 1))
                reached.update((child, spent + 1) for child in self.children[node].values())
        return self._id(reached)

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of words within ``edits`` of the lexicon, the lexicon words they meet, and their edits."""
        if not self.words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = ends - starts
        at = np.flatnonzero((size >= self.shortest) & (size <= self.longest))
        state = np.full(len(at), self.start, np.int32)
        found, hit, cost = ([np.zeros(0, np.int64)] for _ in range(3))
        for k in range(self.longest + 1):
            over = size[at] == k
            if over.any():
                ended = state[over]
                matched = np.array(self.match)[ended]
                found.append(at[over][matched >= 0])
                hit.append(matched[matched >= 0])
                cost.append(np.array(self.cost)[ended][matched >= 0])
            at, state = at[~over], state[~over]
            if not len(at):
                break
            c = codes[starts[at] + k]
            letter = np.searchsorted(self.letters, c)
            known = letter < len(self.letters)
            known[known] = self.letters[letter[known]] == c[known]
            letter[~known] = len(self.letters)
            after = self.table[state, letter]
            for s, x in set(zip(state[after < 0].tolist(), letter[after < 0].tolist(), strict=True)):
                to = self._step(s, x)
                self.table[s, x] = to
            after = self.table[state, letter]
            live = after != DEAD
            at, state = at[live], after[live]
        return np.concatenate(found), np.concatenate(hit), np.concatenate(cost)


@lru_cache(4)
def automaton(words: tuple[str, ...]) -> Automaton:
    """One per Python worker, so transitions that a task has made serve the next."""
    return Automaton(list(words))


FEATURES = ("exact", "fuzzy", "quoted", "clustered", "density", "any_exact", "any_fuzzy")


def features(batch: list[str], probe: Automaton) -> np.ndarray:
    """One row of FEATURES per text. Quoted hits lie between quotation marks; clustered ones have another hit in their window."""
    codes, starts, ends, owner, bounds = laid_words(batch)
    at, word, cost = probe.run(codes, starts, ends)
    order = np.argsort(at)
    at, word, cost = at[order], word[order], cost[order]
    n = len(batch)
    count = np.bincount(owner, minlength=n)[:n]
    mine = owner[at]
    out = np.zeros((n, len(FEATURES)))
    if len(at):
        first = np.searchsorted(owner, np.arange(n))
        marks = np.r_[0, np.cumsum(_quote_chars()[codes])]
        text_start = np.r_[0, bounds[:-1]]
        inside = (marks[starts[at]] - marks[text_start[mine]]) % 2 == 1
        last = np.r_[first[1:], len(owner)]
        left = np.maximum(at - WINDOW, first[mine])
        right = np.minimum(at + WINDOW, last[mine] - 1)
        closed = marks[ends[right]] - marks[ends[at]] > 0
        opened = marks[starts[at]] - marks[starts[left]] > 0
        quoted = inside & closed & opened
        near = np.searchsorted(at, right, side="right") - np.searchsorted(at, left)
        exact = cost == 0
        abuse = ~quoted
        out[:, 0] = np.log1p(np.bincount(mine, exact & abuse, n))
        out[:, 1] = np.log1p(np.bincount(mine, ~exact & abuse, n))
        out[:, 2] = np.log1p(np.bincount(mine, quoted, n))
        out[:, 3] = np.log1p(np.bincount(mine, abuse & (near > 1), n))
        hits = np.bincount(mine, exact & abuse, n)
        out[:, 4] = np.minimum(1.0, 20 * hits / np.maximum(count, 1))
        out[:, 5] = hits > 0
        out[:, 6] = np.bincount(mine, ~exact & abuse, n) > 0
    return out


@dataclass
class Model:
    lexicon: list[str]
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic model, intercept first, by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grade = x.T @ (p - y) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(bend, grade)
    return w


def learn_lexicon(taught: DataFrame) -> list[str]:
    """Words by how many different words they follow in toxic and in other documents.

    Counting contexts, and asking for many of them per occurrence, keeps the plain words of a toxic document with many near copies out.
    The least number of contexts is set so that a word that falls on toxic documents by chance is not expected even once. That alone sets
    the size of the lexicon; the sample bounds it.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[tuple, int] = {}
        for text, label in zip(texts(batch["text"]), batch["toxic"].to_pylist(), strict=True):
            _, starts, ends, _, _ = laid_words([text])
            lowered = text.lower()
            before = ""
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                word = lowered[a:b]
                if 3 <= b - a <= 24 and not word.isdigit():
                    seen[word, before, label] = seen.get((word, before, label), 0) + 1
                before = word
        words, befores, labels = zip(*seen, strict=True) if seen else ((), (), ())
        cols = [pa.array(words, pa.string()), pa.array(befores, pa.string()), pa.array(labels, pa.int32()), pa.array(seen.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["word", "before", "toxic", "n"])

    contexts = taught.select("text", "toxic").mapInArrow(each_batch(run), "word string, before string, toxic int, n long")
    contexts = contexts.groupBy("word", "before", "toxic").agg(F.sum("n").alias("n"))
    counts = staged(contexts.groupBy("word").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.sum(F.col("n") * F.col("toxic")).alias("n")))
    whole = counts.agg(F.count(F.lit(1)).alias("words"), F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not whole["t"] or not whole["c"]:
        return []
    least = math.log(whole["words"] / CHANCE) / -math.log(whole["t"] / (whole["t"] + whole["c"]))
    top = counts.where((F.col("t") >= least) & (F.col("t") >= LIFT * F.col("c")) & (F.col("t") >= VARIETY * F.col("n")))
    return [r["word"] for r in top.orderBy(F.desc("t"), "word").collect()]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon and weights from about ``sample`` labelled rows of ``docs``(doc_id, text), chosen by a hash of the id.

    Labels of one kind only, or none, teach nothing: every score is then below a half.
    """
    marked = labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    part = hash_share(marked, marked, None, sample).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = hash_share(docs, marked, None, sample)
    taught = staged(share.join(part, "doc_id").select("text", "toxic"))
    lexicon = learn_lexicon(taught)
    words = tuple(lexicon)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(texts(batch["text"]), automaton(words))
        return pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch["toxic"]], names=["x", "toxic"])

    rows = taught.mapInArrow(each_batch(run), "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    if len({r["toxic"] for r in rows}) < 2:
        return Model([], np.r_[UNTAUGHT, np.zeros(len(FEATURES))])
    count = [r["count"] for r in rows]
    x = np.repeat(np.array([r["x"] for r in rows]), count, axis=0)
    y = np.repeat(np.array([r["toxic"] for r in rows], float), count)
    return Model(lexicon, logistic(x, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) per row of ``docs``(doc_id, text). Null and empty texts have no hits and get the score of that."""
    words = tuple(model.lexicon)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.scores(features(texts(batch["text"]), automaton(words)))
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        each_batch(run), "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; rows of fold ``held_out`` teach nothing.

    Rows without a label only get a score. Without labels of both kinds every score is the same, below 0.5. Repeated labels of an id: the
    highest counts. Repeated rows and ids stay. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    teach = crc_mod("doc_id", folds) != held_out
    model = fit(rows.where(teach), labels.where(crc_mod("doc_id", folds) != held_out))
    return score(rows, model).withColumn("held_out", crc_mod("doc_id", folds) == held_out).select("doc_id", "held_out", "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, all columns as they are. Learns as ``toxicity`` does."""
    teach = crc_mod("doc_id", folds) != held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(rows.where(teach), labels.where(teach))
    words = tuple(model.lexicon)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.scores(features(texts(batch["text"]), automaton(words)))
        return batch.filter(pa.array(p < 0.5))

    return docs.mapInArrow(each_batch(run), docs.schema)
