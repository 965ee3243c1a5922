"""Language ID by rank-order profiles.

A profile lists a language's most frequent letter n-grams by rank. A document's own list is compared with each profile: an
n-gram costs the difference of its two ranks, one that the profile lacks costs the profile's length. The least sum wins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotegrain.llm.common import crc_mod, each_batch, hash_share, texts

#: N-grams in a profile, longest n-gram, and about how many documents of a language its profile is counted on.
RANKS, LONGEST, SAMPLE = 400, 3, 4000
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> itself for letters, blank for anything else."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def grams(text: str, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to ``longest`` code points, packed 21 bits each, and their counts. Other runs count as one blank."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = codes == 32
    codes = codes[~(blank & np.r_[True, blank[:-1]])] if len(codes) else codes
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.r_[32, codes, [32] * int(codes[-1] != 32)].astype(np.uint64)
    parts, packed = [codes[codes != 32]], codes
    for n in range(2, longest + 1):
        packed = (packed[:-1] << np.uint64(21)) | codes[n - 1 :]
        parts.append(packed)
    return np.unique(np.concatenate(parts), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, most: int = RANKS) -> np.ndarray:
    """The most frequent n-grams in order; ties go to the smaller code."""
    return keys[np.argsort(-counts, kind="stable")[:most]]


@dataclass
class Profiles:
    """Ranks of the n-grams of all profiles side by side. Its size is languages x RANKS, whatever the data."""

    langs: list[str]
    keys: np.ndarray
    ranks: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[str, int, int]]) -> Profiles:
        """From (lang, gram, rank)."""
        langs = sorted({lang for lang, _, _ in rows})
        keys = np.array(sorted({g for _, g, _ in rows}), np.uint64)
        ranks = np.full((len(keys) + 1, max(1, len(langs))), RANKS, np.int64)
        for lang, g, rank in rows:
            ranks[np.searchsorted(keys, np.uint64(g)), langs.index(lang)] = rank
        return cls(langs, keys, ranks)

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a ranked list to every language."""
        at = np.searchsorted(self.keys, own)
        at[at < len(self.keys)] = np.where(self.keys[at[at < len(self.keys)]] == own[at < len(self.keys)], at[at < len(self.keys)], len(self.keys))
        theirs = self.ranks[at]
        here = np.arange(len(own))[:, None]
        return np.where(theirs >= RANKS, RANKS, np.abs(theirs - here)).sum(axis=0)

    def best(self, text: str) -> tuple[str, float]:
        """(language, 1 - distance / largest distance); ties go to the first name. No letter or no profile: unknown, 0."""
        own = ranked(*grams(text))
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        d = self.distances(own)
        k = int(d.argmin())
        return self.langs[k], float(1 - d[k] / (len(own) * RANKS))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from rows with a language, about ``sample`` documents of each, chosen by a hash of the id."""
    known = docs.where("lang is not null")
    part = hash_share(known.select("doc_id", "lang", "text"), known, "lang", sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: dict[tuple[str, int], int] = {}
        for lang, text in zip(batch["lang"].to_pylist(), texts(batch["text"]), strict=True):
            for g, n in zip(*(a.tolist() for a in grams(text)), strict=True):
                total[lang, g] = total.get((lang, g), 0) + n
        langs, keys = zip(*total, strict=True) if total else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(total.values(), pa.int64())], names=["lang", "gram", "n"])

    counts = part.select("lang", "text").mapInArrow(each_batch(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < RANKS)
    return Profiles.build([(r["lang"], r["gram"], r["rank"]) for r in top.collect()])


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs``(doc_id, text); null text is unknown. Repeated rows and ids stay. Other columns are ignored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [profiles.best(t) for t in texts(batch["text"])]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        each_batch(run), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, held_out: int = 2, folds: int = 4) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs``; rows of fold ``held_out`` teach nothing."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    profiles = fit(rows.where(crc_mod("doc_id", folds) != held_out))
    return identify(rows, profiles).withColumn("held_out", crc_mod("doc_id", folds) == held_out).select("doc_id", "held_out", "lang_pred", "score")
