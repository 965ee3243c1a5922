"""Token counts through a digest cache.

Content that differs only in runs of ASCII white space has the same tokens, so its digest is taken after joining words by one
space. Digests and the digest of the tokenizer's file and library version are joined to stored counts; one document of
each missing digest is encoded, and its count is appended to the cache. A run that dies before the append repeats its own misses
and nothing else.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegrain.llm.common import each_batch, raw, staged

CACHE_SCHEMA = "version string, digest binary, n_tokens long"
#: Words and pieces of words whose counts a worker remembers, each, and pieces that are encoded in one go.
MEMO, TOGETHER = 300_000, 2000
#: Pieces of lower-cased ASCII words as the vocabulary's pre-tokenizer cuts them.
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0Da-z0-9]+")


def version(path: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class Counter:
    """Counts tokens with the tokenizers library.

    Tokens never cross ASCII white space, nor the cuts of the pre-tokenizer, so each distinct word and each distinct piece of one is
    counted once and remembered. Pieces are encoded many at a time, told apart by the library's word numbers.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {}

    def count(self, docs: list[bytes]) -> list[int]:
        cut = [t.split() for t in docs]
        if len(self.words) > MEMO:
            self.words.clear()
        fresh = list({w for words in cut for w in words if w not in self.words})
        self.words.update(zip(fresh, self._count_words(fresh), strict=True))
        return [sum(map(self.words.__getitem__, words)) for words in cut]

    def _count_words(self, words: list[bytes]) -> list[int]:
        cut = [_pieces(w) for w in words]
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        fresh = list({p for pieces in cut for p in pieces if p not in self.pieces})
        plain = [p for p in fresh if p.isalpha()]
        for k in range(0, len(plain), TOGETHER):
            part = plain[k : k + TOGETHER]
            numbers = self.tokenizer.encode(" ".join(part), add_special_tokens=False).word_ids
            if numbers[-1] + 1 == len(part):
                self.pieces.update(zip(part, np.bincount(numbers).tolist(), strict=True))
            else:  # lower-casing has made more than one word of a piece
                self._count_alone(part)
        self._count_alone([p for p in fresh if not p.isalpha()])
        return [sum(map(self.pieces.__getitem__, pieces)) for pieces in cut]

    def _count_alone(self, pieces: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False) if pieces else []
        self.pieces.update((p, len(e)) for p, e in zip(pieces, found, strict=True))


@lru_cache(2)
def counter(path: str) -> Counter:
    """One per Python worker, so that what a task has counted serves the next."""
    return Counter(path)


def _pieces(word: bytes) -> list[str]:
    """Lower-case pieces of an ASCII word without special strings; any other word as it is."""
    if word.isascii() and b"<|" not in word:
        return ASCII_PIECE.findall(word.decode().lower())
    return [word.decode()]


def digest(text: bytes) -> bytes:
    return hashlib.sha256(b" ".join(text.split())).digest()


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digest) per row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        body = raw(batch["text"])
        keys = [digest(t) for t in body]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([len(t) for t in body], pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n_bytes", "digest"])

    return docs.mapInArrow(each_batch(run), "doc_id long, n_bytes long, digest binary")


def _encoded(path: str, ship: bool):
    def run(batches):
        own = counter(SparkFiles.get(path) if ship else path)
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                yield pa.RecordBatch.from_arrays(
                    [part["digest"], pa.array(own.count(raw(part["text"])), pa.int64())], names=["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, cache: str, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, ship: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``(doc_id, text); misses are appended to the table at ``cache``.

    Null text: empty, no tokens. Repeated rows and ids stay as they are. Other columns are ignored. ``ship`` says that
    ``tokenizer`` was sent with ``SparkContext.addFile``; else each machine finds it by ``public_tokenizers.path``.
    """
    spark = docs.sparkSession
    path = tokenizer if ship else public_tokenizers.path(tokenizer)
    mark = version(SparkFiles.get(path) if ship else path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = staged(digests(rows))
    known = stored(spark, cache).where(F.col("version") == mark).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    missing = keys.select("digest").distinct().join(known, "digest", "left_anti")
    # The first document of a missing digest carries its text to the encoder.
    chosen = keys.join(missing, "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    # Rows alike in id and text come twice, and are one row of the cache.
    counted = _bodies(rows, chosen).mapInArrow(_encoded(path, ship), "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted.select(F.lit(mark).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = stored(spark, cache).where(F.col("version") == mark).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _bodies(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(digest, text): the text of each chosen (doc_id, digest)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [digest(t) for t in raw(batch["text"])]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(keys, pa.binary()), batch["text"]], names=["doc_id", "own", "text"])

    own = rows.mapInArrow(each_batch(run), "doc_id long, own binary, text string")
    return own.join(chosen, (own["own"] == chosen["digest"]) & own["doc_id"].eqNullSafe(chosen["doc_id"])).select("digest", "text")


def stored(spark: SparkSession, cache: str) -> DataFrame:
    """The cache, empty before its first append."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return spark.createDataFrame([], CACHE_SCHEMA)
