"""Shared helpers: reading tables, Arrow batches, word codes, bounded fits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegrain.session import shared_dir

#: Rows of one Arrow batch; texts can be long, so batches are small.
BATCH_ROWS = 1000


def tune(spark: SparkSession) -> SparkSession:
    """Settings that the operators rely on, for a session somebody else made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, prunes columns, survives lost executors.

    The results of later steps read these files, so the caller removes them: all of one application lie in one folder, by its id.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quotegrain-llm/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the caller's measure of how much data there is."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: str, mod: int):
    """crc32 of the id as text, modulo; null ids count as remainder of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def hash_share(rows: DataFrame, counted: DataFrame, by: str | None, limit: int) -> DataFrame:
    """About ``limit`` rows per value of ``by`` (of the whole table if None), those whose doc_id hashes lowest.

    The share is set from a count of ``counted`` and taken from all 64 bits of the hash, so the sample stays as large whatever the
    table's size, and is all of a small one.
    """
    if by is None:
        return rows.where(F.xxhash64("doc_id") <= F.lit(highest(limit, counted.count())))
    totals = {r[by]: r["count"] for r in counted.groupBy(by).count().collect()}
    keep = F.lit(False)
    for value, n in totals.items():
        keep = keep | ((F.col(by) == value) & (F.xxhash64("doc_id") <= F.lit(highest(limit, n))))
    return rows.where(keep)


def highest(limit: int, n: int) -> int:
    """Largest signed 64-bit hash of a sample of ``limit`` out of ``n`` rows."""
    return -(1 << 63) + min(limit, n) * ((1 << 64) - 1) // max(1, n)


def texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty. ``bytes.split()`` cuts at \\x20 and \\x09-\\x0D only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [t or b"" for t in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


class WordHash(dict):
    """Word -> XXH64, remembered for repeated words; emptied when full, so memory stays bounded."""

    FULL = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.FULL:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of every run of ``width`` codes, also across the seams of texts laid end to end."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(base)
        out += codes[k : k + n]
    return mixed(out)


def inside(lengths: np.ndarray, width: int, n: int) -> np.ndarray:
    """Marks the window starts of laid-out texts whose window stays in its text."""
    ends = np.cumsum(lengths)
    ok = np.ones(n, bool)
    for back in range(1, width):
        at = ends - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def each_batch(fn):
    """``fn(RecordBatch) -> RecordBatch`` as a function for ``mapInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run
