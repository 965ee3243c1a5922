"""Quality rules from compression: zstandard ratios of whole documents and of fixed chunks against length-specific bands.

Repetitive text compresses below its band, noise above it. Short texts carry the frame's overhead and little context, so
bands are by length. A document fails if its whole ratio leaves the band, or if more than ``ODD`` of its chunks leave theirs.
Chunks are of one size for all documents of a length class, so a block of noise or repeats counts by its share of the text.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrain.llm.common import WordHash, each_batch, rolling, texts

LEVEL = 3
#: Bytes below which the row holds, lowest and highest ratio of compressed to plain bytes; prose lies well inside.
BANDS = (
    (64, 0.0, 9.0), (128, 0.50, 1.25), (256, 0.45, 1.05), (512, 0.42, 0.92), (1024, 0.38, 0.85), (2048, 0.34, 0.80),
    (4096, 0.31, 0.76), (16384, 0.28, 0.73), (float("inf"), 0.24, 0.70),
)
#: Bytes of a document below which the row holds, chunk size, lowest and highest chunk ratio. Clean chunks of 1,024 bytes reach
#: 0.61 and of 512 bytes 0.73, base64 starts at 0.79 and 0.84.
CHUNKS = ((512, 0, 0.0, 0.0), (2048, 512, 0.30, 0.78), (float("inf"), 1024, 0.30, 0.70))
#: Share of odd chunks that a document may hold.
ODD = 0.3
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
REPEAT_BASE = 0x9E3779B97F4A7C15


def base_counts(text: str, codes: WordHash, window: int = 8) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(codes.codes(words), window)


def _repeated(codes: np.ndarray, window: int) -> int:
    """Words covered by a window that stands twice or more in the text."""
    runs = rolling(codes, window, REPEAT_BASE)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def ratios(body: bytes, press: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    """(whole ratio, chunks, chunks outside their band); an empty text has ratio 1 and no chunk. A last short chunk is the one that ends with the text."""
    if not body:
        return 1.0, 0, 0
    whole = len(press.compress(body)) / len(body)
    _, chunk, low, high = next(row for row in CHUNKS if len(body) < row[0])
    if not chunk:
        return whole, 0, 0
    starts = [*range(0, len(body) - chunk + 1, chunk), *([len(body) - chunk] if len(body) % chunk else [])]
    parts = [len(press.compress(body[k : k + chunk])) / chunk for k in starts]
    return whole, len(parts), sum(not low <= r <= high for r in parts)


def in_band(size: int, whole: float, chunks: int, odd: int) -> bool:
    low, high = next((a, b) for limit, a, b in BANDS if size < limit)
    return low <= whole <= high and odd <= ODD * chunks


def compression_quality(docs: DataFrame, least_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """Counts, ratios and verdict per row of ``docs``(doc_id, text).

    ``base_failed``: fewer than ``least_words`` words, or over ``repeat_percent`` % of them in repeated 8-word windows.
    ``kept``: not base_failed and inside the bands. Null or empty text: no words, so it fails. Repeated rows and ids stay. Other
    columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, press = WordHash(), zstandard.ZstdCompressor(level=LEVEL)
        rows = []
        for text in texts(batch["text"]):
            n, chars, symbols, lines, repeat = base_counts(text, codes)
            body = text.encode()
            whole, chunks, odd = ratios(body, press)
            failed = n < least_words or 100 * repeat > repeat_percent * n
            rows.append((n, chars, symbols, lines, repeat, failed, not failed and in_band(len(body), whole, chunks, odd), whole, chunks, odd))
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "whole_ratio", "n_chunks", "n_odd_chunks"]
        return pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c) for c in zip(*rows, strict=True))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        each_batch(run),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
        " kept boolean, whole_ratio double, n_chunks long, n_odd_chunks long",
    )
