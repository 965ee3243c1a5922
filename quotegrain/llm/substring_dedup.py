"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping blocks of ``(window + 1) // 2`` words. A run of ``window`` words always holds
one whole block, so blocks are the index and every rolling run of block length is a probe. A probe that meets a
block of another document is an anchor; it is extended over the neighbouring words, and extended windows that start in an
earlier document are kept and merged into maximal exact repeats.

Documents are dealt into chunks by a hash of their id. A chunk reports each distinct run once, so a passage that
millions of documents share is one row per chunk, never a hot key, and answers go back to chunks, never to pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrain.llm.common import WordHash, inside, partitions, raw, rolling

#: Bases of the rolling hashes: anchors, and two for windows.
ANCHOR, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Bits of a run's hash that chunks report, and the widest gap between two of a chunk.
SPACE_BITS, WIDEST = 46, 2**30 - 1
NO_ID = np.int64(2**63 - 1)

#: Bytes of text of the largest chunk, and whose runs make up the largest bucket.
CHUNK_BYTES, BUCKET_BYTES = 128_000_000, 256_000_000


class Chunk:
    """Documents of one chunk laid end to end as word codes."""

    def __init__(self, table: pa.Table, keep_words: bool = False):
        codes, lengths = WordHash(), []
        parts, self.words = [], []
        for text in raw(table["text"]):
            words = text.split()
            lengths.append(len(words))
            parts.append(codes.codes(words))
            if keep_words:
                self.words.append(text)
        self.lengths = np.array(lengths, np.int64)
        self.codes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        ids = table["doc_id"].combine_chunks()
        self.ids = ids.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)

    def owner(self, n: int) -> np.ndarray:
        """Document ordinal of the first ``n`` word positions."""
        return np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)[:n]

    def anchors(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Run hash and whether the run lies in its document, at every word position."""
        run = rolling(self.codes, block, ANCHOR)
        return run, inside(self.lengths, block, len(run))


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted hashes that fall into the same bucket, by the high 32 bits of each."""
    owner = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(owner.astype(np.int64))) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
        if b > a:
            yield int(owner[a]), slice(int(a), int(b))


def _report_runs(block: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Distinct runs of a chunk: bit 0 says aligned to a block, bit 1 that two of its documents hold it."""
        c = Chunk(table)
        key, ok = c.anchors(block)
        at = np.flatnonzero(ok)
        key, owner = key[at] & ~np.uint64(3), c.owner(len(key))[at]
        aligned = ((at - c.starts[owner]) % block == 0).astype(np.uint64) if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        key, owner, aligned = key[order], owner[order], aligned[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        if len(first):
            several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
            key = key[first] | np.maximum.reduceat(aligned, first) | (several.astype(np.uint64) << np.uint64(1))
        chunk = table["chunk"][0].as_py()
        rows = [(b, chunk, _packed(key[s])) for b, s in _by_bucket(key, buckets)]
        return _rows(rows, [("bucket", pa.int64()), ("chunk", pa.int64()), ("runs", pa.binary())])

    return run


def _packed(key: np.ndarray) -> bytes:
    """The first of sorted hashes, then gaps of 30 bits, two flag bits each: a chunk's runs lie that close among 2^SPACE_BITS values.

    A wider gap is bridged by values that no run has; they can only make a needless anchor, as equal short hashes can.
    """
    place = key >> np.uint64(64 - SPACE_BITS)
    gap = np.diff(place, prepend=place[:1])
    extra = (gap // np.uint64(WIDEST)).astype(np.int64)
    out = np.zeros(len(key) + int(extra.sum()), np.uint32)
    own = np.arange(len(key)) + np.cumsum(extra)
    out[:] = WIDEST << 2
    out[own] = ((gap % np.uint64(WIDEST)) << np.uint64(2)) | (key & np.uint64(3))
    return place[:1].tobytes() + out.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    """Short hash times four plus flags."""
    base, gaps = np.frombuffer(data, np.uint64, 1), np.frombuffer(data, np.uint32, offset=8)
    return ((base + np.cumsum(gaps >> np.uint32(2), dtype=np.uint64)) << np.uint64(2)) | (gaps & np.uint32(3)).astype(np.uint64)


def _by_owner(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(owner, its positions in order) of every owner."""
    order = np.argsort(owner, kind="stable")
    own = owner[order]
    for part in np.split(order, np.flatnonzero(own[1:] != own[:-1]) + 1) if len(owner) else []:
        yield int(owner[part[0]]), part


def _rows(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _shared_runs(table: pa.Table) -> pa.Table:
    """Runs of a bucket that are a block somewhere and stand in two documents or more, back to each chunk that has them."""
    chunks = table["chunk"].to_pylist()
    parts = [_unpacked(b) for b in table["runs"].to_pylist()]
    sizes = [len(p) for p in parts]
    key = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), sizes)
    order = np.argsort(key >> np.uint64(2), kind="stable")
    key, owner = key[order], owner[order]
    bare = key >> np.uint64(2)
    first = np.flatnonzero(np.r_[True, bare[1:] != bare[:-1]])
    flags = np.bitwise_or.reduceat(key & np.uint64(3), first)
    count = np.diff(np.r_[first, len(key)])
    hit = ((flags & np.uint64(1)) > 0) & (((flags & np.uint64(2)) > 0) | (count > 1))
    keep = np.repeat(hit, count)
    bare, owner = bare[keep], owner[keep]
    rows = [(chunks[k], bare[own].tobytes()) for k, own in _by_owner(owner)]
    return _rows(rows, [("chunk", pa.int64()), ("anchors", pa.binary())])


def _extended(c: Chunk, answers: pa.Table, window: int, block: int):
    """Window starts that hold an anchor, with both window hashes."""
    found = [np.frombuffer(b, np.uint64) for b in answers["anchors"].to_pylist()]
    n = len(c.codes) - window + 1
    if not found or n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    run, ok = c.anchors(block)
    anchor = ok & np.isin(run >> np.uint64(64 - SPACE_BITS), np.concatenate(found))
    near = np.r_[0, np.cumsum(anchor)]
    span = window - block + 1
    touched = (near[span : span + n] - near[:n]) > 0
    at = np.flatnonzero(touched & inside(c.lengths, window, n))
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return at, rolling(c.codes, window, FIRST)[at], rolling(c.codes, window, SECOND)[at]


def _report_windows(window: int, block: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Distinct candidate windows of a chunk, each with the smallest id of its documents."""
        fields = [("bucket", pa.int64()), ("chunk", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("ids", pa.binary())]
        if not docs.num_rows:
            return _rows([], fields)
        c = Chunk(docs)
        at, a, b = _extended(c, answers, window, block)
        if not len(at):
            return _rows([], fields)
        ids = c.ids[c.owner(int(at[-1]) + 1)[at]]
        b = _short(b)
        order = np.lexsort((b, a))
        a, b, ids = a[order], b[order], ids[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b, several = a[first], b[first], np.maximum.reduceat(ids, first) != np.minimum.reduceat(ids, first)
        b, ids = b | several.astype(np.uint32), np.minimum.reduceat(ids, first)
        chunk = docs["chunk"][0].as_py()
        return _rows([(k, chunk, a[s].tobytes(), b[s].tobytes(), ids[s].tobytes()) for k, s in _by_bucket(a, buckets)], fields)

    return run


def _short(b: np.ndarray) -> np.ndarray:
    """31 bits of the second hash, above a free bit."""
    return ((b >> np.uint64(32)) & ~np.uint64(1)).astype(np.uint32)


def _first_owner(table: pa.Table) -> pa.Table:
    """For each chunk its windows of the bucket that a document before its last holds, with the first document's id."""
    chunks = table["chunk"].to_pylist()
    a = [np.frombuffer(x, np.uint64) for x in table["first"].to_pylist()]
    b = [np.frombuffer(x, np.uint32) for x in table["second"].to_pylist()]
    ids = [np.frombuffer(x, np.int64) for x in table["ids"].to_pylist()]
    owner = np.repeat(np.arange(len(a)), [len(x) for x in a])
    a, b, ids = np.concatenate(a), np.concatenate(b), np.concatenate(ids)
    order = np.lexsort((b, a))  # the free bit is lowest, so equal windows stay together
    a, b, ids, owner = a[order], b[order], ids[order], owner[order]
    several, b = (b & np.uint32(1)) > 0, b & ~np.uint32(1)
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.r_[first, len(a)]))
    told = several | (least < ids)
    a, b, least, owner = a[told], b[told], least[told], owner[told]
    rows = [(chunks[k], a[own].tobytes(), b[own].tobytes(), least[own].tobytes()) for k, own in _by_owner(owner)]
    return _rows(rows, [("chunk", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("least", pa.binary())])


def _verdicts(window: int, block: int):
    def run(docs: pa.Table, answers: pa.Table, owners: pa.Table) -> Iterator[tuple]:
        """(ordinal, id, words, removed mask) of every document of a chunk."""
        c = Chunk(docs, keep_words=True)
        gone = np.zeros(len(c.codes) + 1, np.int64)
        if owners.num_rows:
            at, a, b = _extended(c, answers, window, block)
            ka = np.concatenate([np.frombuffer(x, np.uint64) for x in owners["first"].to_pylist()])
            kb = np.concatenate([np.frombuffer(x, np.uint32) for x in owners["second"].to_pylist()])
            least = np.concatenate([np.frombuffer(x, np.int64) for x in owners["least"].to_pylist()])
            order = np.lexsort((kb, ka))
            ka, kb, least = ka[order], kb[order], least[order]
            place = _find(ka, kb, a, _short(b))
            owner = c.owner(int(at[-1]) + 1)[at] if len(at) else at
            mine = c.ids[owner]
            dead = at[(place >= 0) & (least[np.maximum(place, 0)] < mine) & (mine != NO_ID)] if len(at) else at
            np.add.at(gone, dead, 1)
            np.add.at(gone, dead + window, -1)
        cover = np.cumsum(gone[:-1]) > 0
        for k, (start, n) in enumerate(zip(c.starts, c.lengths, strict=True)):
            yield k, c.words[k].split(), cover[start : start + n]

    return run


def _find(ka: np.ndarray, kb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of (a, b) among sorted distinct (ka, kb), or -1. Equal first hashes with other second ones are rare, so walk."""
    if not len(a):
        return np.zeros(0, np.int64)
    place = np.searchsorted(ka, a)
    out = np.full(len(a), -1, np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        at = place[open_]
        ok = at < len(ka)
        open_, at = open_[ok], at[ok]
        same = ka[at] == a[open_]
        open_, at = open_[same], at[same]
        hit = kb[at] == b[open_]
        out[open_[hit]] = at[hit]
        open_ = open_[~hit]
        place[open_] += 1
    return out


def _spans(mask: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return edge.reshape(-1, 2).tolist()


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256, removed) per row of ``docs``(doc_id, text).

    ``removed`` lists the maximal repeats [start, end) in words. A word goes if a ``window`` that covers it starts in a
    document with a smaller doc_id; windows are judged on the input. Null or empty text: no words, the hash of the empty
    text. Texts shorter than a window keep all. Rows with the same id are no copies of each other. A null id neither
    removes nor loses words. Other columns of ``docs`` are ignored. Windows count as equal by 95 bits of hash.
    """
    spark = docs.sparkSession
    block = (window + 1) // 2
    # A chunk sends a row to each bucket, as a map task sends a block to each reducer. A task holds a chunk or a bucket, so their number
    # follows the bytes of the table.
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    chunks, buckets = max(2 * partitions(spark), -(-size // CHUNK_BYTES)), max(partitions(spark), -(-size // BUCKET_BYTES))
    dealt = docs.select(
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(chunks)).alias("chunk"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
    )
    runs = dealt.groupBy("chunk").applyInArrow(_report_runs(block, buckets), "bucket long, chunk long, runs binary")
    anchors = runs.groupBy("bucket").applyInArrow(_shared_runs, "chunk long, anchors binary")
    candidates = dealt.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(
        _report_windows(window, block, buckets), "bucket long, chunk long, first binary, second binary, ids binary")
    owners = candidates.groupBy("bucket").applyInArrow(_first_owner, "chunk long, first binary, second binary, least binary")
    replies = anchors.select(
        "chunk", "anchors", *(F.lit(None).cast("binary").alias(c) for c in ("first", "second", "least"))
    ).unionByName(owners.withColumn("anchors", F.lit(None).cast("binary")))
    judge = _verdicts(window, block)

    def finish(docs: pa.Table, replies: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
                  ("kept_sha256", pa.string()), ("removed", pa.list_(pa.list_(pa.int64())))]
        if not docs.num_rows:
            return _rows([], fields)
        answers = replies.filter(pc.is_valid(replies["anchors"]))
        owners = replies.filter(pc.is_valid(replies["first"]))
        ids = docs["doc_id"].to_pylist()
        rows = []
        for k, words, mask in judge(docs, answers, owners):
            lost = int(mask.sum())
            kept = b" ".join(words if not lost else [words[i] for i in np.flatnonzero(~mask)])
            rows.append((ids[k], len(words), lost, kept.decode(), hashlib.sha256(kept).hexdigest(), _spans(mask) if lost else []))
        return _rows(rows, fields)

    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        finish, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, removed array<array<long>>")
