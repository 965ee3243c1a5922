"""SimHash near-dedup over a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight (position, byte) terms. Two fingerprints at ``distance`` or fewer differing bits differ in at
most that many bytes, so they share at least ``8 - distance`` terms. The index therefore lists fingerprints under every
combination of that many positional bytes: a pair that meets anywhere has reached the guaranteed count, a pair that meets
nowhere cannot link. The pairs of a list are tallied and verified by their differing bits, in blocks, and only a
spanning forest of the verified links leaves the list, so a group of m near copies gives m - 1 links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrain.llm.common import each_batch, partitions, raw, staged

#: Fingerprints of one list that are compared in one piece; longer lists are compared block by block in a second step.
LIST_BLOCK = 4096
SEED = 42


def fingerprint(text: bytes, width: int = 4) -> int:
    """Majority bits of the XXH64 of every ``width``-word shingle, repeats included; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(flat, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    codes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    bits = np.zeros(64, np.int64)
    rows = codes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(0, len(rows), 65536):
        bits += np.unpackbits(rows[k : k + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    major = 2 * bits > len(codes)
    return int(np.packbits(major, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed long. Null texts count as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = np.array([fingerprint(t, width) for t in raw(batch["text"])], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(codes)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        each_batch(run), "doc_id long, fp long")


def _masks(distance: int) -> list[int]:
    """One mask per combination of positions that a linked pair must share, as signed longs."""
    out = []
    for chosen in combinations(range(8), 8 - distance):
        mask = sum(0xFF << (8 * k) for k in chosen)
        out.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return out


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join all of ``fps`` that differ in ``distance`` bits or fewer, directly or over others of the list.

    Each reached fingerprint is compared with those not reached yet, so n fingerprints give at most n - 1 links.
    """
    left = fps.view(np.uint64)
    links: list[tuple[int, int]] = []
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue.append(left[0])
            left = left[1:]
        at = queue.pop()
        near = np.bitwise_count(left ^ at) <= distance
        if near.any():
            reached = left[near]
            links += [(int(at.view(np.int64)), int(x)) for x in reached.view(np.int64)]
            queue += list(reached)
            left = left[~near]
    return links


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Fingerprints of equal keys from sorted batches; a run may cross batches. Lists of one are passed over."""
    tail: list[list[np.ndarray]] | None = None
    for batch in batches:
        cols = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        fps = batch["fp"].to_numpy(zero_copy_only=False)
        if tail is not None:
            cols = [np.concatenate([t, c]) for t, c in zip(tail[:-1], cols, strict=True)]
            fps = np.concatenate([tail[-1], fps])
        new = np.zeros(len(fps), bool)
        new[:1] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(fps)])
        for a, n in zip(first[:-1][size[:-1] > 1], size[:-1][size[:-1] > 1], strict=True):
            yield tuple(int(c[a]) for c in cols), fps[a : a + n]
        a = first[-1] if len(first) else 0
        tail = [c[a:] for c in cols] + [fps[a:]]
    if tail is not None and len(tail[-1]) > 1:
        yield tuple(int(c[0]) for c in tail[:-1]), tail[-1]


LINK_SCHEMA = "a long, b long, combo long, key long, blocks long"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "combo", "key", "blocks"])


def _join_lists(distance: int):
    def run(batches):
        rows = []
        for (combo, key), fps in _runs(batches, ["combo", "key"]):
            if len(fps) > LIST_BLOCK:
                blocks = -(-len(fps) // (LIST_BLOCK // 2))
                rows += [(int(f), int(k % blocks), combo, key, blocks) for k, f in enumerate(fps)]
            else:
                rows += [(a, b, None, None, None) for a, b in _forest(fps, distance)]
            if len(rows) > 20_000:
                yield _emit(rows)
                rows = []
        if rows:
            yield _emit(rows)

    return run


def _join_blocks(distance: int):
    def run(batches):
        for (_, _, i, j), fps in _runs(batches, ["combo", "key", "i", "j"]):
            links = _forest(fps, distance)
            if links:
                yield _emit([(a, b, None, None, None) for a, b in links])

    return run


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links that connect every pair of distinct fingerprints at ``distance`` or fewer differing bits."""
    spark = prints.sparkSession
    masks = F.array(*(F.lit(m).cast("long") for m in _masks(distance)))
    lists = prints.select("fp").distinct().select("fp", F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fp")))).alias("combo", "key"))
    lists = lists.select(F.col("combo").cast("long").alias("combo"), "key", "fp")
    found = staged(
        lists.repartition(partitions(spark), "combo", "key").sortWithinPartitions("combo", "key", "fp").mapInArrow(_join_lists(distance), LINK_SCHEMA)
    )
    plain = found.where(F.col("blocks").isNull()).select("a", "b")
    # Lists too long for one task: every pair of their blocks is one task of bounded size.
    long_ = found.where(F.col("blocks").isNotNull()).select(
        "combo", "key", F.col("a").alias("fp"), F.col("b").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    pairs = long_.select("combo", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    across = (
        pairs.repartition(partitions(spark), "combo", "key", "i", "j").sortWithinPartitions("combo", "key", "i", "j", "fp")
        .mapInArrow(_join_blocks(distance), LINK_SCHEMA).select("a", "b")
    )
    return plain.unionByName(across).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``nodes``(node) reaches over ``edges``(a, b).

    Alternates two steps until nothing moves: neighbours larger than a node go to its least neighbour, then smaller ones
    do. Each is one aggregate that combines before the shuffle and one join that Spark splits on a hot node.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    while True:
        both = now.select("v", "u").unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v and u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = staged(large.distinct())
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        after = staged(small.select("e.*").where("v <> u").distinct())
        if after.count() == now.count() and after.join(now, ["v", "u"], "left_anti").isEmpty():
            break
        now = after
    return nodes.join(now.select(F.col("v").alias("node"), F.col("u").alias("to")), "node", "left").select("node", F.coalesce("to", "node").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``(doc_id, text).

    Exact copies share a fingerprint and are one node. ``component_id`` is the least doc_id reachable, itself
    included. Null or empty texts have fingerprint zero and link like any other. Repeated rows stay repeated. Rows without
    doc_id take part under their fingerprint; a group of nothing else has a null component_id. Other columns are ignored.
    """
    prints = staged(fingerprints(docs, width))
    by_print = grouped(prints, distance)
    least = by_print.join(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    named = by_print.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, root): the component of every distinct fingerprint."""
    nodes = prints.select(F.col("fp").alias("node")).distinct()
    return components(nodes, links(prints, distance)).select(F.col("node").alias("fp"), "root")


def first_of_each(docs: DataFrame, prints_of: Callable[[DataFrame], DataFrame], grouped_of: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """One row of each group of ``docs``, all columns as they are: the one with the smallest doc_id.

    Rows without doc_id come last; of rows with one id the one with the least row hash stays, and rows alike in every
    column are one row. ``prints_of`` adds the fingerprint fp to (own_id, own_hash, text), ``grouped_of`` gives (fp, root).
    """
    columns = docs.columns
    keyed = docs.select(F.struct(*(docs[c] for c in columns)).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(*(docs[c] for c in columns)).alias("own_hash"))
    texts = keyed.select("own_id", "own_hash", F.col("row.text").cast("string").alias("text"))
    prints = staged(prints_of(texts))
    order = F.struct(F.col("own_id").isNull(), F.col("own_id"), F.col("own_hash"))
    first = prints.groupBy("fp").agg(F.min(order).alias("first"))
    kept = grouped_of(prints, texts).join(first, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.own_id").alias("kept_id"), F.col("first.own_hash").alias("kept_hash"))
    rows = keyed.join(kept, (keyed["own_hash"] == kept["kept_hash"]) & keyed["own_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    return rows.dropDuplicates(["own_hash", "own_id"]).select("row.*")


def one_of_each(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """One row of each group of SimHash near copies; see ``first_of_each``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = np.array([fingerprint(t, width) for t in raw(batch["text"])], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch["own_id"], batch["own_hash"], pa.array(codes)], names=["own_id", "own_hash", "fp"])

    return first_of_each(docs, lambda texts: texts.mapInArrow(each_batch(run), "own_id long, own_hash long, fp long"), lambda prints, _: grouped(prints, distance))
