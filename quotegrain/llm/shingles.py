"""Near copies by the Jaccard similarity of their word shingles, found completely.

Texts are sets of five-word shingles. SimHash comes first (``simhash.links`` on fingerprints of the same shingles): each fingerprint meets its closest
linked one and the texts of its own, and pairs that hold on the whole sets join before anything else. A fingerprint misses pairs at the similarity, so
the rest is found by counting: of each set the first two fifths (and one) in hash order are counted over the whole table, and
the shingles met more than once are stored as sorted hash arrays that the tasks map. Two sets at 0.8 or more share a known
number of these first shingles, so each set keeps the rarest of them that a partner must meet at least once, and no list is
needed for shingles met once: a text whose shingles are mostly its own has no list at all, whatever passages it shares. Sets of
one list are first tied to one partner each and tested, twice, so that a large group of near copies is one component after a few pairs
per set. What is left are pairs of different components, allowed by sizes and parity sketches (neither rules out a similar pair). A list looks at a pair
only if no shingle shortly before in both sets has its list too, and passes on entries, one for each set with such a pair, never the pairs. The
whole sets are brought to those entries, every such pair is tested there, and only links that join components leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrain.llm.arrays import HashArrays, new_folder, pack, save, shard_of, smallest, unpack
from quotegrain.llm.common import WordHash, each_batch, mixed, partitions, raw, rolling, staged
from quotegrain.llm.simhash import components, fingerprint, first_of_each
from quotegrain.llm.simhash import links as simhash_links

WIDTH = 5
#: Similarity that links, as a fraction of whole numbers.
SHARE, OF = 4, 5
BASE = 0x9E3779B97F4A7C15
#: Differing bits at which two SimHash fingerprints propose a pair.
DISTANCE = 4
#: One in so many shingles is counted beyond those that a similar set must meet.
EXTRA = 5
#: Bytes of text whose counted shingles make up one shard, and shingles that a task counts before it passes them on.
SHARD_BYTES, FLUSH = 64_000_000, 3_000_000
#: Leading bits by which counted shingles are told apart; any count is a valid order, so a clash costs a proposal at most.
CELL = np.uint64(0xFFFF_FFFF_FFFF_0000)
#: Words of 64 bits in a parity sketch.
SKETCH = 8
#: Entries of one list that are paired in one piece; longer lists are paired block by block.
LIST_BLOCK = 4096
#: Rounds that tie sets to one partner each before all pairs of components are proposed.
ROUNDS = 2
#: Shingles before that of a list that an entry carries, to tell pairs that an earlier list has met.
BEFORE = 4
#: Shingles of the whole sets that are tested against one another in one piece.
PIECE = 1 << 21
#: Bits of the filter by which tasks pass over texts of no pair.
FILTER = 1 << 22


def shingles(text: bytes, codes: WordHash) -> np.ndarray:
    """Sorted distinct shingles; fewer than ``WIDTH`` words are one shingle, no words none."""
    words = codes.codes(text.lower().split())
    return np.unique(rolling(words, min(WIDTH, max(1, len(words))), BASE))


def set_key(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def head_size(n):
    """Shingles of a set of ``n`` that are counted."""
    return n - -(-SHARE * n // OF) + 1 + n // EXTRA


class LeastShared(dict):
    """Size of a set -> how many counted shingles it shares with any similar set, at least one."""

    def __missing__(self, n: int) -> int:
        m = np.arange(-(-SHARE * n // OF), OF * n // SHARE + 1)
        need = -(-(n + m) * SHARE // (SHARE + OF)) - np.maximum(n - head_size(n), m - head_size(m))
        out = self[n] = max(1, int(need.min()))
        return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SHARE * (len(a) + len(b) - both)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parity of the shingles of each of 512 classes: two sketches differ in no more bits than the sets in shingles."""
    odd = np.bincount((mixed(own) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _cells(own: np.ndarray) -> np.ndarray:
    return mixed(own) & CELL


def _counted(bits: int):
    """Texts to packed (cell, times) of their counted shingles."""

    def flush(parts: list[np.ndarray]):
        cells, n = np.unique(_cells(np.concatenate(parts)), return_counts=True)
        shards = shard_of(cells, bits)
        cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(cells) else np.zeros(0, np.int64)
        ends = np.r_[cuts[1:], len(cells)]
        data = [pack([np.diff(cells[a:b], prepend=np.uint64(0)), smallest(n[a:b])]) for a, b in zip(cuts, ends, strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(shards[cuts], pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, parts, size = WordHash(), [], 0
        for batch in batches:
            for text in raw(batch["text"]):
                own = shingles(text, codes)
                parts.append(own[: head_size(len(own))] if len(own) else own)
                size += len(parts[-1])
            if size >= FLUSH:
                yield flush(parts)
                parts, size = [], 0
        if size:
            yield flush(parts)

    return run


def _repeated(bits: int, folder: str):
    """Stores the cells of one shard that were met more than once."""

    def run(group: pa.Table) -> pa.Table:
        blobs = [unpack(d) for d in group["data"].to_pylist()]
        cells = np.concatenate([np.cumsum(c, dtype=np.uint64) for c, _ in blobs])
        n = np.concatenate([n.astype(np.int64) for _, n in blobs])
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        n = np.add.reduceat(n[order], first)
        save(folder, "repeated", int(group["shard"][0].as_py()), bits, cells[first][n > 1], {"n": n[n > 1]})
        return group.select(["shard"]).slice(0, 1)

    return run


def counted(texts: DataFrame) -> tuple[str, int]:
    """Counts the first shingles of all texts; the folder of the hash arrays and the bits of their shards."""
    size = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    bits = max(0, (-(-size // SHARD_BYTES) - 1).bit_length())
    folder = new_folder(texts.sparkSession, "shingles")
    texts.select("text").mapInArrow(_counted(bits), "shard int, data binary").groupBy("shard").applyInArrow(_repeated(bits, folder), "shard int").count()
    return folder, bits


def _kept(head: np.ndarray, times: np.ndarray, n: int, least: LeastShared) -> np.ndarray:
    """The rarest counted shingles, of which a similar set keeps one too; those met once have no list."""
    on = np.flatnonzero(times)
    many = len(on) - least[n] + 1
    return head[on[np.lexsort((head[on], times[on]))[:many]]] if many > 0 else head[:0]


def prints(texts: DataFrame) -> DataFrame:
    """(own_id, own_hash, fp, n, code, kept, sketch) per row of ``texts``: key and size of its set, its SimHash, and its entries for the lists."""
    folder, bits = counted(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, table, least = WordHash(), HashArrays(folder, "repeated", bits), LeastShared()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = raw(batch["text"])
            sets = [shingles(t, codes) for t in texts]
            heads = [s[: head_size(len(s))] if len(s) else s for s in sets]
            _, (times,) = table.find(_cells(np.concatenate(heads)), ["n"])
            cuts = np.cumsum([0, *map(len, heads)])
            kept = [_kept(h, times[a:b], len(s), least) if len(s) else h for s, h, a, b in zip(sets, heads, cuts[:-1], cuts[1:], strict=True)]
            sketches = [sketch(s) if len(k) else np.zeros(0, np.int64) for s, k in zip(sets, kept, strict=True)]
            cols = [batch["own_id"], batch["own_hash"], pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            cols.append(pa.array(np.array([fingerprint(t, WIDTH) for t in texts], np.uint64).view(np.int64)))
            for lists in ([k.view(np.int64) for k in kept], sketches):
                ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
                cols.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists))))
            return pa.RecordBatch.from_arrays(cols, names=["own_id", "own_hash", "fp", "n", "code", "kept", "sketch"])

        yield from each_batch(one)(batches)

    return texts.mapInArrow(run, "own_id long, own_hash long, fp long, n long, code long, kept array<long>, sketch array<long>")


def _lists(batches, keys: list[str], others: list[str]):
    """(key, columns) of each run of equal keys in sorted batches, runs of one left out; a run may cross batches."""
    names, tail = keys + others, None
    for batch in batches:
        cols = [batch[c].to_numpy(zero_copy_only=False) for c in names]
        if tail is not None:
            cols = [np.concatenate([t, c]) for t, c in zip(tail, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.zeros(len(cols[0]), bool)
        new[0] = True
        for c in cols[: len(keys)]:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a > 1:
                yield tuple(int(c[a]) for c in cols[: len(keys)]), [c[a:b] for c in cols[len(keys) :]]
        tail = [c[first[-1] :] for c in cols]
    if tail is not None and len(tail[0]) > 1:
        yield tuple(int(c[0]) for c in tail[: len(keys)]), [c for c in tail[len(keys) :]]


def _batched(rows, names: list[str]):
    """Record batches from tuples of equally long arrays; None is a column of nulls."""
    held, size = [], 0

    def out():
        cols = [pa.concat_arrays([pa.array(r[k], pa.int64()) for r in held]) for k in range(len(names))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    for row in rows:
        held.append(row)
        size += len(row[0])
        if size > 50_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


SKETCHED = [f"s{k}" for k in range(SKETCH)]
EARLIER = [f"e{k}" for k in range(BEFORE)]
#: An entry of a list: size, component, set, its block and piece, the place of the shingle in the set's order, shingles before it, sketch.
ENTRY = ["n", "comp", "fp", "own", "piece", "place", *EARLIER, *SKETCHED]
#: A block of a list, and two pieces of the block.
BLOCK, PIECES = ["shingle", "i", "j"], ["p", "q"]


def _possible(na, nb, sketch_a: np.ndarray, sketch_b: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches allow the similarity; sketches are arrays of rows."""
    both = na + nb
    most = both - 2 * -(-both * SHARE // (SHARE + OF))
    return (np.maximum(na, nb) * SHARE <= np.minimum(na, nb) * OF) & (np.bitwise_count((sketch_a ^ sketch_b).view(np.uint64)).sum(1, dtype=np.int64) <= most)


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, other): each entry with the first entry of its list, if that is of another component and possible. Holds a batch only."""
    names = ["shingle", "part", "comp", "fp", "n", *SKETCHED]
    hub = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in names], 1)
        new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        hubs = rows[first]
        if hub is not None and (hub[:2] == rows[0, :2]).all():
            hubs[first == 0] = hub
        hub = hubs[-1].copy()
        ok = (hubs[:, 2] != rows[:, 2]) & _possible(rows[:, 4], hubs[:, 4], rows[:, 5:], hubs[:, 5:])
        yield pa.RecordBatch.from_arrays([pa.array(rows[ok, 3]), pa.array(hubs[ok, 3])], names=["fp", "other"])


def _candidates(entries: list[np.ndarray], blocks: bool, pieces: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(k, others): possible pairs of different components among entries sorted by size that met in no list shortly before.

    All sets keep their shingles in one order, so the first list that two sets share never passes over them. ``blocks`` and
    ``pieces`` ask for pairs across the two blocks or pieces only.
    """
    n, comp, _, own, piece, place = entries[:6]
    if (comp == comp[0]).all():
        return
    earlier, marks = np.stack(entries[6 : 6 + BEFORE], 1), np.stack(entries[6 + BEFORE : 6 + BEFORE + SKETCH], 1)
    # Sorted by size: partners of an entry are the next ones up to 5 / 4 of its size.
    ends = np.searchsorted(SHARE * n, OF * n, side="right")
    for k, end in enumerate(ends.tolist()):
        at = slice(k + 1, end)
        apart = comp[at] != comp[k]
        if blocks:
            apart &= own[at] != own[k]
        if pieces:
            apart &= piece[at] != piece[k]
        if apart.any():
            at = np.flatnonzero(apart) + k + 1
            at = at[_possible(n[at], n[k], marks[at], marks[k])]
            if place[k] and len(at):
                met = (earlier[at][:, :, None] == earlier[k]).any((1, 2)) & (place[at] > 0)
                at = at[~met]
            if len(at):
                yield k, at


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of a pair of blocks that have a candidate, once for each piece of the block that has one."""

    def rows():
        for key, entries in _lists(batches, BLOCK, ENTRY):
            entries[4] = piece = np.cumsum(entries[0]) // PIECE
            piece -= piece[0]
            has = np.zeros((len(piece), int(piece[-1]) + 1), bool)
            for k, at in _candidates(entries, key[1] != key[2], False):
                has[k, piece[at]] = True
                has[at, piece[k]] = True
            at, other = np.nonzero(has)
            if len(at):
                mine = piece[at]
                yield *(np.full(len(at), x) for x in key), np.minimum(mine, other), np.maximum(mine, other), *(c[at] for c in entries)

    return _batched(rows(), [*BLOCK, *PIECES, *ENTRY])


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): candidates whose whole sets are similar; of those in two pieces only links that join components not joined yet."""

    def rows():
        for (_, i, j, p, q), (*entries, sets) in _lists(batches, [*BLOCK, *PIECES], [*ENTRY, "set"]):
            comp, fp = entries[1].tolist(), entries[2]
            root = {c: c for c in comp}

            def top(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            whole = [np.frombuffer(x, np.uint64) for x in sets]
            a, b = [], []
            for k, at in _candidates(entries, i != j, p != q):
                for other in at.tolist():
                    x, y = top(comp[k]), top(comp[other])
                    if x != y and similar(whole[k], whole[other]):
                        root[x] = y
                        a.append(fp[k])
                        b.append(fp[other])
            if a:
                yield np.minimum(a, b), np.maximum(a, b)

    return _batched(rows(), ["a", "b"])


def whole_sets(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(fp, own): the whole sets of ``keys``(fp), distinct, from their texts."""
    marks = keys.select(F.pmod("fp", F.lit(FILTER)).alias("m")).distinct().toArrow()["m"].to_numpy()
    wanted = np.zeros(FILTER, bool)
    wanted[marks] = True
    wanted = np.packbits(wanted)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, known = WordHash(), np.unpackbits(wanted).astype(bool)
        sets = [(set_key(s), s.tobytes()) for s in (shingles(t, codes) for t in raw(batch["text"]))]
        sets = [(k, s) for k, s in sets if known[k % FILTER]]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in sets], pa.int64()), pa.array([s for _, s in sets], pa.binary())], names=["fp", "own"])

    return staged(texts.mapInArrow(each_batch(run), "fp long, own binary").join(keys, "fp", "left_semi").dropDuplicates(["fp"]))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of ``pairs``(a, b) whose sets are similar, tested on the whole sets."""
    pairs = staged(pairs.select("a", "b"))
    keys = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()

    def test(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = zip(batch["own_a"].to_pylist(), batch["own_b"].to_pylist(), strict=True)
        ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in both]
        return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sets = whole_sets(keys, texts)
    joined = pairs.join(sets.select(F.col("fp").alias("a"), F.col("own").alias("own_a")), "a").join(sets.select(F.col("fp").alias("b"), F.col("own").alias("own_b")), "b")
    return staged(joined.select("a", "b", "own_a", "own_b").mapInArrow(each_batch(test), "a long, b long"))


def joined(links: DataFrame) -> DataFrame:
    """(node, root) of the sets of ``links``(a, b)."""
    return staged(components(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), links))


def _blocks(salt: int) -> Column:
    """Block of an entry in its list, by its key and a salt; lists of up to LIST_BLOCK entries have one."""
    return F.pmod(F.xxhash64("fp", F.lit(salt)), F.ceil(F.col("len") * F.when(F.col("len") > LIST_BLOCK, 2).otherwise(1) / LIST_BLOCK))


def near_prints(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of sets that SimHash proposes: each with the first one of its fingerprint, and that with the first one of the closest
    fingerprint linked to it. At most two pairs for each set, however large a group is.
    """
    codes = staged(rows.groupBy("fp").agg(F.min("code").alias("code")))
    first = codes.groupBy("code").agg(F.min("fp").alias("first"))
    linked = simhash_links(codes.select(F.col("code").alias("fp")), DISTANCE)
    far = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    # Links point to the lesser fingerprint, so those chosen make trees.
    closest = linked.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).groupBy("x").agg(F.min_by("y", F.struct(far, "y")).alias("y"))
    ends = closest.join(first.select(F.col("code").alias("x"), F.col("first").alias("fp")), "x").join(first.select(F.col("code").alias("y"), F.col("first").alias("other")), "y")
    same = codes.join(first, "code").where("fp <> first").select("fp", F.col("first").alias("other"))
    return ends.select("fp", "other").unionByName(same).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def list_entries(rows: DataFrame) -> DataFrame:
    """(fp, n, sketch, place, shingle, shingles before, len): the distinct sets of ``rows`` under each shingle that another set keeps too."""
    sets = rows.where(F.size("kept") > 0).groupBy("fp").agg(F.first("n").alias("n"), F.first("kept").alias("kept"), F.first("sketch").alias("sketch"))
    # One row per shingle: its place in the set's order, and the ones before it (the first one where there are fewer).
    place = F.transform("kept", lambda x, k: F.struct(k.alias("place"), x.alias("shingle"), *(
        F.col("kept")[F.greatest(k - 1 - back, F.lit(0))].alias(e) for back, e in enumerate(EARLIER))))
    entries = sets.select("fp", "n", *(F.col("sketch")[k].alias(s) for k, s in enumerate(SKETCHED)), F.inline(place))
    lengths = sets.select(F.explode("kept").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("len")).where("len > 1")
    return entries.join(lengths, "shingle")


def open_entries(listed: DataFrame) -> DataFrame:
    """The entries of ``listed`` that have a candidate for a link of two components. Long lists meet block by block."""
    blocks = F.ceil(F.col("len") * F.when(F.col("len") > LIST_BLOCK, 2).otherwise(1) / LIST_BLOCK)
    left = listed.withColumn("own", _blocks(ROUNDS)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    left = left.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "piece": F.lit(0).cast("long"), "place": F.col("place").cast("long")})
    left = left.select(*BLOCK, *ENTRY).repartition(partitions(listed.sparkSession), *BLOCK).sortWithinPartitions(*BLOCK, "n", "fp")
    return left.mapInArrow(_open, ", ".join(f"{c} long" for c in [*BLOCK, *PIECES, *ENTRY]))


def linked(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links among ``open_entries`` that join every two components with a similar pair, each pair tested on the whole sets."""
    sets = whole_sets(entries.select("fp").distinct(), texts).select("fp", F.col("own").alias("set"))
    keys = [*BLOCK, *PIECES]
    met = entries.join(sets, "fp").select(*keys, *ENTRY, "set").repartition(partitions(entries.sparkSession), *keys).sortWithinPartitions(*keys, "n", "fp")
    return staged(met.mapInArrow(_tested, "a long, b long").distinct())


def grouped(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(fp, root): the component of every distinct set of ``rows``(fp, n, code, kept, sketch) over all pairs at the similarity or more."""
    spark = rows.sparkSession
    parts = partitions(spark)
    entries = staged(list_entries(rows))
    links = verified(near_prints(rows), texts)
    comps = joined(links)

    def listed() -> DataFrame:
        return entries.join(comps.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("comp", F.coalesce("root", "fp")).drop("root")

    for salt in range(ROUNDS):
        # Another order of components each round, so that a set whose partner was not similar meets another one.
        order = ["shingle", "part", F.xxhash64("comp", F.lit(salt)), "comp", "fp"]
        found = listed().withColumn("part", _blocks(salt)).select("shingle", "part", "comp", "fp", "n", *SKETCHED)
        found = found.repartition(parts, "shingle", "part").sortWithinPartitions(*order).mapInArrow(_partners, "fp long, other long")
        met = found.groupBy("fp", "other").agg(F.count(F.lit(1)).alias("met")).groupBy("fp").agg(F.max_by("other", F.struct("met", "other")).alias("other"))
        links = links.unionByName(verified(met.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct(), texts))
        comps = joined(links)
    rest = linked(staged(open_entries(listed())), texts)
    return components(rows.select(F.col("fp").alias("node")).distinct(), links.unionByName(rest)).select(F.col("node").alias("fp"), "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of ``docs`` linked by Jaccard similarity, all columns as they are; see ``simhash.first_of_each``."""
    return first_of_each(docs, prints, grouped)
