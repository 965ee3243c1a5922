"""Vector codes by dual-tree Lloyd: product codebooks fitted and applied in whole numbers, exactly.

Vectors are cut into ``PARTS`` equal parts, each with a codebook of its own. Blocks of vectors are written once with a tree per part:
the order of the block's parts in which every node is a run of places, halved level by level along the widest component. A
round holds each block's trees against a tree over the entries of every codebook. Pairs of nodes go down both trees together; an entry
node is dropped where the least distance to the part node exceeds another's greatest, and a part node with one
entry left takes it whole, its sum being a difference of running sums. Points of leaves that stay uncertain compare squared distances of
whole numbers, ties to the lower entry. Tasks send one sum per entry and component, so nothing grows with the data but the blocks; the
codebooks alone pass through the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrain.llm.common import staged

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors and components of one block at most, and parts in a leaf.
BLOCK, BLOCK_SIZE, LEAF = 4096, 1 << 20, 16
#: Sums are sent as digits of this base, so that they add up in longs whatever their size.
DIGIT = 30
MOST = (1 << 63) - 1


# --- vectors of whole numbers -------------------------------------------------------------------------------------


def quantised(flat: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of floor(256 * x), filled up with zeros to ``width``; int64, or Python numbers where those are too small for exact sums."""
    if len(flat) and np.abs(flat).max() >= 1 << 20:
        # 256 * x would pass the largest double near its end, so it is taken after the floor there.
        whole = np.array([math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in flat.tolist()], object)
    else:
        whole = np.floor(flat * 256).astype(np.int64)
    if (sizes == width).all():
        return whole.reshape(len(sizes), width)
    rows = np.zeros((len(sizes), width), whole.dtype)
    rows[np.arange(width) < sizes[:, None]] = whole
    return rows


def in_parts(rows: np.ndarray) -> np.ndarray:
    """(part, row, component) of (row, component)."""
    return np.ascontiguousarray(rows.reshape(len(rows), PARTS, -1).transpose(1, 0, 2))


# --- trees ----------------------------------------------------------------------------------------------------------


def _cuts(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level start and end; node k is halved into 2k and 2k + 1 of the next."""
    return (np.arange((1 << level) + 1) * n) >> level


def depth(n: int, leaf: int) -> int:
    return max(0, (max(1, n) // leaf).bit_length() - 1)


def grown(points: np.ndarray, leaf: int) -> np.ndarray:
    """Order of the points of every part, (part, place), in which the nodes of all levels are runs."""
    parts, n, _ = points.shape
    order = np.tile(np.arange(n), (parts, 1))
    for level in range(depth(n, leaf)):
        cuts = _cuts(n, level)
        placed = np.take_along_axis(points, order[:, :, None], 1)
        spread = np.maximum.reduceat(placed, cuts[:-1], 1) - np.minimum.reduceat(placed, cuts[:-1], 1)
        node = np.repeat(np.arange(1 << level), np.diff(cuts))
        along = spread.argmax(2)[:, node]
        values = np.take_along_axis(placed, along[:, :, None], 2)[:, :, 0]
        order = np.take_along_axis(order, np.lexsort((values, np.tile(node, (parts, 1)))), 1)
    return order


def boxes(placed: np.ndarray, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and greatest components of the nodes of every level, (part, node, component), from the root down."""
    cuts = _cuts(placed.shape[1], levels)[:-1]
    low, high = np.minimum.reduceat(placed, cuts, 1), np.maximum.reduceat(placed, cuts, 1)
    out = [(low, high)]
    for _ in range(levels):
        low, high = np.minimum(low[:, ::2], low[:, 1::2]), np.maximum(high[:, ::2], high[:, 1::2])
        out.append((low, high))
    return out[::-1]


class Codebooks:
    """Entries of every part with their tree."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.exact = entries.dtype == object
        self.order = grown(entries, 1) if not self.exact else None
        self.levels = depth(entries.shape[1], 1)
        self.boxes = boxes(np.take_along_axis(entries, self.order[:, :, None], 1), self.levels) if not self.exact else None
        self.most = 0 if self.exact or not entries.size else int(np.abs(entries).max())


class Assigned:
    """Entry of every part of a block, in the block's tree order, and the sums that the whole nodes and leaves add up to."""

    def __init__(self, entry: np.ndarray, sums: np.ndarray, counts: np.ndarray):
        self.entry, self.sums, self.counts = entry, sums, counts


def assigned(placed: np.ndarray, books: Codebooks) -> Assigned:
    """Nearest entries of ``placed``, (part, place, component) in tree order."""
    parts, n, width = placed.shape
    size = books.entries.shape[1]
    most = max(books.most, 0 if placed.dtype == object else int(np.abs(placed).max()))
    if placed.dtype == object or books.exact or width * (2 * most) ** 2 * ENTRIES * 2 >= 1 << 62:
        return _plain(placed.astype(object), books.entries.astype(object))
    levels = depth(n, LEAF)
    own = boxes(placed, levels)
    running = np.concatenate([np.zeros((parts, 1, width), np.int64), np.cumsum(placed, 1)], 1)
    entry = np.zeros((parts, n), np.int64)
    sums, counts = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
    # Pairs of nodes in order of (part, node). Both trees go down together, the entries' two levels at a time.
    part, node, other, step = np.arange(parts), np.zeros(parts, np.int64), np.zeros(parts, np.int64), 0
    for level in range(levels + 1):
        part, node, other = _pruned(part, node, other, own[level], books.boxes[step])
        while step < (books.levels if level == levels else min(2 * level + 2, books.levels)):
            step += 1
            part, node = np.repeat(part, 2), np.repeat(node, 2)
            other = np.repeat(other, 2) * 2 + np.tile([0, 1], len(other))
            part, node, other = _pruned(part, node, other, own[level], books.boxes[step])
        if step == books.levels:
            part, node, other = _take_whole(part, node, other, level, n, books, running, entry, sums, counts)
        if level == levels or not len(part):
            break
        # Both halves of every node, each with all entry nodes that the node has left.
        first, length = _groups(part, node)
        twice = np.repeat(np.arange(len(first)), 2)
        take = _spans(first[twice], length[twice])
        half = np.repeat(np.tile([0, 1], len(first)), length[twice])
        part, node, other = part[take], 2 * node[take] + half, other[take]
    if len(part):
        _leaves(part, node, other, levels, placed, books, entry, sums, counts)
    return Assigned(entry, sums, counts)


def _groups(part: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (node[1:] != node[:-1])])
    return first, np.diff(np.r_[first, len(part)])


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every span, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length - start, length)


def _pruned(part, node, other, own, theirs):
    """Pairs whose least distance is not above the smallest greatest distance of their part node."""
    if not len(part):
        return part, node, other
    low, high = own[0][part, node], own[1][part, node]
    their_low, their_high = theirs[0][part, other], theirs[1][part, other]
    gap = np.maximum(np.maximum(their_low - high, low - their_high), 0)
    least = (gap * gap).sum(1)
    far = np.maximum(their_high - low, high - their_low)
    greatest = (far * far).sum(1)
    start, length = _groups(part, node)
    keep = least <= np.repeat(np.minimum.reduceat(greatest, start), length)
    return part[keep], node[keep], other[keep]


def _take_whole(part, node, other, level, n, books, running, entry, sums, counts):
    """Gives whole nodes to the only entry left, by their cached sums; the rest goes on."""
    if not len(part):
        return part, node, other
    start, length = _groups(part, node)
    ends = _cuts(books.entries.shape[1], books.levels)
    alone = (length == 1) & (ends[other[start] + 1] - ends[other[start]] == 1)
    at = start[alone]
    if len(at):
        p, cuts = part[at], _cuts(n, level)
        a, b = cuts[node[at]], cuts[node[at] + 1]
        chosen = books.order[p, ends[other[at]]]
        np.add.at(sums, (p, chosen), running[p, b] - running[p, a])
        np.add.at(counts, (p, chosen), b - a)
        entry[np.repeat(p, b - a), _spans(a, b - a)] = np.repeat(chosen, b - a)
    keep = ~np.repeat(alone, length)
    return part[keep], node[keep], other[keep]


def _leaves(part, node, other, level, placed, books, entry, sums, counts):
    """Points of uncertain leaves against the entries left to their leaf, in whole numbers."""
    ends = _cuts(books.entries.shape[1], books.levels)
    wide = ends[other + 1] - ends[other]
    chosen = books.order[np.repeat(part, wide), _spans(ends[other], wide)]
    part, node = np.repeat(part, wide), np.repeat(node, wide)
    cuts = _cuts(placed.shape[1], level)
    start, length = _groups(part, node)
    a = cuts[node[start]]
    points = cuts[node[start] + 1] - a
    # Rows: every point of a leaf times every entry left there, in that order.
    of_leaf = np.repeat(np.arange(len(start)), points)
    place = _spans(a, points)
    many = length[of_leaf]
    row_entry = chosen[_spans(start[of_leaf], many)]
    row_part = np.repeat(part[start][of_leaf], many)
    gap = placed[row_part, np.repeat(place, many)] - books.entries[row_part, row_entry]
    nearest = np.minimum.reduceat((gap * gap).sum(1) * ENTRIES + row_entry, np.cumsum(many) - many) % ENTRIES
    p = part[start][of_leaf]
    entry[p, place] = nearest
    np.add.at(sums, (p, nearest), placed[p, place])
    np.add.at(counts, (p, nearest), 1)


def _plain(placed: np.ndarray, entries: np.ndarray) -> Assigned:
    """The same with numbers of any size: numbers that longs cannot square exactly are compared one by one."""
    parts, n, width = placed.shape
    entry = np.zeros((parts, n), np.int64)
    sums, counts = np.zeros((parts, entries.shape[1], width), object), np.zeros((parts, entries.shape[1]), np.int64)
    for p in range(parts):
        for k in range(n):
            gap = entries[p] - placed[p, k]
            chosen = entry[p, k] = min(enumerate((gap * gap).sum(1)), key=lambda x: (x[1], x[0]))[0]
            sums[p, chosen] += placed[p, k]
            counts[p, chosen] += 1
    return Assigned(entry, sums, counts)


# --- Spark ------------------------------------------------------------------------------------------------------------


def usable(vector: str) -> Column:
    """The vector is there and every component is a finite number."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _packed(rows: np.ndarray) -> tuple[bytes, str]:
    if rows.dtype == object:
        return "\n".join(map(str, rows.ravel())).encode(), "text"
    kind = np.int16 if not rows.size or np.abs(rows).max() < 1 << 15 else np.int32 if np.abs(rows).max() < 1 << 31 else np.int64
    return rows.astype(kind).tobytes(), np.dtype(kind).str


def _unpacked(data: bytes, kind: str, width: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(x) for x in data.split(b"\n")] if data else [], object).reshape(-1, width)
    return np.frombuffer(data, kind).astype(np.int64).reshape(-1, width)


def blocks(kept: DataFrame, width: int) -> DataFrame:
    """(vec_id array, label array, kind, data, trees): blocks of vectors with the tree order of every part, written once."""
    most = max(LEAF, min(BLOCK, BLOCK_SIZE // max(1, width)))
    id_kind = kept.schema["vec_id"].dataType.simpleString()

    def block(ids: pa.Array, labels: pa.Array, rows: np.ndarray) -> pa.RecordBatch:
        data, kind = _packed(rows)
        order = grown(in_parts(rows), LEAF) if rows.dtype != object else np.tile(np.arange(len(rows)), (PARTS, 1))
        whole = pa.array([0, len(ids)], pa.int32())
        cols = [
            pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, labels),
            pa.array([kind]), pa.array([data]), pa.array([order.astype(np.uint16).tobytes()]),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["ids", "labels", "kind", "data", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            vectors = batch["vector"]
            sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            rows = quantised(vectors.flatten().to_numpy(zero_copy_only=False), sizes, width)
            held.append((batch["vec_id"], batch["label"], rows))
            while sum(len(r) for _, _, r in held) >= most:
                whole = [f([h[k] for h in held]) for k, f in enumerate((pa.concat_arrays, pa.concat_arrays, np.concatenate))]
                yield block(*(w[:most] for w in whole))
                held = [tuple(w[most:] for w in whole)]
        if sum(len(r) for _, _, r in held):
            yield block(*(f([h[k] for h in held]) for k, f in enumerate((pa.concat_arrays, pa.concat_arrays, np.concatenate))))

    return staged(kept.mapInArrow(run, f"ids array<{id_kind}>, labels array<string>, kind string, data binary, trees binary"))


def _loaded(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, tree order, parts in tree order) of each block of a batch."""
    for k in range(batch.num_rows):
        rows = _unpacked(batch["data"][k].as_py(), batch["kind"][k].as_py(), width)
        order = np.frombuffer(batch["trees"][k].as_py(), np.uint16).astype(np.int64).reshape(PARTS, -1)
        yield k, order, np.take_along_axis(in_parts(rows), order[:, :, None], 1)


def _sums(books: np.ndarray, width: int):
    """Per task: (cell, digit, value) of the counts and sums of every entry; cell numbers part, entry and component, the count last."""
    each = width // PARTS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, size = Codebooks(books), books.shape[1]
        whole = np.zeros((PARTS, size, each), object)
        for batch in batches:
            for _, _, placed in _loaded(batch, width):
                got = assigned(placed, tree)
                whole[:, :, :-1] += got.sums.astype(object)
                whole[:, :, -1] += got.counts.astype(object)
        cells, digits, values = [], [], []
        for cell, value in enumerate(whole.ravel().tolist()):
            digit, sign = 0, -1 if value < 0 else 1
            value = abs(value)
            while value:
                cells.append(cell)
                digits.append(digit)
                values.append(sign * (value & ((1 << DIGIT) - 1)))
                value >>= DIGIT
                digit += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (cells, digits, values)], names=["cell", "digit", "value"])

    return run


def refined(found: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """Codebooks after one round: floor of the mean of what each entry was nearest to; unused entries stay."""
    each = width // PARTS + 1
    rows = found.mapInArrow(_sums(books, width), "cell long, digit long, value long").groupBy("cell", "digit").agg(F.sum("value").alias("value")).collect()
    whole = np.zeros(PARTS * books.shape[1] * each, object)
    for r in rows:
        whole[r["cell"]] += r["value"] << (DIGIT * r["digit"]) if r["value"] >= 0 else -(-r["value"] << (DIGIT * r["digit"]))
    whole = whole.reshape(PARTS, books.shape[1], each)
    after = books.astype(object)
    used = whole[:, :, -1] > 0
    after[used] = whole[used][:, :-1] // whole[used][:, -1:]
    return _narrow(after)


def _narrow(rows: np.ndarray) -> np.ndarray:
    fits = not rows.size or max(abs(int(rows.max())), abs(int(rows.min()))) < 1 << 62
    return rows.astype(np.int64) if fits else rows.astype(object)


def start(kept: DataFrame, width: int) -> np.ndarray:
    """Parts of the vectors of the smallest ids, (part, entry, component); of rows with one id the least vector, no id last."""
    first = kept.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES)
    rows = kept.join(F.broadcast(first), kept["vec_id"].eqNullSafe(first["vec_id"]), "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = rows.orderBy(F.col("vec_id").asc_nulls_last()).collect()
    sizes = np.array([len(r["vector"]) for r in rows], np.int64)
    return _narrow(in_parts(quantised(np.array([x for r in rows for x in r["vector"]], np.float64), sizes, width)))


def _coded(books: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Codebooks(books)
        for batch in batches:
            for k, order, placed in _loaded(batch, width):
                entry = assigned(placed, tree).entry
                big = placed.dtype == object or tree.exact
                gap = placed.astype(object if big else np.int64) - tree.entries[np.arange(PARTS)[:, None], entry]
                if not big and gap.size and width * int(np.abs(gap).max()) ** 2 > MOST:
                    gap = gap.astype(object)
                own = np.empty_like(entry)
                np.put_along_axis(own, order, entry, 1)
                far = np.zeros(order.shape, gap.dtype)
                np.put_along_axis(far, order, (gap * gap).sum(2), 1)
                errors = [min(int(e), MOST) for e in far.sum(0).tolist()]
                codes = own.astype(np.uint8).T
                cols = [batch["ids"][k].values, batch["labels"][k].values, pa.array([c.tobytes().hex() for c in codes]), pa.array(errors, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "code", "error"])

    return run


def vector_codes(rows: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) per usable row of ``rows``(vec_id, embedding, label).

    Null vectors and vectors with null or non-finite components are dropped. Shorter vectors and lengths that 16 does not divide are filled up
    with zeros. Rows without vec_id are coded but start a codebook only if fewer than 64 ids exist; repeated ids start
    one entry. Rows are coded as often as they occur, null labels are one label. Numbers too large for a long stay exact; an error
    beyond a long is given as the largest long. Other columns are ignored; no usable row gives no rows.
    """
    spark = rows.sparkSession
    # Blocks are rows of a megabyte; batches of them stay small.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)
    id_kind = rows.schema["vec_id"].dataType.simpleString()
    kept = rows.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector")).where(usable("vector"))
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], f"vec_id {id_kind}, code string, error long, label_error long, codebooks_sha256 string")
    width = max(1, -(-longest // PARTS)) * PARTS
    books = start(kept, width)
    found = blocks(kept, width)
    for _ in range(ROUNDS):
        books = refined(found, books, width)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = staged(found.mapInArrow(_coded(books, width), f"vec_id {id_kind}, label string, code string, error long"))
    # A sum beyond a long is the largest long, too.
    by_label = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(28,0)")), F.lit(MOST).cast("decimal(28,0)")).cast("long").alias("label_error"))
    by_label = by_label.withColumnRenamed("label", "of")
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["of"])).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
