"""Mixing sources to target weights with a time-varying curriculum.

A source's weight follows a schedule over training time t in [0, 1]. Its integral G(t) is the share of the source's target that
is asked for by t. Documents of a source are laid end to end in a fixed shuffled order and read round and round until
the target is met; a reading that begins at word x of that stream is due at the time t with target * G(t) = x.
All readings sorted by that time are the training order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrain.llm.common import each_batch, partitions, raw, staged

#: Weights by rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix for each word of the input, and the most often that a source is read.
SHARE, MOST = 1.5, 2.0
#: Start and end of each weight's schedule, by rank of the source, repeating: heavy sources early, light ones late.
SCHEDULE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


#: Columns that the training order adds; columns of these names that the documents have are replaced.
ADDED = ("mix_epoch", "mix_words", "mix_position")
WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame, alike: list[str]) -> DataFrame:
    """(doc_id, source, size, row_hash): words of every row, a null text has none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = pa.array([len(t.split()) for t in raw(batch["text"])], pa.int64())
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], n, batch["row_hash"]], names=["doc_id", "source", "size", "row_hash"])

    return keyed(docs, alike).drop("row").mapInArrow(each_batch(run), "doc_id long, source string, size long, row_hash long")


def keyed(docs: DataFrame, alike: list[str]) -> DataFrame:
    """(doc_id, source, text, row_hash, row): what the operator reads, a hash of the columns ``alike``, and the whole row."""
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    cast = [docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text")]
    return docs.select(*cast, F.xxhash64(*(docs[c] for c in alike)).alias("row_hash"), row)


def fill(totals: list[float], weights: list[float], share: float, most: float) -> list[float]:
    """Targets in proportion to ``weights`` that add up to ``share`` of all sizes, none above ``most`` times its size.

    What a stopped source cannot take is shared again by weight among the others until none is above.
    """
    rest = share * sum(totals)
    out, open_ = [0.0] * len(totals), [k for k, n in enumerate(totals) if n > 0]
    while open_:
        unit = rest / sum(weights[k] for k in open_)
        over = [k for k in open_ if weights[k] * unit > most * totals[k]]
        for k in over or open_:
            out[k] = most * totals[k] if over else weights[k] * unit
        if not over:
            break
        rest -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return out


def targets(totals: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, early, late): one row per source. The table of sources is small; it goes through the driver."""
    rows = sorted(((r["source"], r["source_size"]) for r in totals.collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    wanted = fill([float(n) for _, n in rows], [WEIGHTS[k % len(WEIGHTS)] for k in range(len(rows))], share, most)
    filled = [(s, n, round(t, 6), *SCHEDULE[k % len(SCHEDULE)]) for k, ((s, n), t) in enumerate(zip(rows, wanted, strict=True))]
    return totals.sparkSession.createDataFrame(filled, "source string, source_size long, target double, early double, late double")


def due(share: Column) -> Column:
    """Time by which a linear schedule from ``early`` to ``late`` has asked for ``share`` of the target.

    Scaled to mean one the schedule is a + (b - a) t with a + b = 2; its integral a t + (b - a) t^2 / 2 is inverted here.
    """
    a = 2 * F.col("early") / (F.col("early") + F.col("late"))
    bend = 1 - a
    root = F.sqrt(F.greatest(a * a + 4 * bend * share, F.lit(0.0)))
    return F.least(F.greatest(2 * share / (a + root), F.lit(0.0)), F.lit(1.0))


def laid_out(docs: DataFrame, alike: list[str]) -> DataFrame:
    """(doc_id, source, size, row_hash, start): first word of each document in its source's stream.

    The stream is ordered by a hash of the id, of the row where there is none. The hash range is cut into slices; slice sums give each slice
    its offset, so no task holds more than a slice of a source, however hot.
    """
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row_hash").cast("string"))))
    rows = staged(sizes(docs, alike).withColumn("place", place))
    slices = 4 * partitions(docs.sparkSession)
    cut = rows.withColumn("slice", (F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * slices / F.lit(2**32)).cast("long"))
    sums = cut.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "slice").orderBy("place", "doc_id", "size", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    o = offsets.select(F.col("source").alias("s"), F.col("slice").alias("p"), "offset")
    return placed.join(o, placed["source"].eqNullSafe(o["s"]) & (placed["slice"] == o["p"])).select(
        "doc_id", "source", "size", "row_hash", (F.col("offset") + F.col("ahead")).alias("start"))


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, alike: tuple[str, ...] = ("doc_id", "source", "text")) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position) per row of ``docs``(doc_id, source, text).

    ``taken`` counts the words of the readings that the schedule makes due by its end; the last reading of a source stops at its target, so
    each source meets its target to the word. ``position`` is the time of the first reading, null if none. Rows without
    source are one source, last in order. Empty or null texts have size 0 and are never taken. Rows that agree in id, source
    and size are interchangeable. Reruns agree: the order depends on ids, and on the columns ``alike`` of rows without id. Other columns are ignored.
    """
    laid = staged(laid_out(docs, list(alike)))
    goal = targets(laid.groupBy("source").agg(F.sum("size").alias("source_size")), share, most)
    g = goal.withColumnRenamed("source", "s")
    rows = laid.join(F.broadcast(g) if goal.count() <= 10_000 else g, laid["source"].eqNullSafe(g["s"])).drop("s")
    epochs = F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))
    asked = F.filter(F.transform(epochs, reading), lambda r: (r["words"] > 0) & (r["position"] <= 1))
    rows = rows.withColumn("_asked", asked)
    taken = F.aggregate("_asked", F.lit(0).cast("long"), lambda n, r: n + r["words"])
    return rows.withColumns({"taken": taken, "position": F.when(F.size("_asked") > 0, F.col("_asked")[0]["position"])}).drop("_asked")


def reading(epoch: Column) -> Column:
    """(epoch, words, position) of one reading of a document: the words that the target leaves for it, and the time it is due."""
    begin = epoch * F.col("source_size") + F.col("start")
    words = F.least(F.greatest(F.floor(F.col("target")) - begin, F.lit(0)), F.col("size"))
    return F.struct(epoch.alias("epoch"), words.cast("long").alias("words"), due(begin / F.col("target")).alias("position"))


def readings(mixed: DataFrame, most: float = MOST) -> DataFrame:
    """(doc_id, epoch, words, position, ...): one row per reading of a document."""
    epochs = F.explode(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1)))
    rows = mixed.withColumn("epoch", epochs)
    due_then = reading(F.col("epoch"))
    return rows.withColumns({"words": due_then["words"], "position": due_then["position"]}).where("words > 0")


def ordered(mixed: DataFrame, most: float = MOST) -> DataFrame:
    """The training order as a staged table: (source, start, doc_id, epoch, words, position) of every reading, range-sorted by position."""
    rows = readings(mixed, most).select("source", "start", "doc_id", "epoch", "words", "position")
    return staged(rows.orderBy("position", "source", "doc_id", "epoch"))


def read_in_order(docs: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows of ``mix`` with ``taken`` counted from the training order, in the order in which they are first read; rows that are never read come last."""
    rows = mix(docs, share, most)
    read = ordered(rows, most).groupBy(F.col("source").alias("s"), F.col("start").alias("at")).agg(F.sum("words").alias("read"))
    # Rows of some size have a start of their own within the source; empty ones share it and are never read.
    met = rows.drop("taken").join(read, rows["source"].eqNullSafe(read["s"]) & (rows["start"] == read["at"]) & (rows["size"] > 0), "left")
    counted = met.withColumn("taken", F.coalesce("read", F.lit(0).cast("long"))).drop("s", "at", "read")
    return counted.orderBy(F.col("position").asc_nulls_last(), "source", "doc_id")


def training_order(docs: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows of ``docs`` as the mix reads them, range-sorted by position: all columns, then mix_epoch, mix_words, mix_position.

    The reading that meets a source's target is cut to its first words, joined by blanks. Rows alike in every column are read as often as the mix reads
    each of them. Columns of ``docs`` named like the added ones are replaced.
    """
    columns = [c for c in docs.columns if c not in ADDED]
    docs = docs.select(*columns)
    # One key for id and row: null ids meet, and merging alike rows and the join share one shuffle.
    key = lambda i, h: F.struct(F.col(i).alias("i"), F.col(h).alias("h")).alias("key")
    plan = readings(mix(docs, share, most, tuple(columns)), most).select(
        key("doc_id", "row_hash"), F.col("size").alias("mix_size"), F.col("epoch").alias("mix_epoch"), F.col("words").alias("mix_words"), F.col("position").alias("mix_position"))
    own = keyed(docs, columns).select("row", key("doc_id", "row_hash")).dropDuplicates(["key"])
    rows = own.join(plan, "key")
    words = F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(WORD), 0)
    cut = F.array_join(F.slice(words, 1, F.col("mix_words").cast("int")), " ")
    text = F.when(F.col("mix_words") < F.col("mix_size"), cut).otherwise(F.col("row.text")).alias("text")
    mixed = [text if c == "text" else F.col("row").getField(c).alias(c) for c in columns]
    return rows.select(*mixed, *ADDED).orderBy("mix_position", "source", "doc_id", "mix_epoch")
