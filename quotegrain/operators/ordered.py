"""Ordered per-key operators (previous row, running max, last value, rank) that survive a hot key.

A plain window puts all rows of a key in one task. A key with more than ``rows_per_task`` rows is cut into consecutive slices of about
that many rows instead: splitters are places of the row order, taken from a small sample of the key's rows, and a row's slice is the
number of splitters up to it. Each slice is windowed alone, a one-row summary per slice is carried on (a prefix over slices), and
the carry is joined back. Splitters are whole order tuples, so distinct rows are always told apart, however bunched a single column is.

The sample is drawn once, while the plan is made, by a hash of the row; no key reaching the size means the plain window with nothing
added. Rows are shuffled once either way. Sampling decides where slices begin, never a result. A caller that has its rows staged may ask
``split_limit`` whether any key needs slices; ``rows_per_task=None`` plans the plain window without asking.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrain.session import cut_lineage

ROWS_PER_TASK = 2_000_000
#: Sampled rows that stand for one slice.
SAMPLES = 64
#: Splitters that are sent to every task; more are joined by a shuffle.
BROADCAST_CUTS = 100_000


def split_limit(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> int | None:
    """``rows_per_task`` when some key holds more rows than that, else None. Runs one count, so it is for staged rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return None if sizes.where(F.col("_n") > rows_per_task).isEmpty() else rows_per_task


def splitters(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int) -> DataFrame:
    """(_key, _cuts): for keys of more than about ``rows_per_task`` rows, the places in the row order where slices begin."""
    one_in = max(1, rows_per_task // SAMPLES)
    sample = df.where(F.pmod(F.xxhash64(*keys, *order), F.lit(one_in)) == 0).select(F.struct(*keys).alias("_key"), F.struct(*order).alias("_at"))
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_at"))
    cuts = sample.withColumn("_place", place).where(F.col("_place") % max(1, rows_per_task // one_in) == 0)
    return cuts.groupBy("_key").agg(F.sort_array(F.collect_set("_at")).alias("_cuts"))


def with_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int | None = ROWS_PER_TASK) -> tuple[DataFrame, bool] | None:
    """``df`` with ``_slice`` (0 for keys that are whole) and ``_hot``, and whether carries are small; None when no key needs slices."""
    if rows_per_task is None:
        return None
    cuts = splitters(df, keys, order, rows_per_task)
    if cuts.isEmpty():
        return None
    cuts = cut_lineage(cuts)
    small = cuts.agg(F.sum(F.size("_cuts"))).first()[0] <= BROADCAST_CUTS
    met = df.withColumn("_own", F.struct(*keys)).join(F.broadcast(cuts) if small else cuts, F.col("_own") == F.col("_key"), "left")
    up_to = F.size(F.filter("_cuts", lambda cut: cut <= F.struct(*order)))
    return met.select(
        *df.columns, F.when(F.col("_cuts").isNotNull(), up_to.cast("long")).otherwise(F.lit(0).cast("long")).alias("_slice"), F.col("_cuts").isNotNull().alias("_hot")
    ), small


def _carry_back(sliced: DataFrame, keys: Sequence[str], carry: DataFrame, small: bool) -> DataFrame:
    """Left-join per-slice carries (rows only for hot keys) onto the sliced rows."""
    right = carry.select(F.struct(*keys, "_slice").alias("_place"), "_carry")
    met = sliced.join(F.broadcast(right) if small else right, F.struct(*keys, "_slice") == F.col("_place"), "left")
    return met.select(*sliced.columns, "_carry")


def _before() -> tuple[int, int]:
    return Window.unboundedPreceding, -1


def _drop_helpers(df: DataFrame, *more: str) -> DataFrame:
    return df.drop("_slice", "_hot", *more)


def neighbours(df: DataFrame, keys, order, values, prev="prev", following=None, rows_per_task=ROWS_PER_TASK, next_values=None) -> DataFrame:
    """Add structs of ``values`` from the previous and next row of the key (null at the ends).

    Both sides use one partitioning and one sort; leave a name None to skip that side. ``next_values``: what is taken of the next row, if not the same.
    """
    payload, ahead = F.struct(*values), F.struct(*(next_values or values))

    def local(window) -> dict[str, Column]:
        return ({prev: F.lag(payload).over(window)} if prev else {}) | ({following: F.lead(ahead).over(window)} if following else {})

    found = with_slices(df, keys, order, rows_per_task)
    if found is None:
        return df.withColumns(local(Window.partitionBy(*keys).orderBy(*order)))
    sliced, small = found
    across = Window.partitionBy(*keys).orderBy("_slice")
    sides = [(prev, F.max_by, F.lag, payload)] * bool(prev) + [(following, F.min_by, F.lead, ahead)] * bool(following)
    edges = sliced.where("_hot").groupBy(*keys, "_slice").agg(*[pick(taken, F.struct(*order)).alias(f"_edge_{name}") for name, pick, _, taken in sides])
    carry = edges.withColumn("_carry", F.struct(*[step(f"_edge_{name}").over(across).alias(name) for name, _, step, _ in sides]))
    rows = sliced.withColumns(local(Window.partitionBy(*keys, "_slice").orderBy(*order)))
    joined = _carry_back(rows, keys, carry, small)
    return _drop_helpers(joined.withColumns({name: F.coalesce(F.col(name), F.col(f"_carry.{name}")) for name, *_ in sides}), "_carry")


def previous(df: DataFrame, keys, order, values, out="prev", rows_per_task=ROWS_PER_TASK):
    """Add ``out``: struct of ``values`` from the previous row of the key, null on the first row."""
    return neighbours(df, keys, order, values, out, None, rows_per_task)


def running_max(df: DataFrame, keys, order, value: Column, out, rows_per_task=ROWS_PER_TASK):
    """Add ``out``: largest ``value`` among all earlier rows of the key (null if none)."""
    df = df.withColumn("_v", value)
    found = with_slices(df, keys, order, rows_per_task)
    if found is None:
        return df.withColumn(out, F.max("_v").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_before()))).drop("_v")
    sliced, small = found
    tops = sliced.where("_hot").groupBy(*keys, "_slice").agg(F.max("_v").alias("_top"))
    carry = tops.withColumn("_carry", F.max("_top").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(*_before())))
    window = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(*_before())
    joined = _carry_back(sliced.withColumn(out, F.max("_v").over(window)), keys, carry, small)
    return _drop_helpers(joined.withColumn(out, F.greatest(F.col(out), F.col("_carry"))), "_carry", "_v")


def last_value(df: DataFrame, keys, order, value: Column, out, rows_per_task=ROWS_PER_TASK, forward=False):
    """Add ``out``: nearest non-null ``value`` strictly before the row (after it if ``forward``)."""
    df = df.withColumn("_v", value)
    sort = [F.col(c).desc() if forward else F.col(c).asc() for c in order]
    local = lambda *by: F.last("_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*sort).rowsBetween(*_before()))
    found = with_slices(df, keys, order, rows_per_task)
    if found is None:
        return df.withColumn(out, local(*keys)).drop("_v")
    sliced, small = found
    pick = F.min_by if forward else F.max_by
    # Rows without a value have no order, so the pick passes over them.
    edges = sliced.where("_hot").groupBy(*keys, "_slice").agg(pick("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_edge"))
    along = F.col("_slice").desc() if forward else F.col("_slice").asc()
    carry = edges.withColumn("_carry", F.last("_edge", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(along).rowsBetween(*_before())))
    joined = _carry_back(sliced.withColumn(out, local(*keys, "_slice")), keys, carry, small)
    return _drop_helpers(joined.withColumn(out, F.coalesce(F.col(out), F.col("_carry"))), "_carry", "_v")


def rank_rows(df: DataFrame, keys, order, out="rank", rows_per_task=ROWS_PER_TASK):
    """Add ``out``: 1-based row number within the key."""
    local = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    found = with_slices(df, keys, order, rows_per_task)
    if found is None:
        return df.withColumn(out, local(*keys))
    sliced, small = found
    sizes = sliced.where("_hot").groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    carry = sizes.withColumn("_carry", F.sum("_size").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(*_before())))
    joined = _carry_back(sliced.withColumn(out, local(*keys, "_slice")), keys, carry, small)
    return _drop_helpers(joined.withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0))), "_carry")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None):
    """Last row per key by ``order``. An aggregate, so it pre-combines before the shuffle."""
    return _edge_row(df, keys, order, columns, F.max_by)


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None):
    """First row per key by ``order``."""
    return _edge_row(df, keys, order, columns, F.min_by)


def _edge_row(df, keys, order, columns, pick):
    rest = [c for c in (columns or df.columns) if c not in keys]
    # An empty key list means one row over the whole frame.
    grouped = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return grouped.where(F.col("_row").isNotNull()).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
