"""Price history: changes, timelines, late rows and state at any time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrain.operators import ordered

STATE = ["price_cents", "availability", "active"]


def changed(prev: str = "prev", state: list[str] = STATE) -> Column:
    """True on a first sighting and whenever any state column differs, nulls compared as values."""
    differs = F.lit(False)
    for name in state:
        differs = differs | ~F.col(name).eqNullSafe(F.col(f"{prev}.{name}"))
    return F.col(prev).isNull() | differs


def price_changes(obs, keys, order, state=STATE, rows_per_task=ordered.ROWS_PER_TASK):
    """Rows that open a new state of their offer."""
    return ordered.previous(obs, keys, order, state, rows_per_task=rows_per_task).where(
        changed(state=state)
    )


def late_rows(obs, keys, arrival, time="observed_at", rows_per_task=ordered.ROWS_PER_TASK):
    """Add ``late``: an earlier arrival of the key already carried a newer time. Equal times pass."""
    seen = ordered.running_max(obs, keys, arrival, F.col(time), "newest_before", rows_per_task)
    return seen.withColumn("late", F.coalesce(F.col("newest_before") > F.col(time), F.lit(False)))


def timeline(obs, keys, order, rows_per_task=ordered.ROWS_PER_TASK):
    """Each observation with the previous price, the change and the time the next one takes over."""
    rows = ordered.neighbours(
        obs, keys, order, ["price_cents", "observed_at"], "prev", "next", rows_per_task
    )
    return rows.withColumns(
        {
            "previous_cents": F.col("prev.price_cents"),
            "delta_cents": F.col("price_cents") - F.col("prev.price_cents"),
            "valid_to": F.col("next.observed_at"),
        }
    ).drop("prev", "next")


def state_as_of(obs, keys, order, as_of: Column, columns):
    """Replay to any time: the last row per key not after ``as_of``."""
    return ordered.latest(obs.where(F.col("observed_at") <= as_of), keys, order, columns)


def conflicting_states(obs: DataFrame, offer_key: list[str], run: str, state=STATE) -> DataFrame:
    """(offer, run) pairs seen in more than one state. Repeats of a state collapse map-side first."""
    states = obs.select(*offer_key, run, *state).distinct()
    return states.groupBy(*offer_key, run).agg(F.count(F.lit(1)).alias("states")).where("states > 1")


def upsert_state(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Merge the newest batch rows into the current state; new rows win whole, nulls included."""
    fresh = new.select(*keys, F.struct(*values).alias("_new"))
    return old.select(*keys, F.struct(*values).alias("_old")).join(fresh, keys, "full").select(
        *keys, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{v}")).otherwise(F.col(f"_old.{v}")).alias(v) for v in values]
    )


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored yet; the caller appends them."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def history_audit(before, after, history, keys, planned, checked: str, state=STATE) -> DataFrame:
    """Offers of one run whose history does not match their state, or whose check time stood still: (keys, problem, history_rows).

    A changed or new offer has exactly one history row of the run, an unchanged one none. ``planned`` are the offers that the run had
    to check; each must carry a later ``checked`` than before.
    """
    counts = history.groupBy(*keys).agg(F.count(F.lit(1)).alias("history_rows"))
    old = before.select(*keys, F.struct(*state).alias("_old"), F.col(checked).alias("_was"))
    new = after.select(*keys, F.struct(*state).alias("_new"), F.col(checked).alias("_is"))
    due = planned.select(*keys, F.lit(True).alias("_due")).distinct()
    joined = old.join(new, keys, "full").join(counts, keys, "left").join(due, keys, "left")
    differs, rows = ~F.col("_old").eqNullSafe(F.col("_new")), F.coalesce("history_rows", F.lit(0))
    later = F.col("_was").isNull() | (F.col("_is") > F.col("_was"))
    problem = (
        F.when(differs & (rows == 0), "missing_history")
        .when(differs & (rows > 1), "repeated_history")
        .when(~differs & (rows > 0), "needless_history")
        .when(F.col("_due") & ~F.coalesce(later, F.lit(False)), "check_time_not_refreshed")
    )
    return joined.select(*keys, problem.alias("problem"), rows.alias("history_rows")).where("problem IS NOT NULL")
