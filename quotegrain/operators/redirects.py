"""Resolve chains of redirects for a whole table by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrain.session import cut_lineage

MAX_DEPTH = 20


def resolve(df: DataFrame, key: str, target: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(key, resolved_id, depth): the row at the end of each chain.

    ``resolved_id`` is null when the chain loops, points at a missing row or is longer than ``max_depth``.
    Each round doubles the distance covered, so five joins cover twenty steps. A round's state is
    checkpointed: the next one joins it to itself, and without a cut the plan would double.
    """
    state = df.select(
        F.col(key),
        F.coalesce(target, key).alias("at"),
        F.col(target).isNull().alias("done"),
        F.when(F.col(target).isNull(), 0).otherwise(1).cast("long").alias("depth"),
    )
    covered = 1
    while covered <= max_depth:
        state = cut_lineage(state)
        if state.where("NOT done").limit(1).count() == 0:
            break
        hop = state.select(
            F.col(key).alias("_from"),
            F.col("at").alias("_to"),
            F.col("done").alias("_done"),
            F.col("depth").alias("_more"),
        )
        # A finished row stays where it is; an unfinished one jumps to where its target points.
        settled = state.where("done")
        moved = (
            state.where("NOT done")
            .join(hop, F.col("at") == F.col("_from"), "left")
            .select(
                key,
                F.coalesce("_to", "at").alias("at"),
                F.coalesce("_done", F.lit(False)).alias("done"),
                (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"),
            )
        )
        state = settled.unionByName(moved)
        covered *= 2
    good = F.col("done") & (F.col("depth") <= max_depth)
    return state.select(key, F.when(good, F.col("at")).alias("resolved_id"), F.when(good, F.col("depth")).alias("depth"))


def reachable(edges: DataFrame, key: str, target: str, roots: DataFrame, backward: bool = False) -> DataFrame:
    """Keys on the path of some root; with ``backward``, keys whose own path meets a root.

    ``edges`` give every key at most one target. Each round adds what is one jump away and then doubles
    the jump, so a chain of n steps takes log2(n) rounds, and a loop ends like any other path: when a round
    adds nothing. State is checkpointed between rounds.
    """
    jump = edges.select(F.col(key).alias("_from"), F.col(target).alias("_to"))
    seen = roots.select(key).distinct()
    start, end = ("_to", "_from") if backward else ("_from", "_to")
    while True:
        jump, seen = cut_lineage(jump), cut_lineage(seen)
        step = seen.join(jump, F.col(key) == F.col(start)).select(F.col(end).alias(key)).distinct()
        new = cut_lineage(step.join(seen, key, "left_anti"))
        if new.limit(1).count() == 0:
            return seen
        seen = seen.unionByName(new)
        further = jump.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        jump = jump.join(further, "_to").select("_from", F.col("_next").alias("_to"))
