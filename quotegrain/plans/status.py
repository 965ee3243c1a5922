"""Status reports: runs, listings, offers and frontier per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotegrain.operators.ordered import latest
from quotegrain.plans import offers as offer_plan


def latest_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Newest run per key by start time, then id. An aggregate, so a busy source cannot fill one task."""
    return latest(runs, keys, ["started_at", "run_id"])


def last_success(runs: DataFrame) -> DataFrame:
    finished = F.when(F.col("status") == "succeeded", F.col("finished_at"))
    return runs.groupBy("source_id").agg(F.max(finished).alias("last_successful_run_at"))


def listing_counts(listings: DataFrame) -> DataFrame:
    return listings.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("listings"),
        F.count_if(F.col("match_status") == "verified").alias("verified_listings"),
        F.count_if(F.col("match_status") == "needs_review").alias("review_listings"),
        F.count_if(F.col("match_status") == "unmatched").alias("unmatched_listings"),
    )


def offer_counts(rows: DataFrame, rules) -> DataFrame:
    """Fresh counts only eligible offers, stale counts every old one; they need not add up."""
    return rows.groupBy("source_id").agg(
        F.count_if(offer_plan.eligible(rules)).alias("fresh_eligible_offers"),
        F.count_if(offer_plan.stale(rules)).alias("stale_offers"),
    )


def source_status(sources, runs, listings, rows, rules) -> DataFrame:
    """One row per source, also for sources with no runs, listings or offers."""
    run = latest_runs(runs, ["source_id"]).select(
        "source_id",
        F.col("status").alias("latest_run_status"),
        F.col("started_at").alias("latest_run_started_at"),
    )
    joined = (
        sources.join(run, "source_id", "left")
        .join(last_success(runs), "source_id", "left")
        .join(listing_counts(listings), "source_id", "left")
        .join(offer_counts(rows, rules), "source_id", "left")
    )
    counts = [
        "listings", "verified_listings", "review_listings", "unmatched_listings",
        "fresh_eligible_offers", "stale_offers",
    ]
    return joined.select(
        F.col("slug").alias("source"), "enabled", "latest_run_status", "latest_run_started_at",
        "last_successful_run_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
    )


def frontier_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("source_id", "page_type", "last_result").agg(F.count(F.lit(1)).alias("pages"))


def outcome_counts(results: DataFrame, statuses: list[str]) -> DataFrame:
    return results.groupBy("source_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses], F.count(F.lit(1)).alias("total")
    )


def listings_per_source(sources: DataFrame, listings: DataFrame) -> DataFrame:
    counted = listings.groupBy("source_id").agg(F.count("listing_id").alias("listings"))
    return sources.join(counted, "source_id", "left").select(
        F.col("slug").alias("source"), F.coalesce("listings", F.lit(0)).alias("listings")
    )


def latency_report(samples: DataFrame, limit_ms: float, keys: list[str]) -> DataFrame:
    """Nearest-rank percentiles, errors and the pass flag per group.

    The percentile is taken from counts per distinct value: a group with a third of all samples
    is pre-counted on the map side, and the ranks come from running counts over distinct values
    inside the window of a group.
    """
    counted = samples.groupBy(*keys, "ms").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("valid")).alias("_bad")
    )
    return rank_percentiles(counted, keys).select(
        *keys,
        "requests",
        "p50_ms",
        "p95_ms",
        "max_ms",
        "errors",
        ((F.col("p95_ms") <= limit_ms) & (F.col("errors") == 0)).alias("threshold_met"),
    )


def rank_percentiles(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Percentiles from (key, ms, _n, _bad) without sorting a group in one task.

    Two exact passes over pre-counted values: totals per whole-number bucket first, then only the one
    bucket that holds each rank is looked into.
    """
    bucket = F.floor(F.col("ms")).alias("_b")
    per_bucket = counted.groupBy(*keys, bucket).agg(
        F.sum("_n").alias("_bn"), F.sum("_bad").alias("_bbad"), F.max("ms").alias("_bmax")
    )
    # Buckets per group are bounded by the whole-number range of the measure (a request times out).
    by_key = Window.partitionBy(*keys)
    running = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = per_bucket.withColumns(
        {
            "_upto": F.sum("_bn").over(running),
            "requests": F.sum("_bn").over(by_key),
            "errors": F.sum("_bbad").over(by_key),
            "max_ms": F.max("_bmax").over(by_key),
        }
    )
    ranks = F.explode(F.array(F.struct(F.lit("p50_ms").alias("p"), F.ceil(F.col("requests") * F.lit(0.5)).alias("r")),
                              F.struct(F.lit("p95_ms").alias("p"), F.ceil(F.col("requests") * F.lit(0.95)).alias("r"))))
    holding = (
        placed.select("*", ranks.alias("_want"))
        .where((F.col("_want.r") <= F.col("_upto")) & (F.col("_want.r") > F.col("_upto") - F.col("_bn")))
        .select(
            *keys, "_b", "requests", "errors", "max_ms",
            F.col("_want.p").alias("_p"),
            (F.col("_want.r") - (F.col("_upto") - F.col("_bn"))).alias("_inside"),
        )
    )
    inside = counted.withColumn("_b", F.floor("ms")).join(holding, [*keys, "_b"])
    in_bucket = (
        Window.partitionBy(*keys, "_p").orderBy("ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hit = inside.withColumn("_run", F.sum("_n").over(in_bucket)).where(F.col("_run") >= F.col("_inside"))
    return hit.groupBy(*keys).agg(
        F.max("requests").alias("requests"),
        F.max("errors").alias("errors"),
        F.max("max_ms").alias("max_ms"),
        F.min(F.when(F.col("_p") == "p50_ms", F.col("ms"))).alias("p50_ms"),
        F.min(F.when(F.col("_p") == "p95_ms", F.col("ms"))).alias("p95_ms"),
    )
