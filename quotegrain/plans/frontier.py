"""Crawl frontier: links, next pages, cohort and attempt decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrain.operators import ordered

UNFINISHED_RUNS = ["partial", "interrupted", "running", "failed"]


def due(as_of: Column, cutoff: Column | None = None) -> Column:
    """Never fetched with success (a known missing page counts as done), or due again by ``cutoff``."""
    unfinished = F.col("last_success_at").isNull() & ~F.col("last_result").eqNullSafe(F.lit("not_found"))
    again = F.col("next_crawl_at") <= cutoff if cutoff is not None else F.lit(False)
    return (F.col("page_type") != "ignored") & F.coalesce(unfinished | again, F.lit(False))


def ready(as_of: Column, cutoff: Column | None = None) -> Column:
    return due(as_of, cutoff) & F.coalesce(F.col("next_crawl_at") <= as_of, F.lit(False))


def next_batch(pages: DataFrame, seeds: list[str], as_of: Column, size: int, cutoff: Column | None = None):
    """Next ``size`` pages per source: seeds, other pages, products; then first seen, then id.

    The rank limit also runs before the shuffle, so a source with a third of all pages sends only
    ``size`` rows per task.
    """
    rank = F.when(F.col("url").isin(seeds), 0).when(F.col("page_type") == "product", 3).otherwise(1)
    order = Window.partitionBy("source_id").orderBy("priority", "first_seen_at", "page_id")
    return (
        pages.where(ready(as_of, cutoff))
        .withColumn("priority", rank)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= size)
    )


def remaining(pages: DataFrame, as_of: Column, cutoff: Column | None = None) -> DataFrame:
    return pages.groupBy("source_id").agg(F.count_if(due(as_of, cutoff)).alias("remaining"))


def next_due(page_type: Column, success: Column, now: Column) -> Column:
    """When to fetch again: a product after a day, other pages after a week, a failure after an hour."""
    return (
        F.when(success & (page_type == "product"), now + F.expr("INTERVAL 1 DAY"))
        .when(success, now + F.expr("INTERVAL 7 DAY"))
        .otherwise(now + F.expr("INTERVAL 1 HOUR"))
    )


def merge(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Upsert links. A known page keeps where it came from; its last sighting moves forward only.

    ``found`` may name a URL many times; duplicates collapse before the shuffle. The smallest parent stands
    for the first, since a set of links has no order.
    """
    once = found.groupBy("source_id", "url").agg(
        F.min("discovered_from").alias("_from"), F.max("seen_at").alias("_seen"), F.min("reason").alias("_reason")
    )
    joined = existing.join(once, ["source_id", "url"], "full")
    known = F.col("first_seen_at").isNotNull()
    return joined.select(
        "source_id",
        "url",
        F.when(known, F.col("discovered_from")).otherwise(F.col("_from")).alias("discovered_from"),
        F.when(known, F.col("page_type"))
        .otherwise(F.when(F.col("_reason").isNull(), "unknown").otherwise("ignored"))
        .alias("page_type"),
        F.coalesce("first_seen_at", "_seen").alias("first_seen_at"),
        F.greatest("last_seen_at", "_seen").alias("last_seen_at"),
    )


def representative_url(pages: DataFrame, key: str) -> DataFrame:
    """Shortest URL per key, then the first in text order."""
    return pages.groupBy(key).agg(
        F.min_by(F.struct("page_id", "url"), F.struct(F.length("url"), F.col("url"), F.col("page_id"))).alias("r")
    ).select(key, "r.*")


def cohort(seeds: DataFrame, pages: DataFrame, offers: DataFrame) -> DataFrame:
    """Seed URLs to pages and listings with their sorted active quantities as the plan.

    Quantities form a set per listing; a listing sells a short list of sizes.
    """
    tiers = offers.where("active").groupBy("listing_id").agg(
        F.array_sort(F.collect_set("quantity")).alias("planned_quantities")
    )
    return (
        seeds.join(pages, ["source_id", "url"])
        .join(tiers, "listing_id", "left")
        .withColumn("planned_quantities", F.coalesce("planned_quantities", F.array().cast("array<int>")))
    )


def attempt_state(attempts: DataFrame, latest: DataFrame, cohort_size: int, most: int) -> DataFrame:
    """Per source, whether another attempt may start in the window."""
    tried = attempts.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.max("manifest_index").alias("furthest")
    )
    return latest.join(tried, "source_id", "left").select(
        "source_id",
        F.when(F.col("paused"), "paused")
        .when(F.coalesce("furthest", F.lit(0)) >= cohort_size, "already_attempted_full_cohort")
        .when(F.coalesce("attempts", F.lit(0)) >= most, "process_restart_limit_reached")
        .otherwise("may_start")
        .alias("state"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
    )


def discovery_due(sources, runs, left: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Weekly discovery per source: resume, refresh, start, or not due.

    ``runs``: discovery runs. ``left``: remaining page counts.
    """
    newest = ordered.latest(runs, ["source_id"], ["started_at", "run_id"], ["status", "had_cutoff"])
    done = runs.where("status = 'succeeded'").groupBy("source_id").agg(F.max("finished_at").alias("done_at"))
    joined = (
        sources.join(newest, "source_id", "left").join(done, "source_id", "left").join(left, "source_id", "left")
    )
    resume = F.coalesce(F.col("status").isin(UNFINISHED_RUNS), F.lit(False))
    open_pages = F.coalesce("remaining", F.lit(0))
    recent = F.coalesce(F.col("done_at") > as_of - F.expr(f"INTERVAL {days} DAY"), F.lit(False))
    return joined.select(
        "source_id",
        F.when(~resume & (open_pages == 0) & recent, "weekly_discovery_not_due")
        .when(F.when(resume, F.coalesce("had_cutoff", F.lit(False))).otherwise(open_pages == 0), "refresh_due")
        .otherwise("initial")
        .alias("decision"),
    )


def manifest_problems(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """Manifest rows that differ from the stored page or are not verified."""
    stored = pages.select(
        "source_id", "page_id", F.col("url").alias("_url"), F.col("product_key").alias("_key"), "match_status"
    )
    joined = manifest.join(stored, ["source_id", "page_id"], "left")
    reason = (
        F.when(F.col("_url").isNull(), "unknown_page")
        .when(F.col("_url") != F.col("url"), "url_changed")
        .when(~F.col("_key").eqNullSafe(F.col("product_key")), "product_changed")
        .when(~F.coalesce(F.col("match_status") == "verified", F.lit(False)), "not_verified")
    )
    return joined.withColumn("reason", reason).where("reason IS NOT NULL")
