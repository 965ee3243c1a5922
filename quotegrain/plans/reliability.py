"""Collection reliability: manifest, item results, daily windows, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrain.functions import money

DAY = 86_400
ACCEPT_SECONDS = 7_200
PASS_RATE = 0.95


def item_result(planned: Column, offers: Column) -> Column:
    """Struct of one item's outcome from its offers.

    A quantity counts when some active offer is out of stock, or priced and either in stock or a documented
    estimate. Both arrays are one listing's tiers. Order follows the plan.
    """
    estimate = lambda o: (
        (o["availability"] == "unknown")
        & F.coalesce(o["quote_kind"] == "estimate", F.lit(False))
        & F.coalesce(o["availability_basis"] == "not_provided_by_api", F.lit(False))
    )
    usable = lambda o: o["active"] & (
        (o["availability"] == "out_of_stock")
        | (o["price_cents"].isNotNull() & ((o["availability"] == "in_stock") | estimate(o)))
    )
    quantities = lambda test: F.transform(F.filter(offers, test), lambda o: o["quantity"])
    wanted = F.coalesce(planned, F.transform(offers, lambda o: o["quantity"]))
    checked = in_plan_order(wanted, quantities(usable))
    priced = in_plan_order(wanted, quantities(lambda o: o["active"] & o["price_cents"].isNotNull()))
    whole = F.size(checked) == F.size(wanted)
    reason = F.when(
        ~whole,
        F.when(F.size(priced) == F.size(wanted), "availability_unconfirmed").otherwise(
            "planned_quantities_missing_or_unknown"
        ),
    )
    return F.struct(
        whole.alias("successful"), checked.alias("successful_quantities"),
        priced.alias("validated_quantities"), reason.alias("reason"),
    )


def in_plan_order(planned: Column, seen: Column) -> Column:
    return F.filter(planned, lambda q: F.array_contains(seen, q))


def collection_metrics(items: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics with the plan as the fixed denominator, per ``keys``.

    ``items``: keys, item_id, planned_quantities (null when an item has no plan). ``results``: keys, item_id,
    successful, successful_quantities, validated_quantities.
    """
    done = results.withColumn("_attempted", F.lit(True))
    joined = items.join(done, [*keys, "item_id"], "left")
    hit = lambda c: F.size(F.array_intersect(F.array_distinct("planned_quantities"), F.array_distinct(c)))
    counted = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("planned_listings"),
        F.count("_attempted").alias("attempted_listings"),
        F.count_if(F.col("successful")).alias("successful_listings"),
        F.every(F.coalesce(F.size("planned_quantities") > 0, F.lit(False))).alias("_all_planned"),
        F.sum(F.size("planned_quantities")).alias("_planned"),
        F.coalesce(F.sum(F.when(F.col("_attempted"), hit("successful_quantities"))), F.lit(0)).alias("_checked"),
        F.coalesce(F.sum(F.when(F.col("_attempted"), hit("validated_quantities"))), F.lit(0)).alias("_priced"),
    )
    planned = F.when(F.col("_all_planned"), F.col("_planned"))
    checked = F.when(F.col("_all_planned"), F.col("_checked"))
    return counted.select(
        *keys,
        "planned_listings",
        "attempted_listings",
        "successful_listings",
        (F.col("attempted_listings") - F.col("successful_listings")).alias("failed_listings"),
        (F.col("planned_listings") - F.col("attempted_listings")).alias("unattempted_listings"),
        planned.alias("planned_quantity_checks"),
        checked.alias("successful_quantity_checks"),
        F.when(F.col("_all_planned"), F.col("_priced")).alias("validated_price_quotes"),
        (F.col("successful_listings") / F.col("planned_listings")).alias("listing_success_rate"),
        F.try_divide(checked, planned).alias("quantity_success_rate"),
    )


def manifest_checks(manifest: DataFrame, sources: list[str]) -> DataFrame:
    """First problem per manifest row, null when sound. Duplicates are counted by aggregates.

    ``manifest``: row_id, source, page_id (text), url, canonical_url, product_key, planned_quantities (text array).
    """
    def repeats(column: str, name: str) -> DataFrame:
        return manifest.groupBy("source", column).agg(F.count(F.lit(1)).alias(name))

    joined = manifest
    for column, name in (("page_id", "_pages"), ("url", "_urls"), ("product_key", "_products")):
        counts = repeats(column, name).where(F.col(name) > 1)
        joined = joined.join(counts, ["source", column], "left")
    plan = F.col("planned_quantities")
    canonical = F.forall(
        plan, lambda q: F.coalesce(money.quantity_text(money.quantity(q)) == q, F.lit(False))
    )
    valid = F.forall(plan, lambda q: money.quantity(q).isNotNull())
    reason = (
        F.when(~F.col("source").isin(sources) | ~F.col("page_id").rlike("^[1-9][0-9]{0,17}$"), "invalid_identity")
        .when(~F.coalesce(F.col("canonical_url") == F.col("url"), F.lit(False)), "invalid_url")
        .when(F.col("_pages").isNotNull() | F.col("_urls").isNotNull(), "duplicate_listing")
        .when(F.col("_products").isNotNull(), "duplicate_product")
        .when(
            plan.isNotNull() & ((F.size(plan) == 0) | ~valid | (F.size(F.array_distinct(plan)) != F.size(plan))),
            "invalid_planned_quantities",
        )
        .when(plan.isNotNull() & ~canonical, "noncanonical_quantity")
        .when(F.col("product_key").isNull() | plan.isNull(), "product_and_quantities_required")
    )
    return joined.withColumn("reason", reason).drop("_pages", "_urls", "_products")


def cohort_sizes(manifest: DataFrame, graded: list[str], expected: int) -> DataFrame:
    """(source, listings, size_ok) of every graded source, those without a listing included."""
    counts = manifest.where(F.col("source").isin(graded)).groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    every = manifest.sparkSession.createDataFrame([(g,) for g in graded], "source string")
    listings = F.coalesce("_n", F.lit(0))
    return every.join(counts, "source", "left").select("source", listings.alias("listings"), (listings == expected).alias("size_ok"))


def daily_window(ts: Column, anchor: Column) -> Column:
    """Struct of index, start, deadline and open flag; null before the anchor."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    index = F.floor((micros(ts) - micros(anchor)) / F.lit(DAY * 1_000_000)).cast("long")
    start = F.timestamp_add("SECOND", index * DAY, anchor)
    deadline = F.timestamp_add("SECOND", index * DAY + ACCEPT_SECONDS, anchor)
    return F.when(
        index >= 0,
        F.struct(
            index.alias("index"), start.alias("start"), deadline.alias("deadline"), (ts < deadline).alias("open")
        ),
    )


def windows(spark, anchor: Column, now: Column, graded: list[int]) -> DataFrame:
    """Every window from the anchor to now, per graded source: a few rows a day."""
    last = daily_window(now, anchor)["index"]
    one = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("index"))
    return one.select(
        "index",
        F.timestamp_add("SECOND", F.col("index") * DAY, anchor).alias("window_start"),
        F.timestamp_add("SECOND", F.col("index") * DAY + ACCEPT_SECONDS, anchor).alias("deadline"),
        F.explode(F.array(*[F.lit(s).cast("long") for s in graded])).alias("source_id"),
    )


def window_grades(slots: DataFrame, runs: DataFrame) -> DataFrame:
    """Grade each window and source by its latest valid run; late, running or assisted runs veto.

    ``runs``: source_id, window_start, run_id, status, started_at, finished_at, intervention and the two
    success rates. Runs are reduced by aggregates, never ranked in one task.
    """
    joined = slots.join(runs, ["source_id", "window_start"], "left")
    valid = (
        F.col("finished_at").isNotNull()
        & (F.col("started_at") >= F.col("window_start"))
        & (F.col("finished_at") <= F.col("deadline"))
        & F.col("status").isin("succeeded", "partial")
    )
    # The newest finish wins; of equal ones the first started.
    order = F.struct(
        F.col("finished_at"), -F.unix_micros(F.col("started_at").cast("timestamp")), -F.col("run_id")
    )
    run = F.struct("run_id", "listing_success_rate", "quantity_success_rate")
    late = F.coalesce((F.col("status") == "running") | (F.col("finished_at") > F.col("deadline")), F.lit(False))
    graded = joined.groupBy("index", "window_start", "deadline", "source_id").agg(
        F.count("run_id").alias("candidates"),
        F.max_by(run, F.when(valid, order)).alias("latest"),
        F.bool_or(late).alias("_late"),
        F.bool_or(F.coalesce("intervention", F.lit(False))).alias("_helped"),
    )
    met = (
        F.col("latest").isNotNull()
        & ~F.col("_late")
        & ~F.col("_helped")
        & (F.col("latest.listing_success_rate") >= PASS_RATE)
        & (F.coalesce("latest.quantity_success_rate", F.lit(0.0)) >= PASS_RATE)
    )
    reason = F.when(
        ~F.col("passed"),
        F.when(F.col("_helped"), "operator_intervention")
        .when(F.col("_late"), "unfinished_or_late")
        .when(F.col("candidates") == 0, "missing_run")
        .when(F.col("latest").isNull(), "unfinished_failed_or_late")
        .otherwise("below_success_threshold"),
    )
    return graded.withColumn("passed", F.coalesce(met, F.lit(False))).withColumn("reason", reason).select(
        "index", "window_start", "deadline", "source_id", F.col("latest.run_id").alias("run_id"), "passed", "reason"
    )


def streaks(grades: DataFrame, now: Column, needed: int = 7) -> DataFrame:
    """Current and best run of closed windows in which every graded source passed.

    The windows below see one row per day.
    """
    days = (
        grades.where(F.col("deadline") <= now)
        .groupBy("index")
        .agg(F.every("passed").alias("passed"))
    )
    islands = days.withColumn(
        "_island", F.col("index") - F.row_number().over(Window.partitionBy("passed").orderBy("index"))
    )
    sized = islands.where("passed").groupBy("_island").agg(
        F.count(F.lit(1)).alias("length"), F.max("index").alias("last")
    )
    end = days.agg(F.max("index").alias("end"), F.count(F.lit(1)).alias("windows"))
    joined = end.join(sized, F.col("last") <= F.col("end"), "left")
    return joined.groupBy("windows").agg(
        F.coalesce(F.max(F.when(F.col("last") == F.col("end"), F.col("length"))), F.lit(0)).alias("consecutive"),
        F.coalesce(F.max("length"), F.lit(0)).alias("best"),
    ).withColumn("passed_all", F.col("best") >= needed)
