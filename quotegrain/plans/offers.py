"""Offer queries: which seller has exactly this quantity, fresh and in stock, and if not, why not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrain.functions.hashing import without_keys

# Reason codes, statuses and the two terms that mark a documented estimate.
ESTIMATE = "estimate"
ESTIMATE_BASIS = "not_provided_by_api"
TIER_REASONS = ["unsupported_quantity", "not_matched"]


@dataclass(frozen=True)
class OfferRules:
    """Parameters of one offer query. ``listing_scope`` asks about one listing, not across sellers."""

    as_of: Column
    fresh_for: str = "24 hours"
    include_estimates: bool = False
    listing_scope: bool = False

    @property
    def oldest(self) -> Column:
        return self.as_of - F.expr(f"INTERVAL {self.fresh_for}")


def match_rule(rules: OfferRules) -> Column:
    status = F.col("match_status")
    return status != "needs_review" if rules.listing_scope else status == "verified"


def availability_rule(rules: OfferRules) -> Column:
    in_stock = F.col("availability") == "in_stock"
    if not rules.include_estimates:
        return in_stock
    estimate = (
        (F.col("availability") == "unknown")
        & (F.col("quote_kind") == ESTIMATE)
        & (F.col("availability_basis") == ESTIMATE_BASIS)
    )
    return F.coalesce(in_stock | estimate, F.lit(False))


def content_known() -> Column:
    return F.col("content_quantity").isNotNull() & F.col("content_unit").isNotNull()


def fresh(rules: OfferRules) -> Column:
    """Checked inside the window (inclusive) and not past its own expiry (strict)."""
    unexpired = F.col("valid_until").isNull() | (F.col("valid_until") > rules.as_of)
    return (F.col("last_checked_at") >= rules.oldest) & unexpired


def stale(rules: OfferRules) -> Column:
    return F.coalesce(
        (F.col("last_checked_at") < rules.oldest) | (F.col("valid_until") <= rules.as_of), F.lit(False)
    )


def eligible(rules: OfferRules) -> Column:
    return (
        match_rule(rules)
        & content_known()
        & F.col("enabled")
        & F.col("active")
        & availability_rule(rules)
        & F.col("price_cents").isNotNull()
        & fresh(rules)
    )


def exact_tier(quantity: Column, unit: Column) -> Column:
    """The physical amount equals the request; other tiers are never scaled."""
    same = (F.col("quantity") * F.col("content_quantity") == quantity) & (F.col("content_unit") == unit)
    return F.coalesce(same, F.lit(False))


def context(source=None, location=None, program=None) -> Column:
    """Optional filters; one that is not given adds nothing to the plan."""
    cond = F.lit(True)
    for name, value in (("source", source), ("location_key", location), ("program_key", program)):
        if value is not None:
            cond = cond & (F.col(name) == value)
    return cond


def enrich(offers: DataFrame, listings: DataFrame, sources: DataFrame) -> DataFrame:
    """Offers with their listing and source columns. Sources are few; Catalyst broadcasts them."""
    named = sources.select("source_id", F.col("slug").alias("source"), "enabled")
    return offers.join(listings, "listing_id").join(named, "source_id")


def listings_with_offers(offers: DataFrame, listings: DataFrame, sources: DataFrame) -> DataFrame:
    """Every listing with its source and each of its offers; one row with null offer columns if it has none."""
    named = sources.select("source_id", F.col("slug").alias("source"), "enabled")
    return listings.join(offers, "listing_id", "left").join(named, "source_id")


def project(rows: DataFrame, rules: OfferRules) -> DataFrame:
    """Columns of an offer answer. ``least`` skips nulls, so no expiry means no earlier limit."""
    until = F.col("last_checked_at") + F.expr(f"INTERVAL {rules.fresh_for}")
    return rows.withColumns(
        {
            "physical_quantity": F.col("quantity") * F.col("content_quantity"),
            "fresh_until": F.least(until, F.col("valid_until")),
            "purchase_verification_required": F.col("availability") == "unknown",
            "quote_kind": F.coalesce(F.col("quote_kind"), F.lit("source_product_total")),
            "medication_id": gated_medication(),
        }
    )


#: Metadata keys that are for the library's own use.
INTERNAL_METADATA = ["input_hash", "rekey_run", "identity_conflict_evidence"]


def public_listing(listings: DataFrame) -> DataFrame:
    """``listings`` as readers may see them: gated identity, metadata without internal keys."""
    return listings.withColumns({"medication_id": gated_medication(), "metadata": without_keys(F.col("metadata"), INTERNAL_METADATA)})


def gated_medication() -> Column:
    return F.when(F.col("match_status") == "verified", F.col("medication_id"))


def exclusion_reason(rules: OfferRules, exact: Column | None = None) -> Column:
    """First rule an offer fails, or null when it is eligible or belongs to another tier."""
    reason = F.when(~F.col("enabled"), "source_disabled")
    if rules.listing_scope:
        reason = reason.when(F.col("match_status") == "needs_review", "identity_quarantined").when(
            ~content_known(), "packaging_unresolved"
        )
    else:
        reason = reason.when((F.col("match_status") != "verified") | ~content_known(), "not_verified")
    if exact is not None:
        reason = reason.when(~exact, F.lit(None))
    return (
        reason.when(~F.col("active"), "retired")
        .when(~availability_rule(rules), F.col("availability"))
        .when(F.col("price_cents").isNull(), "missing_price")
        .when(stale(rules), "stale_or_expired")
    )


def exclusions(rows: DataFrame, rules: OfferRules, exact: Column | None = None) -> DataFrame:
    return (
        rows.select("source", exclusion_reason(rules, exact).alias("reason"))
        .where(F.col("reason").isNotNull())
        .groupBy("source", "reason")
        .agg(F.count(F.lit(1)).alias("offers"))
    )


def tier_known(held: DataFrame, by: list[str], exact: Column):
    """Per group and source, whether any offer has the exact tier; listings without offers count as no."""
    return held.groupBy(*by, "source").agg(F.coalesce(F.bool_or(exact), F.lit(False)).alias("has_exact"))


def batch_quotes(requests: DataFrame, rows: DataFrame, rules: OfferRules) -> DataFrame:
    """Many (medication, quantity, unit) requests at once: one equi join, then the same rules."""
    offers = rows.where(eligible(rules)).withColumn(
        "physical_quantity", F.col("quantity") * F.col("content_quantity")
    )
    asked = requests.select(
        "request_id",
        "medication_id",
        F.col("quantity").alias("physical_quantity"),
        F.col("unit").alias("content_unit"),
    )
    return asked.join(offers, ["medication_id", "physical_quantity", "content_unit"])


def quote_status(items: Column, unconfirmed: Column, exact: bool) -> Column:
    none = "no_eligible_exact_quote" if exact else "no_eligible_offers"
    return (
        F.when(items == 0, none).when(unconfirmed > 0, "includes_unconfirmed_estimates").otherwise("available")
    )


def result_outcome(items: Column, reasons: Column) -> Column:
    """``unsupported_quantity`` only when nothing but tier and match reasons were found."""
    only_tier = F.size(F.array_except(reasons, F.array(*[F.lit(r) for r in TIER_REASONS]))) == 0
    unsupported = F.array_contains(reasons, "unsupported_quantity") & only_tier
    return F.when(items > 0, "available").when(unsupported, "unsupported_quantity").otherwise("unavailable")


def request_outcomes(requests: DataFrame, held: DataFrame, sources: DataFrame, rules: OfferRules) -> DataFrame:
    """(request_id, outcome) in one pass over the requests' listings and offers, ``held`` as ``listings_with_offers`` gives them.

    ``requests``: request_id, medication_id, asked_quantity, asked_unit. A source without a listing is not matched, one without an
    offer of the exact tier does not support it. Sources and reasons are short fixed lists, so the sets per request stay small.
    """
    rows = requests.join(held, "medication_id")
    exact = exact_tier(F.col("asked_quantity"), F.col("asked_unit"))
    offered = F.col("offer_id").isNotNull()
    flags = rows.select(
        "request_id", "source", (offered & exact).alias("exact"), F.when(offered, exclusion_reason(rules, exact)).alias("reason"),
        (offered & F.coalesce(eligible(rules), F.lit(False)) & exact).cast("int").alias("hit"),
    )
    judged = flags.groupBy("request_id").agg(
        F.sum("hit").alias("n"), F.collect_set("reason").alias("reasons"), F.collect_set("source").alias("known"),
        F.collect_set(F.when(F.col("exact"), F.col("source"))).alias("served"),
    )
    every = sources.agg(F.count_distinct("slug").alias("n")).scalar()
    none = F.array().cast("array<string>")
    known = F.coalesce("known", none)
    missing = F.array_compact(F.array(
        F.when(F.size(known) < every, F.lit("not_matched")), F.when(F.size(F.array_except(known, F.coalesce("served", none))) > 0, F.lit("unsupported_quantity"))
    ))
    reasons = F.array_distinct(F.concat(F.coalesce("reasons", none), missing))
    joined = requests.select("request_id").join(judged, "request_id", "left")
    return joined.select("request_id", result_outcome(F.coalesce("n", F.lit(0)), reasons).alias("outcome"))


def missing_reasons(requests: DataFrame, known: DataFrame, source_names: list[str]) -> DataFrame:
    """Reasons for sources without a row: not matched at all, or matched without the tier.

    ``known`` has (request_id, source, has_exact). The source list is a fixed short parameter, so
    each request explodes into it.
    """
    wanted = requests.select(
        "request_id", F.explode(F.array(*[F.lit(s) for s in source_names])).alias("source")
    )
    return (
        wanted.join(known, ["request_id", "source"], "left")
        .where(~F.coalesce("has_exact", F.lit(False)))
        .select(
            "request_id",
            "source",
            F.when(F.col("has_exact").isNull(), "not_matched").otherwise("unsupported_quantity").alias("reason"),
        )
    )


def cheapest(rows: DataFrame, by: list[str]) -> DataFrame:
    """Cheapest offer and spread to the dearest per group; price ties go to the smaller offer id."""
    return rows.groupBy(*by).agg(
        F.min("price_cents").alias("min_price"),
        (F.max("price_cents") - F.min("price_cents")).alias("spread"),
        F.min_by("source", F.struct("price_cents", "offer_id")).alias("source"),
        F.min_by("offer_id", F.struct("price_cents", "offer_id")).alias("offer_id"),
        F.count(F.lit(1)).alias("offers"),
    )
