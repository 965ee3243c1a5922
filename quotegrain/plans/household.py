"""Household documents: intake, reconcile, prices, totals, deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrain.functions import text
from quotegrain.functions.hashing import deterministic_id
from quotegrain.operators import ordered

MONEY = "decimal(18,2)"
MAX_LINES = 40
OFFERS_SHOWN = 500

# Headings a transcription may return as if they were medicines.
HEADINGS = [
    "pharmacy", "refill", "refills", "prescriber", "patient", "patient name", "date", "medicine list",
    "medication list",
]
# Longest text accepted per field.
FIELD_LIMITS = {
    "medication": 160, "strength": 80, "form": 80, "directions": 500, "quantity": 60, "prescriber": 160,
    "pharmacy": 160, "refills": 60,
}


def for_household(df: DataFrame, household_id) -> DataFrame:
    """Every household read goes through here; the filter reaches the scan or the partition column."""
    return df.where(F.col("household_id") == household_id)


def identity_key(name: Column, strength: Column, form: Column) -> Column:
    return F.concat_ws("|", text.folded(name), F.regexp_replace(F.lower(strength), r"\s", ""), text.folded(form))


def unambiguous(medications: DataFrame) -> DataFrame:
    """(key, medication_id) of identities no other one shares its key with. One aggregate, no self join."""
    keyed = medications.select(
        "medication_id", identity_key(F.col("name"), F.col("strength"), F.col("form")).alias("key")
    )
    return (
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("medication_id").alias("medication_id"))
        .where("_n = 1")
        .select("key", "medication_id")
    )


def link_prescriptions(lines: DataFrame, medications: DataFrame) -> DataFrame:
    """Lines joined to the one identity with the same trimmed name, form and spaceless strength."""
    given = (F.coalesce("rx_strength", F.lit("")) != "") & (F.coalesce("rx_form", F.lit("")) != "")
    keyed = lines.where(given).withColumn(
        "key", identity_key(F.col("rx_name"), F.col("rx_strength"), F.col("rx_form"))
    )
    return keyed.join(unambiguous(medications), "key").drop("key")


def household_offers(linked: DataFrame, offers: DataFrame, top: int = OFFERS_SHOWN) -> DataFrame:
    """Newest prescription first, then price, then offer; the first ``top`` of each household.

    The rank filter is applied before the shuffle as well (window group limit), so a household with
    very many offers sends at most ``top`` rows per task.
    """
    order = Window.partitionBy("household_id").orderBy(
        F.col("confirmed_at").desc(), "price_cents", "offer_id", "prescription_id", "line_no", "l_suppkey"
    )
    # A line shows no more than ``top`` offers, so dearer ones of its medication need not meet it.
    cheap = Window.partitionBy("medication_id").orderBy("price_cents", "offer_id")
    few = offers.withColumn("_n", F.row_number().over(cheap)).where(F.col("_n") <= top).drop("_n")
    return (
        linked.join(few, "medication_id")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top)
    )


def deals(lines: DataFrame, shown: DataFrame, members: DataFrame, research: DataFrame) -> DataFrame:
    """One row per line with its offers, member name and research result.

    ``shown`` is the ranked offer list, so the collected array holds at most the rank limit.
    """
    per_line = shown.groupBy("line_id").agg(
        F.sort_array(F.collect_list(F.struct("price_cents", "offer_id", "source"))).alias("offers")
    )
    keyed = lines.withColumn(
        "research_key", F.concat_ws("|", *[text.folded(F.col(c)) for c in ("rx_name", "rx_strength", "rx_form")])
    )
    return (
        keyed.join(per_line, "line_id", "left")
        .join(members.select("member_id", F.col("nickname").alias("member_name")), "member_id", "left")
        .join(research.select("research_key", "research_status"), "research_key", "left")
        .withColumns(
            {
                "offers": F.coalesce("offers", F.array().cast("array<struct<price_cents:bigint,offer_id:bigint,source:string>>")),
                "member_name": F.coalesce("member_name", F.lit("Household member")),
                "research_status": F.coalesce("research_status", F.lit("unavailable")),
            }
        )
    )


def offer_prices(offers: DataFrame) -> DataFrame:
    """(medication_id, price) of every offer that can be bought at a known price."""
    price = (F.col("price_cents").cast("decimal(20,0)") / 100).cast(MONEY)
    return offers.where("active AND price_cents IS NOT NULL").select("medication_id", price.alias("price"))


def seller_quotes(offers: DataFrame) -> DataFrame:
    """Cheapest offered price per medication and source, as one row per medication with its sources in name order.

    ``offers``: medication_id, source, active, price_cents. The array holds one entry per source.
    """
    cheapest = (
        offers.where("active AND price_cents IS NOT NULL")
        .groupBy("medication_id", "source")
        .agg((F.min("price_cents").cast("decimal(20,0)") / 100).cast(MONEY).alias("price"))
    )
    return cheapest.groupBy("medication_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("source").alias("pharmacy"), "price"))).alias("_quotes")
    )


def quote_matrix(lines: DataFrame, quotes: DataFrame) -> DataFrame:
    """A quote per line and source that offers its medication; ``quotes`` as ``seller_quotes`` gives them."""
    met = lines.join(quotes, "medication_id").select(*lines.columns, F.posexplode("_quotes").alias("position", "_quote"))
    return met.select("*", "_quote.pharmacy", "_quote.price").drop("_quote")


def rank_quotes(quotes: DataFrame, line_keys: list[str]) -> DataFrame:
    """Cheapest first within a line; equal prices keep input order. A line has a quote per source, so no line needs slices."""
    return ordered.rank_rows(quotes, line_keys, ["price", "position"], "rank", None)


def price_lines(lines: DataFrame, quotes: DataFrame, line_keys: list[str]) -> DataFrame:
    """Active lines take the cheapest quote; lines without one, and deleted lines, keep their price."""
    best = quotes.groupBy(*line_keys).agg(F.min("price").alias("_best"))
    joined = lines.join(best, line_keys, "left")
    unit = F.when(~F.col("deleted"), F.col("_best"))
    return joined.withColumns(
        {
            "total": F.when(
                unit.isNotNull(), F.round(F.col("quantity").cast("decimal(18,0)") * unit, 2).cast(MONEY)
            ).otherwise(F.col("total")),
            "unit_price": F.coalesce(unit, F.col("unit_price")),
        }
    ).drop("_best")


def document_totals(lines: DataFrame, document: str) -> DataFrame:
    """Sum of line totals that are not deleted, never a submitted total."""
    return lines.groupBy(document).agg(
        F.coalesce(F.sum(F.when(~F.col("deleted"), F.col("total"))), F.lit(0)).cast(MONEY).alias("total_price")
    )


def reconcile(existing: DataFrame, incoming: DataFrame, document: str, line_keys: list[str], fields: list[str]):
    """Merge a resubmission into stored lines.

    Both sides: non-price fields from the submission, price and ``deleted`` as stored. Only stored: soft
    deleted. Only submitted: new with no price yet. The nickname follows the submission wherever the
    member is in it. Documents that are unknown or deleted must be removed by the caller first.
    """
    keys = [document, "member_id", *line_keys]
    stored = existing.select(
        *keys, F.struct("nickname", *fields, "unit_price", "total", "deleted").alias("_old")
    )
    sent = incoming.select(*keys, F.struct("nickname", *fields).alias("_new"))
    named = incoming.groupBy(document, "member_id").agg(F.min("nickname").alias("_name"))
    merged = stored.join(sent, keys, "full").join(named, [document, "member_id"], "left")
    both_new, has_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    return merged.select(
        *keys,
        F.coalesce("_name", "_old.nickname").alias("nickname"),
        *[F.when(both_new, F.col(f"_new.{f}")).otherwise(F.col(f"_old.{f}")).alias(f) for f in fields],
        F.coalesce("_old.unit_price", F.lit(0)).cast(MONEY).alias("unit_price"),
        F.coalesce("_old.total", F.lit(0)).cast(MONEY).alias("total"),
        F.when(~has_old, False).when(~both_new, True).otherwise(F.col("_old.deleted")).alias("deleted"),
    )


def accepts_update(incoming: DataFrame, documents: DataFrame, document: str) -> DataFrame:
    """Submitted lines of documents that exist and are not deleted."""
    live = documents.where("NOT deleted").select(document)
    return incoming.join(live, document, "left_semi")


def rejected_updates(incoming: DataFrame, documents: DataFrame, document: str) -> DataFrame:
    live = documents.where("NOT deleted").select(document)
    return incoming.select(document).distinct().join(live, document, "left_anti")


def soft_delete(documents: DataFrame, requests: DataFrame, document: str) -> DataFrame:
    """Mark documents deleted for the household that asked; nothing is removed."""
    asked = requests.select(document, "household_id", F.lit(True).alias("_asked")).distinct()
    joined = documents.join(asked, [document, "household_id"], "left")
    return joined.withColumn("deleted", F.col("deleted") | F.coalesce("_asked", F.lit(False))).drop("_asked")


def unknown_deletes(documents: DataFrame, requests: DataFrame, document: str) -> DataFrame:
    keys = [document, "household_id"]
    return requests.select(*keys).distinct().join(documents.select(*keys), keys, "left_anti")


def nest(lines: DataFrame, document: str, line: str, fields: list[str]) -> DataFrame:
    """Lines to one nested document each, members and lines in order.

    Lines are gathered per member first, so a document's members are spread over tasks until the last step.
    """
    members = lines.groupBy(document, "member_id").agg(
        F.min("nickname").alias("nickname"),
        F.sort_array(F.collect_list(F.struct(line, *fields))).alias("lines"),
    )
    return members.groupBy(document).agg(
        F.sort_array(F.collect_list(F.struct("member_id", "nickname", "lines"))).alias("members")
    )


def unnest(documents: DataFrame, document: str) -> DataFrame:
    member = documents.select(document, F.inline("members"))
    return member.select(document, "member_id", "nickname", F.inline("lines"))


def idempotent_intake(requests: DataFrame, saved: DataFrame) -> DataFrame:
    """First submission of a request key wins; repeats are replays, differing repeats are conflicts.

    ``requests``: request_key, seq, payload. ``saved``: request_key, payload already stored.
    """
    digest = F.sha2("payload", 256)
    first = requests.groupBy("request_key").agg(
        F.min("seq").alias("_first"), F.min_by(digest, "seq").alias("_digest")
    )
    stored = saved.select("request_key", F.sha2("payload", 256).alias("_stored"))
    winner = first.join(stored, "request_key", "left").select(
        "request_key",
        F.when(F.col("_stored").isNull(), F.col("_first")).alias("_first"),
        F.coalesce("_stored", "_digest").alias("_want"),
    )
    return requests.join(winner, "request_key").withColumns(
        {
            "outcome": F.when(F.col("seq") == F.col("_first"), "created")
            .when(digest == F.col("_want"), "replayed")
            .otherwise("conflict"),
            "draft_id": deterministic_id(F.col("request_key"), F.lit("0")),
        }
    ).drop("_first", "_want")


def batch_sizes(lines: DataFrame, batches: DataFrame, key: str) -> DataFrame:
    """(key, lines, size_ok) of every batch: one line at least and MAX_LINES at most."""
    counts = lines.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    size = F.coalesce("_n", F.lit(0))
    return batches.select(key).join(counts, key, "left").select(key, size.alias("lines"), size.between(1, MAX_LINES).alias("size_ok"))


def dedupe_members(members: DataFrame) -> DataFrame:
    """Trimmed nickname; a case-insensitive repeat in the household reuses the first member."""
    named = members.withColumn("nickname", F.trim("nickname")).withColumn("_fold", F.lower("nickname"))
    first = named.groupBy("household_id", "_fold").agg(F.min("member_id").alias("kept_id"))
    return (
        named.join(first, ["household_id", "_fold"])
        .select("household_id", "member_id", "kept_id", "nickname", (F.col("member_id") != F.col("kept_id")).alias("replayed"))
    )


def unsaved_drafts(drafts: DataFrame, saved: DataFrame) -> DataFrame:
    return drafts.join(saved.select("household_id", "draft_id").distinct(), ["household_id", "draft_id"], "left_anti")


def batch_problems(drafts: DataFrame, saved: DataFrame, entries: DataFrame) -> DataFrame:
    """Drafts missing from a batch and batch entries that are no draft of it."""
    keys = ["intake_id", "draft_id"]
    known = drafts.select(*keys).distinct()
    given = entries.select(*keys).distinct()
    covered = saved.select(*keys).unionByName(given).distinct()
    missing = known.join(covered, keys, "left_anti").withColumn("problem", F.lit("incomplete_batch"))
    foreign = given.join(known, keys, "left_anti").withColumn("problem", F.lit("draft_not_in_batch"))
    return missing.unionByName(foreign)


def not_headings(rows: DataFrame) -> DataFrame:
    bare = F.lower(F.regexp_replace(F.trim("medication"), ":+$", ""))
    return rows.where(~F.coalesce(bare, F.lit("")).isin(HEADINGS))


def field_problems(rows: DataFrame) -> DataFrame:
    """Array of fields that are too long, or a missing medicine name."""
    checks = [
        F.when(F.length(F.trim(F.coalesce(name, F.lit("")))) > limit, F.lit(f"{name}_too_long"))
        for name, limit in FIELD_LIMITS.items()
    ]
    empty = F.when(F.length(F.trim(F.coalesce("medication", F.lit("")))) < 1, F.lit("medication_missing"))
    return rows.withColumn("problems", F.array_compact(F.array(empty, *checks)))


def annual_savings(dearer: Column, cheaper: Column, days: int) -> Column:
    """Difference for one fill scaled to a year, to the nearest cent."""
    scaled = (dearer - cheaper).cast("decimal(20,0)") * F.lit(365) / F.lit(days)
    return F.round(scaled, 0).cast("long")
