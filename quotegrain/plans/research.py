"""Research documents and the tool-call ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrain.functions import money, text, urls
from quotegrain.operators import ordered
from quotegrain.operators.redirects import reachable

# Plural units a caller may use.
UNIT_ALIASES = {"tablets": "tablet", "capsules": "capsule"}


def validate_documents(documents: DataFrame) -> DataFrame:
    """Per document: problem codes, recomputed coverage. The nested rows explode once and meet by aggregates.

    ``documents``: doc_id, requested array<string>, returned array<string>, listings array<struct<source,
    listing_url, match_status, content_quantity, offers array<struct<program, location, ordering_quantity,
    physical_quantity, content_unit, price_cents, observed_at, evidence_url, verification_status>>>>.
    """
    want = F.transform("requested", text.folded)
    given = F.transform("returned", text.folded)
    whole = documents.select(
        "doc_id",
        F.size("requested").alias("pharmacies_requested"),
        F.when((F.size(F.array_except(want, given)) > 0) | (F.size("returned") != F.size(F.array_distinct(want))), "source_mismatch").alias("doc_problem"),
    )
    listings = documents.select(
        "doc_id", F.array_distinct(want).alias("want"), F.posexplode("listings").alias("pos", "l")
    )
    safe = lambda u: urls.split_url(u)
    unsafe = lambda u: ~F.coalesce((safe(u)["scheme"] == "https") & (safe(u)["user"] == "") & (safe(u)["port"] == ""), F.lit(False))
    source = text.folded(F.col("l.source"))
    problems = listings.select(
        "doc_id", "pos", source.alias("source"), F.col("l.listing_url").alias("url"), F.col("l.match_status").alias("match_status"),
        F.when(unsafe(F.col("l.listing_url")), "unsafe_url")
        .when(~F.array_contains("want", source), "unrequested_source")
        .when(F.col("l.content_quantity") <= 0, "invalid_content_quantity").alias("problem"),
        "l.offers",
    )
    repeated = problems.groupBy("doc_id", "source", "url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "doc_id", F.lit("duplicate_listing").alias("problem")
    )
    offers = problems.select("doc_id", "pos", F.inline("offers"))
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("program", "location", "ordering_quantity", "physical_quantity", "content_unit", "price_cents")])
    checked = offers.select(
        "doc_id", "pos", key.alias("offer_key"), "verification_status", "price_cents",
        F.when(unsafe(F.col("evidence_url")), "unsafe_url")
        .when((F.col("ordering_quantity") <= 0) | (F.col("physical_quantity") <= 0), "invalid_quantity")
        .when(F.col("observed_at").isNull(), "invalid_observed_at")
        .when((F.col("verification_status") == "observed") & (F.col("price_cents").isNull() | F.col("physical_quantity").isNull()), "incomplete_observed_offer")
        .alias("problem"),
    )
    twice = checked.groupBy("doc_id", "pos", "offer_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "doc_id", F.lit("duplicate_offer").alias("problem")
    )
    # Problem codes are a short fixed list, so the set per document is small.
    found = (
        problems.select("doc_id", "problem")
        .unionByName(checked.select("doc_id", "problem"))
        .unionByName(repeated)
        .unionByName(twice)
        .unionByName(whole.select("doc_id", F.col("doc_problem").alias("problem")))
        .where("problem IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("problem")).alias("problems"))
    )
    sources = problems.where("match_status = 'verified'").select("doc_id", "source").distinct().groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_sources")
    )
    observed = checked.where("verification_status = 'observed' AND price_cents IS NOT NULL").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_offers")
    )
    return (
        whole.join(found, "doc_id", "left")
        .join(sources, "doc_id", "left")
        .join(observed, "doc_id", "left")
        .select(
            "doc_id",
            "pharmacies_requested",
            F.coalesce("_sources", F.lit(0)).alias("pharmacies_with_verified_listings"),
            F.coalesce("_offers", F.lit(0)).alias("verified_offer_count"),
            F.coalesce("problems", F.array().cast("array<string>")).alias("problems"),
        )
    )


def derived_unit_price(offers: DataFrame) -> DataFrame:
    return offers.withColumn(
        "derived_price_per_unit_cents", money.per_unit(F.col("price_cents"), F.col("physical_quantity"))
    )


def query_key(tool: Column, arguments: Column, with_cursor: bool = True) -> Column:
    """Effective query of a tool call: normalised arguments in name order.

    ``arguments`` is a map of text. Limits never matter; a search text is trimmed and folded, units and
    quantities of price tools take their canonical form.
    """
    ignored = ["limit"] if with_cursor else ["limit", "cursor"]
    priced = tool.isin("get_listing_prices", "get_medication_offers")

    def value(k, v):
        exact = money.quantity_text(money.quantity(v))
        return (
            F.when(k == "q", text.folded(v))
            .when(priced & (k == "unit"), F.coalesce(text.lookup(v, UNIT_ALIASES), v))
            .when(priced & (k == "quantity"), F.coalesce(exact, v))
            .otherwise(v)
        )

    kept = F.map_filter(arguments, lambda k, v: ~k.isin(ignored) & v.isNotNull())
    changed = F.transform_values(kept, value)
    default = F.when(
        priced & ~F.coalesce(F.map_contains_key(changed, F.lit("include_estimates")), F.lit(False)),
        F.create_map(F.lit("include_estimates"), F.lit("false")),
    ).otherwise(F.create_map().cast("map<string,string>"))
    return F.concat_ws(
        " ", tool, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(changed, default)))))
    )


def latest_calls(records: DataFrame, seq: str) -> DataFrame:
    """Every record with a flag whether a later record answers the same query."""
    newest = records.groupBy("query_key").agg(F.max(seq).alias("_newest"))
    return records.join(newest, "query_key").withColumn("superseded", F.col(seq) < F.col("_newest")).drop("_newest")


def reference_problems(references: DataFrame, records: DataFrame, items: DataFrame) -> DataFrame:
    """References to calls that are missing, failed or superseded, or to items they did not return."""
    joined = references.join(
        records.select("call_id", "status", "superseded"), "call_id", "left"
    ).join(items.select("call_id", "item_id", F.lit(True).alias("_known")).distinct(), ["call_id", "item_id"], "left")
    reason = (
        F.when(F.col("status").isNull() | (F.col("status") != "ok"), "unsupported_reference")
        .when(F.col("superseded"), "superseded_reference")
        .when(F.col("_known").isNull(), "unknown_item")
    )
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select("call_id", "item_id", "reason")


def complete_pages(pages: DataFrame) -> DataFrame:
    """Flag pages that belong to a chain running from a first page to the last.

    ``pages``: page_id (number), seq, query_key, cursor, next_cursor. Cursors meet by an equi join;
    the first page with the wanted cursor, in record order, is the continuation.
    """
    targets = ordered.earliest(pages.where("cursor IS NOT NULL"), ["query_key", "cursor"], ["seq"], ["page_id"]).select(
        "query_key", F.col("cursor").alias("next_cursor"), F.col("page_id").alias("next_id")
    )
    linked = pages.join(targets, ["query_key", "next_cursor"], "left").select(
        "page_id", "cursor", F.col("next_cursor").isNull().alias("ends"), "next_id"
    )
    steps = linked.where("next_id IS NOT NULL").select("page_id", "next_id")
    finishing = reachable(steps, "page_id", "next_id", linked.where("ends").select("page_id"), backward=True)
    starts = linked.where("cursor IS NULL").join(finishing, "page_id", "left_semi").select("page_id")
    seen = reachable(steps, "page_id", "next_id", starts)
    return pages.select("page_id").join(seen.withColumn("complete", F.lit(True)), "page_id", "left").select(
        "page_id", F.coalesce("complete", F.lit(False)).alias("complete")
    )


RESULT = r"(?i)Title:\s*([^\n]+)\s*\nURL:\s*(https://[^\s]+)"


def listing_from_search(results: DataFrame, domain: str) -> DataFrame:
    """First search hit per request on the seller's own site that names the medicine and strength.

    ``results``: request_id, content, medicine, strength. Hits keep their order within the text.
    """
    titles = F.regexp_extract_all("content", F.lit(RESULT), F.lit(1))
    links = F.regexp_extract_all("content", F.lit(RESULT), F.lit(2))
    hits = results.select(
        "request_id", text.compact(F.col("medicine")).alias("m"), text.compact(F.coalesce("strength", F.lit(""))).alias("s"),
        F.posexplode(F.arrays_zip(titles.alias("title"), links.alias("url"))).alias("pos", "hit"),
    ).select("request_id", "pos", "m", "s", F.col("hit.title").alias("title"), F.regexp_replace("hit.url", "[.,)]+$", "").alias("url"))
    title = text.compact(F.col("title"))
    good = (
        (F.col("m") != "")
        & urls.first_party(F.col("url"), domain)
        & F.contains(title, F.col("m"))
        & ((F.col("s") == "") | F.contains(title, F.col("s")))
    )
    return ordered.earliest(hits.where(good), ["request_id"], ["pos"], ["title", "url"])


def price_evidence(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Cash price of each candidate from the one page fetched for its URL; none when pages are ambiguous."""
    from quotegrain.plans.capture import cash_price

    single = pages.groupBy("url").agg(F.count(F.lit(1)).alias("_n"), F.first("content").alias("content")).where("_n = 1")
    joined = candidates.join(single, "url", "left").withColumn("_p", cash_price(F.col("content")))
    return joined.select(*candidates.columns, "_p.price_cents", "_p.physical_quantity", "_p.content_unit")
