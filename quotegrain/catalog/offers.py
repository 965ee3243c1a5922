"""Offer filters, projections and serving queries."""

from pyspark.sql import functions as F

from quotegrain.catalog import query
from quotegrain.operators import paging
from quotegrain.plans import offers as plan
from quotegrain.sources import serving
from quotegrain.sources.bridge import FRESH_DAYS
from quotegrain.sources.tables import as_of

SOURCES = ["source_0", "source_1", "source_2", "source_3"]


def rules(**more):
    return plan.OfferRules(as_of=as_of(), fresh_for=f"{FRESH_DAYS} days", **more)


def enriched(t):
    """Offers with listing and source, from the stored state."""
    return serving.rows(t).where("offer_id IS NOT NULL")


# Shared SQL fragments of the oracle texts.
FROM_ALL = """FROM b_offer_rows o JOIN b_listings l ON l.listing_id = o.listing_id
JOIN b_sources s ON s.source_id = l.source_id"""
OLDEST = "TIMESTAMP '2001-06-30 00:00:00' - INTERVAL 365 DAY"
NOW = "TIMESTAMP '2001-06-30 00:00:00'"
FRESH = f"o.last_checked_at >= {OLDEST} AND (o.valid_until IS NULL OR o.valid_until > {NOW})"
STOCK = "o.availability = 'in_stock'"
STOCK_EST = """COALESCE(o.availability = 'in_stock' OR (o.availability = 'unknown' AND o.quote_kind = 'estimate'
  AND o.availability_basis = 'not_provided_by_api'), FALSE)"""
KNOWN = "l.content_quantity IS NOT NULL AND l.content_unit IS NOT NULL"


def eligible_sql(match="l.match_status = 'verified'", stock=STOCK):
    return f"{match} AND {KNOWN} AND s.enabled AND o.active AND {stock} AND o.price_cents IS NOT NULL AND {FRESH}"


def reason_sql(listing=False, exact=None, stock=STOCK):
    head = "CASE WHEN NOT s.enabled THEN 'source_disabled' "
    if listing:
        head += f"WHEN l.match_status = 'needs_review' THEN 'identity_quarantined' WHEN NOT ({KNOWN}) THEN 'packaging_unresolved' "
    else:
        head += f"WHEN l.match_status <> 'verified' OR NOT ({KNOWN}) THEN 'not_verified' "
    if exact:
        head += f"WHEN NOT COALESCE({exact}, FALSE) THEN NULL "
    return head + f"""WHEN NOT o.active THEN 'retired' WHEN NOT {stock} THEN o.availability
      WHEN o.price_cents IS NULL THEN 'missing_price'
      WHEN o.last_checked_at < {OLDEST} OR o.valid_until <= {NOW} THEN 'stale_or_expired' END"""


@query("eligible_offers", "FLT-01", oracle=f"""
SELECT o.offer_id, l.listing_id, s.slug AS source, o.price_cents {FROM_ALL} WHERE {eligible_sql()}""")
def eligible_offers(t):
    return enriched(t).where(plan.eligible(rules())).select("offer_id", "listing_id", "source", "price_cents")


@query("match_rule", "FLT-02", oracle="""
SELECT l.listing_id, l.match_status = 'verified' AS cross_source, l.match_status <> 'needs_review' AS one_listing
FROM b_listings l""")
def match_rule(t):
    return t.listings.select(
        "listing_id",
        plan.match_rule(rules()).alias("cross_source"),
        plan.match_rule(rules(listing_scope=True)).alias("one_listing"),
    )


@query("estimates_opt_in", "FLT-03", oracle=f"""
SELECT s.slug AS source, CAST(COUNT(*) FILTER (WHERE {STOCK}) AS BIGINT) AS strict_offers,
  CAST(COUNT(*) FILTER (WHERE {STOCK_EST}) AS BIGINT) AS with_estimates {FROM_ALL} GROUP BY s.slug""")
def estimates_opt_in(t):
    return enriched(t).groupBy("source").agg(
        F.count_if(plan.availability_rule(rules())).alias("strict_offers"),
        F.count_if(plan.availability_rule(rules(include_estimates=True))).alias("with_estimates"),
    )


@query("fresh_offers", "FLT-04", oracle=f"""
SELECT o.offer_id, o.last_checked_at, o.valid_until FROM b_offer_rows o WHERE {FRESH}""")
def fresh_offers(t):
    return t.offer_rows.where(plan.fresh(rules())).select("offer_id", "last_checked_at", "valid_until")


EXACT_90 = "o.quantity * l.content_quantity = 90 AND l.content_unit = 'tablet'"


@query("exact_quantity", "FLT-05", oracle=f"""
SELECT o.offer_id, s.slug AS source, CAST(o.quantity * l.content_quantity AS BIGINT) AS physical_quantity, l.content_unit,
  o.price_cents {FROM_ALL} WHERE {eligible_sql()} AND {EXACT_90}""")
def exact_quantity(t):
    exact = plan.exact_tier(F.lit(90), F.lit("tablet"))
    rows = enriched(t).where(plan.eligible(rules()) & exact)
    return plan.project(rows, rules()).select(
        "offer_id", "source", "physical_quantity", "content_unit", "price_cents"
    )


@query("context_filter", "FLT-06", oracle=f"""
SELECT o.offer_id, s.slug AS source, o.location_key, o.program_key {FROM_ALL}
WHERE s.slug = 'source_1' AND o.location_key = 'loc_2'""")
def context_filter(t):
    cond = plan.context(source="source_1", location="loc_2")
    return enriched(t).where(cond).select("offer_id", "source", "location_key", "program_key")


@query("offer_projection", "PRJ-01", oracle=f"""
SELECT o.offer_id, CAST(o.quantity * l.content_quantity AS BIGINT) AS physical_quantity,
  LEAST(o.last_checked_at + INTERVAL 365 DAY, COALESCE(o.valid_until, TIMESTAMP '9999-01-01 00:00:00')) AS fresh_until,
  o.availability = 'unknown' AS purchase_verification_required,
  COALESCE(o.quote_kind, 'source_product_total') AS quote_kind,
  CASE WHEN l.match_status = 'verified' THEN l.medication_id END AS medication_id {FROM_ALL}""")
def offer_projection(t):
    return plan.project(enriched(t), rules()).select(
        "offer_id", "physical_quantity", "fresh_until", "purchase_verification_required", "quote_kind",
        "medication_id",
    )


@query("gated_identity", "PRJ-02", oracle="""
SELECT l.listing_id, CASE WHEN l.match_status = 'verified' THEN l.medication_id END AS medication_id,
  CASE WHEN l.match_status = 'verified' THEN m.name END AS name
FROM b_listings l LEFT JOIN b_medications m ON m.medication_id = l.medication_id""")
def gated_identity(t):
    gated = t.listings.select("listing_id", plan.gated_medication().alias("medication_id"))
    return gated.join(t.medications.select("medication_id", "name"), "medication_id", "left")


@query("unit_price", "PRJ-05", oracle=f"""
SELECT o.offer_id, CASE WHEN o.price_cents IS NOT NULL AND o.quantity * l.content_quantity > 0 THEN
  CAST(ROUND(CAST(o.price_cents AS DOUBLE) / (o.quantity * l.content_quantity), 6) AS DOUBLE) END AS unit_price_cents {FROM_ALL}""")
def unit_price(t):
    from quotegrain.functions.money import per_unit

    amount = F.col("quantity") * F.col("content_quantity")
    return enriched(t).select(
        "offer_id", per_unit(F.col("price_cents"), amount).cast("double").alias("unit_price_cents")
    )


@query("offers_enriched", "JOIN-01", oracle=f"""
SELECT o.offer_id, l.listing_id, s.slug AS source, s.enabled, l.match_status {FROM_ALL}""")
def offers_enriched(t):
    return plan.enrich(t.offer_rows, t.listings, t.sources).select("offer_id", "listing_id", "source", "enabled", "match_status")


@query("tier_known", "JOIN-06", "AGG-04", oracle="""
SELECT l.medication_id, s.slug AS source,
  COALESCE(BOOL_OR(o.quantity * l.content_quantity = 90 AND l.content_unit = 'tablet'), FALSE) AS has_exact
FROM b_listings l JOIN b_sources s ON s.source_id = l.source_id
LEFT JOIN b_offer_rows o ON o.listing_id = l.listing_id GROUP BY l.medication_id, s.slug""")
def tier_known(t):
    exact = plan.exact_tier(F.lit(90), F.lit("tablet"))
    return plan.tier_known(serving.rows(t), ["medication_id"], exact)


@query("exclusions", "AGG-01", "QRY-03", oracle=f"""
SELECT source, reason, CAST(COUNT(*) AS BIGINT) AS offers FROM (
  SELECT s.slug AS source, {reason_sql()} AS reason {FROM_ALL}) x
WHERE reason IS NOT NULL GROUP BY source, reason""")
def exclusions(t):
    return plan.exclusions(enriched(t), rules())


@query("exclusions_exact_tier", "QRY-03", oracle=f"""
SELECT source, reason, CAST(COUNT(*) AS BIGINT) AS offers FROM (
  SELECT s.slug AS source, {reason_sql(listing=True, exact=EXACT_90)} AS reason {FROM_ALL}) x
WHERE reason IS NOT NULL GROUP BY source, reason""")
def exclusions_exact_tier(t):
    return plan.exclusions(
        enriched(t), rules(listing_scope=True), plan.exact_tier(F.lit(90), F.lit("tablet"))
    )


def quote_requests(t):
    """One request per identity and unit; the amount asked for varies with the identity."""
    return t.sql("""
SELECT medication_id AS request_id, medication_id, 30 * (1 + medication_id % 6) AS quantity,
  CASE WHEN medication_id % 2 = 0 THEN 'tablet' ELSE 'capsule' END AS unit FROM b_medications""")


REQUESTS_SQL = """requests AS (SELECT medication_id AS request_id, medication_id, 30 * (1 + medication_id % 6) AS quantity,
  CASE WHEN medication_id % 2 = 0 THEN 'tablet' ELSE 'capsule' END AS unit FROM b_medications)"""
ASKED = "o.quantity * l.content_quantity = r.quantity AND l.content_unit = r.unit"


@query("batch_quotes", "QRY-09", oracle=f"""
WITH {REQUESTS_SQL}
SELECT r.request_id, o.offer_id, s.slug AS source, o.price_cents {FROM_ALL}
JOIN requests r ON r.medication_id = l.medication_id AND {ASKED} WHERE {eligible_sql()}""")
def batch_quotes(t):
    return plan.batch_quotes(quote_requests(t), enriched(t), rules()).select(
        "request_id", "offer_id", "source", "price_cents"
    )


@query("quote_status", "QRY-04", oracle=f"""
WITH {REQUESTS_SQL}, hits AS (
  SELECT r.request_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE o.availability = 'unknown') AS unconfirmed {FROM_ALL}
  JOIN requests r ON r.medication_id = l.medication_id AND {ASKED} WHERE {eligible_sql(stock=STOCK_EST)} GROUP BY r.request_id)
SELECT r.request_id, CASE WHEN h.n IS NULL THEN 'no_eligible_exact_quote' WHEN h.unconfirmed > 0
  THEN 'includes_unconfirmed_estimates' ELSE 'available' END AS quote_status
FROM requests r LEFT JOIN hits h ON h.request_id = r.request_id""")
def quote_status(t):
    rule = rules(include_estimates=True)
    hits = plan.batch_quotes(quote_requests(t), enriched(t), rule).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("availability") == "unknown").alias("unconfirmed")
    )
    joined = quote_requests(t).join(hits, "request_id", "left")
    n, unconfirmed = F.coalesce("n", F.lit(0)), F.coalesce("unconfirmed", F.lit(0))
    return joined.select("request_id", plan.quote_status(n, unconfirmed, exact=True).alias("quote_status"))


@query("missing_reasons", "SET-04", oracle=f"""
WITH {REQUESTS_SQL}, known AS (
  SELECT r.request_id, s.slug AS source, COALESCE(BOOL_OR({ASKED}), FALSE) AS has_exact
  FROM requests r JOIN b_listings l ON l.medication_id = r.medication_id JOIN b_sources s ON s.source_id = l.source_id
  LEFT JOIN b_offer_rows o ON o.listing_id = l.listing_id GROUP BY r.request_id, s.slug)
SELECT r.request_id, s.slug AS source, CASE WHEN k.request_id IS NULL THEN 'not_matched' ELSE 'unsupported_quantity' END AS reason
FROM requests r CROSS JOIN b_sources s LEFT JOIN known k ON k.request_id = r.request_id AND k.source = s.slug
WHERE k.request_id IS NULL OR NOT k.has_exact""")
def missing_reasons(t):
    return plan.missing_reasons(quote_requests(t), known_tiers(t), SOURCES)


def known_tiers(t):
    asked = quote_requests(t).withColumnsRenamed({"quantity": "asked_quantity", "unit": "asked_unit"})
    exact = plan.exact_tier(F.col("asked_quantity"), F.col("asked_unit"))
    return plan.tier_known(serving.rows(t).join(asked, "medication_id"), ["request_id"], exact)


@query("result_outcome", "QRY-05", oracle=f"""
WITH {REQUESTS_SQL}, x AS (
  SELECT r.request_id, s.slug AS source, {reason_sql(exact=ASKED)} AS reason,
    COALESCE({eligible_sql()}, FALSE) AND COALESCE({ASKED}, FALSE) AS hit {FROM_ALL}
  JOIN requests r ON r.medication_id = l.medication_id),
known AS (
  SELECT r.request_id, s.slug AS source, COALESCE(BOOL_OR({ASKED}), FALSE) AS has_exact
  FROM requests r JOIN b_listings l ON l.medication_id = r.medication_id JOIN b_sources s ON s.source_id = l.source_id
  LEFT JOIN b_offer_rows o ON o.listing_id = l.listing_id GROUP BY r.request_id, s.slug),
synthetic AS (
  SELECT r.request_id, CASE WHEN k.request_id IS NULL THEN 'not_matched' ELSE 'unsupported_quantity' END AS reason
  FROM requests r CROSS JOIN b_sources s LEFT JOIN known k ON k.request_id = r.request_id AND k.source = s.slug
  WHERE k.request_id IS NULL OR NOT k.has_exact),
reasons AS (SELECT request_id, reason FROM x WHERE reason IS NOT NULL UNION SELECT request_id, reason FROM synthetic),
judged AS (SELECT request_id, BOOL_OR(reason = 'unsupported_quantity') AS tier,
  BOOL_AND(reason IN ('unsupported_quantity', 'not_matched')) AS only_tier FROM reasons GROUP BY request_id),
hits AS (SELECT request_id, COUNT(*) AS n FROM x WHERE hit GROUP BY request_id)
SELECT r.request_id, CASE WHEN h.n IS NOT NULL THEN 'available' WHEN j.tier AND j.only_tier THEN 'unsupported_quantity'
  ELSE 'unavailable' END AS outcome
FROM requests r LEFT JOIN hits h ON h.request_id = r.request_id LEFT JOIN judged j ON j.request_id = r.request_id""")
def result_outcome(t):
    asked = quote_requests(t).withColumnsRenamed({"quantity": "asked_quantity", "unit": "asked_unit"})
    return plan.request_outcomes(asked, serving.rows(t), t.sources, rules())


@query("medication_offers", "QRY-01", "JOIN-11", oracle=f"""
WITH RECURSIVE chain(requested, id, nxt, depth) AS (
  SELECT medication_id, medication_id, superseded_by_id, 0 FROM b_medications
  UNION ALL SELECT c.requested, m.medication_id, m.superseded_by_id, c.depth + 1
  FROM chain c JOIN b_medications m ON m.medication_id = c.nxt WHERE c.depth < 20),
resolved AS (SELECT requested, id FROM chain WHERE nxt IS NULL)
SELECT r.requested AS requested_id, r.id AS resolved_id, o.offer_id, s.slug AS source, o.price_cents {FROM_ALL}
JOIN resolved r ON r.id = l.medication_id WHERE {eligible_sql()} AND {EXACT_90}""")
def medication_offers(t):
    from quotegrain.operators.redirects import resolve

    resolved = resolve(t.medications, "medication_id", "superseded_by_id").select(
        F.col("medication_id").alias("requested_id"), F.col("resolved_id")
    )
    exact = plan.exact_tier(F.lit(90), F.lit("tablet"))
    rows = enriched(t).where(plan.eligible(rules()) & exact)
    return resolved.join(rows, F.col("resolved_id") == F.col("medication_id")).select(
        "requested_id", "resolved_id", "offer_id", "source", "price_cents"
    )


@query("listing_offers", "QRY-02", oracle=f"""
SELECT l.listing_id, o.offer_id, o.price_cents, o.quantity {FROM_ALL}
WHERE {eligible_sql(match="l.match_status <> 'needs_review'", stock=STOCK_EST)}""")
def listing_offers(t):
    rule = rules(listing_scope=True, include_estimates=True)
    return enriched(t).where(plan.eligible(rule)).select("listing_id", "offer_id", "price_cents", "quantity")


@query("keyset_page", "SRT-01", oracle=f"""
WITH page AS (SELECT o.offer_id, s.slug AS source, o.price_cents {FROM_ALL}
  WHERE {eligible_sql()} AND o.offer_id > 1000000000000 ORDER BY o.offer_id LIMIT 51),
ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY offer_id) AS rn, COUNT(*) OVER () AS n FROM page)
SELECT offer_id, source, price_cents, CASE WHEN n > 50 THEN (SELECT MAX(offer_id) FROM ranked WHERE rn <= 50) END AS next_cursor
FROM ranked WHERE rn <= 50""")
def keyset_page(t):
    rows = enriched(t).where(plan.eligible(rules())).select("offer_id", "source", "price_cents")
    return paging.keyset_page(rows, "offer_id", 50, cursor=1_000_000_000_000)


@query("literal_search", "FLT-07", oracle="""
SELECT medication_id, name FROM b_medications WHERE CONTAINS(LOWER(name), 'ed g')""")
def literal_search(t):
    return t.medications.where(paging.contains_literal(F.col("name"), "ED g")).select("medication_id", "name")


@query("active_identities", "FLT-10", oracle="""
SELECT medication_id, name, strength FROM b_medications WHERE superseded_by_id IS NULL""")
def active_identities(t):
    return t.medications.where(F.col("superseded_by_id").isNull()).select("medication_id", "name", "strength")


@query("identity_search", "QRY-07", oracle="""
WITH page AS (SELECT medication_id, name, form FROM b_medications
  WHERE superseded_by_id IS NULL AND CONTAINS(LOWER(name), 'bolt') AND medication_id > 100 ORDER BY medication_id LIMIT 31),
ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY medication_id) AS rn, COUNT(*) OVER () AS n FROM page)
SELECT medication_id, name, form, CASE WHEN n > 30 THEN (SELECT MAX(medication_id) FROM ranked WHERE rn <= 30) END AS next_cursor
FROM ranked WHERE rn <= 30""")
def identity_search(t):
    found = t.medications.where(
        F.col("superseded_by_id").isNull() & paging.contains_literal(F.col("name"), "bolt")
    ).select("medication_id", "name", "form")
    return paging.keyset_page(found, "medication_id", 30, cursor=100)


@query("listing_search", "QRY-08", "JOIN-02", oracle="""
WITH page AS (SELECT l.listing_id, s.slug AS source, CASE WHEN l.match_status = 'verified' THEN l.medication_id END AS medication_id,
    m.name FROM b_listings l JOIN b_sources s ON s.source_id = l.source_id
  LEFT JOIN b_medications m ON m.medication_id = l.medication_id AND l.match_status = 'verified'
  WHERE s.slug = 'source_2' AND l.content_unit = 'tablet' ORDER BY l.listing_id LIMIT 21),
ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY listing_id) AS rn, COUNT(*) OVER () AS n FROM page)
SELECT listing_id, source, medication_id, name, CASE WHEN n > 20 THEN (SELECT MAX(listing_id) FROM ranked WHERE rn <= 20) END AS next_cursor
FROM ranked WHERE rn <= 20""")
def listing_search(t):
    named = t.sources.select("source_id", F.col("slug").alias("source"))
    rows = (
        t.listings.join(named, "source_id")
        .where((F.col("source") == "source_2") & (F.col("content_unit") == "tablet"))
        .withColumn("medication_id", plan.gated_medication())
        .select("listing_id", "source", "medication_id")
    )
    page = paging.keyset_page(rows, "listing_id", 20)
    return page.join(t.medications.select("medication_id", "name"), "medication_id", "left")


@query("listing_left_medication", "JOIN-02", oracle="""
SELECT l.listing_id, l.match_status, m.medication_id AS linked_id, m.strength
FROM b_listings l LEFT JOIN b_medications m ON m.medication_id = l.medication_id AND l.match_status = 'verified'""")
def listing_left_medication(t):
    linked = t.medications.select(F.col("medication_id").alias("linked_id"), "strength")
    on = (F.col("medication_id") == F.col("linked_id")) & (F.col("match_status") == "verified")
    return t.listings.join(linked, on, "left").select("listing_id", "match_status", "linked_id", "strength")


@query("cheapest_observed", "PRC-03", oracle=f"""
WITH e AS (SELECT l.medication_id, l.content_unit, o.quantity * l.content_quantity AS physical_quantity, o.offer_id,
    s.slug AS source, o.price_cents {FROM_ALL} WHERE {eligible_sql()}),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY medication_id, content_unit, physical_quantity ORDER BY price_cents, offer_id) AS rn,
    MIN(price_cents) OVER w AS min_price, MAX(price_cents) OVER w AS max_price, COUNT(*) OVER w AS n
  FROM e WINDOW w AS (PARTITION BY medication_id, content_unit, physical_quantity))
SELECT medication_id, content_unit, CAST(physical_quantity AS BIGINT) AS physical_quantity, min_price,
  max_price - min_price AS spread, source, offer_id, n AS offers FROM r WHERE rn = 1""")
def cheapest_observed(t):
    rows = enriched(t).where(plan.eligible(rules())).withColumn(
        "physical_quantity", F.col("quantity") * F.col("content_quantity")
    )
    return plan.cheapest(rows, ["medication_id", "content_unit", "physical_quantity"])
