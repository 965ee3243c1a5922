"""Source status, run and frontier reports."""

from pyspark.sql import functions as F

from quotegrain.catalog import query
from quotegrain.catalog.offers import FROM_ALL, NOW, OLDEST, eligible_sql, enriched, rules
from quotegrain.operators import ordered
from quotegrain.plans import offers as offer_plan
from quotegrain.plans import status as plan

RUNS_SQL = """SELECT run_id, source_id, attempted_at AS started_at, attempted_at + INTERVAL '2' HOUR AS finished_at,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial' WHEN 'purchase' THEN 'interrupted' ELSE 'succeeded' END AS status,
  CASE WHEN item_id % 3 = 0 THEN 'api' ELSE 'website' END AS channel FROM b_runs"""


def runs(t):
    return t.sql(RUNS_SQL)


@query("latest_run", "WIN-01", oracle=f"""
WITH runs AS ({RUNS_SQL})
SELECT source_id, channel, run_id, status, started_at FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id, channel ORDER BY started_at DESC, run_id DESC) AS rn FROM runs) x WHERE rn = 1""")
def latest_run(t):
    return plan.latest_runs(runs(t), ["source_id", "channel"]).select(
        "source_id", "channel", "run_id", "status", "started_at"
    )


@query("latest_run_join", "JOIN-03", oracle=f"""
WITH runs AS ({RUNS_SQL})
SELECT s.slug AS source, r.run_id, r.status FROM b_sources s LEFT JOIN (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rn FROM runs) r
ON r.source_id = s.source_id AND r.rn = 1""")
def latest_run_join(t):
    newest = plan.latest_runs(runs(t), ["source_id"]).select("source_id", "run_id", "status")
    return t.sources.join(newest, "source_id", "left").select(F.col("slug").alias("source"), "run_id", "status")


@query("last_success", "AGG-05", oracle=f"""
WITH runs AS ({RUNS_SQL})
SELECT source_id, MAX(finished_at) FILTER (WHERE status = 'succeeded') AS last_successful_run_at FROM runs GROUP BY source_id""")
def last_success(t):
    return plan.last_success(runs(t))


@query("last_check_per_listing", "AGG-05", oracle="""
SELECT listing_id, MAX(last_checked_at) AS newest_check FROM b_offers GROUP BY listing_id""")
def last_check_per_listing(t):
    return t.offers.groupBy("listing_id").agg(F.max("last_checked_at").alias("newest_check"))


@query("source_status", "QRY-06", "JOIN-04", "AGG-02", oracle=f"""
WITH runs AS ({RUNS_SQL}),
newest AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rn FROM runs),
good AS (SELECT source_id, MAX(finished_at) AS last_successful_run_at FROM runs WHERE status = 'succeeded' GROUP BY source_id),
c AS (SELECT source_id, COUNT(*) AS listings, COUNT(*) FILTER (WHERE match_status = 'verified') AS verified_listings,
  COUNT(*) FILTER (WHERE match_status = 'needs_review') AS review_listings,
  COUNT(*) FILTER (WHERE match_status = 'unmatched') AS unmatched_listings FROM b_listings GROUP BY source_id),
p AS (SELECT s.source_id, COUNT(*) FILTER (WHERE {eligible_sql()}) AS fresh_eligible_offers,
  COUNT(*) FILTER (WHERE o.last_checked_at < {OLDEST} OR o.valid_until <= {NOW}) AS stale_offers {FROM_ALL} GROUP BY s.source_id)
SELECT s.slug AS source, s.enabled, n.status AS latest_run_status, n.started_at AS latest_run_started_at, g.last_successful_run_at,
  COALESCE(c.listings, 0) AS listings, COALESCE(c.verified_listings, 0) AS verified_listings,
  COALESCE(c.review_listings, 0) AS review_listings, COALESCE(c.unmatched_listings, 0) AS unmatched_listings,
  COALESCE(p.fresh_eligible_offers, 0) AS fresh_eligible_offers, COALESCE(p.stale_offers, 0) AS stale_offers
FROM b_sources s LEFT JOIN newest n ON n.source_id = s.source_id AND n.rn = 1 LEFT JOIN good g ON g.source_id = s.source_id
LEFT JOIN c ON c.source_id = s.source_id LEFT JOIN p ON p.source_id = s.source_id""")
def source_status(t):
    return plan.source_status(t.sources, runs(t), t.listings, enriched(t), rules())


PAGES_SQL = """SELECT page_id, page_id % 4 AS source_id, url,
  CASE page_id % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'directory' WHEN 2 THEN 'product' WHEN 3 THEN 'content' WHEN 4 THEN 'policy' ELSE 'ignored' END AS page_type,
  CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'failed' WHEN 2 THEN 'not_found' WHEN 3 THEN 'blocked' ELSE 'success' END AS last_result,
  CASE WHEN page_id % 5 = 4 THEN TIMESTAMP '2001-06-01 00:00:00' END AS last_success_at,
  CASE WHEN page_id % 6 = 5 THEN NULL WHEN page_id % 7 = 0 THEN TIMESTAMP '2001-07-05 00:00:00' ELSE TIMESTAMP '2001-06-20 00:00:00' END AS next_crawl_at,
  TIMESTAMP '2001-01-01 00:00:00' AS first_seen_at FROM pages"""


def crawl_pages(t):
    return t.sql(PAGES_SQL)


@query("frontier_counts", "AGG-03", "REL-09", oracle=f"""
WITH p AS ({PAGES_SQL}) SELECT source_id, page_type, last_result, COUNT(*) AS pages FROM p GROUP BY ALL""")
def frontier_counts(t):
    return plan.frontier_counts(crawl_pages(t))


@query("outcome_counts", "AGG-15", oracle=f"""
WITH runs AS ({RUNS_SQL})
SELECT source_id, COUNT(*) FILTER (WHERE status = 'succeeded') AS succeeded, COUNT(*) FILTER (WHERE status = 'partial') AS partial,
  COUNT(*) FILTER (WHERE status = 'failed') AS failed, COUNT(*) FILTER (WHERE status = 'interrupted') AS interrupted,
  COUNT(*) AS total FROM runs GROUP BY source_id""")
def outcome_counts(t):
    return plan.outcome_counts(runs(t), ["succeeded", "partial", "failed", "interrupted"])


@query("listings_per_source", "AGG-18", oracle="""
SELECT s.slug AS source, COUNT(l.listing_id) AS listings FROM b_sources s
LEFT JOIN b_listings l ON l.source_id = s.source_id GROUP BY s.slug""")
def listings_per_source(t):
    return plan.listings_per_source(t.sources, t.listings)


@query("latency_percentiles", "AGG-10", "REL-10", oracle="""
SELECT event_type, COUNT(*) AS requests, QUANTILE_DISC(value, 0.5) AS p50_ms, QUANTILE_DISC(value, 0.95) AS p95_ms,
  MAX(value) AS max_ms, COUNT(*) FILTER (WHERE event_type = 'error') AS errors,
  QUANTILE_DISC(value, 0.95) <= 500 AND COUNT(*) FILTER (WHERE event_type = 'error') = 0 AS threshold_met
FROM events GROUP BY event_type""")
def latency_percentiles(t):
    samples = t.events.select("event_type", F.col("value").alias("ms"), (F.col("event_type") != "error").alias("valid"))
    return plan.latency_report(samples, 500.0, ["event_type"])


@query("sample_first_offer", "WIN-02", oracle=f"""
SELECT listing_id, offer_id, source, physical_quantity FROM (
  SELECT l.listing_id, o.offer_id, s.slug AS source, CAST(o.quantity * l.content_quantity AS BIGINT) AS physical_quantity,
    ROW_NUMBER() OVER (PARTITION BY l.listing_id ORDER BY o.offer_id) AS rn {FROM_ALL} WHERE {eligible_sql()}) x
WHERE rn = 1 ORDER BY listing_id LIMIT 300""")
def sample_first_offer(t):
    rows = enriched(t).where(offer_plan.eligible(rules())).withColumn(
        "physical_quantity", F.col("quantity") * F.col("content_quantity")
    )
    first = ordered.earliest(rows, ["listing_id"], ["offer_id"], ["offer_id", "source", "physical_quantity"])
    return first.orderBy("listing_id").limit(300)
