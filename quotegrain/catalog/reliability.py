"""Collection reliability."""

from pyspark.sql import functions as F

from quotegrain.catalog import query
from quotegrain.plans import reliability as plan
from quotegrain.sources.tables import as_of

ITEM_SQL = """SELECT user_id % 3 AS source_id, user_id AS item_id, CASE WHEN user_id % 3 = 2 AND user_id % 5 = 0 THEN NULL WHEN user_id % 4 = 0 THEN '30' WHEN user_id % 4 = 1 THEN '30,60' ELSE '30,60,90' END AS plan_text
FROM events GROUP BY user_id"""
RESULT_SQL = """SELECT user_id % 3 AS source_id, user_id AS item_id, MIN(CASE WHEN value < 5 THEN '' WHEN value < 20 THEN '30' WHEN value < 60 THEN '60,30,30' ELSE '30,60,90,120' END) AS seen_text, MIN(event_type) <> 'click' AS successful
FROM events WHERE event_id % 3 = 0 GROUP BY user_id"""


def parts(column):
    return F.when(F.col(column) == "", F.array().cast("array<string>")).otherwise(F.split(column, ","))


@query("collection_metrics", "AGG-09", "SCL-31", oracle=f"""
WITH i AS ({ITEM_SQL}), r AS ({RESULT_SQL}),
j AS (SELECT i.source_id, i.item_id, i.plan_text, r.item_id IS NOT NULL AS attempted, r.successful, len(split(i.plan_text, ',')) AS planned,
  len(list_intersect(split(i.plan_text, ','), split(r.seen_text, ','))) AS checked FROM i LEFT JOIN r ON r.source_id = i.source_id AND r.item_id = i.item_id),
a AS (SELECT source_id, COUNT(*) AS planned_listings, COUNT(*) FILTER (WHERE attempted) AS attempted_listings, COUNT(*) FILTER (WHERE successful) AS successful_listings,
  BOOL_AND(plan_text IS NOT NULL) AS ok, CAST(SUM(planned) AS BIGINT) AS p, CAST(COALESCE(SUM(checked), 0) AS BIGINT) AS c FROM j GROUP BY source_id)
SELECT source_id, planned_listings, attempted_listings, successful_listings, attempted_listings - successful_listings AS failed_listings, planned_listings - attempted_listings AS unattempted_listings,
  CASE WHEN ok THEN p END AS planned_quantity_checks, CASE WHEN ok THEN c END AS successful_quantity_checks, CASE WHEN ok THEN c END AS validated_price_quotes,
  successful_listings / planned_listings AS listing_success_rate, CASE WHEN ok THEN c / p END AS quantity_success_rate FROM a""")
def collection_metrics(t):
    items = t.sql(ITEM_SQL).withColumn("planned_quantities", parts("plan_text")).drop("plan_text")
    results = t.sql(RESULT_SQL).withColumn("successful_quantities", parts("seen_text")).withColumn(
        "validated_quantities", F.col("successful_quantities")
    ).drop("seen_text")
    return plan.collection_metrics(items, results, ["source_id"])


@query("item_result", "REL-03", oracle="""
WITH w AS (SELECT listing_id, 30 * v.k AS quantity FROM b_listings JOIN (VALUES (1), (2), (3)) AS v(k) ON v.k <= 1 + listing_id % 3),
o AS (SELECT listing_id, quantity, BOOL_OR(active AND (availability = 'out_of_stock' OR (price_cents IS NOT NULL AND (availability = 'in_stock' OR (availability = 'unknown' AND COALESCE(quote_kind = 'estimate', FALSE) AND COALESCE(availability_basis = 'not_provided_by_api', FALSE)))))) AS usable,
  BOOL_OR(active AND price_cents IS NOT NULL) AS priced FROM b_offer_rows GROUP BY ALL),
j AS (SELECT w.listing_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE usable) AS u, COUNT(*) FILTER (WHERE priced) AS p, COALESCE(array_to_string(list(w.quantity ORDER BY w.quantity) FILTER (WHERE usable), ','), '') AS q
  FROM w LEFT JOIN o ON o.listing_id = w.listing_id AND o.quantity = w.quantity GROUP BY w.listing_id)
SELECT listing_id, u = n AS successful, q AS successful_quantities, CASE WHEN u = n THEN NULL WHEN p = n THEN 'availability_unconfirmed' ELSE 'planned_quantities_missing_or_unknown' END AS reason FROM j""")
def item_result(t):
    offer = F.struct("quantity", "price_cents", "availability", "active", "quote_kind", "availability_basis")
    # A listing sells at most three sizes here; the array is one listing's tiers.
    tiers = t.offer_rows.groupBy("listing_id").agg(F.collect_list(offer).alias("offers"))
    kind = tiers.schema["offers"].dataType.simpleString()
    planned = F.slice(F.array(F.lit(30), F.lit(60), F.lit(90)), F.lit(1), (1 + F.col("listing_id") % 3).cast("int"))
    rows = t.listings.select("listing_id").join(tiers, "listing_id", "left").withColumn(
        "offers", F.coalesce("offers", F.array().cast(kind))
    )
    result = rows.select("listing_id", plan.item_result(planned, F.col("offers")).alias("r"))
    return result.select(
        "listing_id", "r.successful", F.array_join(F.transform("r.successful_quantities", lambda x: x.cast("string")), ",").alias("successful_quantities"), "r.reason"
    )


RUN_SQL = """SELECT event_id AS run_id, user_id % 2 AS source_id, date_trunc('day', ts) AS window_start, ts AS started_at,
  CASE WHEN user_id % 41 = 0 THEN NULL ELSE ts + INTERVAL '20' MINUTE END AS finished_at, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'click' THEN 'partial' ELSE 'succeeded' END AS status,
  event_id % 211 = 0 AS intervention, CASE WHEN value > 1.5 THEN 0.97 ELSE 0.5 END AS listing_success_rate, CASE WHEN value > 1.2 THEN 1.0 ELSE 0.2 END AS quantity_success_rate
FROM events WHERE EXTRACT(HOUR FROM ts) < 1 OR (EXTRACT(HOUR FROM ts) = 1 AND EXTRACT(MINUTE FROM ts) < 38) OR event_id % 97 = 0"""
FIRST, NOW = "2024-01-01 00:00:00", "2024-01-29 12:00:00"

GRADE_CTES = f"""
slots AS (SELECT i AS index, TIMESTAMP '{FIRST}' + i * INTERVAL 1 DAY AS window_start, TIMESTAMP '{FIRST}' + i * INTERVAL 1 DAY + INTERVAL 2 HOUR AS deadline, s AS source_id
  FROM range(0, 29) r(i), (VALUES (0), (1)) v(s)),
runs AS ({RUN_SQL}),
j AS (SELECT s.*, r.run_id, r.status, r.started_at, r.finished_at, r.intervention, r.listing_success_rate AS lr, r.quantity_success_rate AS qr,
  r.finished_at IS NOT NULL AND r.started_at >= s.window_start AND r.finished_at <= s.deadline AND r.status IN ('succeeded', 'partial') AS valid
  FROM slots s LEFT JOIN runs r ON r.source_id = s.source_id AND r.window_start = s.window_start),
a AS (SELECT index, window_start, deadline, source_id, COUNT(run_id) AS candidates, BOOL_OR(COALESCE(status = 'running' OR finished_at > deadline, FALSE)) AS late, BOOL_OR(COALESCE(intervention, FALSE)) AS helped FROM j GROUP BY ALL),
l AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY index, source_id ORDER BY finished_at DESC, started_at, run_id) AS rn FROM j WHERE valid) x WHERE rn = 1),
grades AS (SELECT a.*, l.run_id, l.run_id IS NOT NULL AND NOT late AND NOT helped AND l.lr >= 0.95 AND COALESCE(l.qr, 0) >= 0.95 AS passed FROM a LEFT JOIN l ON l.index = a.index AND l.source_id = a.source_id)"""


def grades(t):
    slots = plan.windows(t.spark, as_of(FIRST), as_of(NOW), [0, 1])
    return plan.window_grades(slots, t.sql(RUN_SQL))


@query("window_grades", "REL-04", "SCL-29", "STR-05", oracle=f"""
WITH {GRADE_CTES} SELECT index, window_start, deadline, source_id, run_id, passed, CASE WHEN passed THEN NULL WHEN helped THEN 'operator_intervention' WHEN late THEN 'unfinished_or_late'
  WHEN candidates = 0 THEN 'missing_run' WHEN run_id IS NULL THEN 'unfinished_failed_or_late' ELSE 'below_success_threshold' END AS reason FROM grades""")
def window_grades(t):
    return grades(t)


@query("passing_streak", "WIN-05", "REL-05", oracle=f"""
WITH {GRADE_CTES}, d AS (SELECT index, BOOL_AND(passed) AS passed FROM grades WHERE deadline <= TIMESTAMP '{NOW}' GROUP BY index),
isl AS (SELECT index - ROW_NUMBER() OVER (PARTITION BY passed ORDER BY index) AS g, passed, index FROM d), s AS (SELECT COUNT(*) AS n, MAX(index) AS last FROM isl WHERE passed GROUP BY g)
SELECT (SELECT COUNT(*) FROM d) AS windows, COALESCE((SELECT n FROM s WHERE last = (SELECT MAX(index) FROM d)), 0) AS consecutive, COALESCE((SELECT MAX(n) FROM s), 0) AS best, COALESCE((SELECT MAX(n) FROM s), 0) >= 7 AS passed_all""")
def passing_streak(t):
    return plan.streaks(grades(t), as_of(NOW))


@query("daily_window", "SCL-29", oracle="""
SELECT event_id, date_diff('day', TIMESTAMP '2024-01-01 06:00:00', ts - INTERVAL 6 HOUR + INTERVAL 6 HOUR) AS raw_days,
  CAST(FLOOR(epoch_us(ts - INTERVAL 6 HOUR) / 86400000000) - FLOOR(epoch_us(TIMESTAMP '2024-01-01 00:00:00') / 86400000000) AS BIGINT) AS index,
  (epoch_us(ts - INTERVAL 6 HOUR) % 86400000000) < 7200000000 AS open FROM events WHERE ts >= TIMESTAMP '2024-01-01 06:00:00'""")
def daily_window(t):
    anchor = as_of("2024-01-01 06:00:00")
    rows = t.events.select("event_id", "ts", plan.daily_window(F.col("ts"), anchor).alias("w")).where("w IS NOT NULL")
    days = F.date_diff(F.to_date("ts"), F.to_date(anchor)).cast("long")
    return rows.select("event_id", days.alias("raw_days"), "w.index", "w.open")


MANIFEST_SQL = """SELECT page_id AS row_id, CASE WHEN page_id % 29 = 0 THEN 'elsewhere' ELSE 'source_' || CAST(page_id % 2 AS VARCHAR(5)) END AS source,
  CASE WHEN page_id % 17 = 0 THEN '0' || CAST(page_id AS VARCHAR(10)) WHEN page_id % 23 = 0 THEN '7' ELSE CAST(page_id + 10 AS VARCHAR(10)) END AS page_id, url,
  CASE WHEN page_id % 19 = 0 THEN url || '#x' ELSE url END AS canonical_url, CASE WHEN page_id % 13 = 0 THEN NULL WHEN page_id % 31 = 0 THEN 'same' ELSE 'key' || CAST(page_id AS VARCHAR(10)) END AS product_key,
  CASE page_id % 8 WHEN 0 THEN '30,30' WHEN 1 THEN '30,1e3' WHEN 2 THEN '30.0' WHEN 3 THEN NULL WHEN 4 THEN '0' ELSE '30,90.5' END AS plan_text FROM pages"""


@query("manifest_checks", "REL-01", oracle=f"""
WITH m AS ({MANIFEST_SQL}), c AS (SELECT *, COUNT(*) OVER (PARTITION BY source, page_id) AS np, COUNT(*) OVER (PARTITION BY source, url) AS nu, COUNT(*) OVER (PARTITION BY source, product_key) AS nk FROM m)
SELECT row_id, CASE WHEN source = 'elsewhere' OR NOT regexp_matches(page_id, '^[1-9][0-9]{{0,17}}$') THEN 'invalid_identity' WHEN canonical_url <> url THEN 'invalid_url' WHEN np > 1 OR nu > 1 THEN 'duplicate_listing'
  WHEN product_key IS NOT NULL AND nk > 1 THEN 'duplicate_product' WHEN plan_text IN ('30,30', '30,1e3', '0') THEN 'invalid_planned_quantities' WHEN plan_text = '30.0' THEN 'noncanonical_quantity'
  WHEN product_key IS NULL OR plan_text IS NULL THEN 'product_and_quantities_required' END AS reason FROM c""")
def manifest_checks(t):
    manifest = t.sql(MANIFEST_SQL).withColumn("planned_quantities", F.split("plan_text", ",")).drop("plan_text")
    return plan.manifest_checks(manifest, ["source_0", "source_1"]).select("row_id", "reason")


@query("cohort_sizes", "REL-01", oracle=f"""
WITH m AS ({MANIFEST_SQL}), s AS (SELECT UNNEST(['source_0', 'source_1', 'source_2']) AS source)
SELECT s.source, COUNT(m.row_id) AS listings, COUNT(m.row_id) = 100 AS size_ok FROM s LEFT JOIN m ON m.source = s.source GROUP BY s.source""")
def cohort_sizes(t):
    """Every graded source must plan as many listings as the cohort asks for; one without any is wrong, too."""
    return plan.cohort_sizes(t.sql(MANIFEST_SQL), ["source_0", "source_1", "source_2"], 100)
