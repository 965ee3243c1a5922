"""Research documents and the tool-call ledger."""

from pyspark.sql import functions as F

from quotegrain.catalog import query
from quotegrain.plans import research as plan

# One document per identity, from its listings and offers: bounded by sources x tiers.
NESTED_OFFERS = """SELECT listing_id, CAST(quantity AS BIGINT) AS ordering_quantity, price_cents, availability FROM b_offers"""


def documents(t):
    offer = F.struct(
        F.lit("public_cash").alias("program"), F.lit("online").alias("location"), "ordering_quantity",
        F.when(F.col("listing_id") % 43 != 0, F.col("ordering_quantity")).alias("physical_quantity"), F.lit("tablet").alias("content_unit"),
        "price_cents", F.lit("2001-06-30").alias("observed_at"),
        F.when(F.col("listing_id") % 47 == 0, "http://a.example.com/x").otherwise("https://a.example.com/x").alias("evidence_url"),
        F.when(F.col("price_cents").isNull() & (F.col("listing_id") % 5 != 0), "unavailable").otherwise("observed").alias("verification_status"),
    )
    offers = t.sql(NESTED_OFFERS).groupBy("listing_id").agg(F.sort_array(F.collect_list(offer)).alias("offers"))
    site = F.concat(F.lit("https://www.source_"), F.col("source_id").cast("string"), F.lit(".example.com/"))
    listing = F.struct(
        F.concat(F.lit(" Source_"), F.col("source_id").cast("string")).alias("source"),
        F.when(F.col("listing_id") % 53 == 0, "http://plain.example.com/").otherwise(site).alias("listing_url"),
        "match_status", "content_quantity", "offers",
    )
    # A fourth source was never asked for; identity 10 of every 100 lists its first source twice.
    rows = t.listings.join(offers, "listing_id").withColumn(
        "copy", F.explode(F.when((F.col("medication_id") % 100 == 10) & (F.col("source_id") == 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    )
    names = F.array(*[F.lit(f"source_{i}") for i in range(3)])
    docs = rows.groupBy(F.col("medication_id").alias("doc_id")).agg(F.collect_list(listing).alias("listings"))
    returned = F.when(F.col("doc_id") % 31 == 0, F.slice(names, 1, 2)).otherwise(names)
    return docs.withColumns({"requested": names, "returned": returned})


@query("validate_research", "RSH-01", "SET-07", oracle="""
WITH l AS (SELECT b.* FROM b_listings b WHERE listing_id IN (SELECT listing_id FROM b_offers)),
x AS (SELECT l.medication_id AS doc_id, l.listing_id, l.source_id, l.match_status, o.quantity, o.price_cents, l.content_quantity,
  CASE WHEN o.price_cents IS NULL AND l.listing_id % 5 <> 0 THEN 'unavailable' ELSE 'observed' END AS vs, CASE WHEN l.medication_id % 100 = 10 AND l.source_id = 0 THEN 2 ELSE 1 END AS copies
  FROM l JOIN b_offers o ON o.listing_id = l.listing_id),
p AS (SELECT doc_id, 'unsafe_url' AS problem FROM x WHERE listing_id % 53 = 0 OR listing_id % 47 = 0
  UNION SELECT doc_id, 'unrequested_source' FROM x WHERE source_id = 3 AND listing_id % 53 <> 0
  UNION SELECT doc_id, 'incomplete_observed_offer' FROM x WHERE listing_id % 47 <> 0 AND vs = 'observed' AND (price_cents IS NULL OR listing_id % 43 = 0)
  UNION SELECT doc_id, 'duplicate_listing' FROM x WHERE copies = 2
  UNION SELECT doc_id, 'source_mismatch' FROM x WHERE doc_id % 31 = 0),
pp AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT problem)), ',') AS problems FROM p GROUP BY doc_id)
SELECT x.doc_id, 3 AS pharmacies_requested, COUNT(DISTINCT source_id) FILTER (WHERE match_status = 'verified') AS pharmacies_with_verified_listings,
  CAST(COALESCE(SUM(copies) FILTER (WHERE vs = 'observed' AND price_cents IS NOT NULL), 0) AS BIGINT) AS verified_offer_count, COALESCE(MIN(pp.problems), '') AS problems
FROM x LEFT JOIN pp ON pp.doc_id = x.doc_id GROUP BY x.doc_id""")
def validate_research(t):
    checked = plan.validate_documents(documents(t))
    return checked.withColumn("problems", F.array_join("problems", ","))


@query("derived_unit_price", "RSH-01", "PRJ-05", oracle="""
SELECT listing_id, quantity, CASE WHEN price_cents IS NOT NULL THEN CAST(ROUND(price_cents / CAST(quantity AS DOUBLE), 6) AS DOUBLE) END AS unit_price FROM b_offers""")
def derived_unit_price(t):
    rows = plan.derived_unit_price(t.offers.withColumn("physical_quantity", F.col("quantity")))
    return rows.select("listing_id", "quantity", F.col("derived_price_per_unit_cents").cast("double").alias("unit_price"))


def ledger(t):
    """Events as tool calls: the event kind names the tool, its properties and value give the arguments."""
    tool = F.when(F.col("event_type") == "click", "search_catalog").when(F.col("event_type") == "error", "get_medication_offers").otherwise("get_listing_prices")
    k = F.get_json_object("props", "$.k")
    args = F.create_map(
        F.lit("q"), F.concat(F.lit(" Item "), k, F.lit(" ")), F.lit("limit"), (F.col("event_id") % 3).cast("string"),
        F.lit("quantity"), F.when(F.col("event_id") % 2 == 0, "30").otherwise("30.0"), F.lit("unit"), F.when(F.col("user_id") % 2 == 0, "tablets").otherwise("tablet"),
    )
    return t.spread("events").select("event_id", F.col("event_id").alias("call_id"), tool.alias("tool"), args.alias("arguments"),
                           F.when(F.col("value") < 2, "error").otherwise("ok").alias("status"))


LEDGER_SQL = """ledger AS (SELECT event_id AS call_id, event_type, value, props,
  CASE event_type WHEN 'click' THEN 'search_catalog' WHEN 'error' THEN 'get_medication_offers' ELSE 'get_listing_prices' END AS tool, json_extract_string(props, '$.k') AS k,
  CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN '30' ELSE '30.0' END ELSE '30' END AS qty, CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'tablets' ELSE 'tablet' END AS unit FROM events),
keyed AS (SELECT *, tool || ' {' || CASE WHEN event_type = 'click' THEN '' ELSE '"include_estimates":"false",' END || '"q":"item ' || k || '","quantity":"' || qty || '","unit":"' || unit || '"}' AS query_key FROM ledger),
marked AS (SELECT *, call_id < MAX(call_id) OVER (PARTITION BY query_key) AS superseded FROM keyed)"""


@query("latest_query", "RSH-05", oracle=f"""
WITH {LEDGER_SQL} SELECT call_id, query_key, superseded FROM marked""")
def latest_query(t):
    keyed = ledger(t).withColumn("query_key", plan.query_key(F.col("tool"), F.col("arguments")))
    return plan.latest_calls(keyed, "call_id").select("call_id", "query_key", "superseded")


@query("reference_problems", "RSH-05", oracle=f"""
WITH {LEDGER_SQL}, r AS (SELECT event_id * 2 AS call_id, event_id % 4 AS item_id FROM events)
SELECT r.call_id, r.item_id, CASE WHEN m.call_id IS NULL OR m.value < 2 THEN 'unsupported_reference' WHEN m.superseded THEN 'superseded_reference' ELSE 'unknown_item' END AS reason
FROM r LEFT JOIN marked m ON m.call_id = r.call_id WHERE m.call_id IS NULL OR m.value < 2 OR m.superseded OR r.item_id > 1""")
def reference_problems(t):
    keyed = ledger(t).withColumn("query_key", plan.query_key(F.col("tool"), F.col("arguments")))
    records = plan.latest_calls(keyed, "call_id")
    references = t.events.select((F.col("event_id") * 2).alias("call_id"), (F.col("event_id") % 4).alias("item_id"))
    items = t.events.select(F.col("event_id").alias("call_id"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("item_id"))
    return plan.reference_problems(references, records, items)


PAGE_SQL = """SELECT conv_id * 1000 + turn AS page_id, conv_id * 1000 + turn AS seq, CAST(conv_id AS VARCHAR(20)) AS query_key, CASE WHEN turn > 0 THEN CAST(turn AS VARCHAR(20)) END AS cursor,
  CASE WHEN NOT is_last THEN CAST(turn + 1 AS VARCHAR(20)) WHEN conv_id % 6 = 1 THEN '1' END AS next_cursor FROM (
  SELECT conv_id, turn, turn = MAX(turn) OVER (PARTITION BY conv_id) AS is_last FROM conversations) c WHERE NOT (conv_id % 5 = 0 AND turn = 2)"""


@query("chain_complete", "WIN-10", "RSH-06", oracle=f"""
WITH RECURSIVE p0 AS ({PAGE_SQL}), p AS (SELECT DISTINCT * FROM p0),
tgt AS (SELECT query_key, cursor, MIN(page_id) AS page_id FROM p WHERE cursor IS NOT NULL GROUP BY query_key, cursor),
nx AS (SELECT p.page_id, p.cursor, p.next_cursor, t.page_id AS next_id FROM p LEFT JOIN tgt t ON t.query_key = p.query_key AND t.cursor = p.next_cursor),
walk AS (SELECT page_id AS root, page_id AS at, 0 AS n FROM nx WHERE cursor IS NULL UNION ALL SELECT w.root, x.next_id, w.n + 1 FROM walk w JOIN nx x ON x.page_id = w.at WHERE x.next_id IS NOT NULL AND w.n < 200),
good AS (SELECT DISTINCT root FROM walk w JOIN nx x ON x.page_id = w.at WHERE x.next_cursor IS NULL),
done AS (SELECT DISTINCT w.at FROM walk w JOIN good g ON g.root = w.root)
SELECT p.page_id, d.at IS NOT NULL AS complete FROM p LEFT JOIN done d ON d.at = p.page_id""")
def chain_complete(t):
    return plan.complete_pages(t.sql(PAGE_SQL).distinct())


SEARCH_SQL = """SELECT p_partkey AS request_id, p_name AS medicine, CASE WHEN p_size % 2 = 0 THEN '10 mg' END AS strength,
  'Title: ' || UPPER(p_name) || ' 10mg tablets' || chr(10) || 'URL: https://other.example.org/a' || chr(10) || 'Title: ' || p_name || CASE WHEN p_size % 3 = 0 THEN ' 20mg' ELSE ' 10-mg' END || chr(10)
  || 'URL: https://www.shop.example.com/p/' || CAST(p_partkey AS VARCHAR(10)) || '.' || chr(10) || 'Title: ' || p_name || ' 10 MG' || chr(10) || 'URL: https://shop.example.com/q/' || CAST(p_partkey AS VARCHAR(10)) AS content FROM part"""


@query("listing_from_search", "RSH-02", "SCL-05", oracle="""
SELECT p_partkey AS request_id, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN p_name || ' 10 MG' ELSE p_name || CASE WHEN p_size % 3 = 0 THEN ' 20mg' ELSE ' 10-mg' END END AS title,
  CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'https://shop.example.com/q/' ELSE 'https://www.shop.example.com/p/' END || CAST(p_partkey AS VARCHAR) AS url FROM part""")
def listing_from_search(t):
    return plan.listing_from_search(t.sql(SEARCH_SQL, deal=("part",)), "shop.example.com")


@query("cash_price", "RSH-03", "SCL-23", oracle="""
SELECT p_partkey, CASE WHEN p_partkey % 6 <> 0 AND p_size % 4 <> 3 THEN 100000 + p_size * 100 + 25 END AS price_cents, CASE WHEN p_partkey % 6 <> 0 AND p_size % 4 <> 3 THEN '30' END AS physical_quantity,
  CASE WHEN p_partkey % 6 <> 0 THEN CASE p_size % 4 WHEN 0 THEN 'tablet' WHEN 1 THEN 'capsule' WHEN 2 THEN 'ml' END END AS content_unit FROM part""")
def cash_price(t):
    unit = F.element_at(F.array(F.lit("tablets"), F.lit("Capsule"), F.lit("ml"), F.lit("weeks")), (F.col("p_size") % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://shop.example.com/"), F.col("p_partkey").cast("string"))
    body = F.concat(
        F.lit("Save now $3.99. Cash price: $1,0"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".25 for 30 "), unit, F.lit(" only")
    )
    pages = t.part.select(url.alias("url"), body.alias("content"), F.explode(F.when(F.col("p_partkey") % 6 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    candidates = t.part.select("p_partkey", url.alias("url"))
    return plan.price_evidence(candidates, pages).drop("url")
