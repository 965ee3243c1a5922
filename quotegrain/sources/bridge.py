"""Adapters from the star-schema test tables to the price-observation model.

The text runs unchanged on both engines (Spark reads ``TIMESTAMP`` literals as zone-free), so it
serves the Spark tables and the SQL oracles alike.
"""

AS_OF = "2001-06-30 00:00:00"
FRESH_DAYS = 365

VIEWS: dict[str, str] = {
    "b_sources": """
SELECT CAST(s AS BIGINT) AS source_id, 'source_' || CAST(s AS VARCHAR(10)) AS slug, s <> 3 AS enabled
FROM (VALUES (0),(1),(2),(3)) AS v(s)""",
    "b_medications": """
SELECT p_partkey AS medication_id, p_name AS name,
  CAST(5 * (1 + p_size % 4) AS VARCHAR(10)) || CASE WHEN p_partkey % 2 = 0 THEN 'MG' ELSE ' mg' END AS strength,
  CASE p_type WHEN 'ECONOMY' THEN 'tabs' WHEN 'STANDARD' THEN 'Tablet' WHEN 'SMALL' THEN 'CAPSULES'
    WHEN 'MEDIUM' THEN 'cap' WHEN 'LARGE' THEN 'Oral Solution' ELSE 'kit' END AS form,
  p_brand AS brand_name,
  CASE WHEN p_partkey % 5 <> 0 THEN p_partkey - 1 END AS superseded_by_id
FROM part""",
    "b_listings": """
SELECT CAST(l_suppkey % 4 AS BIGINT) * 1000000000 + l_partkey AS listing_id,
  CAST(l_suppkey % 4 AS BIGINT) AS source_id, l_partkey AS medication_id,
  CASE WHEN l_partkey % 10 = 7 THEN 'needs_review' WHEN l_partkey % 10 = 3 THEN 'unmatched' ELSE 'verified' END AS match_status,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 1 + l_partkey % 3 END AS content_quantity,
  CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 2 = 0 THEN 'tablet' ELSE 'capsule' END AS content_unit
FROM lineitem GROUP BY l_suppkey % 4, l_partkey""",
    "b_observations": """
SELECT CAST(l_suppkey % 4 AS BIGINT) * 1000000000 + l_partkey AS listing_id,
  CASE WHEN l_quantity <= 15 THEN 30 WHEN l_quantity <= 35 THEN 60 ELSE 90 END AS quantity,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN NULL ELSE
    (500 + 25 * (l_partkey % 40)) * CASE WHEN l_quantity <= 15 THEN 1 WHEN l_quantity <= 35 THEN 2 ELSE 3 END
    + 10 * (l_suppkey % 4) - CASE WHEN l_discount >= 0.05 THEN 50 ELSE 0 END END AS price_cents,
  CASE WHEN l_returnflag = 'R' THEN 'out_of_stock' WHEN l_returnflag = 'A' THEN 'unknown' ELSE 'in_stock' END AS availability,
  l_linestatus = 'O' OR l_linenumber > 1 AS active,
  l_shipdate AS observed_at, date_trunc('month', l_shipdate) AS run_month,
  l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem""",
    "b_offers": """
SELECT listing_id, quantity, price_cents, availability, active, observed_at AS last_checked_at
FROM (SELECT o.*, ROW_NUMBER() OVER (PARTITION BY listing_id, quantity
        ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn
      FROM b_observations o WHERE observed_at <= TIMESTAMP '2001-06-30 00:00:00') t
WHERE rn = 1""",
    "b_prescriptions": """
SELECT o_orderkey AS prescription_id, c_nationkey AS household_id, c_custkey AS member_id,
  c_name AS nickname, l_partkey AS medication_id, l_linenumber AS line_no, l_suppkey,
  CAST(l_quantity AS BIGINT) AS quantity, l_returnflag = 'R' AS deleted, o_orderdate AS confirmed_at
FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey""",
    "b_runs": """
SELECT event_id AS run_id, user_id AS item_id, user_id % 2 AS source_id, ts AS attempted_at,
  event_type <> 'error' AS successful, event_type, value
FROM events""",
    "b_offer_rows": """
SELECT listing_id * 1000 + quantity AS offer_id, listing_id, quantity, price_cents, availability, active, last_checked_at,
  CASE WHEN listing_id % 7 = 0 THEN last_checked_at + INTERVAL '30' DAY END AS valid_until,
  CASE WHEN quantity = 90 THEN 'estimate' END AS quote_kind,
  CASE WHEN listing_id % 3 <> 0 THEN 'not_provided_by_api' END AS availability_basis,
  'loc_' || CAST(listing_id % 3 AS VARCHAR(5)) AS location_key,
  CASE WHEN listing_id % 4 = 0 THEN 'member' ELSE 'cash' END AS program_key
FROM b_offers""",
}
