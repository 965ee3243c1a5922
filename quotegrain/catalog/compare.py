"""Modelled price comparison."""

from pyspark.sql import functions as F

from quotegrain.catalog import query
from quotegrain.plans import compare as plan

STRENGTH_SQL = """SELECT p_partkey, p_name, CAST(ROUND(p_retailprice / 90.0, 2) AS DECIMAL(12,4)) AS acquisition_unit_price_cents,
  CAST(1 + p_size % 3 AS BIGINT) AS doses_per_day, p_partkey % 4 = 0 AS in_program FROM part"""

MODELS_SQL = """models AS (SELECT * FROM (VALUES (0, 'walmart', 11.0, 1.0, 0, 400), (1, 'costco', 7.0, 1.0, 0, 299), (2, 'costplus', 1.0, 1.15, 1025, 0), (3, 'amazon', 8.5, 1.0, 0, 500))
  AS m(supplier_pos, supplier, factor, markup, fee, floor_cents)),
tiers AS (SELECT * FROM (VALUES (0, 30, 1, 1.0, 400), (1, 90, 1, 0.95, 1000), (2, 365, 4, 0.9, 4000)) AS t(tier_pos, days, fills, discount, program)),
strengths AS (""" + STRENGTH_SQL + """),
raw AS (SELECT s.p_partkey, m.supplier_pos, t.tier_pos, m.supplier, t.days AS days_supply, s.doses_per_day * t.days AS quantity, t.fills,
  GREATEST(CAST(ROUND(s.acquisition_unit_price_cents * CAST(m.factor AS DECIMAL(4,1)) * CAST(m.markup AS DECIMAL(4,2)) * CAST(CASE WHEN m.supplier = 'costplus' THEN 1 ELSE t.discount END AS DECIMAL(4,2))
    * CAST(s.doses_per_day * t.days AS DECIMAL(8,0)) + m.fee * t.fills, 0) AS BIGINT), m.floor_cents) AS modelled, t.program, s.in_program FROM strengths s, models m, tiers t),
prices AS (SELECT p_partkey, supplier_pos, tier_pos, supplier, days_supply, quantity, fills,
  CASE WHEN supplier = 'walmart' AND in_program AND program <= modelled THEN program ELSE modelled END AS price_cents FROM raw),
full_prices AS (SELECT *, ((2 * price_cents * 100 + quantity) // (2 * quantity)) / 100.0 AS unit_price_cents, ((2 * price_cents * 100 + days_supply) // (2 * days_supply)) / 100.0 AS price_per_day_cents FROM prices)"""


def prices(t):
    return plan.modelled_prices(t.sql(STRENGTH_SQL))


@query("modelled_prices", "PRC-01", oracle=f"""
WITH {MODELS_SQL} SELECT p_partkey, supplier, days_supply, quantity, fills, price_cents, unit_price_cents, price_per_day_cents FROM full_prices""")
def modelled_prices(t):
    return prices(t).select(
        "p_partkey", "supplier", "days_supply", "quantity", "fills", "price_cents",
        F.col("unit_price_cents").cast("double").alias("unit_price_cents"),
        F.col("price_per_day_cents").cast("double").alias("price_per_day_cents"),
    )


@query("best_by_days", "AGG-08", oracle=f"""
WITH {MODELS_SQL} SELECT p_partkey, days_supply, supplier, price_cents FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY p_partkey, days_supply ORDER BY price_cents, supplier_pos) AS rn FROM full_prices) x WHERE rn = 1""")
def best_by_days(t):
    return plan.best_by_tier(prices(t), ["p_partkey"])


@query("best_value", "AGG-08", oracle=f"""
WITH {MODELS_SQL} SELECT p_partkey, supplier, days_supply, price_cents, price_per_day_cents FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY p_partkey ORDER BY price_per_day_cents, supplier_pos, tier_pos) AS rn FROM full_prices) x WHERE rn = 1""")
def best_value(t):
    best = plan.best_value(prices(t), ["p_partkey"])
    return best.withColumn("price_per_day_cents", F.col("price_per_day_cents").cast("double"))


@query("price_comparison", "PRC-02", oracle=f"""
WITH {MODELS_SQL}, v AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_partkey ORDER BY price_per_day_cents, supplier_pos, tier_pos) AS rn FROM full_prices)
SELECT p_partkey, array_to_string(list(supplier || ':' || CAST(days_supply AS VARCHAR) || ':' || CAST(price_cents AS VARCHAR) ORDER BY supplier_pos, tier_pos), ',') AS quotes,
  MAX(supplier) FILTER (WHERE rn = 1) AS best_supplier, MAX(days_supply) FILTER (WHERE rn = 1) AS best_days FROM v GROUP BY p_partkey""")
def price_comparison(t):
    nested = plan.comparison(prices(t), ["p_partkey"])
    line = lambda x: F.concat_ws(":", x["supplier"], x["days_supply"].cast("string"), x["price_cents"].cast("string"))
    return nested.select(
        "p_partkey", F.array_join(F.transform("quotes", line), ",").alias("quotes"),
        F.col("best_value.supplier").alias("best_supplier"), F.col("best_value.days_supply").alias("best_days"),
    )


@query("per_day_monotone", "PRC-05", oracle=f"""
WITH {MODELS_SQL} SELECT p_partkey, supplier, days_supply FROM (
  SELECT *, LAG(price_per_day_cents) OVER (PARTITION BY p_partkey, supplier ORDER BY days_supply) AS prev FROM full_prices) x
WHERE price_per_day_cents > prev""")
def per_day_monotone(t):
    return plan.rises_with_supply(prices(t), ["p_partkey"])


@query("pick_strength", "PRC-04", oracle="""
WITH s AS (SELECT p_name AS medicine, p_partkey AS position, CAST(5 * (1 + p_size % 4) AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN 'MG' ELSE '-mg' END AS strength FROM part),
r AS (SELECT p_partkey AS request_id, p_name AS medicine, CASE p_partkey % 3 WHEN 0 THEN '10 mg' WHEN 1 THEN '20mg' END AS wanted FROM part),
j AS (SELECT r.request_id, r.medicine, s.strength, s.position, COALESCE(TRIM(regexp_replace(LOWER(s.strength), '[^a-z0-9]+', ' ', 'g')) = TRIM(regexp_replace(LOWER(r.wanted), '[^a-z0-9]+', ' ', 'g')), FALSE) AS hit
  FROM r JOIN s ON s.medicine = r.medicine)
SELECT request_id, medicine, strength, NOT hit AS defaulted FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY NOT hit, position) AS rn FROM j) x WHERE rn = 1""")
def pick_strength(t):
    number = (5 * (1 + F.col("p_size") % 4)).cast("string")
    strengths = t.part.select(
        F.col("p_name").alias("medicine"), F.col("p_partkey").alias("position"),
        F.concat(number, F.when(F.col("p_partkey") % 2 == 0, "MG").otherwise("-mg")).alias("strength"),
    )
    requests = t.part.select(
        F.col("p_partkey").alias("request_id"), F.col("p_name").alias("medicine"),
        F.when(F.col("p_partkey") % 3 == 0, "10 mg").when(F.col("p_partkey") % 3 == 1, "20mg").alias("wanted"),
    )
    return plan.pick_strength(strengths, requests)


@query("suppliers_by_price", "SRT-06", oracle=f"""
WITH {MODELS_SQL} SELECT p_partkey, ROW_NUMBER() OVER (PARTITION BY p_partkey ORDER BY price_cents, supplier_pos) AS place, supplier, price_cents FROM full_prices WHERE days_supply = 30""")
def suppliers_by_price(t):
    return plan.suppliers_by_price(prices(t), ["p_partkey"], 30)
