"""Data-quality checks."""

from pyspark.sql import functions as F

from quotegrain.catalog import query
from quotegrain.catalog.status import RUNS_SQL, runs
from quotegrain.plans import quality as plan

BAD_LISTINGS = """SELECT listing_id, source_id, CASE WHEN listing_id % 53 = 0 THEN NULL ELSE medication_id END AS medication_id,
  CASE WHEN listing_id % 59 = 0 THEN 'maybe' ELSE match_status END AS match_status, CASE WHEN listing_id % 61 = 0 THEN -1 ELSE content_quantity END AS content_quantity,
  CASE WHEN listing_id % 67 = 0 THEN 'barrel' ELSE content_unit END AS content_unit FROM b_listings"""
BAD_OFFERS = """SELECT listing_id, CASE WHEN listing_id % 71 = 0 THEN 0 ELSE quantity END AS quantity, CASE WHEN listing_id % 73 = 0 THEN -5 WHEN listing_id % 79 = 0 THEN NULL ELSE price_cents END AS price_cents,
  availability FROM b_offers"""


def unpivot(table, checks):
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{name}' AS check_name, COUNT(*) FILTER (WHERE NOT ({cond})) AS violations FROM {table}" for name, cond in checks.items()
    )


@query("dq_row_checks", "DQ-01", oracle=f"""
WITH listings AS ({BAD_LISTINGS}), offers AS ({BAD_OFFERS}), runs AS ({RUNS_SQL})
{unpivot('listings', {'match_status_domain': "match_status IN ('unmatched', 'verified', 'needs_review')", 'content_quantity_positive': 'content_quantity > 0',
 'verified_is_complete': "match_status <> 'verified' OR (medication_id IS NOT NULL AND content_quantity IS NOT NULL AND content_unit IS NOT NULL)",
 'content_unit_domain': "content_unit IN ('tablet','capsule','ml','g','patch','inhaler','vial','syringe','pen','ampule','suppository','lozenge','dose')"})} UNION ALL
{unpivot('offers', {'quantity_positive': 'quantity > 0', 'price_not_negative': 'price_cents >= 0', 'availability_domain': "availability IN ('in_stock','out_of_stock','unknown')",
 'in_stock_has_price': "availability <> 'in_stock' OR price_cents IS NOT NULL"})} UNION ALL
{unpivot('runs', {'status_domain': "status IN ('running','succeeded','partial','failed','interrupted')", 'finished_after_start': 'finished_at >= started_at'})}""")
def dq_row_checks(t):
    parts = [
        plan.row_checks(t.sql(BAD_LISTINGS), "listings", plan.listing_checks()),
        plan.row_checks(t.sql(BAD_OFFERS), "offers", plan.offer_checks()),
        plan.row_checks(runs(t), "runs", plan.run_checks()),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("dq_unique", "DQ-02", oracle="""
SELECT CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS key, COUNT(*) AS rows, 'lines' AS table_name FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1
UNION ALL SELECT p_name AS key, COUNT(*) AS rows, 'active_names' AS table_name FROM part WHERE p_partkey % 5 = 0 GROUP BY p_name HAVING COUNT(*) > 1""")
def dq_unique(t):
    lines = plan.duplicate_keys(t.lineitem, "lines", ["l_orderkey", "l_linenumber"]).select(
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"), "rows", "table_name"
    )
    names = plan.duplicate_keys(t.part, "active_names", ["p_name"], F.col("p_partkey") % 5 == 0).select(
        F.col("p_name").alias("key"), "rows", "table_name"
    )
    return lines.unionByName(names)


@query("dq_foreign", "DQ-03", oracle="""
SELECT 'orders' AS table_name, CAST(COUNT(*) AS BIGINT) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)
UNION ALL SELECT 'tenant' AS table_name, CAST(COUNT(*) AS BIGINT) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = CASE WHEN o.o_orderkey % 100 = 0 THEN 99 ELSE c.c_nationkey END)""")
def dq_foreign(t):
    lines = plan.orphans(t.lineitem, t.orders.where("o_orderkey % 10 <> 0"), ["l_orderkey"], ["o_orderkey"])
    scoped = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left").withColumn(
        "tenant", F.when(F.col("o_orderkey") % 100 == 0, 99).otherwise(F.col("c_nationkey"))
    )
    tenants = plan.orphans(scoped.select("o_custkey", "tenant"), t.customer, ["o_custkey", "tenant"], ["c_custkey", "c_nationkey"])
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("table_name"), "orphans")
    return count(lines, "orders").unionByName(count(tenants, "tenant"))


@query("redirect_targets", "DQ-06", "UDF-05", oracle="""
WITH m AS (SELECT medication_id, superseded_by_id, CASE WHEN medication_id % 3 = 0 THEN 'verified' ELSE 'legacy' END AS status FROM b_medications)
SELECT a.medication_id, a.superseded_by_id, CASE WHEN b.medication_id IS NULL THEN 'missing_target' WHEN b.superseded_by_id IS NOT NULL THEN 'target_is_redirect' ELSE 'target_not_verified' END AS reason
FROM m a LEFT JOIN m b ON b.medication_id = a.superseded_by_id WHERE a.superseded_by_id IS NOT NULL
  AND (b.medication_id IS NULL OR b.superseded_by_id IS NOT NULL OR b.status <> 'verified')""")
def redirect_targets(t):
    status = F.when(F.col("medication_id") % 3 == 0, "verified").otherwise("legacy")
    return plan.bad_redirects(t.medications.withColumn("status", status))


@query("evidence_conflicts", "DQ-08", "SNK-03", oracle="""
WITH e AS (SELECT 'source/' || SUBSTR(sha256(url), 1, 20) || '-' || sha256(html) || '.json' AS path, CASE WHEN page_id % 25 = 0 THEN html || 'x' ELSE html END AS body FROM pages)
SELECT path, COUNT(DISTINCT sha256(body)) AS bodies, FALSE AS hash_ok FROM e GROUP BY path
HAVING COUNT(DISTINCT sha256(body)) > 1 OR NOT BOOL_AND(CONTAINS(path, sha256(body)))""")
def evidence_conflicts(t):
    from quotegrain.sources.sinks import evidence_conflicts as conflicts
    from quotegrain.sources.sinks import evidence_rows

    rows = evidence_rows(t.pages.select("page_id", F.lit("source").alias("source"), F.col("url").alias("key"), F.col("html").alias("body")))
    broken = F.when(F.col("page_id") % 25 == 0, F.concat("body", F.lit("x"))).otherwise(F.col("body"))
    return conflicts(rows.withColumn("body", broken))


@query("dose_safety", "DQ-07", oracle="""
SELECT CAST(COUNT(*) AS BIGINT) AS pairs, CAST(0 AS BIGINT) AS collapsed FROM part""")
def dose_safety(t):
    """Each identity beside one that differs in strength, form, release, brand or species: keys must differ."""
    from quotegrain.plans import identity

    number = (5 * (1 + F.col("p_size") % 4)).cast("string")
    kind = F.col("p_partkey") % 5
    row = lambda other: F.struct(
        F.col("p_name").alias("name"),
        F.concat(number, F.when(F.lit(other) & (kind == 0), " mg/mL").otherwise(" mg")).alias("strength"),
        F.when(F.lit(other) & (kind == 1), "capsule").otherwise("tablet").alias("form"),
        F.lit("oral").alias("route"),
        F.when(F.lit(other) & (kind == 2), "ER").otherwise("immediate").alias("release_type"),
        F.when(F.lit(other) & (kind == 3), F.col("p_brand")).alias("brand_name"),
        F.lit(None).cast("string").alias("ndc"),
        F.when(F.lit(other) & (kind == 4), F.array(F.lit("dog"))).otherwise(F.array().cast("array<string>")).alias("species"),
        F.lit(True).alias("reviewed"),
    )
    pairs = t.part.select(F.col("p_partkey").alias("pair_id"), F.inline(F.array(row(False), row(True))))
    keyed = identity.normalize(pairs).select("pair_id", identity.local_key().alias("normalized_key"))
    per_pair = keyed.groupBy("pair_id").agg(F.count("normalized_key").alias("keys"), F.count_distinct("normalized_key").alias("different"))
    return per_pair.agg(F.count_if(F.col("keys") == 2).alias("pairs"), F.count_if(F.col("different") < F.col("keys")).alias("collapsed"))
