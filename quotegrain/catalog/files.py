"""Files that jobs write and read: captured documents in, versions, history, reports and exports out.

Each query writes what it derives from the tables into a folder of its own below the shared folder, and reads it back.
"""

import uuid

from pyspark.sql import functions as F

from quotegrain.catalog import query
from quotegrain.operators import fingerprint, ordered
from quotegrain.plans import history as history_plan
from quotegrain.plans import rekey
from quotegrain.session import shared_dir
from quotegrain.sources import captures, sinks
from quotegrain.sources.tables import OFFER_KEY, TIME_ORDER


def folder(t) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/quotegrain-files/{uuid.uuid4().hex}"


def write_documents(rows, name: str, path: str) -> None:
    """One JSON document per bucket, ``{name: [rows]}``, a file each."""
    members = [c for c in rows.columns if c != "bucket"]
    documents = rows.groupBy("bucket").agg(F.to_json(F.struct(F.collect_list(F.struct(*members)).alias(name))).alias("value"))
    documents.repartition("bucket").write.partitionBy("bucket").text(path)


# Products in documents of about a hundred each.
DUMP_SQL = """SELECT CAST(p_partkey AS VARCHAR(12)) AS ndc, p_name AS medication_name,
  CASE WHEN p_partkey % 6 = 0 THEN 'http://other.example.com/x/' ELSE 'http://Shop.example.com/drug/' END || CAST(p_partkey % 500 AS VARCHAR(12)) || '?utm_source=a#top' AS url, CAST(FLOOR(p_partkey / 100.0) AS INT) AS bucket FROM part"""


@query("catalogue_dump", "SRC-03", oracle="""
SELECT DISTINCT 'https://shop.example.com/drug/' || CAST(p_partkey % 500 AS VARCHAR) AS url, 'product' AS page_type FROM part WHERE p_partkey % 6 <> 0 AND (p_partkey % 500) % 7 <> 0""")
def catalogue_dump(t):
    from quotegrain.functions.urls import Site

    path = folder(t)
    write_documents(t.sql(DUMP_SQL), "results", path)
    known = t.part.where("(p_partkey % 500) % 7 = 0").select(F.concat(F.lit("https://shop.example.com/drug/"), (F.col("p_partkey") % 500).cast("string")).alias("url"))
    pages = captures.catalogue_pages(captures.read_catalogue(t.spark, path), Site(hosts=["shop.example.com"]), known)
    return pages.select("url", "page_type")


@query("reference_list", "SRC-05", oracle="""
SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS entry FROM part WHERE p_partkey < 200""")
def reference_list(t):
    """The list has 200 numbered entries by its nature; lines between them are no entries."""
    path = folder(t)
    n = F.col("p_partkey")
    entry = F.concat(F.lit(" "), F.lpad(n.cast("string"), 3, "0"), F.lit(".  "), F.col("p_name"), F.lit(" "), n.cast("string"), F.lit("  "))
    t.part.select(F.when(n < 200, entry).otherwise(F.concat(F.lit("see "), F.col("p_name"))).alias("value")).write.text(path)
    return captures.read_reference_list(t.spark, path)


@query("price_model_file", "SRC-06", oracle="""
SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name, v.position, CAST(v.strength * (1 + p_size % 4) AS VARCHAR) || ' mg' AS strength, CAST(p_size + v.position / 4.0 AS DOUBLE) AS unit_cents
FROM part CROSS JOIN (VALUES (0, 5), (1, 10)) AS v(position, strength)""")
def price_model_file(t):
    path = folder(t)
    strength = lambda k, mg: F.struct(
        F.concat((F.lit(mg) * (1 + F.col("p_size") % 4)).cast("string"), F.lit(" mg")).alias("strength"),
        (F.col("p_size") + F.lit(k) / 4).cast("decimal(12,4)").alias("acquisition_unit_price_cents"))
    rows = t.part.select(
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.lit("tablet").alias("form"), F.lit(1).alias("doses_per_day"),
        F.array(strength(0, 5), strength(1, 10)).alias("strengths"), F.floor(F.col("p_partkey") / 100).alias("bucket"))
    write_documents(rows, "medications", path)
    return captures.read_price_model(t.spark, path).select("name", "position", "strength", F.col("acquisition_unit_price_cents").cast("double").alias("unit_cents"))


@query("history_append", "SNK-02", oracle="""
WITH c AS (SELECT *, ROW_NUMBER() OVER w AS rn, LAG(price_cents) OVER w AS pp, LAG(availability) OVER w AS pa, LAG(active) OVER w AS pv FROM b_observations
  WINDOW w AS (PARTITION BY listing_id, quantity ORDER BY observed_at, l_orderkey, l_linenumber, l_suppkey))
SELECT strftime(observed_at, '%Y-%m') AS month, COUNT(*) AS rows, CAST(SUM(price_cents) AS BIGINT) AS cents FROM c
WHERE rn = 1 OR price_cents IS DISTINCT FROM pp OR availability IS DISTINCT FROM pa OR active IS DISTINCT FROM pv GROUP BY 1""")
def history_append(t):
    """Changes appended in two runs, the second half after the first."""
    path = folder(t)
    changes = history_plan.price_changes(t.observations, OFFER_KEY, TIME_ORDER).select(*OFFER_KEY, "observed_at", "price_cents", "availability", "active")
    cut = F.lit("1995-06-30").cast("timestamp_ntz")
    sinks.append_history(changes.where(F.col("observed_at") <= cut), path)
    sinks.append_history(changes.where(F.col("observed_at") > cut), path)
    return t.spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("rows"), F.sum("price_cents").alias("cents"))


@query("report_file", "SNK-04", oracle="""
SELECT event_type, COUNT(*) AS events, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def report_file(t):
    path = folder(t)
    sinks.write_report(t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users")), path)
    return t.spark.read.schema("event_type string, events long, users long").json(path)


@query("replace_quotes", "SNK-05", oracle="""
SELECT l_orderkey AS doc, l_linenumber AS line, l_suppkey AS seller, CASE WHEN l_orderkey % 3 = 1 THEN 2 ELSE 1 END AS version FROM lineitem
WHERE l_orderkey % 6 <> 3 AND (l_orderkey % 3 <> 1 OR l_linenumber % 2 = 0)""")
def replace_quotes(t):
    """All quotes, then new ones for a third of the documents and none for another part."""
    path = folder(t)
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("seller"))
    sinks.replace_children(rows.withColumn("version", F.lit(1)), path, "doc", t.spark, buckets=16)
    again = rows.where("doc % 3 = 1").withColumn("version", F.lit(2))
    asked = rows.where("doc % 3 = 1 OR doc % 6 = 3").select("doc").distinct()
    sinks.replace_children(again.where("line % 2 = 0"), path, "doc", t.spark, buckets=16, documents=asked)
    return t.spark.read.parquet(path).select("doc", "line", "seller", "version")


@query("product_link_export", "SNK-07", oracle="""
WITH u AS (SELECT p_name AS name, p_size % 4 AS strength, p_partkey AS id, 'stored' AS origin, 0 AS pr FROM part WHERE p_partkey % 9 = 0
  UNION ALL SELECT p_name, p_size % 4, p_partkey, 'catalogue', 1 FROM part)
SELECT name, strength, origin, 'https://www.example.com/p/' || CAST(id AS VARCHAR) AS url FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name, strength ORDER BY pr, id) AS rn FROM u) x WHERE rn = 1 AND id % 10 <> 3""")
def product_link_export(t):
    """Links from two lists, the stored one first, each with its origin; links of another host are not exported."""
    from quotegrain.functions.urls import first_party

    path = folder(t)
    host = F.when(F.col("p_partkey") % 10 == 3, "https://evil.example.org/p/").otherwise("https://www.example.com/p/")
    rows = t.part.select(F.col("p_name").alias("name"), (F.col("p_size") % 4).alias("strength"), F.col("p_partkey").alias("id"), F.concat(host, F.col("p_partkey").cast("string")).alias("url"))
    both = rows.where("id % 9 = 0").select("*", F.lit("stored").alias("origin"), F.lit(0).alias("priority")).unionByName(
        rows.select("*", F.lit("catalogue").alias("origin"), F.lit(1).alias("priority")))
    chosen = ordered.earliest(both, ["name", "strength"], ["priority", "id"], ["id", "origin", "url"])
    chosen.where(first_party(F.col("url"), "example.com")).select("name", "strength", "origin", "url").write.json(path)
    return t.spark.read.schema("name string, strength int, origin string, url string").json(path)


@query("stage_plan", "BKF-03", oracle="""
SELECT 'r1' AS run_id, COUNT(DISTINCT l_partkey) AS items, '' AS problems FROM lineitem UNION ALL SELECT 'r2', 0, 'snapshot_changed_during_planning'
UNION ALL SELECT 'r3', 0, 'restore_verified_backup_required,backup_database_state_mismatch'""")
def stage_plan(t):
    """Three runs: one that may be staged, one whose tables moved while it was planned, one without a proper backup."""
    items = t.lineitem.select(F.col("l_partkey").alias("legacy_id")).distinct()
    before = fingerprint.snapshot({"sources": (t.sources, None)})
    moved = fingerprint.snapshot({"sources": (t.sources.where("source_id > 0"), None)})
    state = fingerprint.snapshot_hash(before)
    backup = state.select(F.col("snapshot_hash").alias("database_state_hash"), F.lit(True).alias("restore_verified"))
    stale = backup.select(F.lit("other").alias("database_state_hash"), F.lit(False).alias("restore_verified"))
    out, path = None, folder(t)
    for run, (held, now) in {"r1": (backup, before), "r2": (backup, moved), "r3": (stale, before)}.items():
        event = rekey.stage(items, held, before, now, path, run)
        out = event if out is None else out.unionByName(event)
    return out
