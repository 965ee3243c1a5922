"""Scalar expressions over whole tables."""

from pyspark.sql import functions as F

from quotegrain.catalog import query
from quotegrain.catalog import sqltext as q
from quotegrain.functions import hashing, money, text
from quotegrain.plans import capture
from quotegrain.plans import identity as identity_plan
from quotegrain.plans import offers as offers_plan


@query("search_text", "SCL-01", "SCL-18", "UDF-03", oracle=f"""
SELECT doc_id, sha256({q.norm('text')}) AS text_hash, LENGTH({q.norm('text')}) AS chars, len({q.tokens(q.norm('text'))}) AS distinct_tokens FROM documents""")
def search_text(t):
    cleaned = t.spread("documents").select("doc_id", text.search_text(F.col("text")).alias("s"))
    return cleaned.select(
        "doc_id", F.sha2("s", 256).alias("text_hash"), F.length("s").alias("chars"), F.size(text.tokens(F.col("s"))).alias("distinct_tokens")
    )


@query("text_keys", "SCL-05", "SCL-06", "SCL-07", oracle=f"""
SELECT p_partkey, regexp_replace(LOWER(p_brand || ' ' || p_name), '[^a-z0-9]', '', 'g') AS compacted, {q.title('p_name')} AS titled,
  regexp_replace(regexp_replace(LOWER('(' || p_brand || ') ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '(^-|-$)', '', 'g') AS slug, LENGTH(p_name) >= 3 AS valid_actor FROM part""")
def text_keys(t):
    return t.part.select(
        "p_partkey",
        text.compact(F.concat_ws(" ", "p_brand", "p_name")).alias("compacted"),
        text.title_case(F.col("p_name")).alias("titled"),
        text.slug(F.concat(F.lit("("), "p_brand", F.lit(") "), "p_name", F.lit("!"))).alias("slug"),
        text.valid_actor(F.col("p_name")).alias("valid_actor"),
    )


@query("money_text", "SCL-10", "SCL-11", oracle="""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber IN (2, 3, 5) THEN NULL ELSE c END AS cents, CASE l_linenumber WHEN 2 THEN 'non_cent_total' WHEN 3 THEN 'invalid_money' WHEN 5 THEN 'invalid_money' END AS reason,
  '$' || CAST(c // 100 AS VARCHAR) || '.' || LPAD(CAST(c % 100 AS VARCHAR), 2, '0') AS dollars FROM x""")
def money_text(t):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    shown = money.dollars(cents)
    number = F.col("l_linenumber")
    typed = (
        F.when(number == 1, F.concat(shown, F.lit("00")))
        .when(number == 2, F.concat(shown, F.lit("5")))
        .when(number == 3, F.concat(F.lit("-"), shown))
        .when(number == 5, F.lit("1e3"))
        .otherwise(F.concat(F.lit("$"), F.format_number(cents.cast("decimal(20,2)") / 100, 2)))
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", typed.alias("typed"), shown.alias("dollars"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money.cents(F.col("typed")).alias("cents"), money.cents_reason(F.col("typed")).alias("reason"), "dollars"
    )


@query("quantity_text", "SCL-12", oracle="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.25' WHEN 3 THEN CAST(CAST(l_quantity AS BIGINT) * 10 AS VARCHAR)
  WHEN 7 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.000001' END AS quantity FROM lineitem""")
def quantity_text(t):
    whole = F.col("l_quantity").cast("long").cast("string")
    n = F.col("l_linenumber")
    typed = (
        F.when(n == 1, F.concat(whole, F.lit(".000")))
        .when(n == 2, F.concat(whole, F.lit(".250")))
        .when(n == 3, F.concat(whole, F.lit("0")))
        .when(n == 4, F.concat(whole, F.lit("e3")))
        .when(n == 5, F.lit("0.0"))
        .when(n == 6, F.concat(whole, F.lit("0000000")))
        .otherwise(F.concat(whole, F.lit(".0000010")))
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", typed.alias("typed"))
    return rows.withColumn("quantity", money.quantity_text(money.quantity(F.col("typed")))).drop("typed")


@query("mass_conversion", "SCL-14", oracle="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity * CASE l_linenumber % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 1 ELSE 1000 END AS DOUBLE) AS mg FROM lineitem""")
def mass_conversion(t):
    unit = F.element_at(F.array(F.lit("mcg"), F.lit("mg"), F.lit("g")), F.col("l_linenumber") % 3 + 1)
    mg = identity_plan.milligrams(F.col("l_quantity").cast("decimal(20,9)"), unit)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", mg.cast("double").alias("mg"))


@query("inferred_route_release", "SCL-17", oracle="""
WITH x AS (SELECT p_partkey, p_name || CASE p_size % 6 WHEN 0 THEN ' hypnotic tablet' WHEN 1 THEN ' extended release capsule' WHEN 2 THEN ' patch' WHEN 3 THEN ' topical cream' WHEN 4 THEN ' DR tablet' ELSE ' gel' END AS c,
  CASE p_size % 6 WHEN 0 THEN 'tablet' WHEN 1 THEN 'capsule' WHEN 2 THEN 'patch' WHEN 3 THEN 'cream' WHEN 4 THEN 'tablet' ELSE 'gel' END AS f FROM part)
SELECT p_partkey, f AS form, CASE WHEN CONTAINS(c, 'topical') THEN 'topical' WHEN CONTAINS(c, 'otic') THEN 'otic' WHEN f IN ('tablet', 'capsule') THEN 'oral' WHEN f = 'patch' THEN 'transdermal' END AS route,
  CASE WHEN CONTAINS(c, 'extended release') THEN 'extended' WHEN CONTAINS(c, ' DR ') THEN 'delayed' WHEN f IN ('tablet', 'capsule') THEN 'immediate' ELSE 'not_applicable' END AS release_type FROM x""")
def inferred_route_release(t):
    kinds = [" hypnotic tablet", " extended release capsule", " patch", " topical cream", " DR tablet", " gel"]
    name = F.concat("p_name", F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("p_size") % 6 + 1))
    cleaned = text.search_text(name)
    rows = t.part.select("p_partkey", cleaned.alias("c"), text.form_code(text.alias_from_search(cleaned)).alias("form"))
    return rows.select(
        "p_partkey", "form", identity_plan.inferred_route(F.col("c"), F.col("form")).alias("route"),
        identity_plan.inferred_release(F.col("c"), F.col("form")).alias("release_type"),
    )


@query("json_paths", "SCL-25", "SCL-26", oracle="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"a":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS canonical,
  'kind=' || event_type || ',note=new' AS merged FROM events""")
def json_paths(t):
    raw = F.concat(F.lit('{ "k": '), F.get_json_object("props", "$.k"), F.lit(', "a" : "'), F.col("event_type"), F.lit('" }'))
    base = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("note"), F.lit("old"), F.lit("gone"), F.lit("x"))
    merged = hashing.merged_map(base, F.create_map(F.lit("note"), F.lit("new")), ["gone"])
    # Of an event without a type nothing is known to merge.
    merged = F.when(F.col("event_type").isNotNull(), entries(merged))
    return t.events.select(
        "event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"), hashing.canonical_json(raw).alias("canonical"), merged.alias("merged")
    )


def entries(column):
    return F.array_join(F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")


@query("metadata_merge", "SCL-26", oracle="""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'k=' || json_extract_string(props, '$.k') || ',' END || 'note=' || event_type || CASE WHEN event_id % 2 = 0 THEN ',seen=' || CAST(user_id AS VARCHAR) ELSE '' END AS merged FROM events""")
def metadata_merge(t):
    """What was stored of an event, what a later one says about it, and a key that goes."""
    stored = F.when(F.col("event_id") % 3 != 0, F.from_json("props", "map<string,string>"))
    said = F.map_concat(F.create_map(F.lit("note"), F.col("event_type")), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("seen"), F.col("user_id").cast("string"))).otherwise(F.create_map(F.lit("gone"), F.lit("x"))))
    return t.events.select("event_id", entries(hashing.merged_map(stored, said, ["gone"])).alias("merged"))


@query("row_hashes", "SCL-27", oracle="""
SELECT p_partkey, sha256('{"name":"' || p_name || '","note":null,"size":' || CAST(p_size AS VARCHAR) || '}') AS row_hash, sha256('["' || CAST(p_size AS VARCHAR) || '","' || p_brand || '",' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '"shop ' || CAST(p_partkey % 5 AS VARCHAR) || '"' END || ',"cash","USD"]') AS offer_key FROM part""")
def row_hashes(t):
    rows = t.part.select("p_partkey", "p_brand", F.col("p_size").alias("size"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("note"))
    location = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("shop "), (F.col("p_partkey") % 5).cast("string")))
    return rows.select(
        "p_partkey", F.sha2(hashing.canonical_struct(["size", "name", "note"]), 256).alias("row_hash"),
        hashing.sha256_text(hashing.offer_key(F.col("size"), F.col("p_brand"), location, F.lit("cash"), F.lit("USD"))).alias("offer_key"),
    )


@query("medication_view", "PRJ-03", "AGG-06", oracle="""
SELECT p_name AS name, COUNT(*) AS components, array_to_string(list(CAST(p_partkey AS VARCHAR) || ':' || CAST(5 * (1 + p_size % 4) AS VARCHAR) ORDER BY p_partkey), ',') AS component_list, 'legacy' AS normalization_status
FROM part GROUP BY p_name""")
def medication_view(t):
    from quotegrain.plans.identity import with_components

    rows = t.part
    medications = rows.select(F.col("p_name").alias("medication_id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("normalization_status")).distinct()
    components = rows.select(F.col("p_name").alias("medication_id"), F.col("p_partkey").alias("sequence"), (5 * (1 + F.col("p_size") % 4)).alias("numerator_value"))
    view = with_components(medications, components)
    line = lambda c: F.concat_ws(":", c["sequence"].cast("string"), c["numerator_value"].cast("string"))
    return view.select("name", F.size("components").alias("components"), F.array_join(F.transform("components", line), ",").alias("component_list"), "normalization_status")


@query("public_listing", "PRJ-04", oracle="""
SELECT listing_id, source_id, match_status, 'tiers=' || CAST(tiers AS VARCHAR) || CASE WHEN unit IS NULL THEN '' ELSE ',unit=' || unit END AS metadata
FROM (SELECT l.listing_id, l.source_id, l.match_status, MAX(l.content_unit) AS unit, COUNT(DISTINCT o.quantity) AS tiers FROM b_listings l JOIN b_observations o ON o.listing_id = l.listing_id GROUP BY l.listing_id, l.source_id, l.match_status) x""")
def public_listing(t):
    """Listings as they may be shown: the metadata that a normaliser gathered, without its internal keys."""
    tiers = t.observations.groupBy("listing_id").agg(F.count_distinct("quantity").alias("tiers"), F.max("l_orderkey").alias("newest"))
    rows = t.listings.join(tiers, "listing_id")
    unit = F.when(F.col("content_unit").isNotNull(), F.create_map(F.lit("unit"), F.col("content_unit"))).otherwise(F.create_map().cast("map<string,string>"))
    internal = F.create_map(F.lit("rekey_run"), F.col("newest").cast("string"), F.lit("input_hash"), F.sha2(F.col("listing_id").cast("string"), 256))
    metadata = F.map_concat(F.create_map(F.lit("tiers"), F.col("tiers").cast("string")), unit, internal)
    return offers_plan.public_listing(rows.withColumn("metadata", metadata)).select("listing_id", "source_id", "match_status", entries(F.col("metadata")).alias("metadata"))


@query("stock_values", "SCL-22", oracle="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'out_of_stock' WHEN 'A' THEN 'unknown' ELSE 'in_stock' END AS availability FROM lineitem""")
def stock_values(t):
    value = F.when(F.col("l_returnflag") == "R", "http://schema.org/Discontinued").when(F.col("l_returnflag") == "A", "InStockSoon").otherwise("InStock")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", capture.stock(value).alias("availability"))
