"""Capture jobs over pages and derived panels, snapshots and catalogue responses."""

from pyspark.sql import functions as F

from quotegrain.catalog import query
from quotegrain.catalog.status import PAGES_SQL, crawl_pages
from quotegrain.functions import urls
from quotegrain.plans import capture as plan
from quotegrain.plans import frontier
from quotegrain.sources.tables import as_of

SITE = urls.Site(private_paths=["/cart", "/the"], scope_paths=None)
HOST = "regexp_extract({0}, '^https?://([^/?#]*)', 1)"
PERCENT = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN regexp_matches(c, '[^!-~]|[\"<>`]') THEN url_encode(c) ELSE c END), '')"
REASON = "CASE WHEN LOWER(path) IN ('/cart', '/the') OR starts_with(LOWER(path), '/cart/') OR starts_with(LOWER(path), '/the/') THEN 'private_or_transactional' END"


@query("page_links", "OBS-06", "SET-05", oracle=f"""
WITH h AS (SELECT DISTINCT page_id, url AS page_url, UNNEST(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1)) AS href FROM pages),
p AS (SELECT page_id, page_url, {PERCENT.format('href')} AS path FROM h)
SELECT DISTINCT page_id, page_url, 'https://' || {HOST.format('page_url')} || path AS url, {REASON} AS reason FROM p""")
def page_links(t):
    return plan.page_links(t.spread("pages"), SITE, same_host=True)


CLEAN_QUERY = """regexp_replace(regexp_replace(regexp_extract(url, '(\\?[^#]*)', 1), '([?&])utm_[^&]*', '\\1', 'g'), '[?&]+$', '')"""


@query("canonical_urls", "SCL-08", oracle=f"""
SELECT page_id, 'https://' || {HOST.format('url')} || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) || {CLEAN_QUERY} AS url,
  CASE WHEN starts_with(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/fr/') THEN 'private_or_transactional'
   WHEN NOT (starts_with(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/en/') OR starts_with(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/de/')) THEN 'out_of_source_scope' END AS reason
FROM pages""")
def canonical_urls(t):
    site = urls.Site(private_paths=["/fr"], scope_paths=["/en", "/de"])
    rows = t.pages.select("page_id", urls.canonical(F.col("url"), site, same_host_as=F.col("url")).alias("c"))
    return rows.select("page_id", "c.url", "c.reason")


@query("url_gate", "FLT-11", oracle="""
SELECT page_id, regexp_matches(url, '^https://(www\\.)?ththon\\.example\\.org([/?#]|$)') AS first_party FROM pages""")
def url_gate(t):
    return t.pages.select("page_id", urls.first_party(F.col("url"), "ththon.example.org").alias("first_party"))


@query("query_parameters", "SCL-09", oracle="""
SELECT page_id, COALESCE(NULLIF(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), NULLIF(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '')) AS value,
  REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(url_encode(regexp_extract(html, '<title>([^<]*)</title>', 1)), '%2A', '*'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')') AS encoded FROM pages""")
def query_parameters(t):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return t.pages.select("page_id", urls.query_value(F.col("url"), "page", "utm_source").alias("value"), urls.encode_component(title).alias("encoded"))


@query("page_snapshot", "SRC-04", "UDF-04", oracle=f"""
WITH h AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, UNNEST(list_distinct(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1))) AS href FROM pages),
l AS (SELECT page_id, array_to_string(list(origin || {PERCENT.format("REPLACE(href, '&amp;', '&')")} ORDER BY origin || {PERCENT.format("REPLACE(href, '&amp;', '&')")}), ' ') AS links FROM h GROUP BY page_id)
SELECT p.page_id, REPLACE(REPLACE(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&nbsp;', chr(160)) AS title,
  len(regexp_extract_all(html, '<h1')) AS headings, COALESCE(l.links, '') AS links, FALSE AS has_product, CAST(NULL AS VARCHAR) AS reason FROM pages p LEFT JOIN l ON l.page_id = p.page_id""")
def page_snapshot(t):
    snaps = plan.page_snapshots(t.spread("pages"))
    return snaps.select(
        "page_id", "title", F.size("h1").alias("headings"), F.array_join(F.array_sort("links"), " ").alias("links"), F.col("product").isNotNull().alias("has_product"), "reason"
    )


@query("page_kind", "OBS-07", oracle=f"""
SELECT page_id, CASE WHEN page_id % 10 = 0 OR regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '/en/685' THEN 'product' WHEN CONTAINS(url, 'page=') OR url LIKE '%/sitemap' OR url = 'https://x.example.com/' THEN 'directory'
  WHEN regexp_matches(url, 'privacy|terms|shipping|policy|hipaa') OR url LIKE '%7%policy' THEN 'policy' ELSE 'content' END AS kind FROM pages""")
def page_kind(t):
    parts = urls.split_url(F.col("url"))
    kind = plan.page_kind(F.col("url"), parts["path"], F.col("page_id") % 10 == 0, F.contains("url", F.lit("page=")), ["/en/685"], "https://x.example.com")
    return t.pages.select("page_id", kind.alias("kind"))


@query("page_loops", "OBS-08", oracle="""
WITH v AS (SELECT page_id, html FROM pages UNION ALL SELECT page_id, html FROM pages WHERE page_id % 3 = 0),
s AS (SELECT page_id, array_to_string(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1), chr(10)) AS links FROM v)
SELECT page_id, sha256('p' || chr(10) || links) AS fingerprint, COUNT(*) AS seen FROM s GROUP BY page_id, links HAVING COUNT(*) > 1""")
def page_loops(t):
    """Every page is seen once, one in three a second time, as a crawl that goes in circles sees it."""
    links = F.regexp_extract_all("html", F.lit('<a [^>]*?href="([^"]*)"'), F.lit(1))
    states = t.pages.select("page_id", F.lit("p").alias("range_text"), links.alias("links"))
    return plan.page_loops(states.unionByName(states.where("page_id % 3 = 0")))


@query("frontier_merge", "SET-05", oracle=f"""
WITH e AS (SELECT source_id, url, MIN(page_id) AS page_id, MIN(page_type) AS page_type FROM ({PAGES_SQL}) p WHERE page_id % 2 = 0 GROUP BY source_id, url),
f AS (SELECT page_id % 4 AS source_id, url, MIN('from ' || CAST(page_id AS VARCHAR)) AS parent, MAX(TIMESTAMP '2001-06-01 00:00:00' + CAST(page_id % 30 AS INTEGER) * INTERVAL 1 DAY) AS seen, MIN(CASE WHEN page_id % 9 = 0 THEN 'asset' END) AS reason FROM pages WHERE page_id % 2 = 1 OR page_id % 3 <> 1 GROUP BY ALL)
SELECT COALESCE(e.source_id, f.source_id) AS source_id, COALESCE(e.url, f.url) AS url, CASE WHEN e.url IS NULL THEN f.parent END AS discovered_from,
  CASE WHEN e.url IS NOT NULL THEN e.page_type WHEN f.reason IS NULL THEN 'unknown' ELSE 'ignored' END AS page_type,
  CASE WHEN e.url IS NOT NULL THEN TIMESTAMP '2001-01-01 00:00:00' ELSE f.seen END AS first_seen_at, CASE WHEN f.url IS NULL THEN TIMESTAMP '2001-06-15 00:00:00' WHEN e.url IS NULL THEN f.seen ELSE GREATEST(f.seen, TIMESTAMP '2001-06-15 00:00:00') END AS last_seen_at
FROM e FULL JOIN f ON f.source_id = e.source_id AND f.url = e.url""")
def frontier_merge(t):
    known = crawl_pages(t).where("page_id % 2 = 0").groupBy("source_id", "url").agg(F.min("page_type").alias("page_type")).select(
        "source_id", "url", F.lit(None).cast("string").alias("discovered_from"), "page_type",
        as_of("2001-01-01 00:00:00").alias("first_seen_at"), as_of("2001-06-15 00:00:00").alias("last_seen_at"),
    )
    found = t.pages.where("page_id % 2 = 1 OR page_id % 3 <> 1").select(
        (F.col("page_id") % 4).alias("source_id"), "url", F.concat(F.lit("from "), F.col("page_id").cast("string")).alias("discovered_from"),
        F.timestamp_add("DAY", F.col("page_id") % 30, as_of("2001-06-01 00:00:00")).alias("seen_at"),
        F.when(F.col("page_id") % 9 == 0, "asset").alias("reason"),
    )
    return frontier.merge(known, found)


# Price panels as one seller prints them: a label, the product, its maker and the tiers.
PANEL_SQL = """SELECT p_partkey AS page_id, 'Prices' || chr(10) || 'Generic Alternative:' || chr(10) || p_name || ' ' || CAST(5 * (1 + p_size % 4) AS VARCHAR(10)) || CASE WHEN p_size % 2 = 0 THEN 'MG TABS' ELSE ' mg caps' END || CASE WHEN p_size % 5 = 0 THEN ' film coated' ELSE '' END || chr(10)
  || 'Mfr.' || chr(10) || p_brand || chr(10) || '30 Tablets' || chr(10) || '$' || CAST(10 + p_size AS VARCHAR(10)) || '.50' || chr(10) || CASE WHEN p_partkey % 7 = 0 THEN '90 Capsules' ELSE '90 tabs' END || chr(10) || '$1,0' || CAST(10 + p_size AS VARCHAR(10)) || '.05'
  || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'Brand Name:' || chr(10) || p_name || ' plain' || chr(10) || '30 Tablets' || chr(10) || 'call us' ELSE '' END AS panel,
  p_name AS name, CAST(5 * (1 + p_size % 4) AS VARCHAR(10)) || ' mg' AS strength, CASE WHEN p_size % 2 = 0 THEN 'tablet' ELSE 'capsule' END AS form FROM part"""


@query("panel_rows", "OBS-02", "SCL-20", oracle="""
SELECT p_partkey AS page_id, 'Generic Alternative' AS label, p_name AS name, CAST(5 * (1 + p_size % 4) AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN 'MG' ELSE ' mg' END AS strength,
  CASE WHEN p_size % 2 = 0 THEN 'tablet' ELSE 'capsule' END AS form, CASE WHEN p_size % 5 = 0 THEN 'film coated' END AS suffix, p_brand AS manufacturer,
  '30:tablet:' || CAST((10 + p_size) * 100 + 50 AS VARCHAR) || ',90:' || CASE WHEN p_partkey % 7 = 0 THEN 'capsule' ELSE 'tablet' END || ':' || CAST(100000 + (10 + p_size) * 100 + 5 AS VARCHAR) AS tiers FROM part
UNION ALL SELECT p_partkey, 'Brand Name', NULL, NULL, NULL, NULL, NULL, '' FROM part WHERE p_partkey % 3 = 0""")
def panel_rows(t):
    blocks = plan.panel_blocks(t.sql(PANEL_SQL).select("page_id", "panel"))
    tier = lambda o: F.concat_ws(":", o["quantity"], o["unit"], o["price_cents"].cast("string"))
    return blocks.select(
        "page_id", "label", "parsed.name", "parsed.strength", "parsed.form", "parsed.suffix", "manufacturer",
        F.array_join(F.transform("offers", tier), ",").alias("tiers"),
    )


@query("panel_listings", "OBS-02", oracle="""
SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 = 0 THEN 'review_required' WHEN p_partkey % 11 = 0 AND p_partkey % 4 <> 0 THEN 'ambiguous_review_match' WHEN p_partkey % 7 = 0 THEN 'mixed_quantity_units' END AS reason FROM part""")
def panel_listings(t):
    panels = t.sql(PANEL_SQL)
    other = F.when(F.col("page_id") % 11 == 0, "something else").otherwise(F.col("name"))
    reviews = panels.where("page_id % 4 <> 0").select("page_id", other.alias("name"), "strength", "form")
    return plan.panel_listings(plan.panel_blocks(panels.select("page_id", "panel")), reviews).select("page_id", "reason")


SNAP_SQL = """SELECT p_partkey AS page_id, 'SKU' || CAST(p_partkey AS VARCHAR(10)) AS sku, p_name || CASE p_size % 4 WHEN 0 THEN ' 90 Count tablets' WHEN 1 THEN ' 10 ml vial' WHEN 2 THEN ' tablets' ELSE ' 30ct' END AS name, p_size, p_brand FROM part"""


PRODUCT_OFFERS_SQL = f"""
WITH s AS ({SNAP_SQL})
SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'sku_mismatch' WHEN page_id % 17 = 0 THEN 'no_validated_quantities' WHEN page_id % 19 = 0 THEN 'currency_mismatch' WHEN page_id % 23 = 0 THEN 'default_price_mismatch' END AS reason,
  CASE p_size % 4 WHEN 0 THEN 'pack' WHEN 1 THEN 'vial' ELSE 'tablet' END AS sold_as, CASE p_size % 4 WHEN 0 THEN '90' WHEN 1 THEN '10' WHEN 2 THEN '1' END AS content_quantity,
  CASE p_size % 4 WHEN 0 THEN 'tablet' WHEN 1 THEN 'ml' WHEN 2 THEN 'tablet' END AS content_unit,
  CASE WHEN page_id % 17 = 0 THEN '' ELSE '30:' || CAST(1000 + p_size AS VARCHAR) || ':in_stock,90:2500:' || CASE WHEN page_id % 2 = 0 THEN 'out_of_stock' ELSE 'unknown' END END AS tiers FROM s"""


def product_snapshots(t, deal=()):
    snap = t.sql(SNAP_SQL, deal)
    p = F.col("page_id")
    offer = lambda q, price, stock: F.struct(F.lit(q).alias("quantity"), price.alias("price"), F.when(p % 19 == 0, "EUR").otherwise("USD").alias("currency"), stock.alias("availability"))
    first = F.concat(F.lit("10."), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    shown = F.when(p % 23 == 0, "99.99").otherwise(first)
    panel = F.concat(F.lit("SKU: "), F.when(p % 13 == 0, "other").otherwise(F.col("sku")), F.lit("\nCount • Tablet / bottle\nSelected quantity: 30\nTotal price updated to $"), shown, F.lit("\n"))
    labels = F.when(p % 17 == 0, F.array(F.lit("Add to cart"))).otherwise(F.array(F.lit("Select quantity 30 units"), F.lit("Select quantity 90 units")))
    offers = F.array(
        offer("30", first, F.lit("https://schema.org/InStock")),
        offer("90", F.lit("25.00"), F.when(p % 2 == 0, "https://schema.org/SoldOut").otherwise("https://schema.org/PreOrder")),
        offer("365", F.lit("50.00"), F.lit("https://schema.org/InStock")),
    )
    return snap.select("page_id", "sku", "name", panel.alias("panel"), labels.alias("button_labels"), offers.alias("offers"))


def shown_offers(rows):
    tier = lambda x: F.concat_ws(":", x["quantity"], x["price_cents"].cast("string"), x["availability"])
    return plan.product_offers(rows).select(
        "page_id", "reason", "package.sold_as", "package.content_quantity", "package.content_unit",
        F.array_join(F.transform("tiers", tier), ",").alias("tiers"),
    )


@query("product_offers", "OBS-01", "SCL-21", "SCL-22", oracle=PRODUCT_OFFERS_SQL)
def product_offers(t):
    return shown_offers(product_snapshots(t))


@query("captured_offers", "SRC-04", "OBS-01", oracle=PRODUCT_OFFERS_SQL)
def captured_offers(t):
    """The same products as whole pages: parsed, then read as offers."""
    rows = product_snapshots(t, deal=("part",))
    offer = lambda o: F.struct(
        o["price"].alias("price"), o["currency"].alias("priceCurrency"), o["availability"].alias("availability"), F.struct(o["quantity"].alias("value")).alias("eligibleQuantity"))
    product = F.to_json(F.struct(F.lit("Product").alias("@type"), "sku", "name", F.transform("offers", offer).alias("offers")))
    lines = F.array_join(F.transform(F.split("panel", "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    buttons = F.array_join(F.transform("button_labels", lambda x: F.concat(F.lit('<button aria-label="'), x, F.lit('">+</button>'))), "")
    html = F.concat(
        F.lit('<html><head><title>t</title><script type="application/ld+json">'), product, F.lit("</script></head><body><main>"), lines, F.lit("</main>"), buttons, F.lit("</body></html>"))
    pages = rows.select("page_id", F.lit("https://shop.example.com/p").alias("url"), html.alias("html"))
    return shown_offers(plan.offer_snapshots(plan.page_snapshots(pages)))


CATALOG_SQL = """SELECT CASE WHEN p_partkey % 50 = 0 THEN 'bad' ELSE LPAD(CAST(p_partkey AS VARCHAR(11)), 11, '0') END AS ndc, p_partkey, p_name AS medication_name, CAST(5 * (1 + p_size % 4) AS VARCHAR(10)) || 'mg' AS strength, 'Tablet' AS form, CASE WHEN p_size % 3 = 0 THEN p_brand END AS brand_name, p_size FROM part"""


@query("catalogue_quotes", "OBS-03", oracle="""
SELECT CASE WHEN p_partkey % 50 = 0 THEN 'bad' ELSE LPAD(CAST(p_partkey AS VARCHAR), 11, '0') END AS ndc, v.q AS quantity, CASE WHEN p_partkey % 50 = 0 THEN 'invalid_catalogue_identity'
  WHEN p_partkey % 7 = 0 OR (p_partkey % 9 = 0 AND v.q = '30') OR p_partkey % 13 = 0 THEN 'ambiguous_or_missing_quote' WHEN p_partkey % 11 = 0 THEN 'quote_identity_mismatch' END AS reason,
  CASE WHEN p_partkey % 50 <> 0 AND p_partkey % 7 <> 0 AND NOT (p_partkey % 9 = 0 AND v.q = '30') AND p_partkey % 13 <> 0 AND p_partkey % 11 <> 0 THEN CAST(v.q AS BIGINT) * 10 + p_size END AS price_cents
FROM part CROSS JOIN (VALUES ('30'), ('90')) AS v(q)""")
def catalogue_quotes(t):
    rows = t.sql(CATALOG_SQL).withColumn("quantity", F.explode(F.array(F.lit("30"), F.lit("90"))))
    p = F.col("p_partkey")
    copies = F.when(p % 7 == 0, 2).when((p % 9 == 0) & (F.col("quantity") == "30"), 0).otherwise(1)
    cents_text = F.col("quantity").cast("long") * 10 + F.col("p_size")
    answers = rows.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))).select(
        "ndc", F.col("quantity").alias("requested_units"),
        F.concat((cents_text.cast("decimal(12,2)") / 100).cast("decimal(12,2)").cast("string")).alias("requested_quote"),
        F.when(p % 13 == 0, "no quote").alias("error_message"),
        "medication_name", F.when(p % 11 == 0, "1mg").otherwise(F.col("strength")).alias("strength"), "form", "brand_name",
    )
    return plan.catalogue_quotes(rows.drop("p_partkey", "p_size"), answers).select("ndc", "quantity", "reason", "price_cents")


@query("review_overlay", "OBS-04", oracle="""
SELECT listing_id, CASE WHEN listing_id % 3 = 0 THEN 'reviewed' ELSE content_unit END AS sold_as, CASE WHEN listing_id % 6 = 0 THEN NULL WHEN listing_id % 3 = 0 THEN 7 ELSE content_quantity END AS content_quantity,
  CASE WHEN listing_id % 3 = 0 THEN 'base=old,note=new,seen=yes' ELSE 'base=old,note=old' END AS metadata FROM b_listings""")
def review_overlay(t):
    base = t.listings.select(
        "listing_id", F.col("content_unit").alias("sold_as"), "content_quantity",
        F.create_map(F.lit("base"), F.lit("old"), F.lit("note"), F.lit("old")).alias("metadata"),
    )
    reviews = t.listings.where("listing_id % 3 = 0").select(
        "listing_id", F.lit("reviewed").alias("sold_as"),
        F.when(F.col("listing_id") % 6 != 0, 7).alias("content_quantity"), F.lit(True).alias("has_content_quantity"),
        F.create_map(F.lit("note"), F.lit("new"), F.lit("seen"), F.lit("yes")).alias("metadata"),
    )
    merged = plan.review_overlay(base, reviews, "listing_id", ["sold_as"], ["content_quantity"])
    line = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return merged.select("listing_id", "sold_as", "content_quantity", line.alias("metadata"))


@query("validate_observations", "OBS-05", oracle="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([CASE WHEN l_partkey % 101 = 0 THEN 'missing_identity' END, CASE WHEN l_partkey % 103 = 0 THEN 'invalid_observation_time' END,
  CASE WHEN l_suppkey % 50 = 7 THEN 'no_offers' END, CASE WHEN l_suppkey % 50 <> 7 AND l_partkey % 107 = 0 THEN 'invalid_quantity' END, CASE WHEN l_suppkey % 50 <> 7 AND l_partkey % 109 = 0 THEN 'invalid_cents' END,
  CASE WHEN l_suppkey % 50 <> 7 AND l_partkey % 113 = 0 THEN 'invalid_currency' END, CASE WHEN l_suppkey % 50 <> 7 AND l_partkey % 127 = 0 AND l_partkey % 109 <> 0 THEN 'missing_price' END,
  CASE WHEN l_suppkey % 50 <> 7 AND l_linenumber = 6 AND l_partkey % 107 <> 0 AND l_partkey % 113 <> 0 THEN 'duplicate_quantity_context' END], lambda v: v IS NOT NULL), ',') AS reasons FROM lineitem""")
def validate_observations(t):
    p = F.col("l_partkey")
    text = lambda v: F.lit(v)
    offer = lambda q, first: F.struct(
        (F.when(p % 107 == 0, "1e3").otherwise(q) if first else q).alias("quantity"),
        (F.when(p % 109 == 0, "12.5").when(p % 127 == 0, None).otherwise("1250") if first else text("990")).alias("price_cents"),
        (F.when(p % 113 == 0, "EUR").otherwise("USD") if first else text("USD")).alias("currency"),
        text("in_stock").alias("availability"), text("s").alias("seller_key"), text("l").alias("location_key"), text("cash").alias("program_key"),
    )
    second = F.when(F.col("l_linenumber") == 6, "30.0").otherwise("90")
    offers = F.array(offer(text("30"), True), offer(second, False))
    rows = t.spread("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(p % 101 == 0, "").otherwise("key").alias("source_product_key"), text("name").alias("source_name"),
        F.when(p % 103 != 0, F.col("l_shipdate")).alias("observed_at"), offers.alias("offers"),
    )
    none = F.filter("offers", lambda _: F.lit(False))
    rows = rows.withColumn("offers", F.when(F.col("l_suppkey") % 50 == 7, none).otherwise(F.col("offers")))
    return plan.observation_reasons(rows).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("reasons", ",").alias("reasons")
    )


@query("title_identity", "SCL-19", oracle="""
WITH x AS (SELECT p_partkey, p_name, p_size, CASE p_size % 5 WHEN 0 THEN p_name || ' (new) 20mg ER oral tablets' WHEN 1 THEN p_name || ' 10-25 mg tablet' WHEN 2 THEN p_name || ' 5 mg/5 mL solution for dogs' WHEN 3 THEN '30 mg tablets' ELSE p_name || ' Extended Release 2.5 % cream topical' END AS title FROM part)
SELECT p_partkey, CASE WHEN p_size % 5 IN (0, 2, 4) THEN p_name END AS name, CASE p_size % 5 WHEN 0 THEN '20mg' WHEN 2 THEN '5 mg/5 mL' WHEN 4 THEN '2.5 %' END AS strength, CASE p_size % 5 WHEN 0 THEN 'tablet' WHEN 2 THEN 'solution' WHEN 4 THEN 'cream' END AS form,
  CASE p_size % 5 WHEN 0 THEN 'oral' WHEN 4 THEN 'topical' END AS route, CASE p_size % 5 WHEN 0 THEN 'ER' WHEN 4 THEN 'Extended Release' END AS release_type, CASE p_size % 5 WHEN 2 THEN 'dog' WHEN 0 THEN '' WHEN 4 THEN '' END AS species FROM x""")
def title_identity(t):
    n, kind = F.col("p_name"), F.col("p_size") % 5
    title = (
        F.when(kind == 0, F.concat(n, F.lit(" (new) 20mg ER oral tablets")))
        .when(kind == 1, F.concat(n, F.lit(" 10-25 mg tablet")))
        .when(kind == 2, F.concat(n, F.lit(" 5 mg/5 mL solution for dogs")))
        .when(kind == 3, F.lit("30 mg tablets"))
        .otherwise(F.concat(n, F.lit(" Extended Release 2.5 % cream topical")))
    )
    rows = t.part.select("p_partkey", plan.title_identity(title, F.lit(None).cast("string")).alias("i"))
    return rows.select("p_partkey", "i.name", "i.strength", "i.form", "i.route", "i.release_type", F.array_join("i.species", ",").alias("species"))


DIRECTORY_SQL = """SELECT o_orderkey AS probe_id, 'https://dir.example.com/search?k=' || CAST(o_orderkey AS VARCHAR(12)) AS from_url,
  '<html><script>var rxSearchResults = {"drugResults":[{"drugId":"' || CAST(o_custkey % 50 AS VARCHAR(12)) || '","drugName":"drug ' || CAST(o_custkey % 50 AS VARCHAR(12)) || '"},{"drugId":"","drugName":"x"},{"drugId":"d' || CAST(o_orderkey % 400 AS VARCHAR(12)) || '","drugName":"other"}]};</script></html>' AS html FROM orders"""


@query("directory_sweep", "SRC-08", "SRC-09", oracle="""
WITH r AS (SELECT o_orderkey, CAST(o_custkey % 50 AS VARCHAR) AS id, 'drug ' || CAST(o_custkey % 50 AS VARCHAR) AS name FROM orders UNION ALL SELECT o_orderkey, 'd' || CAST(o_orderkey % 400 AS VARCHAR), 'other' FROM orders)
SELECT 'https://dir.example.com/details?drugId=' || id || '&drugName=' || REPLACE(name, ' ', '%20') AS url, MIN(o_orderkey) AS probe_id FROM r GROUP BY id, name""")
def directory_sweep(t):
    from quotegrain.sources.captures import directory_sightings, embedded_results

    results = embedded_results(t.sql(DIRECTORY_SQL))
    return directory_sightings(results, "https://dir.example.com/details").select("url", "probe_id")


@query("json_ld_products", "SCL-24", oracle="""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'sku-' || CAST(page_id AS VARCHAR) END AS sku FROM pages""")
def json_ld_products(t):
    """Pages with a product block added: one product in a graph for every third page, two for the next."""
    item = F.concat(F.lit('{"@type":["Thing","Product"],"sku":"sku-'), F.col("page_id").cast("string"), F.lit('"}'))
    items = F.when(F.col("page_id") % 3 == 0, item).when(F.col("page_id") % 3 == 1, F.concat(item, F.lit(","), item)).otherwise(F.lit('{"@type":"Offer"}'))
    block = F.concat(F.lit('<script type="application/ld+json">[{"@graph":['), items, F.lit("]}]</script></head>"))
    pages = t.spread("pages").withColumn("html", F.replace(F.col("html"), F.lit("</head>"), block))
    return plan.page_snapshots(pages).select("page_id", F.get_json_object("product", "$.sku").alias("sku"))
