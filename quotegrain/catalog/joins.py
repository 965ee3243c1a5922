"""Joins between lists, set operations and ordered picks."""

from pyspark.sql import functions as F

from quotegrain.catalog import query
from quotegrain.catalog.household import RX_SQL, rx
from quotegrain.catalog.status import PAGES_SQL, RUNS_SQL, crawl_pages, runs
from quotegrain.functions import vocab
from quotegrain.operators import fingerprint, ordered, redirects
from quotegrain.plans import frontier, matching
from quotegrain.session import spread
from quotegrain.sources.tables import OFFER_KEY, TIME_ORDER, as_of


@query("latest_evidence", "JOIN-05", oracle="""
WITH e AS (SELECT listing_id, 'evidence/' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS path,
  ROW_NUMBER() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn
  FROM b_observations WHERE availability = 'unknown')
SELECT l.listing_id, COALESCE(e.path, 'legacy://listing/' || CAST(l.listing_id AS VARCHAR)) AS evidence_path
FROM b_listings l LEFT JOIN e ON e.listing_id = l.listing_id AND e.rn = 1""")
def latest_evidence(t):
    path = F.concat(F.lit("evidence/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    seen = t.observations.where("availability = 'unknown'").withColumn("path", path)
    newest = ordered.latest(seen, ["listing_id"], TIME_ORDER, ["path"])
    default = F.concat(F.lit("legacy://listing/"), F.col("listing_id").cast("string"))
    return t.listings.select("listing_id").join(newest, "listing_id", "left").select(
        "listing_id", F.coalesce("path", default).alias("evidence_path")
    )


@query("manifest_semi", "JOIN-07", oracle="""
SELECT listing_id, source_id FROM b_listings WHERE match_status = 'verified' AND source_id < 2 AND medication_id % 3 = 0""")
def manifest_semi(t):
    manifest = t.listings.where("source_id < 2 AND medication_id % 3 = 0").select("source_id", "medication_id")
    return t.listings.where("match_status = 'verified'").join(manifest, ["source_id", "medication_id"], "left_semi").select(
        "listing_id", "source_id"
    )


@query("resolve_redirects", "JOIN-11", oracle="""
WITH RECURSIVE chain(requested, id, nxt, depth) AS (
  SELECT medication_id, medication_id, superseded_by_id, 0 FROM b_medications
  UNION ALL SELECT c.requested, m.medication_id, m.superseded_by_id, c.depth + 1
  FROM chain c JOIN b_medications m ON m.medication_id = c.nxt WHERE c.depth < 20)
SELECT requested AS medication_id, id AS resolved_id, CAST(depth AS BIGINT) AS depth FROM chain WHERE nxt IS NULL""")
def resolve_redirects(t):
    return redirects.resolve(t.medications, "medication_id", "superseded_by_id")


def drug_words(x):
    s = f"regexp_replace(REPLACE(REPLACE(LOWER({x}), '&', ';'), '%', ' '), '[^a-z0-9;.\\s-]', ' ', 'g')"
    words = vocab.DOSAGE_WORDS
    return f"TRIM(regexp_replace(regexp_replace({s}, '{words}', ' ', 'g'), '\\s+', ' ', 'g'))"


def drug_parts(x):
    one = drug_words("z")
    return f"list_sort(list_filter(list_transform(string_split({x}, ';'), lambda z: {one}), lambda z: z <> ''))"


ENTRY_SQL = """SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN REPLACE(p_name, ' ', ' 10 mg; ') ELSE p_name || ' oral tablet' END AS entry
FROM part"""
LABEL_SQL = "SELECT medication_id AS label_id, name || ' ' || strength || '/' || form || ' by ' || brand_name AS label FROM b_medications"


@query("scope_filter", "JOIN-15", "SCL-03", oracle=f"""
WITH e AS (SELECT DISTINCT {drug_parts('entry')} AS parts FROM ({ENTRY_SQL}) e0),
l AS (SELECT label_id, ' ' || {drug_words("regexp_replace(label, '[-/]', ' ', 'g')")} || ' ' AS words FROM ({LABEL_SQL}) l0)
SELECT label_id, MIN(array_to_string(parts, ';')) AS entry_key, COUNT(*) AS entries FROM l JOIN e ON len(parts) > 0
  AND len(list_filter(parts, lambda p: NOT CONTAINS(words, ' ' || p || ' '))) = 0 GROUP BY label_id""")
def scope_filter(t):
    return matching.scope_filter(spread(t.sql(LABEL_SQL)), t.sql(ENTRY_SQL))


SCOPE_SQL = """SELECT medication_id AS label_id, name || ' ' || strength AS label, CASE medication_id % 4 WHEN 0 THEN UPPER(name) || ' tablets' WHEN 1 THEN 'unlisted ' || CAST(medication_id AS VARCHAR(10)) END AS drug_name FROM b_medications"""


@query("in_scope", "IDN-12", oracle=f"""
WITH e AS (SELECT DISTINCT {drug_parts('entry')} AS parts FROM ({ENTRY_SQL}) e0),
l AS (SELECT label_id, array_to_string({drug_parts('drug_name')}, ';') AS key, ' ' || {drug_words("regexp_replace(label, '[-/]', ' ', 'g')")} || ' ' AS words FROM ({SCOPE_SQL}) l0),
n AS (SELECT DISTINCT label_id FROM l JOIN e ON len(parts) > 0 AND array_to_string(parts, ';') = key),
w AS (SELECT DISTINCT label_id FROM l JOIN e ON len(parts) > 0 AND len(list_filter(parts, lambda p: NOT CONTAINS(words, ' ' || p || ' '))) = 0)
SELECT label_id, 'name' AS by FROM n UNION ALL SELECT label_id, 'label' AS by FROM w WHERE label_id NOT IN (SELECT label_id FROM n)""")
def in_scope(t):
    return matching.in_scope(spread(t.sql(SCOPE_SQL)), t.sql(ENTRY_SQL))


RESULT_SQL = """SELECT o.o_orderkey AS search_id, w.p_name AS target, l.l_linenumber * 100000 + l.l_suppkey AS seq,
  CASE WHEN l.l_linenumber % 2 = 0 THEN r.p_name || ' tablets' ELSE REPLACE(r.p_name, ' ', ';') END AS drug_name
FROM orders o JOIN part w ON w.p_partkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part r ON r.p_partkey = l.l_partkey"""


@query("best_name_match", "JOIN-16", oracle=f"""
WITH r AS (SELECT search_id, seq, drug_name, {drug_parts('target')} AS tp, {drug_parts('drug_name')} AS rp FROM ({RESULT_SQL}) x0),
k AS (SELECT *, array_to_string(tp, ';') AS tk, array_to_string(rp, ';') AS rk FROM r),
s AS (SELECT *, CASE WHEN rk = tk THEN 0 WHEN len(list_filter(rp, lambda p: NOT CONTAINS(tk, p))) = 0 OR len(list_filter(tp, lambda p: NOT CONTAINS(rk, p))) = 0 THEN 1 END AS rank FROM k)
SELECT search_id, drug_name, rank, seq FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY search_id ORDER BY rank, seq, drug_name) AS rn FROM s WHERE rank IS NOT NULL) x WHERE rn = 1""")
def best_name_match(t):
    results = t.sql(RESULT_SQL)
    return matching.best_name_match(results)


PRODUCT_SQL = """SELECT p_name AS name, CAST(5 * (1 + p_size % 4) AS VARCHAR(10)) || ' MG' AS strength,
  'https://www.example.com/medications/' || CAST(CASE WHEN p_size % 2 = 0 THEN p_size % 4 ELSE p_partkey END AS VARCHAR(10)) AS url FROM part"""


@query("unique_link", "JOIN-17", "SCL-04", oracle=f"""
WITH rx AS ({RX_SQL}),
p AS (SELECT TRIM(regexp_replace(LOWER(name), '[^a-z0-9]+', ' ', 'g')) AS nk, regexp_replace(LOWER(strength), '\\s', '', 'g') AS sk, MIN(url) AS url
  FROM ({PRODUCT_SQL}) p0 GROUP BY 1, 2 HAVING COUNT(DISTINCT url) = 1)
SELECT r.line_id, r.medication_id, p.url FROM rx r JOIN p ON p.nk = TRIM(regexp_replace(LOWER(r.rx_name), '[^a-z0-9]+', ' ', 'g'))
  AND p.sk = regexp_replace(LOWER(r.rx_strength), '\\s', '', 'g')""")
def unique_link(t):
    return matching.link_lines(rx(t), t.sql(PRODUCT_SQL)).select("line_id", "medication_id", "url")


@query("evidence_orphans", "JOIN-18", oracle="""
WITH refs AS (SELECT DISTINCT 'data/evidence/' || CAST(l_orderkey AS VARCHAR) AS path FROM lineitem
  UNION SELECT DISTINCT 'data/evidence/run-' || CAST(event_id AS VARCHAR) FROM events),
kept AS (SELECT 'data/evidence/' || CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE o_orderkey % 50 <> 0
  UNION SELECT 'data/evidence/run-' || CAST(event_id AS VARCHAR) FROM events WHERE event_id % 99 <> 0)
SELECT path FROM refs EXCEPT SELECT path FROM kept""")
def evidence_orphans(t):
    from quotegrain.plans.quality import evidence_orphans as orphans

    local = lambda c: F.concat(F.lit("local://"), F.col(c).cast("string"))
    refs = [
        t.lineitem.select(local("l_orderkey").alias("ref")),
        t.events.select(F.concat(F.lit("storage://evidence/run-"), F.col("event_id").cast("string")).alias("ref")),
    ]
    path = lambda prefix, c: F.concat(F.lit(f"data/evidence/{prefix}"), F.col(c).cast("string")).alias("path")
    archive = t.orders.where("o_orderkey % 50 <> 0").select(path("", "o_orderkey")).unionByName(
        t.events.where("event_id % 99 <> 0").select(path("run-", "event_id"))
    )
    return orphans(refs, archive)


MANIFEST_SQL = """SELECT source_id, page_id, CASE WHEN page_id % 40 = 0 THEN url || '?moved' ELSE url END AS url,
  CASE WHEN page_id % 31 = 0 THEN 'other' ELSE 'key' || CAST(page_id AS VARCHAR(10)) END AS product_key FROM (SELECT page_id, page_id % 4 AS source_id, url FROM pages WHERE page_id % 3 = 0) m"""
STORED_PAGE_SQL = """SELECT page_id % 4 AS source_id, page_id, url, 'key' || CAST(page_id AS VARCHAR(10)) AS product_key,
  CASE WHEN page_id % 7 = 0 THEN 'needs_review' WHEN page_id % 13 = 0 THEN NULL ELSE 'verified' END AS match_status FROM pages WHERE page_id % 21 <> 0"""


@query("manifest_mismatch", "JOIN-19", oracle=f"""
WITH m AS ({MANIFEST_SQL}), s AS ({STORED_PAGE_SQL})
SELECT m.source_id, m.page_id, CASE WHEN s.url IS NULL THEN 'unknown_page' WHEN s.url <> m.url THEN 'url_changed' WHEN s.product_key <> m.product_key THEN 'product_changed' ELSE 'not_verified' END AS reason
FROM m LEFT JOIN s ON s.source_id = m.source_id AND s.page_id = m.page_id
WHERE s.url IS NULL OR s.url <> m.url OR s.product_key <> m.product_key OR s.match_status IS DISTINCT FROM 'verified'""")
def manifest_mismatch(t):
    found = frontier.manifest_problems(t.sql(MANIFEST_SQL), t.sql(STORED_PAGE_SQL))
    return found.select("source_id", "page_id", "reason")


READY_SQL = """page_type <> 'ignored' AND next_crawl_at <= TIMESTAMP '2001-06-30 00:00:00' AND ((last_success_at IS NULL AND last_result IS DISTINCT FROM 'not_found')
  OR next_crawl_at <= TIMESTAMP '2001-06-25 00:00:00')"""


@query("frontier_next", "SRT-02", "REL-07", oracle=f"""
WITH p AS ({PAGES_SQL}), r AS (SELECT *, CASE WHEN url LIKE '%/en/685' THEN 0 WHEN page_type = 'product' THEN 3 ELSE 1 END AS priority FROM p WHERE {READY_SQL})
SELECT source_id, page_id, priority, place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY priority, first_seen_at, page_id) AS place FROM r) x WHERE place <= 10""")
def frontier_next(t):
    seeds = ["https://thther.example.org/en/685"]
    batch = frontier.next_batch(crawl_pages(t), seeds, as_of(), 10, cutoff=as_of("2001-06-25 00:00:00"))
    return batch.select("source_id", "page_id", "priority", "place")


@query("frontier_due", "REL-07", oracle=f"""
WITH p AS ({PAGES_SQL}) SELECT source_id, COUNT(*) FILTER (WHERE page_type <> 'ignored' AND ((last_success_at IS NULL AND last_result IS DISTINCT FROM 'not_found')
  OR next_crawl_at <= TIMESTAMP '2001-06-25 00:00:00')) AS remaining FROM p GROUP BY source_id""")
def frontier_due(t):
    return frontier.remaining(crawl_pages(t), as_of(), as_of("2001-06-25 00:00:00"))


@query("next_due", "SCL-30", oracle="""
SELECT event_id, CASE WHEN event_type <> 'error' AND user_id % 3 = 0 THEN ts + INTERVAL 1 DAY WHEN event_type <> 'error' THEN ts + INTERVAL 7 DAY ELSE ts + INTERVAL 1 HOUR END AS next_crawl_at FROM events""")
def next_due(t):
    kind = F.when(F.col("user_id") % 3 == 0, "product").otherwise("content")
    return t.events.select("event_id", frontier.next_due(kind, F.col("event_type") != "error", F.col("ts")).alias("next_crawl_at"))


@query("representative_url", "SRT-03", oracle="""
SELECT host, page_id, url FROM (SELECT *, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, ROW_NUMBER() OVER (
  PARTITION BY regexp_extract(url, '^https?://([^/?#:]+)', 1) ORDER BY LENGTH(url), url, page_id) AS rn FROM pages) x WHERE rn = 1""")
def representative_url(t):
    hosts = t.pages.withColumn("host", F.regexp_extract("url", "^https?://([^/?#:]+)", 1))
    return frontier.representative_url(hosts, "host").select("host", "page_id", "url")


QUERY_SQL = """SELECT MIN(p_partkey) AS query_id, SUBSTRING(p_name, 1 + CAST(p_size % 4 AS INT), 3 + CAST(p_partkey % 4 AS INT)) AS query FROM part
GROUP BY SUBSTRING(p_name, 1 + CAST(p_size % 4 AS INT), 3 + CAST(p_partkey % 4 AS INT))
UNION ALL SELECT 1000000 + MIN(p_partkey) AS query_id, p_brand AS query FROM part GROUP BY p_brand"""


@query("scored_search", "SRT-04", "SCL-02", oracle=f"""
WITH qq AS (SELECT query_id, TRIM(regexp_replace(LOWER(query), '[^a-z0-9]+', ' ', 'g')) AS q FROM ({QUERY_SQL}) q0),
c AS (SELECT medication_id, name, TRIM(regexp_replace(LOWER(name), '[^a-z0-9]+', ' ', 'g')) AS n, TRIM(regexp_replace(LOWER(brand_name), '[^a-z0-9]+', ' ', 'g')) AS b FROM b_medications),
s AS (SELECT query_id, medication_id, name, CASE WHEN n = q THEN 0 WHEN starts_with(n, q) THEN 1 WHEN b = q THEN 2 WHEN starts_with(b, q) THEN 3 WHEN CONTAINS(n, q) THEN 4 WHEN CONTAINS(b, q) THEN 5 END AS score FROM qq JOIN c ON q <> '')
SELECT query_id, medication_id, name, score, place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score, name, medication_id) AS place FROM s WHERE score IS NOT NULL) x WHERE place <= 8""")
def scored_search(t):
    return matching.scored_search(t.medications, t.sql(QUERY_SQL), 8)


@query("first_n_distinct", "SRT-08", "RSH-04", oracle="""
WITH f AS (SELECT household_id, medication_id, MIN(prescription_id * 10 + line_no) AS first_seen FROM b_prescriptions GROUP BY ALL),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY household_id ORDER BY first_seen, medication_id) AS place FROM f)
SELECT household_id, medication_id, first_seen, CASE WHEN place <= 4 THEN place END AS place, CASE WHEN place <= 4 THEN 'selected' ELSE 'skipped_limit' END AS status FROM r""")
def first_n_distinct(t):
    rows = t.prescriptions.withColumn("position", F.col("prescription_id") * 10 + F.col("line_no"))
    return matching.first_n_distinct(rows, "household_id", "medication_id", "position", 4)


@query("union_priority", "SET-01", oracle="""
WITH u AS (SELECT p_name AS name, p_size % 4 AS strength, p_partkey AS id, 'stored' AS origin, 0 AS pr FROM part WHERE p_partkey % 9 = 0
  UNION ALL SELECT p_name, p_size % 4, p_partkey, 'catalogue', 1 FROM part)
SELECT name, strength, id, origin FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name, strength ORDER BY pr, id) AS rn FROM u) x WHERE rn = 1""")
def union_priority(t):
    rows = t.part.select(F.col("p_name").alias("name"), (F.col("p_size") % 4).alias("strength"), F.col("p_partkey").alias("id"))
    primary = rows.where("id % 9 = 0").select("*", F.lit("stored").alias("origin"), F.lit(0).alias("priority"))
    filling = rows.select("*", F.lit("catalogue").alias("origin"), F.lit(1).alias("priority"))
    both = primary.unionByName(filling)
    return ordered.earliest(both, ["name", "strength"], ["priority", "id"], ["id", "origin"])


@query("cohort_builder", "REL-11", oracle="""
WITH seeds AS (SELECT page_id % 4 AS source_id, url FROM pages WHERE page_id % 2 = 0 GROUP BY ALL),
pg AS (SELECT page_id, page_id % 4 AS source_id, url, CAST(page_id % 4 AS BIGINT) * 1000000000 + page_id AS listing_id FROM pages),
tiers AS (SELECT listing_id, array_to_string(list(DISTINCT quantity ORDER BY quantity), ',') AS planned FROM b_offers WHERE active GROUP BY listing_id)
SELECT p.page_id, p.source_id, p.listing_id, COALESCE(t.planned, '') AS planned FROM seeds s JOIN pg p ON p.source_id = s.source_id AND p.url = s.url LEFT JOIN tiers t ON t.listing_id = p.listing_id""")
def cohort_builder(t):
    pages = t.pages.select("page_id", (F.col("page_id") % 4).alias("source_id"), "url").withColumn(
        "listing_id", F.col("source_id") * 1000000000 + F.col("page_id")
    )
    seeds = pages.where("page_id % 2 = 0").select("source_id", "url").distinct()
    built = frontier.cohort(seeds, pages, t.offers)
    return built.select("page_id", "source_id", "listing_id", F.array_join("planned_quantities", ",").alias("planned"))


@query("attempt_state", "REL-06", oracle=f"""
WITH r AS ({RUNS_SQL}), a AS (SELECT source_id, channel, COUNT(*) AS attempts, MAX(run_id % 100) AS furthest FROM r WHERE started_at < TIMESTAMP '2024-01-01 02:00:00' GROUP BY ALL),
n AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id, channel ORDER BY started_at DESC, run_id DESC) AS rn FROM r) x WHERE rn = 1)
SELECT n.source_id * 10 + CASE n.channel WHEN 'api' THEN 1 ELSE 0 END AS source_id, CASE WHEN n.status = 'partial' THEN 'paused' WHEN COALESCE(a.furthest, 0) >= 100 THEN 'already_attempted_full_cohort'
  WHEN COALESCE(a.attempts, 0) >= 3 THEN 'process_restart_limit_reached' ELSE 'may_start' END AS state, COALESCE(a.attempts, 0) AS attempts
FROM n LEFT JOIN a ON a.source_id = n.source_id AND a.channel = n.channel""")
def attempt_state(t):
    lane = F.col("source_id") * 10 + F.when(F.col("channel") == "api", 1).otherwise(0)
    rows = runs(t).withColumn("source_id", lane).withColumn("manifest_index", F.col("run_id") % 100)
    newest = ordered.latest(rows, ["source_id"], ["started_at", "run_id"], ["status"])
    newest = newest.withColumn("paused", F.col("status") == "partial")
    window = rows.where(F.col("started_at") < as_of("2024-01-01 02:00:00"))
    return frontier.attempt_state(window, newest, 100, 3)


@query("discovery_due", "REL-08", oracle=f"""
WITH r AS ({RUNS_SQL}), p AS ({PAGES_SQL}),
n AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rn FROM r) x WHERE rn = 1),
d AS (SELECT source_id, MAX(finished_at) AS done_at FROM r WHERE status = 'succeeded' GROUP BY source_id),
m AS (SELECT source_id, COUNT(*) FILTER (WHERE page_type <> 'ignored' AND last_success_at IS NULL AND last_result IS DISTINCT FROM 'not_found') AS remaining FROM p GROUP BY source_id),
j AS (SELECT s.source_id, COALESCE(n.status IN ('partial', 'interrupted', 'running', 'failed'), FALSE) AS resume, COALESCE(m.remaining, 0) AS remaining,
  COALESCE(d.done_at > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 7 DAY, FALSE) AS recent, COALESCE(n.run_id % 2 = 0, FALSE) AS had_cutoff
  FROM b_sources s LEFT JOIN n ON n.source_id = s.source_id LEFT JOIN d ON d.source_id = s.source_id LEFT JOIN m ON m.source_id = s.source_id)
SELECT source_id, CASE WHEN NOT resume AND remaining = 0 AND recent THEN 'weekly_discovery_not_due' WHEN CASE WHEN resume THEN had_cutoff ELSE remaining = 0 END THEN 'refresh_due' ELSE 'initial' END AS decision FROM j""")
def discovery_due(t):
    left = frontier.remaining(crawl_pages(t), as_of())
    rows = runs(t).withColumn("had_cutoff", F.col("run_id") % 2 == 0)
    return frontier.discovery_due(t.sources, rows, left, as_of("2024-01-10 00:00:00"))


@query("table_fingerprint", "AGG-13", "REL-02", oracle="""
SELECT 'offers' AS table_name, CAST(COUNT(*) AS BIGINT) AS rows, TRUE AS stable FROM b_offers
UNION ALL SELECT 'sources' AS table_name, CAST(COUNT(*) AS BIGINT) AS rows, TRUE AS stable FROM b_sources""")
def table_fingerprint(t):
    """The digest itself has no SQL twin; it must not move when the rows are dealt out differently."""
    one = fingerprint.snapshot({"offers": (t.offers, None), "sources": (t.sources, None)})
    two = fingerprint.snapshot({"offers": (t.offers.repartition(7, "quantity"), None), "sources": (t.sources.repartition(3), None)})
    other = two.select("table_name", F.col("digest").alias("again"))
    return one.join(other, "table_name").select("table_name", "rows", (F.col("digest") == F.col("again")).alias("stable"))


@query("reconcile", "SET-06", "BKF-06", "DQ-05", oracle="""
SELECT 'offers' AS table_name, CAST(COUNT(*) AS BIGINT) AS before_rows, CAST(COUNT(*) AS BIGINT) AS after_rows, TRUE AS same_count, TRUE AS same_content FROM b_offers
UNION ALL SELECT 'listings', COUNT(*), COUNT(*), TRUE, FALSE FROM b_listings
UNION ALL SELECT 'listings_immutable', COUNT(*), COUNT(*), TRUE, TRUE FROM b_listings""")
def reconcile(t):
    keep = ["listing_id", "source_id", "content_quantity", "content_unit"]
    moved = t.listings.withColumn("match_status", F.when(F.col("listing_id") % 97 == 0, "needs_review").otherwise(F.col("match_status")))
    before = {"offers": (t.offers, None), "listings": (t.listings, None), "listings_immutable": (t.listings, keep)}
    after = {"offers": (t.offers, None), "listings": (moved, None), "listings_immutable": (moved, keep)}
    return fingerprint.reconcile(fingerprint.snapshot(before), fingerprint.snapshot(after))


@query("version_differences", "SET-06", "DQ-05", oracle="""
SELECT listing_id, quantity, price_cents, 'removed' AS side FROM b_offers WHERE listing_id % 101 = 0
UNION ALL SELECT listing_id, quantity, price_cents + 1 AS price_cents, 'added' AS side FROM b_offers WHERE listing_id % 101 = 0 AND price_cents IS NOT NULL
UNION ALL SELECT listing_id, quantity, 0 AS price_cents, 'added' AS side FROM b_offers WHERE listing_id % 101 = 0 AND price_cents IS NULL""")
def version_differences(t):
    old = t.offers.select("listing_id", "quantity", "price_cents")
    bumped = F.when(F.col("listing_id") % 101 == 0, F.coalesce(F.col("price_cents") + 1, F.lit(0))).otherwise(F.col("price_cents"))
    return fingerprint.differences(old, old.withColumn("price_cents", bumped.cast(old.schema["price_cents"].dataType)), OFFER_KEY)


@query("collection_plan_digest", "REL-02", "AGG-13", oracle="""
WITH h AS (SELECT sha256('{"listing_id":' || CAST(listing_id AS VARCHAR) || ',"source_id":' || CAST(source_id AS VARCHAR) || '}') AS h FROM b_listings),
g AS (SELECT SUBSTR(h, 1, 4) AS g, COUNT(*) AS n, SUM(CAST(CAST('0x' || SUBSTR(h, 1, 12) AS BIGINT) AS HUGEINT)) AS s0, SUM(CAST(CAST('0x' || SUBSTR(h, 13, 12) AS BIGINT) AS HUGEINT)) AS s1,
  SUM(CAST(CAST('0x' || SUBSTR(h, 25, 12) AS BIGINT) AS HUGEINT)) AS s2, SUM(CAST(CAST('0x' || SUBSTR(h, 37, 12) AS BIGINT) AS HUGEINT)) AS s3, SUM(CAST(CAST('0x' || SUBSTR(h, 49, 12) AS BIGINT) AS HUGEINT)) AS s4 FROM h GROUP BY 1),
x AS (SELECT n, g || ':' || n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3 || ':' || s4 AS line FROM g)
SELECT CAST(SUM(n) AS BIGINT) AS listings, sha256(array_to_string(list(line ORDER BY line), chr(10))) AS digest FROM x""")
def collection_plan_digest(t):
    rows = t.listings.select("source_id", "listing_id")
    return fingerprint.table_fingerprint(rows, "manifest").select(F.col("rows").alias("listings"), "digest")
