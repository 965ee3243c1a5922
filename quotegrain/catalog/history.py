"""Change detection, late rows, retirement, replay and the full ingest."""

from pyspark.sql import functions as F

from quotegrain.catalog import query
from quotegrain.operators import ordered
from quotegrain.plans import history as plan
from quotegrain.plans import ingest
from quotegrain.sources import observations, releases
from quotegrain.sources.tables import ARRIVAL_ORDER, OFFER_KEY, TIME_ORDER, as_of
from quotegrain.streaming import ingest as streaming

BY_TIME = "PARTITION BY listing_id, quantity ORDER BY observed_at, l_orderkey, l_linenumber, l_suppkey"
BY_ARRIVAL = "PARTITION BY listing_id, quantity ORDER BY l_orderkey, l_linenumber, l_suppkey"
ROW = ["listing_id", "quantity", "observed_at", "l_orderkey", "l_linenumber", "l_suppkey"]
ROW_SQL = ", ".join(ROW)


@query("price_changes", "WIN-03", oracle=f"""
SELECT {ROW_SQL}, price_cents, availability, active FROM (
  SELECT *, ROW_NUMBER() OVER w AS rn, LAG(price_cents) OVER w AS pp, LAG(availability) OVER w AS pa, LAG(active) OVER w AS pv
  FROM b_observations WINDOW w AS ({BY_TIME})) x
WHERE rn = 1 OR price_cents IS DISTINCT FROM pp OR availability IS DISTINCT FROM pa OR active IS DISTINCT FROM pv""")
def price_changes(t):
    rows = plan.price_changes(t.observations, OFFER_KEY, TIME_ORDER)
    return rows.select(*ROW, "price_cents", "availability", "active")


@query("late_observations", "WIN-04", oracle=f"""
SELECT {ROW_SQL}, newest_before FROM (SELECT *, MAX(observed_at) OVER (
  {BY_ARRIVAL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest_before FROM b_observations) x
WHERE newest_before > observed_at""")
def late_observations(t):
    rows = plan.late_rows(t.observations, OFFER_KEY, ARRIVAL_ORDER)
    return rows.where("late").select(*ROW, "newest_before")


@query("price_timeline", "WIN-08", oracle=f"""
SELECT {ROW_SQL}, price_cents, LAG(price_cents) OVER w AS previous_cents, price_cents - LAG(price_cents) OVER w AS delta_cents,
  LEAD(observed_at) OVER w AS valid_to FROM b_observations WINDOW w AS ({BY_TIME})""")
def price_timeline(t):
    rows = plan.timeline(t.observations, OFFER_KEY, TIME_ORDER)
    return rows.select(*ROW, "price_cents", "previous_cents", "delta_cents", "valid_to")


@query("keep_last", "WIN-09", oracle=f"""
SELECT {ROW_SQL}, price_cents FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY listing_id, quantity
  ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn FROM b_observations) x WHERE rn = 1""")
def keep_last(t):
    return ordered.latest(t.observations, OFFER_KEY, ARRIVAL_ORDER, [*ROW, "price_cents"])


@query("offers_as_of", "ING-05", oracle="""
SELECT listing_id, quantity, price_cents, availability, active, observed_at FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY listing_id, quantity
    ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn
  FROM b_observations WHERE observed_at <= TIMESTAMP '1999-12-31 00:00:00') x WHERE rn = 1""")
def offers_as_of(t):
    columns = ["price_cents", "availability", "active", "observed_at"]
    return plan.state_as_of(t.observations, OFFER_KEY, TIME_ORDER, as_of("1999-12-31 00:00:00"), columns)


@query("conflicting_states", "ING-03", oracle="""
SELECT listing_id, quantity, run_month, COUNT(*) AS states FROM (
  SELECT DISTINCT listing_id, quantity, run_month, price_cents, availability, active FROM b_observations) x
GROUP BY listing_id, quantity, run_month HAVING COUNT(*) > 1""")
def conflicting_states(t):
    found = plan.conflicting_states(t.observations, OFFER_KEY, "run_month")
    return found.withColumn("run_month", F.col("run_month").cast("timestamp_ntz"))


@query("upsert_state", "SNK-01", oracle="SELECT * FROM b_offers")
def upsert_state(t):
    """A stored state, a batch merged into it, and the state that readers find after it was published."""
    cut, values = as_of("1999-12-31 00:00:00"), ["price_cents", "availability", "active", "observed_at"]
    root = streaming.new_root(t.spark, "offers")
    first = releases.replace(t.spark, root, {"offers": plan.state_as_of(t.observations, OFFER_KEY, TIME_ORDER, cut, values)}, None)
    batch = t.observations.where(F.col("observed_at") > cut)
    new = plan.state_as_of(batch, OFFER_KEY, TIME_ORDER, as_of(), values)
    merged = plan.upsert_state(releases.read(t.spark, first, "offers"), new, OFFER_KEY, values)
    releases.replace(t.spark, root, {"offers": merged}, first)
    return releases.read(t.spark, releases.load(t.spark, root), "offers").withColumnRenamed("observed_at", "last_checked_at")


@query("insert_if_absent", "SNK-06", oracle="""
SELECT DISTINCT listing_id, quantity FROM b_observations o WHERE observed_at > TIMESTAMP '1999-12-31 00:00:00'
AND NOT EXISTS (SELECT 1 FROM b_observations p WHERE p.listing_id = o.listing_id AND p.quantity = o.quantity
  AND p.observed_at <= TIMESTAMP '1999-12-31 00:00:00')""")
def insert_if_absent(t):
    cut = as_of("1999-12-31 00:00:00")
    keys = t.observations.select(*OFFER_KEY, "observed_at")
    old, new = keys.where(F.col("observed_at") <= cut), keys.where(F.col("observed_at") > cut)
    return plan.insert_if_absent(old, new.select(*OFFER_KEY).distinct(), OFFER_KEY)


@query("history_audit", "ING-06", oracle="""
WITH ranked AS (SELECT *, observed_at <= TIMESTAMP '1999-12-31 00:00:00' AS early, ROW_NUMBER() OVER (PARTITION BY listing_id, quantity, observed_at <= TIMESTAMP '1999-12-31 00:00:00'
  ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn FROM b_observations),
old AS (SELECT * FROM ranked WHERE early AND rn = 1), run AS (SELECT * FROM ranked WHERE NOT early AND rn = 1),
j AS (SELECT r.listing_id, r.quantity, o.listing_id IS NOT NULL AS known, o.listing_id IS NULL OR o.price_cents IS DISTINCT FROM r.price_cents OR o.availability IS DISTINCT FROM r.availability
  OR o.active IS DISTINCT FROM r.active AS differs FROM run r LEFT JOIN old o ON o.listing_id = r.listing_id AND o.quantity = r.quantity),
k AS (SELECT *, CASE WHEN differs AND listing_id % 10 <> 1 THEN CASE WHEN listing_id % 10 = 2 THEN 2 ELSE 1 END WHEN NOT differs AND listing_id % 10 = 3 THEN 1 ELSE 0 END AS n FROM j)
SELECT listing_id, quantity, CASE WHEN differs AND n = 0 THEN 'missing_history' WHEN differs AND n > 1 THEN 'repeated_history' WHEN NOT differs AND n > 0 THEN 'needless_history' ELSE 'check_time_not_refreshed' END AS problem,
  CAST(n AS BIGINT) AS history_rows FROM k WHERE (differs AND n <> 1) OR (NOT differs AND n > 0) OR (known AND listing_id % 10 = 4)""")
def history_audit(t):
    """One run over every offer seen after the cut. Its history lacks, repeats or adds rows, and some check times stand still."""
    cut, values = as_of("1999-12-31 00:00:00"), [*plan.STATE, "observed_at"]
    before = plan.state_as_of(t.observations, OFFER_KEY, TIME_ORDER, cut, values)
    run = ordered.latest(t.observations.where(F.col("observed_at") > cut), OFFER_KEY, TIME_ORDER, values)
    was = before.select(*OFFER_KEY, F.struct(*plan.STATE).alias("_was"), F.col("observed_at").alias("_checked"))
    met = run.join(was, OFFER_KEY, "left")
    kind = F.col("listing_id") % 10
    changed = ~F.col("_was").eqNullSafe(F.struct(*plan.STATE))
    copies = F.when(changed & (kind != 1), F.when(kind == 2, 2).otherwise(1)).when(~changed & (kind == 3), 1).otherwise(0)
    recorded = met.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*OFFER_KEY)
    stood = met.withColumn("observed_at", F.when((kind == 4) & F.col("_checked").isNotNull(), F.col("_checked")).otherwise(F.col("observed_at")))
    after = plan.upsert_state(before, stood.select(*OFFER_KEY, *values), OFFER_KEY, values)
    return plan.history_audit(before, after, recorded, OFFER_KEY, run, "observed_at")


RUN_CHECK_SQL = """SELECT DISTINCT run_month, CAST(l_suppkey % 4 AS BIGINT) AS offer_source,
  CASE WHEN EXTRACT(MONTH FROM run_month) = 6 AND l_suppkey % 4 = 1 THEN 2 ELSE CAST(l_suppkey % 4 AS BIGINT) END AS run_source,
  CASE WHEN EXTRACT(MONTH FROM run_month) = 7 THEN 'succeeded' ELSE 'running' END AS status FROM b_observations"""


@query("run_source_check", "ING-02", "DQ-04", oracle=f"""
WITH runs AS ({RUN_CHECK_SQL})
SELECT o.listing_id, o.quantity, o.l_orderkey, o.l_linenumber, CASE WHEN r.run_source <> o.l_suppkey % 4 THEN 'source_mismatch' ELSE 'run_not_running' END AS reason
FROM b_observations o JOIN runs r ON r.run_month = o.run_month AND r.offer_source = o.l_suppkey % 4
WHERE r.run_source <> o.l_suppkey % 4 OR r.status <> 'running'""")
def run_source_check(t):
    runs = t.sql(RUN_CHECK_SQL)
    obs = t.observations.withColumn("offer_source", (F.col("l_suppkey") % 4).cast("long"))
    joined = obs.join(runs, ["run_month", "offer_source"], "left")
    reason = (
        F.when(F.col("run_source").isNull(), "unknown_run")
        .when(F.col("run_source") != F.col("offer_source"), "source_mismatch")
        .when(F.col("status") != "running", "run_not_running")
    )
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select(
        "listing_id", "quantity", "l_orderkey", "l_linenumber", "reason"
    )


def nest_row(observations, carried=()):
    """Nested observations as capture writes them: tiers up to the ordered amount, some identity drift. Columns of ``carried`` stay."""
    obs = observations.withColumnRenamed("quantity", "top_quantity")
    offer = lambda q: F.when(
        F.col("top_quantity") >= q,
        F.struct(
            F.lit(q).cast("long").alias("quantity"),
            F.when(F.col("price_cents").isNotNull(), F.col("price_cents") + q).cast("long").alias("price_cents"),
            "availability",
            "active",
            F.lit(None).cast("string").alias("terms"),
            F.lit(None).cast("timestamp_ntz").alias("valid_until"),
        ),
    )
    tiers = F.filter(F.array(offer(30), offer(60), offer(90)), lambda x: x.isNotNull())
    part = F.col("l_partkey").cast("string")
    drift = F.when((F.col("l_partkey") % 7 == 0) & (F.col("l_linenumber") == 7), F.concat(F.lit("other "), part))
    brand = F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("brand "), (F.col("l_linenumber") % 2).cast("string")))
    return obs.select(
        "listing_id",
        "l_orderkey", "l_linenumber", "l_suppkey",
        "observed_at",
        F.col("run_month").alias("run_id"),
        (F.col("l_linenumber") % 2 == 0).alias("complete"),
        F.coalesce(drift, F.concat(F.lit("product "), part)).alias("source_name"),
        F.lit("bottle").alias("sold_as"),
        F.lit(1).cast("long").alias("content_quantity"),
        F.lit("tablet").alias("content_unit"),
        F.when(F.col("l_partkey") % 5 == 0, brand).alias("brand_name"),
        tiers.alias("offers"),
        *carried,
    )


#: Documents of one packed file.
DOCUMENTS_PER_FILE = 500_000


def nested_observations(t):
    return nest_row(t.observations)


def number_arrivals(rows):
    """Give each observation of a listing its arrival number. Some lines agree in all of the arrival order; their times tell them apart."""
    return ingest.number_arrivals(rows, [*ARRIVAL_ORDER, "observed_at"])


def arrivals(t):
    """Numbered first: a flat row is a third of a nested one."""
    return nest_row(number_arrivals(t.observations), ["seq"])


@query("obs_flatten", "SRC-02", oracle="""
SELECT o.listing_id, o.l_orderkey, o.l_linenumber, o.l_suppkey, v.q AS quantity, o.price_cents + v.q AS price_cents, o.availability, o.active
FROM b_observations o JOIN (VALUES (30), (60), (90)) AS v(q) ON v.q <= o.quantity""")
def obs_flatten(t):
    """Observations as JSON documents in files, read with the fixed schema of the captures and taken apart."""
    path = streaming.new_root(t.spark, "documents")
    # The text repeats its field names on every line. A packed file is read by one task, so none gets long.
    nested_observations(t).write.option("compression", "gzip").option("maxRecordsPerFile", DOCUMENTS_PER_FILE).json(path)
    rows = observations.flatten(observations.read(t.spark, path, "l_orderkey long, l_linenumber long, l_suppkey long"), ARRIVAL_ORDER)
    return rows.select("listing_id", *ARRIVAL_ORDER, "quantity", "price_cents", "availability", "active")


# Sequential semantics in SQL: walk each listing in arrival order with its stored identity and time.
WALK_SQL = """
obs AS (SELECT listing_id, ROW_NUMBER() OVER (PARTITION BY listing_id ORDER BY l_orderkey, l_linenumber, l_suppkey, observed_at) AS seq,
  observed_at, run_month, quantity AS top_quantity, price_cents, availability, active, l_linenumber % 2 = 0 AS complete,
  CASE WHEN l_partkey % 7 = 0 AND l_linenumber = 7 THEN 'other ' ELSE 'product ' END AS name,
  CASE WHEN l_partkey % 5 = 0 AND l_linenumber % 3 <> 0 THEN l_linenumber % 2 END AS brand FROM b_observations),
walk(listing_id, seq, outcome, name, brand, t) AS (
  SELECT listing_id, seq, 'accepted', name, brand, observed_at FROM obs WHERE seq = 1
  UNION ALL
  SELECT o.listing_id, o.seq,
    CASE WHEN w.t > o.observed_at THEN 'older_observation' WHEN o.name <> w.name OR COALESCE(o.brand <> w.brand, FALSE) THEN 'identity_conflict' ELSE 'accepted' END,
    CASE WHEN w.t > o.observed_at OR o.name <> w.name OR COALESCE(o.brand <> w.brand, FALSE) THEN w.name ELSE o.name END,
    CASE WHEN w.t > o.observed_at OR o.name <> w.name OR COALESCE(o.brand <> w.brand, FALSE) THEN w.brand ELSE o.brand END,
    CASE WHEN w.t > o.observed_at OR o.name <> w.name OR COALESCE(o.brand <> w.brand, FALSE) THEN w.t ELSE o.observed_at END
  FROM walk w JOIN obs o ON o.listing_id = w.listing_id AND o.seq = w.seq + 1)"""

# Then every (accepted observation, offer of the listing) pair the reference would have touched.
STATE_SQL = WALK_SQL + """,
acc AS (SELECT o.* FROM obs o JOIN walk w ON w.listing_id = o.listing_id AND w.seq = o.seq WHERE w.outcome = 'accepted'),
seen AS (SELECT a.listing_id, v.q AS quantity, a.seq, a.observed_at, a.price_cents + v.q AS price_cents, a.availability, a.active
  FROM acc a JOIN (VALUES (30), (60), (90)) AS v(q) ON v.q <= a.top_quantity),
touched AS (SELECT a.listing_id, k.quantity, a.seq, a.observed_at, s.price_cents, s.availability, s.active, s.seq IS NOT NULL AS present
  FROM acc a JOIN (SELECT listing_id, quantity, MIN(seq) AS first_seq FROM seen GROUP BY ALL) k ON k.listing_id = a.listing_id AND k.first_seq <= a.seq
  LEFT JOIN seen s ON s.listing_id = a.listing_id AND s.quantity = k.quantity AND s.seq = a.seq
  WHERE s.seq IS NOT NULL OR a.complete),
filled AS (SELECT listing_id, quantity, seq, observed_at, present,
  LAST_VALUE(price_cents) OVER w AS raw_price, SUM(CASE WHEN present THEN 1 ELSE 0 END) OVER w AS grp, price_cents, availability, active
  FROM touched WINDOW w AS (PARTITION BY listing_id, quantity ORDER BY seq)),
states AS (SELECT listing_id, quantity, seq, observed_at, present, FIRST_VALUE(price_cents) OVER g AS price_cents,
  FIRST_VALUE(availability) OVER g AS availability, CASE WHEN present THEN active ELSE FALSE END AS active, FIRST_VALUE(active) OVER g AS was_active,
  ROW_NUMBER() OVER g AS in_grp FROM filled WINDOW g AS (PARTITION BY listing_id, quantity, grp ORDER BY seq)),
kept AS (SELECT * FROM states WHERE present OR (was_active AND in_grp = 2))"""


@query("ingest_decisions", "ING-01", "IDN-09", oracle=f"""
WITH RECURSIVE {WALK_SQL} SELECT listing_id, seq, outcome FROM walk""")
def ingest_decisions(t):
    return ingest.decide(arrivals(t)).select("listing_id", "seq", "outcome")


# Decisions of a product over time: a first one, later ones that name another identity or none. Runs by month and source.
DECISIONS_SQL = """SELECT p_partkey AS product, TIMESTAMP '1990-01-01 00:00:00' AS observed_at, 'verified' AS decision_status, 'rxnorm:' || CAST(p_partkey % 1100 AS VARCHAR(10)) AS decision_key FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, TIMESTAMP '1996-03-01 00:00:00', CASE WHEN p_partkey % 4 = 1 THEN 'needs_review' ELSE 'verified' END, CASE WHEN p_partkey % 4 <> 1 THEN 'rxnorm:' || CAST(p_partkey % 1100 + p_partkey % 2 AS VARCHAR(10)) END
FROM part WHERE p_partkey % 5 = 0"""
INGEST_RUNS_SQL = """SELECT CAST(run_month AS VARCHAR(30)) || '/' || CAST(s AS VARCHAR(5)) AS run_id, CASE WHEN s = 2 AND EXTRACT(YEAR FROM run_month) = 1997 AND EXTRACT(MONTH FROM run_month) = 2 THEN 1 ELSE s END AS source_id,
  CASE WHEN EXTRACT(MONTH FROM run_month) = 9 AND s = 1 THEN 'succeeded' ELSE 'running' END AS status FROM (SELECT DISTINCT run_month, CAST(l_suppkey % 4 AS BIGINT) AS s FROM b_observations) m"""
OUTCOMES_SQL = f"""
runs AS ({INGEST_RUNS_SQL}), decisions AS ({DECISIONS_SQL}),
arrived AS (SELECT listing_id, ROW_NUMBER() OVER (PARTITION BY listing_id ORDER BY l_orderkey, l_linenumber, l_suppkey, observed_at) AS seq, observed_at, l_partkey, l_linenumber,
  CASE WHEN l_partkey % 7 = 0 AND l_linenumber = 7 THEN 'other ' ELSE 'product ' END AS name, CASE WHEN l_partkey % 5 = 0 AND l_linenumber % 3 <> 0 THEN l_linenumber % 2 END AS brand,
  CASE WHEN l_partkey % 101 = 0 AND l_linenumber = 2 THEN 'missing_identity' WHEN r.source_id IS DISTINCT FROM l_suppkey % 4 OR r.status <> 'running' THEN 'invalid_observation_run' END AS problem
  FROM b_observations o LEFT JOIN runs r ON r.run_id = CAST(o.run_month AS VARCHAR(30)) || '/' || CAST(o.l_suppkey % 4 AS VARCHAR(5))),
dec AS (SELECT *, LEAD(observed_at) OVER (PARTITION BY product ORDER BY observed_at) AS until FROM decisions),
obs AS (SELECT a.*, CASE WHEN l_linenumber % 4 <> 0 THEN d.decision_status END AS ds, CASE WHEN l_linenumber % 4 <> 0 THEN d.decision_key END AS dk,
  ROW_NUMBER() OVER (PARTITION BY a.listing_id ORDER BY seq) AS n FROM arrived a LEFT JOIN dec d ON d.product = a.l_partkey AND d.observed_at <= a.observed_at AND (d.until IS NULL OR d.until > a.observed_at) WHERE problem IS NULL),
walk(listing_id, n, seq, outcome, name, brand, k, t) AS (
  SELECT listing_id, n, seq, 'accepted', name, brand, CASE WHEN ds = 'verified' THEN dk END, observed_at FROM obs WHERE n = 1
  UNION ALL
  SELECT listing_id, n, seq, outcome, CASE WHEN outcome = 'accepted' THEN name ELSE oname END, CASE WHEN outcome = 'accepted' THEN brand ELSE obrand END,
    CASE WHEN outcome = 'accepted' THEN COALESCE(ok, CASE WHEN ds = 'verified' THEN dk END) ELSE ok END, CASE WHEN outcome = 'accepted' THEN observed_at ELSE ot END FROM (
    SELECT o.listing_id, o.n, o.seq, o.name, o.brand, o.ds, o.dk, o.observed_at, w.name AS oname, w.brand AS obrand, w.k AS ok, w.t AS ot,
      CASE WHEN w.t > o.observed_at THEN 'older_observation' WHEN o.name <> w.name OR COALESCE(o.brand <> w.brand, FALSE) OR (w.k IS NOT NULL AND o.ds IS NOT NULL AND o.dk IS DISTINCT FROM w.k)
        THEN 'identity_conflict' ELSE 'accepted' END AS outcome
    FROM walk w JOIN obs o ON o.listing_id = w.listing_id AND o.n = w.n + 1) x)"""


def full_arrivals(t):
    """Arrivals with everything an ingest may refuse them for: own defects, their runs, the decisions of their time."""
    rows = t.observations.withColumnRenamed("run_month", "run_id").withColumns({
        "product": F.col("listing_id") % 1_000_000_000, "source_id": F.floor(F.col("listing_id") / 1_000_000_000).cast("long"), "source_product_key": F.lit("key")})
    broken = (F.col("product") % 101 == 0) & (F.col("l_linenumber") == 2)
    rows = rows.withColumns({
        "source_product_key": F.when(~broken, F.col("source_product_key")).otherwise(""),
        "run_id": F.concat_ws("/", F.col("run_id").cast("date").cast("string"), F.col("source_id").cast("string"))})
    rows = rows.withColumn("problem", F.when(F.col("source_product_key") == "", "missing_identity"))
    runs = t.sql(INGEST_RUNS_SQL).withColumn("run_id", F.regexp_replace("run_id", " 00:00:00", ""))
    rows = ingest.run_problem(rows, runs)
    rows = ingest.decided_as_of(rows, t.sql(DECISIONS_SQL), ["product"], ["listing_id", *ARRIVAL_ORDER])
    asked = F.col("l_linenumber") % 4 != 0
    rows = number_arrivals(rows.withColumns({c: F.when(asked, F.col(c)) for c in ingest.DECISION}))
    return nest_row(rows.withColumnRenamed("run_id", "run_month"), ["seq", "problem", *ingest.DECISION])


@query("ingest_outcomes", "ING-01", "IDN-09", "ING-02", "OBS-05", oracle=f"""
WITH RECURSIVE {OUTCOMES_SQL} SELECT listing_id, seq, outcome FROM walk UNION ALL SELECT listing_id, seq, problem AS outcome FROM arrived WHERE problem IS NOT NULL""")
def ingest_outcomes(t):
    return ingest.decide(full_arrivals(t)).select("listing_id", "seq", "outcome")


@query("ingest_links", "IDN-09", oracle=f"""
WITH RECURSIVE {OUTCOMES_SQL}, last AS (SELECT listing_id, k, ROW_NUMBER() OVER (PARTITION BY listing_id ORDER BY n DESC) AS rn FROM walk),
q AS (SELECT listing_id, BOOL_OR(outcome = 'identity_conflict') AS needs_review FROM walk GROUP BY listing_id)
SELECT l.listing_id, l.k AS canonical_key, q.needs_review FROM last l JOIN q ON q.listing_id = l.listing_id WHERE l.rn = 1""")
def ingest_links(t):
    """Canonical identity and review mark of each listing after all arrivals."""
    return ingest.apply(full_arrivals(t), ["quantity"]).listings.select("listing_id", "canonical_key", "needs_review")


@query("identity_conflicts", "IDN-09", oracle=f"""
WITH RECURSIVE {WALK_SQL} SELECT listing_id, COUNT(*) AS conflicts FROM walk WHERE outcome = 'identity_conflict' GROUP BY listing_id""")
def identity_conflicts(t):
    decided = ingest.decide(arrivals(t))
    return decided.where("outcome = 'identity_conflict'").groupBy("listing_id").agg(F.count(F.lit(1)).alias("conflicts"))


@query("ingest_current_state", "ING-01", oracle=f"""
WITH RECURSIVE {STATE_SQL}
SELECT listing_id, quantity, price_cents, availability, active, observed_at AS last_checked_at FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY listing_id, quantity ORDER BY seq DESC) AS rn FROM kept) x WHERE rn = 1""")
def ingest_current_state(t):
    done = ingest.apply(arrivals(t), ["quantity"])
    return done.offers.select(
        "listing_id", "quantity", "price_cents", "availability", "active",
        F.col("observed_at").alias("last_checked_at"),
    )


@query("ingest_history", "ING-01", "WIN-03", oracle=f"""
WITH RECURSIVE {STATE_SQL}
SELECT listing_id, quantity, seq, price_cents, availability, active FROM (
  SELECT *, ROW_NUMBER() OVER w AS rn, LAG(price_cents) OVER w AS pp, LAG(availability) OVER w AS pa, LAG(active) OVER w AS pv
  FROM kept WINDOW w AS (PARTITION BY listing_id, quantity ORDER BY seq)) x
WHERE rn = 1 OR price_cents IS DISTINCT FROM pp OR availability IS DISTINCT FROM pa OR active IS DISTINCT FROM pv""")
def ingest_history(t):
    done = ingest.apply(arrivals(t), ["quantity"])
    return done.history.select("listing_id", "quantity", "seq", "price_cents", "availability", "active")


@query("retired_offers", "SET-02", oracle=f"""
WITH RECURSIVE {STATE_SQL} SELECT listing_id, quantity, seq, observed_at FROM kept WHERE NOT present""")
def retired_offers(t):
    done = ingest.apply(arrivals(t), ["quantity"])
    seen = ingest.expand_offers(done.decisions.where("outcome = 'accepted'")).select(
        "listing_id", "quantity", "seq"
    )
    retired = done.history.where("NOT active").select("listing_id", "quantity", "seq", "observed_at")
    return retired.join(seen, ["listing_id", "quantity", "seq"], "left_anti")


@query("evidence_hash", "SNK-03", "DQ-08", oracle="""
SELECT page_id, sha256(url) AS key_hash, sha256(html) AS body_hash,
  'source_' || CAST(page_id % 4 AS VARCHAR) || '/' || SUBSTR(sha256(url), 1, 20) || '-' || sha256(html) || '.json' AS path FROM pages""")
def evidence_hash(t):
    from quotegrain.sources.sinks import evidence_rows

    rows = t.pages.select("page_id", F.concat(F.lit("source_"), (F.col("page_id") % 4).cast("string")).alias("source"),
                          F.col("url").alias("key"), F.col("html").alias("body"))
    return evidence_rows(rows).select("page_id", "key_hash", "body_hash", "path")


@query("json_rowset", "SRC-07", oracle="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_rowset(t):
    rows = t.events.select("event_id", F.concat(F.lit("["), "props", F.lit("]")).alias("doc"))
    return rows.select("event_id", F.inline(F.from_json("doc", "array<struct<k:bigint>>")))


@query("scan_tables", "SRC-01", oracle="""
SELECT medication_id, name, strength, form, brand_name, superseded_by_id FROM b_medications""")
def scan_tables(t):
    return t.medications


@query("failed_runs_excluded", "ING-04", oracle=f"""
WITH runs AS ({RUN_CHECK_SQL})
SELECT listing_id, quantity, price_cents, availability, active, observed_at FROM (
  SELECT o.*, ROW_NUMBER() OVER (PARTITION BY listing_id, quantity ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn
  FROM b_observations o JOIN runs r ON r.run_month = o.run_month AND r.offer_source = o.l_suppkey % 4 WHERE r.status <> 'succeeded') x WHERE rn = 1""")
def failed_runs_excluded(t):
    """The July runs failed here: their rows never replace the last good price."""
    runs = t.sql(RUN_CHECK_SQL).withColumn("failed", F.col("status") == "succeeded")
    obs = t.observations.withColumn("offer_source", (F.col("l_suppkey") % 4).cast("long"))
    good = obs.join(runs.where("NOT failed").select("run_month", "offer_source"), ["run_month", "offer_source"], "left_semi")
    return ordered.latest(good, OFFER_KEY, TIME_ORDER, ["price_cents", "availability", "active", "observed_at"])
