"""Re-keying of legacy identities."""

from pyspark.sql import functions as F

from quotegrain.catalog import query
from quotegrain.plans import rekey as plan
from quotegrain.session import cut_lineage
from quotegrain.sources import releases
from quotegrain.streaming import ingest as streaming

DECISION_SQL = """SELECT l.listing_id, l.medication_id AS legacy_id, CASE WHEN l.medication_id % 4 = 1 THEN l.match_status ELSE 'verified' END AS listing_status,
  CASE WHEN l.medication_id % 41 = 0 AND l.content_unit IS NOT NULL THEN 'barrel' WHEN l.content_unit = 'tablet' THEN 'Tabs' ELSE l.content_unit END AS content_unit,
  CASE WHEN l.medication_id % 7 = 0 AND l.source_id > 1 THEN 'needs_review' WHEN l.medication_id % 9 = 0 THEN 'unmatched' ELSE 'verified' END AS status,
  CASE WHEN l.medication_id % 7 = 0 AND l.source_id > 1 THEN 'multiple_compatible_concepts' WHEN l.medication_id % 9 = 0 THEN 'no_compatible_concept' END AS reason,
  CASE WHEN (l.medication_id % 7 = 0 AND l.source_id > 1) OR l.medication_id % 9 = 0 THEN NULL WHEN l.medication_id % 29 = 0 AND l.source_id = 1 THEN 'rxnorm:other'
    ELSE 'rxnorm:' || CAST(l.medication_id % 1100 AS VARCHAR(10)) END AS normalized_key,
  'canonical ' || CAST(l.medication_id % 1100 AS VARCHAR(10)) AS canonical_name,
  CASE WHEN l.medication_id % 31 = 0 AND l.source_id = 0 THEN '10 mg' ELSE '5 mg' END AS strength, 'tablet' AS form, 'oral' AS route, 'immediate' AS release_type,
  CAST(l.medication_id % 1100 AS VARCHAR(10)) AS rxcui, 'SCD' AS term_type FROM b_listings l"""

# Identities that are canonical already; ids far from the legacy ones.
ACTIVE_SQL = """SELECT p_partkey + 10000000 AS medication_id, 'verified' AS status, CAST(NULL AS BIGINT) AS superseded_by_id, 'canonical ' || CAST(p_partkey AS VARCHAR(10)) AS canonical_name,
  'rxnorm:' || CAST(p_partkey AS VARCHAR(10)) AS normalized_key, CASE WHEN p_partkey % 20 = 0 THEN '7 mg' ELSE '5 mg' END AS strength, 'tablet' AS form, 'oral' AS route,
  'immediate' AS release_type, CAST(p_partkey AS VARCHAR(10)) AS rxcui, 'SCD' AS term_type FROM part WHERE p_partkey % 10 = 0 AND p_partkey < 1100"""

LEGACY_SQL = """SELECT medication_id, CAST(NULL AS VARCHAR(10)) AS status, CAST(NULL AS BIGINT) AS superseded_by_id, CAST(NULL AS VARCHAR(10)) AS canonical_name, CAST(NULL AS VARCHAR(10)) AS normalized_key,
  strength, form, 'oral' AS route, 'unknown' AS release_type, CAST(NULL AS VARCHAR(10)) AS rxcui, CAST(NULL AS VARCHAR(10)) AS term_type FROM b_medications"""

UNIT = "CASE LOWER(content_unit) WHEN 'tabs' THEN 'tablet' WHEN 'tablet' THEN 'tablet' WHEN 'capsule' THEN 'capsule' END"
ITEM_CTES = f"""
d AS ({DECISION_SQL}), active AS ({ACTIVE_SQL}), legacy AS ({LEGACY_SQL}),
g AS (SELECT legacy_id, COUNT(*) AS evidence, COUNT(*) FILTER (WHERE status = 'verified') AS v, MIN(normalized_key) AS k1, MAX(normalized_key) AS k2,
  MIN(strength) FILTER (WHERE status = 'verified') AS s1, MAX(strength) FILTER (WHERE status = 'verified') AS s2, COUNT(*) FILTER (WHERE listing_status <> 'verified') AS nv,
  COUNT(*) FILTER (WHERE listing_status = 'verified' AND content_unit IS NOT NULL AND {UNIT} IS NULL) AS nu, COUNT(*) FILTER (WHERE status = 'needs_review') AS nr,
  MIN(canonical_name) AS canonical_name, MIN(rxcui) AS rxcui, ARG_MIN(reason, listing_id) FILTER (WHERE status = 'needs_review') AS rr, ARG_MIN(reason, listing_id) AS fr FROM d GROUP BY legacy_id),
items AS (SELECT legacy_id, evidence, canonical_name, rxcui, s1, k1, CASE WHEN nv > 0 OR nu > 0 THEN 'needs_review' WHEN v = evidence AND k1 = k2 THEN CASE WHEN s1 = s2 THEN 'ready' ELSE 'needs_review' END
  WHEN v > 0 OR nr > 0 THEN 'needs_review' ELSE 'unmatched' END AS decision_status,
  CASE WHEN nv > 0 THEN 'attached_listing_not_verified' WHEN nu > 0 THEN 'unsupported_quantity_unit' WHEN v = evidence AND k1 = k2 THEN CASE WHEN s1 <> s2 THEN 'canonical_structure_conflict' END
  WHEN v > 0 THEN 'listing_identity_decisions_disagree' WHEN nr > 0 THEN rr ELSE COALESCE(fr, 'no_normalization_candidate') END AS reason FROM g),
grp AS (SELECT k1, COUNT(*) AS n, MIN(legacy_id) AS least, ARG_MIN(s1, legacy_id) AS gs FROM items WHERE decision_status = 'ready' GROUP BY k1),
full_items AS (SELECT i.legacy_id, i.evidence, i.k1, i.s1, i.canonical_name, i.rxcui, i.decision_status = 'ready' AND a.medication_id IS NOT NULL AND a.strength <> g.gs AS conflict,
  i.decision_status AS ds, i.reason AS rs, g.n + CASE WHEN a.medication_id IS NULL THEN 0 ELSE 1 END AS members, COALESCE(a.medication_id, g.least) AS survivor
  FROM items i LEFT JOIN grp g ON g.k1 = i.k1 AND i.decision_status = 'ready' LEFT JOIN active a ON a.normalized_key = i.k1 AND i.decision_status = 'ready'),
final AS (SELECT legacy_id, evidence, k1, s1, canonical_name, rxcui, CASE WHEN conflict THEN 'needs_review' ELSE ds END AS decision_status, CASE WHEN conflict THEN 'active_canonical_collision_conflict' ELSE rs END AS reason,
  CASE WHEN ds = 'ready' AND NOT conflict THEN k1 END AS normalized_key, CASE WHEN ds = 'ready' AND NOT conflict THEN survivor END AS survivor_id,
  CASE WHEN ds = 'ready' AND NOT conflict THEN members ELSE 1 END AS group_size,
  CASE WHEN ds = 'ready' AND NOT conflict THEN CASE WHEN members > 1 THEN 'collision_review' ELSE 'pending' END WHEN conflict OR ds = 'needs_review' THEN 'requires_review' ELSE 'unmatched' END AS approval_status FROM full_items)"""


def decisions(t):
    return t.sql(DECISION_SQL)


def medications(t):
    return t.sql(LEGACY_SQL).unionByName(t.sql(ACTIVE_SQL))


def items(t):
    return plan.group_items(plan.plan_items(decisions(t)), t.sql(ACTIVE_SQL))


def rekey_listings(t):
    return decisions(t).select(
        "listing_id", F.col("legacy_id").alias("medication_id"), F.col("listing_status").alias("match_status"), "content_unit"
    )


@query("evidence_agreement", "AGG-11", oracle=f"""
WITH {ITEM_CTES} SELECT legacy_id, evidence, v = evidence AS all_verified, COALESCE(k1 = k2, FALSE) AS one_key FROM g""")
def evidence_agreement(t):
    verified = F.col("status") == "verified"
    return decisions(t).groupBy("legacy_id").agg(
        F.count(F.lit(1)).alias("evidence"),
        F.every(verified).alias("all_verified"),
        F.coalesce(F.min("normalized_key") == F.max("normalized_key"), F.lit(False)).alias("one_key"),
    )


@query("backfill_plan", "BKF-01", oracle=f"""
WITH {ITEM_CTES} SELECT legacy_id, evidence, decision_status, reason, CASE WHEN decision_status = 'ready' THEN k1 END AS normalized_key FROM items""")
def backfill_plan(t):
    return plan.plan_items(decisions(t)).select("legacy_id", "evidence", "decision_status", "reason", "normalized_key")


@query("collision_groups", "BKF-02", "AGG-12", oracle=f"""
WITH {ITEM_CTES} SELECT legacy_id, decision_status, reason, normalized_key, survivor_id, group_size, approval_status FROM final""")
def collision_groups(t):
    return items(t).select(
        "legacy_id", "decision_status", "reason", "normalized_key", "survivor_id", "group_size", "approval_status"
    )


@query("elect_survivor", "WIN-07", oracle=f"""
WITH {ITEM_CTES} SELECT normalized_key, MIN(survivor_id) AS survivor_id, COUNT(*) AS members FROM final WHERE survivor_id IS NOT NULL GROUP BY normalized_key""")
def elect_survivor(t):
    return items(t).where("survivor_id IS NOT NULL").groupBy("normalized_key").agg(
        F.min("survivor_id").alias("survivor_id"), F.count(F.lit(1)).alias("members")
    )


@query("plan_summary", "AGG-14", oracle=f"""
WITH {ITEM_CTES} SELECT COUNT(*) AS legacy_medications, COUNT(*) FILTER (WHERE decision_status = 'ready') AS ready, COUNT(*) FILTER (WHERE decision_status = 'needs_review') AS needs_review,
  COUNT(*) FILTER (WHERE decision_status = 'unmatched') AS unmatched, COUNT(*) FILTER (WHERE approval_status = 'collision_review') AS collision_review, CAST(SUM(evidence) AS BIGINT) AS target_listings FROM final""")
def plan_summary(t):
    return plan.summary(items(t))


@query("candidate_union", "AGG-16", oracle="""
SELECT l_orderkey AS legacy_id, array_to_string(list(DISTINCT l_partkey ORDER BY l_partkey), ',') AS candidates FROM lineitem GROUP BY l_orderkey""")
def candidate_union(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("legacy_id"), F.col("l_partkey").alias("rxcui"))
    return plan.candidate_union(rows).withColumn("candidates", F.array_join(F.transform("candidates", lambda c: c.cast("string")), ","))


@query("approval_counts", "BKF-04", oracle=f"""
WITH {ITEM_CTES} SELECT COUNT(*) FILTER (WHERE approval_status IN ('pending', 'collision_review')) AS approved, COUNT(*) FILTER (WHERE approval_status NOT IN ('pending', 'collision_review')) AS unresolved FROM final""")
def approval_counts(t):
    approved = F.col("approval_status") == "approved"
    return plan.approve(items(t), collisions=True).agg(F.count_if(approved).alias("approved"), F.count_if(~approved).alias("unresolved"))


def applied(t):
    approved = plan.approve(items(t), collisions=True)
    return approved, plan.apply(medications(t), rekey_listings(t), approved, decisions(t), "run-1")


APPLY_CTES = ITEM_CTES + """,
ok AS (SELECT * FROM final WHERE survivor_id IS NOT NULL),
surv AS (SELECT survivor_id, ARG_MIN(k1, legacy_id) AS k, ARG_MIN(s1, legacy_id) AS s, ARG_MIN(canonical_name, legacy_id) AS c FROM ok GROUP BY survivor_id),
meds AS (SELECT * FROM legacy UNION ALL SELECT * FROM active)"""


@query("apply_rekey", "BKF-05", oracle=f"""
WITH {APPLY_CTES} SELECT m.medication_id, CASE WHEN o.legacy_id IS NOT NULL THEN 'superseded' WHEN s.survivor_id IS NOT NULL AND m.normalized_key IS NULL THEN 'verified' ELSE m.status END AS status,
  COALESCE(o.survivor_id, m.superseded_by_id) AS superseded_by_id, CASE WHEN o.legacy_id IS NULL AND s.survivor_id IS NOT NULL AND m.normalized_key IS NULL THEN s.k ELSE m.normalized_key END AS normalized_key,
  CASE WHEN o.legacy_id IS NULL AND s.survivor_id IS NOT NULL AND m.normalized_key IS NULL THEN s.s ELSE m.strength END AS strength
FROM meds m LEFT JOIN ok o ON o.legacy_id = m.medication_id AND o.survivor_id <> o.legacy_id LEFT JOIN surv s ON s.survivor_id = m.medication_id""")
def apply_rekey(t):
    return applied(t)[1].medications.select("medication_id", "status", "superseded_by_id", "normalized_key", "strength")


@query("apply_rekey_listings", "BKF-05", oracle=f"""
WITH {APPLY_CTES} SELECT d.listing_id, CASE WHEN o.legacy_id IS NOT NULL AND d.listing_status = 'verified' THEN o.survivor_id ELSE d.legacy_id END AS medication_id,
  CASE WHEN o.legacy_id IS NOT NULL AND d.listing_status = 'verified' THEN {UNIT} ELSE d.content_unit END AS content_unit, CASE WHEN o.legacy_id IS NOT NULL AND d.listing_status = 'verified' THEN 'run-1' END AS rekey_run
FROM d LEFT JOIN ok o ON o.legacy_id = d.legacy_id""")
def apply_rekey_listings(t):
    return applied(t)[1].listings.select("listing_id", "medication_id", "content_unit", "rekey_run")


@query("undo_rekey", "BKF-07", oracle=f"""
WITH {ITEM_CTES}, meds AS (SELECT * FROM legacy UNION ALL SELECT * FROM active) SELECT medication_id, status, superseded_by_id, normalized_key, strength FROM meds""")
def undo_rekey(t):
    approved, new = applied(t)
    back = plan.undo(new, medications(t), rekey_listings(t), approved, "run-1")
    return back.medications.select("medication_id", "status", "superseded_by_id", "normalized_key", "strength")


@query("undo_blockers", "BKF-07", oracle=f"""
WITH {APPLY_CTES}, cur AS (SELECT d.listing_id, CASE WHEN d.listing_id % 301 = 0 THEN 5 ELSE o.survivor_id END AS now, o.survivor_id AS want FROM d JOIN ok o ON o.legacy_id = d.legacy_id)
SELECT listing_id, 'listing_changed' AS reason FROM cur WHERE now IS DISTINCT FROM want""")
def undo_blockers(t):
    """Somebody repointed some listings after the run; the undo has to refuse those."""
    approved, new = applied(t)
    moved = new.listings.withColumn(
        "medication_id",
        F.when(F.col("rekey_run").isNotNull() & (F.col("listing_id") % 301 == 0), 5).otherwise(F.col("medication_id")),
    )
    blockers = plan.undo_blockers(moved, rekey_listings(t), approved, "run-1")
    return blockers.select("listing_id", "reason")


def released(t):
    """A root whose first release holds the tables of an approved run."""
    root = streaming.new_root(t.spark, "rekey")
    listings = rekey_listings(t).withColumn("rekey_run", F.lit(None).cast("string"))
    components = t.spark.createDataFrame([], "medication_id long, sequence int, ingredient_name string, ingredient_rxcui string, numerator_value decimal(20,6), "
                                             "numerator_unit string, denominator_value decimal(20,6), denominator_unit string, rekey_run string")
    matches = t.spark.createDataFrame([], "listing_id long, legacy_id long, selected_id long, status string, reason string, rekey_run string")
    runs = t.spark.createDataFrame([("run-0", "staged", 0), ("run-1", "approved", 1), ("run-2", "staged", 2)], "run_id string, status string, created long")
    frames = {"medications": medications(t), "listings": listings, "components": components, "matches": matches, "items": plan.approve(items(t), collisions=True), "runs": runs}
    return root, releases.replace(t.spark, root, frames, None)


def read_back(t, root, step):
    """What a reader finds: rows of each table, and how many of them the run has touched."""
    now = releases.load(t.spark, root)
    marks = {
        "medications": F.col("status") == "superseded", "listings": F.col("rekey_run") == "run-1", "components": F.col("rekey_run") == "run-1",
        "matches": F.col("rekey_run") == "run-1", "items": F.col("approval_status") == "applied", "runs": F.col("status") == "applied",
    }
    out = None
    for name, mark in marks.items():
        part = releases.read(t.spark, now, name).agg(F.count(F.lit(1)).alias("rows"), F.count_if(mark).alias("touched")).select(F.lit(step).alias("step"), F.lit(name).alias("table_name"), "rows", "touched")
        out = part if out is None else out.unionByName(part)
    return out


@query("rekey_release", "BKF-05", "SNK-01", oracle=f"""
WITH {APPLY_CTES}, survivors AS (SELECT COUNT(DISTINCT survivor_id) AS n FROM ok),
counts AS (SELECT (SELECT COUNT(*) FROM meds) AS m, (SELECT COUNT(*) FROM d) AS l, (SELECT COUNT(*) FROM final) AS i, (SELECT n FROM survivors) AS c,
  (SELECT COUNT(*) FROM ok WHERE legacy_id <> survivor_id) AS moved, (SELECT COUNT(*) FROM d JOIN ok ON ok.legacy_id = d.legacy_id) AS x,
  (SELECT COUNT(*) FROM d JOIN ok ON ok.legacy_id = d.legacy_id WHERE d.listing_status = 'verified') AS lx, (SELECT COUNT(*) FROM ok) AS applied)
SELECT 'interrupted' AS step, v.table_name, CASE v.table_name WHEN 'medications' THEN m WHEN 'listings' THEN l WHEN 'items' THEN i WHEN 'runs' THEN 3 ELSE 0 END AS rows, CAST(0 AS BIGINT) AS touched
FROM counts, (SELECT UNNEST(['medications', 'listings', 'components', 'matches', 'items', 'runs']) AS table_name) v
UNION ALL SELECT 'applied', v.table_name, CASE v.table_name WHEN 'medications' THEN m WHEN 'listings' THEN l WHEN 'items' THEN i WHEN 'runs' THEN 3 WHEN 'components' THEN c ELSE x END,
  CASE v.table_name WHEN 'medications' THEN moved WHEN 'listings' THEN lx WHEN 'items' THEN applied WHEN 'runs' THEN 1 WHEN 'components' THEN c ELSE x END
FROM counts, (SELECT UNNEST(['medications', 'listings', 'components', 'matches', 'items', 'runs']) AS table_name) v""")
def rekey_release(t):
    """A run that dies after writing some of its tables, which nobody sees, and the run again to its end."""
    root, first = released(t)
    half = plan.apply(*(releases.read(t.spark, first, n) for n in ("medications", "listings", "items")), decisions(t), "run-1")
    releases.write(half.medications, root, "medications")
    releases.write(half.listings, root, "listings")
    interrupted = cut_lineage(read_back(t, root, "interrupted"))
    plan.apply_and_publish(t.spark, root, decisions(t), "run-1")
    return interrupted.unionByName(read_back(t, root, "applied"))


@query("rekey_components", "BKF-05", oracle=f"""
WITH {APPLY_CTES} SELECT survivor_id AS medication_id, 1 AS sequence, c AS ingredient_name, CAST(regexp_extract(s, '^[0-9]+') AS DOUBLE) AS numerator_value, 'mg' AS numerator_unit, regexp_extract(k, '[0-9]+$') AS ingredient_rxcui FROM surv""")
def rekey_components(t):
    rows = applied(t)[1].components
    return rows.select("medication_id", "sequence", "ingredient_name", F.col("numerator_value").cast("double").alias("numerator_value"), "numerator_unit", "ingredient_rxcui")


@query("rekey_problems", "BKF-05", oracle=f"""
WITH {APPLY_CTES}, taken AS (SELECT survivor_id FROM ok GROUP BY survivor_id), act AS (SELECT medication_id FROM active WHERE medication_id % 30 = 0),
p AS (SELECT o.legacy_id, 'survivor_not_active' AS problem FROM ok o JOIN act a ON a.medication_id = o.survivor_id
  UNION SELECT legacy_id, 'legacy_changed' FROM ok WHERE legacy_id % 59 = 0 AND legacy_id <> survivor_id
  UNION SELECT o.legacy_id, 'survivor_conflict' FROM ok o WHERE o.survivor_id % 59 = 0 AND o.survivor_id < 10000000
  UNION SELECT d.legacy_id, 'listing_decision_missing' FROM d JOIN ok ON ok.legacy_id = d.legacy_id WHERE d.listing_status = 'verified' AND d.listing_id % 37 = 0)
SELECT DISTINCT legacy_id, problem FROM p""")
def rekey_problems(t):
    """The tables moved on after the approval: some survivors redirect, some legacy rows became canonical, some decisions are gone."""
    approved = plan.approve(items(t), collisions=True)
    own = F.col("medication_id") % 59 == 0
    moved = medications(t).withColumns({
        "superseded_by_id": F.when((F.col("medication_id") > 10_000_000) & (F.col("medication_id") % 30 == 0), F.lit(5).cast("long")).otherwise(F.col("superseded_by_id")),
        "normalized_key": F.when(own & (F.col("medication_id") < 10_000_000), "rxnorm:elsewhere").otherwise(F.col("normalized_key"))})
    return plan.apply_problems(moved, rekey_listings(t), approved, decisions(t).where("listing_id % 37 <> 0")).distinct()


@query("rekey_run_status", "BKF-08", oracle="""
SELECT 'by_id' AS asked, 'run-1' AS run_id, 'applied' AS status UNION ALL SELECT 'newest', 'run-2', 'staged'""")
def rekey_run_status(t):
    """Of the runs of a release after one was applied: one by its id, and the newest."""
    root, _ = released(t)
    plan.apply_and_publish(t.spark, root, decisions(t), "run-1")
    runs = releases.read(t.spark, releases.load(t.spark, root), "runs")
    by_id, newest = plan.run_status(runs, "run-1"), plan.run_status(runs)
    return by_id.select(F.lit("by_id").alias("asked"), "run_id", "status").unionByName(newest.select(F.lit("newest").alias("asked"), "run_id", "status"))
