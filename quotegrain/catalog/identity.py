"""Identity normalisation, terminology lookup, decisions and what follows from them."""

from pyspark.sql import functions as F

from quotegrain.catalog import query
from quotegrain.catalog import sqltext as q
from quotegrain.functions import vocab
from quotegrain.plans import identity as plan

NUMBERED = "(SELECT x.*, CAST(5 * (1 + p_size % 4) AS VARCHAR(10)) AS n FROM part x)"

RAW_SQL = f"""
SELECT p_partkey AS medication_id, CASE WHEN p_partkey % 37 = 0 THEN ' ' ELSE p_name END AS name,
  CASE p_size % 12 WHEN 0 THEN n || ' mg/mL' WHEN 1 THEN n || '0U/ml' WHEN 2 THEN '0.' || n || '0%' WHEN 3 THEN n || ' mg / 5 mL'
    WHEN 4 THEN n || ' mL' WHEN 5 THEN n || '-25 mg' WHEN 6 THEN '0 mg' WHEN 7 THEN n || ' Milligrams' WHEN 8 THEN n || ' mg' ELSE n || 'MG' END AS strength,
  CASE p_type WHEN 'ECONOMY' THEN 'tabs' WHEN 'STANDARD' THEN 'Tablet' WHEN 'SMALL' THEN 'CAPSULES'
    WHEN 'MEDIUM' THEN 'chewable tablets' WHEN 'LARGE' THEN 'Oral Solution' ELSE 'kit' END AS form,
  CASE p_partkey % 5 WHEN 0 THEN 'Oral' WHEN 1 THEN 'by mouth' WHEN 4 THEN CASE WHEN p_size = 9 THEN 'sideways' ELSE 'ORAL' END END AS route,
  CASE p_partkey % 6 WHEN 0 THEN 'Immediate-Release' WHEN 1 THEN 'IR' WHEN 5 THEN CASE WHEN p_size = 10 THEN 'sometimes' ELSE 'er' END END AS release_type,
  CASE WHEN p_partkey % 8 = 3 THEN p_brand END AS brand_name,
  CASE WHEN p_partkey % 12 = 1 THEN LPAD(CAST(p_partkey AS VARCHAR(11)), 11, '0') END AS ndc,
  p_partkey % 17 = 0 AS veterinary, p_partkey % 2 = 1 AS reviewed FROM {NUMBERED} y"""

SHAPED = f"""(SELECT z.*, CASE p_type WHEN 'ECONOMY' THEN 'oral tablet' WHEN 'STANDARD' THEN 'Tablet' WHEN 'SMALL' THEN 'oral capsule'
    WHEN 'MEDIUM' THEN 'ER oral tablet' ELSE 'oral solution' END AS f FROM {NUMBERED} z WHERE p_partkey % 3 <> 0)"""

CONCEPT_SQL = f"""
SELECT 100000000 + MIN(p_partkey) AS rxcui, p_name || ' ' || n || ' mg ' || f AS concept_name, 'SCD' AS tty, TRUE AS active
FROM {SHAPED} a GROUP BY p_name, n, f
UNION ALL SELECT 200000000 + MIN(p_partkey) AS rxcui, p_name || ' ' || n || ' mg ' || f || ' [' || p_brand || ']' AS concept_name, 'SBD' AS tty,
  MIN(p_partkey) % 7 <> 0 AS active FROM {SHAPED} b GROUP BY p_name, n, f, p_brand"""

NDC_SQL = f"""
SELECT LPAD(CAST(p_partkey AS VARCHAR(11)), 11, '0') AS ndc, rxcui FROM (
  SELECT p_partkey, 100000000 + MIN(p_partkey) OVER (PARTITION BY p_name, n, f) AS rxcui FROM {SHAPED} c) d WHERE p_partkey % 12 = 1"""


def raw_identities(t):
    rows = t.sql(RAW_SQL, deal=("part",))
    species = F.when(F.col("veterinary"), F.array(F.lit("dog"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("species", species).drop("veterinary")


def normalized(t):
    return plan.normalize(raw_identities(t))


def concepts(t):
    return plan.prepare_concepts(t.sql(CONCEPT_SQL))


def ndc_map(t):
    return t.sql(NDC_SQL)


def keyed_inputs(t):
    """Identities of all rows. Whether a person reviewed the text is not in the hash, so it joins it here."""
    mark = F.when(F.col("reviewed"), "+").otherwise("-")
    return raw_identities(t).withColumn("input_hash", F.concat(plan.input_hash(), mark))


def distinct_inputs(t):
    """Distinct identities only: the lookup runs once per different input."""
    rows = keyed_inputs(t).dropDuplicates(["input_hash"]).drop("medication_id").withColumnRenamed("input_hash", "_key")
    return plan.distinct_inputs(plan.normalize(rows).drop("input_hash").withColumnRenamed("_key", "input_hash"))


def decisions(t):
    decided = plan.decide(distinct_inputs(t), concepts(t), ndc_map(t))
    return keyed_inputs(t).select("medication_id", "input_hash").join(decided, "input_hash")


NORM_CTES = f"""
raw AS ({RAW_SQL}),
{q.strength_ctes('raw', 'medication_id', 'strength')},
ident AS (SELECT r.*, {q.norm('r.name')} AS norm_name, {q.norm("COALESCE(r.brand_name, '')")} AS norm_brand,
  s.num, s.unit, s.den, s.den_unit, CASE WHEN s.good THEN s.display END AS display, CASE WHEN s.good THEN s.skey END AS skey, COALESCE(s.good, FALSE) AS good,
  {q.alias('r.form')} AS fk, {q.alias('r.route')} AS rk, {q.alias('r.release_type')} AS lk FROM raw r JOIN strengths s ON s.medication_id = r.medication_id),
coded AS (SELECT *, {q.form('fk')} AS form_code, {q.codes('rk', vocab.ROUTES)} AS route_code, {q.codes('lk', vocab.RELEASES)} AS release_code FROM ident),
gated AS (SELECT *, CASE WHEN norm_name = '' THEN 'missing_name' WHEN NOT good THEN 'unsupported_or_ambiguous_strength'
  WHEN unit IN ('ml', 'l') THEN 'volume_without_concentration' WHEN form_code IS NULL THEN 'unsupported_form'
  WHEN route IS NOT NULL AND route_code IS NULL THEN 'unsupported_route' WHEN release_type IS NOT NULL AND release_code IS NULL THEN 'unsupported_release_type'
  WHEN veterinary AND NOT reviewed THEN 'species_requires_review' END AS gate FROM coded),
complete AS (SELECT *, reviewed AND norm_name <> '' AND good AND form_code IS NOT NULL AND route_code IS NOT NULL AND release_code IS NOT NULL
  AND unit NOT IN ('ml', 'l') AS standalone FROM gated)"""

LOCAL_KEY_SQL = """'local:' || sha256(norm_name || '|' || skey || '|' || form_code || '|' || route_code || '|' || release_code || '|' || norm_brand
  || CASE WHEN veterinary THEN '|dog' ELSE '' END)"""
DISPLAY_SQL = f"""{q.title('norm_name')} || ' ' || display || ' ' || {q.title('route_code')} ||
  CASE WHEN release_code IN ('immediate', 'not_applicable') THEN '' ELSE ' ' || {q.title('release_code')} || ' Release' END || ' ' || {q.title('form_code')}"""

CANDIDATE_CTES = NORM_CTES + f""",
concepts AS (SELECT *, {q.norm('concept_name')} AS ctext FROM ({CONCEPT_SQL}) c0 WHERE active),
ctok AS (SELECT *, {q.tokens('ctext')} AS ct, {q.form("TRIM(regexp_replace(REPLACE(ctext, '/', ' '), ' +', ' ', 'g'))")} AS cform FROM concepts),
asked AS (SELECT *, {q.tokens('norm_name')} AS nt,
  LOWER(TRIM(array_to_string(list_filter([name, strength, route, release_type, form, brand_name], lambda v: v IS NOT NULL AND v <> ''), ' '))) AS lt FROM complete WHERE gate IS NULL),
keyed AS (SELECT *, array_to_string(list_sort({q.tokens(q.norm('lt'))}), ' ') AS wk FROM asked),
found AS (
  SELECT k.medication_id, c.rxcui, 1 AS rank FROM keyed k JOIN ({NDC_SQL}) m ON m.ndc = k.ndc JOIN ctok c ON c.rxcui = m.rxcui
  UNION SELECT k.medication_id, c.rxcui, 2 FROM keyed k JOIN ctok c ON LOWER(TRIM(c.concept_name)) = k.lt
  UNION SELECT k.medication_id, c.rxcui, 3 FROM keyed k JOIN ctok c ON array_to_string(list_sort(c.ct), ' ') = k.wk
  UNION SELECT k.medication_id, c.rxcui, 4 FROM keyed k JOIN (SELECT rxcui, ct, UNNEST(ct) AS w FROM ctok) c ON c.w = k.nt[1] AND list_has_all(c.ct, k.nt)),
best AS (SELECT medication_id, MIN(rank) AS rank FROM found GROUP BY medication_id),
cand AS (SELECT f.medication_id, f.rxcui, CASE f.rank WHEN 1 THEN 'ndc' WHEN 2 THEN 'rxnorm_exact' WHEN 3 THEN 'rxnorm_normalized' ELSE 'rxnorm_approximate' END AS method
  FROM found f JOIN best b ON b.medication_id = f.medication_id AND b.rank = f.rank),
rel AS (SELECT *, CASE WHEN regexp_matches(ctext, '\\b(extended release|er|xr|xl|sr)\\b') THEN 'extended' WHEN regexp_matches(ctext, '\\b(delayed release|dr|enteric coated|ec)\\b') THEN 'delayed'
  WHEN cform IN ('tablet', 'capsule', 'lozenge') THEN 'immediate' ELSE 'not_applicable' END AS crel,
  CASE WHEN CONTAINS(ctext, 'oral') THEN 'oral' WHEN cform IN ('tablet', 'capsule', 'lozenge') THEN 'oral' END AS croute FROM ctok),
judged AS (SELECT k.medication_id, d.rxcui, d.method, c.concept_name, c.tty, c.crel, c.croute,
  COALESCE(list_has_all(c.ct, k.nt) AND list_has_all(c.ct, {q.tokens(q.norm('k.display'))}) AND c.cform = k.form_code
    AND (k.route IS NULL OR list_contains(c.ct, k.route_code)) AND (k.release_type IS NULL OR k.release_code = c.crel)
    AND CASE WHEN k.brand_name IS NOT NULL THEN c.tty = 'SBD' AND list_has_all(c.ct, {q.tokens('k.norm_brand')}) ELSE c.tty = 'SCD' END, FALSE) AS compatible
  FROM keyed k JOIN cand d ON d.medication_id = k.medication_id JOIN rel c ON c.rxcui = d.rxcui)"""

DECISION_CTES = CANDIDATE_CTES + f""",
tally AS (SELECT medication_id, MIN(method) AS method, COUNT(*) AS found, COUNT(*) FILTER (WHERE compatible) AS fits,
  MAX(rxcui) FILTER (WHERE compatible) AS rxcui FROM judged GROUP BY medication_id),
joined AS (SELECT c.*, t.method AS lookup, t.found, t.fits, t.rxcui, r.concept_name, COALESCE(c.route_code, r.croute) AS route_final, COALESCE(c.release_code, r.crel) AS release_final
  FROM complete c LEFT JOIN tally t ON t.medication_id = c.medication_id LEFT JOIN rel r ON r.rxcui = t.rxcui),
decided AS (SELECT *, CASE WHEN gate = 'species_requires_review' THEN 'needs_review' WHEN gate IS NOT NULL THEN CASE WHEN standalone THEN 'verified' WHEN reviewed THEN 'needs_review' ELSE 'unmatched' END
  WHEN COALESCE(lookup, 'rxnorm_approximate') = 'rxnorm_approximate' THEN 'needs_review' WHEN fits > 1 THEN 'needs_review' WHEN fits = 0 THEN 'unmatched'
  WHEN route_final IS NULL OR release_final IS NULL THEN 'needs_review' ELSE 'verified' END AS status,
  CASE WHEN gate IS NOT NULL THEN gate WHEN COALESCE(lookup, 'rxnorm_approximate') = 'rxnorm_approximate' THEN 'approximate_match_requires_review'
  WHEN fits > 1 THEN 'multiple_compatible_concepts' WHEN fits = 0 THEN 'no_compatible_concept' WHEN route_final IS NULL OR release_final IS NULL THEN 'route_or_release_unresolved' END AS reason FROM joined),
final AS (SELECT *, CASE WHEN gate IS NOT NULL AND status = 'verified' THEN 'reviewed_input' WHEN gate IS NOT NULL THEN 'none' ELSE COALESCE(lookup, 'rxnorm_approximate') END AS method,
  CASE WHEN status <> 'verified' THEN NULL WHEN gate IS NOT NULL THEN {LOCAL_KEY_SQL} ELSE 'rxnorm:' || CAST(rxcui AS VARCHAR) END AS normalized_key,
  CASE WHEN status <> 'verified' THEN NULL WHEN gate IS NOT NULL THEN {DISPLAY_SQL} ELSE concept_name END AS canonical_name FROM decided)"""


@query("normalize_identity", "IDN-01", "SCL-15", "SCL-16", "SCL-27", oracle=f"""
WITH {NORM_CTES} SELECT medication_id, norm_name, display AS strength, skey AS strength_key, form_code, route_code, release_code,
  sha256('{{"name":"' || name || '","strength":"' || strength || '","form":"' || form || '","route":' || COALESCE('"' || route || '"', 'null')
   || ',"release_type":' || COALESCE('"' || release_type || '"', 'null') || ',"brand_name":' || COALESCE('"' || brand_name || '"', 'null')
   || ',"ndc":' || COALESCE('"' || ndc || '"', 'null') || ',"species":' || CASE WHEN veterinary THEN '["dog"]' ELSE '[]' END || '}}') AS input_hash FROM complete""")
def normalize_identity(t):
    return normalized(t).select(
        "medication_id", "norm_name", F.col("strength_value.display").alias("strength"),
        F.col("strength_value.key").alias("strength_key"), "form_code", "route_code", "release_code", "input_hash",
    )


@query("identity_reasons", "IDN-02", oracle=f"""
WITH {NORM_CTES} SELECT medication_id, gate AS reason, COALESCE(gate, 'terminology_resolver_unavailable') AS offline_reason FROM gated""")
def identity_reasons(t):
    return normalized(t).select(
        "medication_id", plan.gate_reason().alias("reason"), plan.gate_reason(False).alias("offline_reason")
    )


@query("local_identity_key", "IDN-06", oracle=f"""
WITH {NORM_CTES} SELECT medication_id, {LOCAL_KEY_SQL} AS normalized_key, {DISPLAY_SQL} AS canonical_name FROM complete WHERE standalone""")
def local_identity_key(t):
    rows = normalized(t).where(plan.reviewed_fallback())
    return rows.select(
        "medication_id", plan.local_key().alias("normalized_key"), plan.display_name().alias("canonical_name")
    )


@query("concept_candidates", "IDN-03", oracle=f"WITH {CANDIDATE_CTES} SELECT medication_id, rxcui, method FROM cand")
def concept_candidates(t):
    asked = distinct_inputs(t).where(plan.gate_reason().isNull())
    pairs = plan.candidates(asked, concepts(t), ndc_map(t))
    return keyed_inputs(t).select("medication_id", "input_hash").join(pairs, "input_hash").drop("input_hash")


@query("compatible_concepts", "IDN-04", oracle=f"""
WITH {CANDIDATE_CTES} SELECT medication_id, rxcui, method FROM judged WHERE compatible""")
def compatible_concepts(t):
    asked = distinct_inputs(t).where(plan.gate_reason().isNull())
    judged = plan.judged_candidates(asked, concepts(t), ndc_map(t)).where("compatible")
    ids = keyed_inputs(t).select("medication_id", "input_hash")
    return ids.join(judged, "input_hash").select("medication_id", "rxcui", "method")


@query("match_decisions", "IDN-05", "UDF-01", oracle=f"""
WITH {DECISION_CTES} SELECT medication_id, status, method, reason, normalized_key, canonical_name FROM final""")
def match_decisions(t):
    return decisions(t).select("medication_id", "status", "method", "reason", "normalized_key", "canonical_name")


@query("decision_log", "IDN-08", oracle=f"""
WITH {CANDIDATE_CTES} SELECT j.medication_id, j.rxcui, j.method, j.compatible, CASE WHEN r.strength LIKE '5%' THEN 'r1' ELSE 'r2' END AS run FROM judged j JOIN raw r ON r.medication_id = j.medication_id""")
def decision_log(t):
    """A first run over part of the inputs, then one over all of them, which adds only what the log lacks."""
    inputs, terms, codes = distinct_inputs(t), concepts(t), ndc_map(t)
    stored = plan.decision_log(inputs.where("strength LIKE '5%'"), terms, codes, "v1")
    added = plan.new_evidence(stored, plan.decision_log(inputs, terms, codes, "v1"))
    log = stored.withColumn("run", F.lit("r1")).unionByName(added.withColumn("run", F.lit("r2")))
    ids = keyed_inputs(t).select("medication_id", "input_hash")
    return ids.join(log, "input_hash").select("medication_id", "rxcui", "method", "compatible", "run")


@query("canonical_medications", "IDN-07", oracle=f"""
WITH {DECISION_CTES} SELECT normalized_key, MIN(medication_id) AS medication_id, COUNT(*) AS members,
  MIN_BY(canonical_name, medication_id) AS canonical_name,
  COUNT(DISTINCT norm_name || '|' || skey) > 1 AS component_conflict FROM final WHERE normalized_key IS NOT NULL GROUP BY normalized_key""")
def canonical_medications(t):
    return plan.canonical_rows(decisions(t).where("normalized_key IS NOT NULL"))


@query("listing_match_status", "IDN-14", oracle=f"""
WITH {DECISION_CTES} SELECT l.listing_id, CASE WHEN f.status = 'verified' AND l.content_quantity IS NOT NULL AND l.content_unit IS NOT NULL THEN 'verified'
  WHEN f.status = 'needs_review' THEN 'needs_review' ELSE 'unmatched' END AS new_status,
  CASE WHEN l.match_status = 'needs_review' THEN 'needs_review' WHEN f.status = 'verified' AND l.content_quantity IS NOT NULL AND l.content_unit IS NOT NULL THEN 'verified'
  WHEN f.status = 'needs_review' THEN 'needs_review' ELSE 'unmatched' END AS stored_status
FROM b_listings l JOIN final f ON f.medication_id = l.medication_id""")
def listing_match_status(t):
    decided = decisions(t).select("medication_id", "status")
    new = plan.listing_status(F.col("status") == "verified", F.lit(False), F.col("status"))
    return t.listings.join(decided, "medication_id").select(
        "listing_id", new.alias("new_status"), plan.sticky_review(F.col("match_status"), new).alias("stored_status")
    )


@query("reuse_match", "IDN-10", oracle=f"""
WITH {NORM_CTES} SELECT l.listing_id, l.match_status = 'verified' AND c.gate IS NULL AND l.source_id <> 2 AS reused,
  CASE WHEN l.match_status = 'verified' AND c.gate IS NULL AND l.source_id <> 2 AND l.content_quantity IS NOT NULL THEN 'verified'
   WHEN c.reviewed AND NOT c.standalone THEN 'needs_review' WHEN c.standalone AND l.content_quantity IS NOT NULL THEN 'verified' ELSE 'unmatched' END AS new_status
FROM b_listings l JOIN complete c ON c.medication_id = l.medication_id WHERE c.gate IS NULL""")
def reuse_match(t):
    """Terminology is down: a verified listing whose input is unchanged keeps its match.

    Source 2 changed its text since, so its stored hash differs.
    """
    rows = normalized(t).where(plan.gate_reason().isNull())
    stored = t.listings.join(rows, "medication_id").withColumn(
        "stored_hash", F.when(F.col("source_id") != 2, F.col("input_hash")).otherwise("changed")
    )
    reused = (F.col("match_status") == "verified") & (F.col("stored_hash") == F.col("input_hash"))
    alone = plan.reviewed_fallback()
    status = F.when(alone, "verified").when(F.col("reviewed"), "needs_review").otherwise("unmatched")
    marked = stored.withColumns({"reused": reused, "alone": F.coalesce(alone, F.lit(False)), "status": status})
    return marked.select(
        "listing_id", "reused", plan.listing_status(F.col("alone"), F.col("reused"), F.col("status")).alias("new_status")
    )


@query("legacy_shield", "IDN-15", oracle="""
SELECT l.listing_id, m.medication_id % 5 <> 0 AS shielded, CASE WHEN m.medication_id % 5 <> 0 THEN l.match_status ELSE 'unmatched' END AS next_status
FROM b_listings l LEFT JOIN b_medications m ON m.medication_id = l.medication_id""")
def legacy_shield(t):
    """Listings of identities without a key yet keep their status until the re-keying job."""
    keyed = t.medications.select(
        "medication_id", F.when(F.col("superseded_by_id").isNull(), F.lit("key")).alias("normalized_key")
    )
    joined = t.listings.join(keyed, "medication_id", "left")
    shielded = F.col("normalized_key").isNull()
    return joined.select(
        "listing_id", shielded.alias("shielded"),
        F.when(shielded, F.col("match_status")).otherwise("unmatched").alias("next_status"),
    )


@query("reviewed_links", "IDN-16", oracle="""
SELECT l.listing_id, CASE WHEN l.medication_id % 10 = 3 AND l.content_quantity = 1 AND l.content_unit = 'capsule' AND l.source_id < 2 THEN l.medication_id + 1000000 ELSE l.medication_id END AS medication_id,
  CASE WHEN l.medication_id % 10 = 3 AND l.content_quantity = 1 AND l.content_unit = 'capsule' AND l.source_id < 2 THEN 'verified' ELSE l.match_status END AS match_status FROM b_listings l""")
def reviewed_links(t):
    listings = t.listings.withColumn("product_key", F.col("medication_id").cast("string"))
    picked = listings.where("medication_id % 10 = 3 AND content_unit = 'capsule' AND source_id < 2")
    # The review table asks for packages of one; other packages must not match.
    reviews = picked.select(
        "source_id", "product_key", F.lit(1).cast("long").alias("content_quantity"), "content_unit",
        (F.col("medication_id") + 1000000).alias("medication_id"), F.lit("checked label").alias("proof"),
    )
    return plan.apply_reviews(listings, reviews).select("listing_id", "medication_id", "match_status")


@query("normalization_coverage", "IDN-13", oracle=f"""
WITH {DECISION_CTES}, v AS (SELECT l.source_id, f.status, CASE WHEN l.medication_id % 3 = 0 THEN 'v2' ELSE 'v1' END AS version, f.reason FROM b_listings l JOIN final f ON f.medication_id = l.medication_id)
SELECT source_id, status, version, reason, COUNT(*) AS inputs, GROUPING(source_id, status, version, reason) AS level FROM v GROUP BY ROLLUP (source_id, status, version, reason)""")
def normalization_coverage(t):
    version = F.when(F.col("medication_id") % 3 == 0, "v2").otherwise("v1")
    decided = decisions(t).select("medication_id", "status", "reason").withColumn("version", version)
    return plan.coverage(t.listings.join(decided, "medication_id"))


COMPONENT_SQL = f"""
SELECT 300000000 + MIN(p_partkey) AS rxcui, p_name AS concept_name, CASE WHEN MIN(p_partkey) % 3 = 0 THEN 'BN' ELSE 'IN' END AS tty, p_name AS base FROM part GROUP BY p_name
UNION ALL SELECT 400000000 + MIN(p_partkey) AS rxcui, p_name || ' ' || n || ' mg' || CASE WHEN b THEN ' [' || p_name || ']' ELSE '' END AS concept_name,
  CASE WHEN b THEN 'SBDC' ELSE 'SCDC' END AS tty, p_name AS base FROM (SELECT k.*, p_partkey % 2 = 0 AS b FROM {NUMBERED} k WHERE p_partkey % 4 < 3) j GROUP BY p_name, n, b"""
REQUEST_SQL = f"""
SELECT p_partkey AS request_id, CASE p_partkey % 5 WHEN 0 THEN p_name || ' ' || n || ' mg' WHEN 1 THEN p_name || ' 0.0' || n || ' g' WHEN 2 THEN UPPER(p_name) || ' ' || n || '000mcg'
  WHEN 3 THEN p_name ELSE p_name || ' lots' END AS medication FROM {NUMBERED} w"""


@query("resolve_components", "IDN-11", "SCL-14", oracle=f"""
WITH concepts AS ({COMPONENT_SQL}), asked AS ({REQUEST_SQL}),
ckeys AS (SELECT *, array_to_string(list_sort({q.tokens(q.norm('concept_name'))}), ' ') AS k FROM concepts),
uniq AS (SELECT k, MIN(rxcui) AS rxcui, MIN(tty) AS tty, MIN(concept_name) AS concept_name, MIN(base) AS base FROM ckeys GROUP BY k HAVING COUNT(*) = 1),
exact AS (SELECT a.request_id, a.medication, u.rxcui, u.tty, u.concept_name, u.base FROM asked a LEFT JOIN uniq u ON u.k = array_to_string(list_sort({q.tokens(q.norm('a.medication'))}), ' ')),
loose AS (SELECT request_id, regexp_extract(medication, '(?i)^([A-Za-z][A-Za-z -]*?)\\s+([0-9.]+)\\s*(mcg|mg|g)$', 1) AS nm,
  TRY_CAST(regexp_extract(medication, '(?i)^([A-Za-z][A-Za-z -]*?)\\s+([0-9.]+)\\s*(mcg|mg|g)$', 2) AS DECIMAL(18,6)) AS amt,
  LOWER(regexp_extract(medication, '(?i)^([A-Za-z][A-Za-z -]*?)\\s+([0-9.]+)\\s*(mcg|mg|g)$', 3)) AS u FROM exact
  WHERE rxcui IS NULL AND regexp_matches(medication, '(?i)^([A-Za-z][A-Za-z -]*?)\\s+([0-9.]+)\\s*(mcg|mg|g)$')),
mg AS (SELECT request_id, nm, amt * CASE u WHEN 'mcg' THEN 0.001 WHEN 'g' THEN 1000 ELSE 1 END AS mg FROM loose),
base AS (SELECT m.request_id, m.mg, u.base, CASE u.tty WHEN 'BN' THEN 'SBDC' ELSE 'SCDC' END AS want FROM mg m
  JOIN uniq u ON u.k = array_to_string(list_sort({q.tokens(q.norm('m.nm'))}), ' ') AND u.tty IN ('BN', 'IN')),
parts AS (SELECT b.request_id, COUNT(*) AS c, MIN(x.rxcui) AS rxcui, MIN(x.tty) AS tty, MIN(x.concept_name) AS concept_name, MIN(x.base) AS base FROM base b
  JOIN concepts x ON x.base = b.base AND x.tty = b.want AND TRY_CAST(regexp_extract(x.concept_name, ' ([0-9]+) mg', 1) AS DECIMAL(18,6)) = b.mg GROUP BY b.request_id),
matched AS (SELECT e.request_id, COALESCE(e.rxcui, p.rxcui) AS rxcui, COALESCE(e.tty, p.tty) AS tty, COALESCE(e.concept_name, p.concept_name) AS concept_name, COALESCE(e.base, p.base) AS base
  FROM exact e LEFT JOIN parts p ON p.request_id = e.request_id AND p.c = 1),
prod AS (SELECT * FROM matched WHERE tty IN ('SCDC', 'SBDC')),
gen AS (SELECT p.request_id, COUNT(*) AS c, MIN(g.rxcui) AS rxcui, MIN(g.concept_name) AS concept_name FROM prod p
  JOIN concepts g ON g.base = p.base AND g.tty = 'SCDC' WHERE p.tty = 'SBDC' GROUP BY p.request_id)
SELECT a.request_id, COALESCE(CASE WHEN p.tty = 'SCDC' THEN p.concept_name WHEN g.c = 1 THEN g.concept_name END, a.medication) AS name,
  CASE WHEN p.tty = 'SCDC' THEN p.rxcui WHEN g.c = 1 THEN g.rxcui END AS rxcui, CASE WHEN p.tty = 'SCDC' OR g.c = 1 THEN p.rxcui END AS matched_rxcui,
  CASE WHEN p.tty = 'SCDC' OR g.c = 1 THEN 'ingredient_strength' END AS scope, CASE WHEN p.tty = 'SCDC' OR g.c = 1 THEN 'verified' ELSE 'unverified' END AS status
FROM asked a LEFT JOIN prod p ON p.request_id = a.request_id LEFT JOIN gen g ON g.request_id = a.request_id""")
def resolve_components(t):
    rows = t.sql(COMPONENT_SQL)
    related = rows.select("base", F.col("rxcui").alias("related_rxcui"))
    # In the fixture every concept of one base name is related to every other; bases are small.
    relations = rows.select("base", "rxcui").join(related, "base").where("rxcui <> related_rxcui").drop("base")
    return plan.resolve_components(t.sql(REQUEST_SQL), rows.drop("base"), relations)
