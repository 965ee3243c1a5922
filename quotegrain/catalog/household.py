"""Household documents, prices and deals."""

from pyspark.sql import functions as F

from quotegrain.catalog import query
from quotegrain.catalog.offers import FROM_ALL, eligible_sql, enriched, rules
from quotegrain.functions import text
from quotegrain.plans import household as plan
from quotegrain.plans import offers as offer_plan

# Saved lines with the drug text as a person typed it.
RX_SQL = """
SELECT p.*, p.prescription_id * 100000 + p.line_no * 10000 + p.l_suppkey AS line_id, '  ' || UPPER(m.name) AS rx_name,
  LOWER(m.strength) AS rx_strength, m.form || ' ' AS rx_form
FROM b_prescriptions p JOIN b_medications m ON m.medication_id = p.medication_id"""

KEY_SQL = "LOWER(TRIM({0}name)) || '|' || regexp_replace(LOWER({0}strength), '\\s', '', 'g') || '|' || LOWER(TRIM({0}form))"
UNIQUE_CTE = f"""uniq AS (SELECT {KEY_SQL.format('')} AS k, MIN(medication_id) AS medication_id FROM b_medications GROUP BY 1 HAVING COUNT(*) = 1)"""

MATRIX_SQL = f"""best AS (SELECT l.medication_id, s.slug AS pharmacy, CAST(MIN(o.price_cents) / 100.0 AS DECIMAL(18,2)) AS price {FROM_ALL}
  WHERE o.active AND o.price_cents IS NOT NULL GROUP BY l.medication_id, s.slug),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY medication_id ORDER BY pharmacy) - 1 AS position FROM best),
quotes AS (SELECT r.prescription_id, r.line_id, r.medication_id, v.position, v.pharmacy, v.price FROM rx r JOIN placed v ON v.medication_id = r.medication_id)"""

LINE = ["prescription_id", "line_id", "medication_id"]


def rx(t):
    return t.sql(RX_SQL)


def matrix(t):
    return plan.quote_matrix(rx(t), plan.seller_quotes(enriched(t)))


@query("ambiguous_identity_anti", "JOIN-08", oracle=f"WITH {UNIQUE_CTE} SELECT k AS key, medication_id FROM uniq")
def ambiguous_identity_anti(t):
    return plan.unambiguous(t.medications)


@query("rx_identity_join", "JOIN-09", oracle=f"""
WITH rx AS ({RX_SQL}), {UNIQUE_CTE}
SELECT r.line_id, r.household_id, u.medication_id FROM rx r JOIN uniq u ON u.k = {KEY_SQL.format('r.rx_')}""")
def rx_identity_join(t):
    linked = plan.link_prescriptions(rx(t).drop("medication_id"), t.medications)
    return linked.select("line_id", "household_id", "medication_id")


@query("household_offers", "JOIN-21", "SRT-05", oracle=f"""
WITH rx AS ({RX_SQL}), {UNIQUE_CTE}
SELECT household_id, line_id, offer_id, price_cents, place FROM (
  SELECT r.household_id, r.line_id, o.offer_id, o.price_cents, ROW_NUMBER() OVER (PARTITION BY r.household_id
    ORDER BY r.confirmed_at DESC, o.price_cents, o.offer_id, r.prescription_id, r.line_no, r.l_suppkey) AS place
  {FROM_ALL} JOIN uniq u ON u.medication_id = l.medication_id JOIN rx r ON u.k = {KEY_SQL.format('r.rx_')} WHERE {eligible_sql()}) x WHERE place <= 500""")
def household_offers(t):
    linked = plan.link_prescriptions(rx(t).drop("medication_id"), t.medications)
    offers = enriched(t).where(offer_plan.eligible(rules())).select("medication_id", "offer_id", "price_cents", "source")
    return plan.household_offers(linked, offers).select("household_id", "line_id", "offer_id", "price_cents", "place")


@query("household_deals", "JOIN-14", "HH-07", oracle=f"""
WITH rx AS ({RX_SQL}), {UNIQUE_CTE},
shown AS (SELECT * FROM (SELECT r.line_id, o.offer_id, o.price_cents, ROW_NUMBER() OVER (PARTITION BY r.household_id
    ORDER BY r.confirmed_at DESC, o.price_cents, o.offer_id, r.prescription_id, r.line_no, r.l_suppkey) AS place
  {FROM_ALL} JOIN uniq u ON u.medication_id = l.medication_id JOIN rx r ON u.k = {KEY_SQL.format('r.rx_')} WHERE {eligible_sql()}) x WHERE place <= 500),
per AS (SELECT line_id, COUNT(*) AS n, MIN(price_cents) AS cheapest FROM shown GROUP BY line_id),
res AS (SELECT DISTINCT LOWER(TRIM(name)) || '|' || LOWER(TRIM(strength)) || '|' || LOWER(TRIM(form)) AS k FROM b_medications WHERE medication_id % 2 = 0)
SELECT r.line_id, r.member_id, CASE WHEN r.member_id % 9 = 0 THEN 'Household member' ELSE r.nickname END AS member_name, COALESCE(p.n, 0) AS offers, p.cheapest AS cheapest_cents,
  CASE WHEN s.k IS NULL THEN 'unavailable' ELSE 'complete' END AS research_status
FROM rx r LEFT JOIN per p ON p.line_id = r.line_id LEFT JOIN res s ON s.k = LOWER(TRIM(r.rx_name)) || '|' || LOWER(TRIM(r.rx_strength)) || '|' || LOWER(TRIM(r.rx_form))""")
def household_deals(t):
    lines = rx(t)
    linked = plan.link_prescriptions(lines.drop("medication_id"), t.medications)
    offers = enriched(t).where(offer_plan.eligible(rules())).select("medication_id", "offer_id", "price_cents", "source")
    shown = plan.household_offers(linked, offers)
    members = t.customer.where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("member_id"), F.col("c_name").alias("nickname"))
    research = t.medications.where("medication_id % 2 = 0").select(
        F.concat_ws("|", *[text.folded(F.col(c)) for c in ("name", "strength", "form")]).alias("research_key")
    ).distinct().withColumn("research_status", F.lit("complete"))
    deals = plan.deals(lines, shown, members, research)
    return deals.select(
        "line_id", "member_id", "member_name", F.size("offers").alias("offers"),
        F.get("offers", F.lit(0))["price_cents"].alias("cheapest_cents"), "research_status",
    )


@query("quote_matrix", "JOIN-12", "PRC-06", oracle=f"""
WITH rx AS ({RX_SQL}), {MATRIX_SQL} SELECT line_id, medication_id, position, pharmacy, CAST(price AS DOUBLE) AS price FROM quotes""")
def quote_matrix(t):
    return matrix(t).select("line_id", "medication_id", "position", "pharmacy", F.col("price").cast("double").alias("price"))


@query("rank_quotes", "WIN-06", oracle=f"""
WITH rx AS ({RX_SQL}), {MATRIX_SQL}, d AS (SELECT DISTINCT * FROM quotes)
SELECT line_id, medication_id, pharmacy, CAST(price AS DOUBLE) AS price,
  ROW_NUMBER() OVER (PARTITION BY prescription_id, line_id, medication_id ORDER BY price, position) AS rank FROM d""")
def rank_quotes(t):
    # A medication's quotes differ among themselves, so lines that differ give quotes that differ.
    quotes = plan.quote_matrix(rx(t).select(*LINE).distinct(), plan.seller_quotes(enriched(t)))
    ranked = plan.rank_quotes(quotes, LINE)
    return ranked.select("line_id", "medication_id", "pharmacy", F.col("price").cast("double").alias("price"), "rank")


def priced(t):
    """A line takes the least price of its medication, so the quotes shrink to one a medication before they meet the lines."""
    lines = rx(t).withColumns({"unit_price": F.lit("1.00").cast(plan.MONEY), "total": F.col("quantity").cast(plan.MONEY)})
    return plan.price_lines(lines, plan.offer_prices(enriched(t)), ["medication_id"])


PRICED_SQL = f"""WITH rx AS ({RX_SQL}), {MATRIX_SQL},
cheapest AS (SELECT prescription_id, line_id, medication_id, MIN(price) AS best FROM quotes GROUP BY ALL),
priced AS (SELECT r.*, CASE WHEN NOT r.deleted AND b.best IS NOT NULL THEN b.best ELSE 1.00 END AS unit_price,
  CASE WHEN NOT r.deleted AND b.best IS NOT NULL THEN ROUND(r.quantity * b.best, 2) ELSE r.quantity END AS total
  FROM rx r LEFT JOIN cheapest b ON b.prescription_id = r.prescription_id AND b.line_id = r.line_id AND b.medication_id = r.medication_id)"""


@query("price_households", "HH-01", "UDF-02", oracle=f"""
{PRICED_SQL} SELECT line_id, medication_id, quantity, deleted, CAST(unit_price AS DOUBLE) AS unit_price, CAST(total AS DOUBLE) AS total FROM priced""")
def price_households(t):
    return priced(t).select(
        "line_id", "medication_id", "quantity", "deleted",
        F.col("unit_price").cast("double").alias("unit_price"), F.col("total").cast("double").alias("total"),
    )


@query("household_total", "AGG-07", "HH-02", oracle=f"""
{PRICED_SQL} SELECT prescription_id, CAST(COALESCE(SUM(total) FILTER (WHERE NOT deleted), 0) AS DOUBLE) AS total_price FROM priced GROUP BY prescription_id""")
def household_total(t):
    totals = plan.document_totals(priced(t), "prescription_id")
    return totals.select("prescription_id", F.col("total_price").cast("double").alias("total_price"))


# Stored lines and a resubmission: dropped members and lines, changed amounts, new lines.
STORED_SQL = """SELECT DISTINCT prescription_id, member_id, line_no * 1000000 + medication_id AS line_key, nickname, quantity, deleted FROM b_prescriptions
WHERE l_suppkey % 2 = 0 AND line_no <> 6"""
SENT_SQL = """SELECT DISTINCT prescription_id, member_id, line_no * 1000000 + medication_id AS line_key, nickname || ' jr' AS nickname, quantity + 1 AS quantity FROM b_prescriptions
WHERE l_suppkey % 2 = 0 AND prescription_id % 11 <> 0 AND (line_no + prescription_id) % 3 <> 0"""
DOC_SQL = "SELECT o_orderkey AS prescription_id, c_nationkey AS household_id, o_orderdate AS submitted_at, o_orderstatus = 'P' AS deleted FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 17 <> 0"


def one_line(df):
    """A line key may repeat in the fixture; keep the smallest amount per key."""
    others = [c for c in df.columns if c not in ("prescription_id", "member_id", "line_key", "quantity")]
    return df.groupBy("prescription_id", "member_id", "line_key").agg(
        F.min("quantity").alias("quantity"),
        *[F.min(c).alias(c) for c in others],
    )


RECON_SQL = f"""WITH s0 AS ({STORED_SQL}), n0 AS ({SENT_SQL}), docs AS ({DOC_SQL}),
s AS (SELECT prescription_id, member_id, line_key, MIN(nickname) AS nickname, MIN(quantity) AS quantity, BOOL_AND(deleted) AS deleted FROM s0 GROUP BY ALL),
n AS (SELECT prescription_id, member_id, line_key, MIN(nickname) AS nickname, MIN(quantity) AS quantity FROM n0
  WHERE prescription_id IN (SELECT prescription_id FROM docs WHERE NOT deleted) GROUP BY ALL)"""


@query("reconcile_lines", "JOIN-13", "HH-03", oracle=f"""
{RECON_SQL}, sx AS (SELECT * FROM s WHERE prescription_id IN (SELECT prescription_id FROM docs WHERE NOT deleted)),
nm AS (SELECT prescription_id, member_id, MIN(nickname) AS nickname FROM n GROUP BY ALL)
SELECT COALESCE(s.prescription_id, n.prescription_id) AS prescription_id, COALESCE(s.member_id, n.member_id) AS member_id, COALESCE(s.line_key, n.line_key) AS line_key,
  COALESCE(nm.nickname, s.nickname) AS nickname, COALESCE(n.quantity, s.quantity) AS quantity,
  CAST(CASE WHEN s.line_key IS NULL THEN 0 ELSE 2.5 END AS DOUBLE) AS unit_price, CASE WHEN s.line_key IS NULL THEN FALSE WHEN n.line_key IS NULL THEN TRUE ELSE s.deleted END AS deleted
FROM sx s FULL JOIN n ON n.prescription_id = s.prescription_id AND n.member_id = s.member_id AND n.line_key = s.line_key
LEFT JOIN nm ON nm.prescription_id = COALESCE(s.prescription_id, n.prescription_id) AND nm.member_id = COALESCE(s.member_id, n.member_id)""")
def reconcile_lines(t):
    docs = t.sql(DOC_SQL)
    money = F.lit("2.50").cast(plan.MONEY)
    stored = one_line(t.sql(STORED_SQL)).withColumns({"unit_price": money, "total": money})
    stored = plan.accepts_update(stored, docs, "prescription_id")
    sent = plan.accepts_update(one_line(t.sql(SENT_SQL)), docs, "prescription_id")
    merged = plan.reconcile(stored, sent, "prescription_id", ["line_key"], ["quantity"])
    return merged.select(
        "prescription_id", "member_id", "line_key", "nickname", "quantity",
        F.col("unit_price").cast("double").alias("unit_price"), "deleted",
    )


@query("rejected_updates", "HH-03", oracle=f"""
{RECON_SQL} SELECT DISTINCT prescription_id FROM n0 WHERE prescription_id NOT IN (SELECT prescription_id FROM docs WHERE NOT deleted)""")
def rejected_updates(t):
    return plan.rejected_updates(t.sql(SENT_SQL), t.sql(DOC_SQL), "prescription_id")


@query("rx_document", "AGG-06", "HH-04", oracle="""
SELECT prescription_id, COUNT(DISTINCT member_id) AS members, COUNT(*) AS lines,
  array_to_string(list(CAST(line_no AS VARCHAR) || ':' || CAST(medication_id AS VARCHAR) ORDER BY member_id, line_no, medication_id, l_suppkey, quantity), ',') AS line_list
FROM b_prescriptions GROUP BY prescription_id""")
def rx_document(t):
    docs = plan.nest(t.prescriptions, "prescription_id", "line_no", ["medication_id", "l_suppkey", "quantity"])
    lines = F.flatten(F.transform("members", lambda m: m["lines"]))
    return docs.select(
        "prescription_id", F.size("members").alias("members"), F.size(lines).alias("lines"),
        F.array_join(F.transform(lines, lambda x: F.concat_ws(":", x["line_no"].cast("string"), x["medication_id"].cast("string"))), ",").alias("line_list"),
    )


@query("rx_document_lines", "HH-04", oracle="""
SELECT prescription_id, member_id, nickname, line_no, medication_id, l_suppkey, quantity FROM b_prescriptions""")
def rx_document_lines(t):
    docs = plan.nest(t.prescriptions, "prescription_id", "line_no", ["medication_id", "l_suppkey", "quantity"])
    return plan.unnest(docs, "prescription_id")


@query("tenant_scope", "FLT-08", oracle="""
SELECT prescription_id, member_id, line_no, medication_id FROM b_prescriptions WHERE household_id = 7""")
def tenant_scope(t):
    return plan.for_household(t.prescriptions, 7).select("prescription_id", "member_id", "line_no", "medication_id")


@query("soft_delete_list", "FLT-09", oracle="""
SELECT household_id, COUNT(*) FILTER (WHERE NOT deleted) AS active_lines, COUNT(*) AS all_lines FROM b_prescriptions GROUP BY household_id""")
def soft_delete_list(t):
    return t.prescriptions.groupBy("household_id").agg(
        F.count_if(~F.col("deleted")).alias("active_lines"), F.count(F.lit(1)).alias("all_lines")
    )


@query("folded_lookup", "FLT-12", oracle="""
SELECT c_custkey, c_name FROM customer WHERE LOWER(c_name) = 'customer#000000042'""")
def folded_lookup(t):
    return t.customer.where(F.lower("c_name") == F.lower(F.lit("CUSTOMER#000000042"))).select("c_custkey", "c_name")


@query("rx_summary", "PRJ-06", "SRT-07", oracle=f"""
WITH docs AS ({DOC_SQL}) SELECT prescription_id, submitted_at, household_id FROM docs WHERE NOT deleted AND household_id = 3""")
def rx_summary(t):
    docs = plan.for_household(t.sql(DOC_SQL), 3).where("NOT deleted")
    return docs.select("prescription_id", "submitted_at", "household_id").orderBy(F.col("submitted_at").desc())


@query("rx_recent", "SRT-07", oracle=f"""
WITH docs AS ({DOC_SQL}) SELECT prescription_id, submitted_at FROM docs WHERE household_id = 3 ORDER BY submitted_at DESC, prescription_id LIMIT 100""")
def rx_recent(t):
    docs = plan.for_household(t.sql(DOC_SQL), 3).select("prescription_id", "submitted_at")
    return docs.orderBy(F.col("submitted_at").desc(), "prescription_id").limit(100)


@query("rx_quotes", "JOIN-20", oracle=f"""
WITH rx AS ({RX_SQL}), {MATRIX_SQL} SELECT r.nickname, q.line_id, q.pharmacy, CAST(q.price AS DOUBLE) AS price FROM quotes q
JOIN rx r ON r.line_id = q.line_id AND r.medication_id = q.medication_id AND r.prescription_id = q.prescription_id WHERE r.prescription_id = 4242""")
def rx_quotes(t):
    lines = rx(t).where("prescription_id = 4242")
    quotes = matrix(t).where("prescription_id = 4242").select(*LINE, "position", "pharmacy", "price")
    joined = lines.select(*LINE, "nickname").join(quotes, LINE)
    return joined.select("nickname", "line_id", "pharmacy", F.col("price").cast("double").alias("price")).orderBy("line_id", "pharmacy")


@query("soft_delete", "HH-10", oracle=f"""
WITH docs AS ({DOC_SQL}) SELECT prescription_id, deleted OR (prescription_id % 13 = 0 AND household_id < 20) AS deleted FROM docs""")
def soft_delete(t):
    docs = t.sql(DOC_SQL)
    # Households from 20 on ask with a wrong household id, which must not delete anything.
    asked = docs.where("prescription_id % 13 = 0").select(
        "prescription_id", F.when(F.col("household_id") < 20, F.col("household_id")).otherwise(99).alias("household_id")
    )
    return plan.soft_delete(docs, asked, "prescription_id").select("prescription_id", "deleted")


@query("unknown_deletes", "HH-10", oracle=f"""
WITH docs AS ({DOC_SQL}), asked AS (SELECT o_orderkey AS prescription_id, c_nationkey AS household_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 13 = 0)
SELECT prescription_id, household_id FROM asked WHERE prescription_id NOT IN (SELECT prescription_id FROM docs)""")
def unknown_deletes(t):
    asked = t.sql("SELECT o_orderkey AS prescription_id, c_nationkey AS household_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 13 = 0")
    return plan.unknown_deletes(t.sql(DOC_SQL), asked, "prescription_id")


@query("idempotent_intake", "HH-05", "SCL-28", oracle="""
WITH saved AS (SELECT user_id AS k, MIN_BY(event_type, event_id) AS payload FROM events WHERE user_id % 5 = 0 GROUP BY user_id),
f AS (SELECT user_id AS k, MIN(event_id) AS first_id, MIN_BY(event_type, event_id) AS payload FROM events GROUP BY user_id)
SELECT e.event_id, e.user_id AS request_key, CASE WHEN s.k IS NULL AND e.event_id = f.first_id THEN 'created' WHEN e.event_type = COALESCE(s.payload, f.payload) THEN 'replayed' ELSE 'conflict' END AS outcome,
  SUBSTR(h, 1, 8) || '-' || SUBSTR(h, 9, 4) || '-' || SUBSTR(h, 13, 4) || '-' || SUBSTR(h, 17, 4) || '-' || SUBSTR(h, 21, 12) AS draft_id
FROM (SELECT *, sha256(CAST(user_id AS VARCHAR) || '|0') AS h FROM events) e JOIN f ON f.k = e.user_id LEFT JOIN saved s ON s.k = e.user_id""")
def idempotent_intake(t):
    requests = t.events.select(F.col("user_id").alias("request_key"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    saved = requests.where("request_key % 5 = 0").groupBy("request_key").agg(F.min_by("payload", "seq").alias("payload"))
    done = plan.idempotent_intake(requests, saved)
    return done.select(F.col("seq").alias("event_id"), "request_key", "outcome", "draft_id")


@query("intake_batch_sizes", "HH-05", oracle="""
SELECT c.c_custkey AS intake_id, COUNT(l.l_orderkey) AS lines, COUNT(l.l_orderkey) BETWEEN 1 AND 40 AS size_ok
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY c.c_custkey""")
def intake_batch_sizes(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("intake_id"))
    return plan.batch_sizes(lines, t.customer.select(F.col("c_custkey").alias("intake_id")), "intake_id")


MEMBER_SQL = """SELECT c_nationkey AS household_id, c_custkey AS member_id,
  CASE WHEN c_custkey % 2 = 0 THEN ' Ann ' ELSE 'aNN' END || CAST(c_custkey % 12 AS VARCHAR(5)) AS nickname FROM customer"""


@query("member_dedupe", "HH-06", oracle=f"""
WITH m AS ({MEMBER_SQL}), n AS (SELECT household_id, member_id, TRIM(nickname) AS nickname FROM m),
f AS (SELECT *, MIN(member_id) OVER (PARTITION BY household_id, LOWER(nickname)) AS kept_id FROM n)
SELECT household_id, member_id, kept_id, nickname, member_id <> kept_id AS replayed FROM f""")
def member_dedupe(t):
    return plan.dedupe_members(t.sql(MEMBER_SQL))


DRAFT_SQL = "SELECT c_nationkey AS household_id, o_custkey AS intake_id, o_orderkey AS draft_id, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey"


@query("unsaved_drafts", "JOIN-10", oracle=f"""
WITH d AS ({DRAFT_SQL}) SELECT household_id, intake_id, draft_id FROM d WHERE o_orderstatus <> 'F'""")
def unsaved_drafts(t):
    drafts = t.sql(DRAFT_SQL)
    saved = drafts.where("o_orderstatus = 'F'")
    left = plan.unsaved_drafts(drafts, saved).select("household_id", "intake_id", "draft_id")
    return left.orderBy("intake_id", "draft_id")


@query("batch_completeness", "SET-03", oracle=f"""
WITH d AS ({DRAFT_SQL}) SELECT intake_id, draft_id, 'incomplete_batch' AS problem FROM d WHERE o_orderstatus <> 'F' AND draft_id % 4 = 0
UNION ALL SELECT intake_id, draft_id + 1000000000 AS draft_id, 'draft_not_in_batch' AS problem FROM d WHERE draft_id % 50 = 0""")
def batch_completeness(t):
    drafts = t.sql(DRAFT_SQL).select("intake_id", "draft_id", "o_orderstatus")
    saved = drafts.where("o_orderstatus = 'F'").select("intake_id", "draft_id")
    given = drafts.where("draft_id % 4 <> 0").select("intake_id", "draft_id")
    foreign = drafts.where("draft_id % 50 = 0").select("intake_id", (F.col("draft_id") + 1000000000).alias("draft_id"))
    return plan.batch_problems(drafts, saved, given.unionByName(foreign))


@query("savings_total", "AGG-17", "HH-08", "SCL-13", oracle="""
WITH p AS (SELECT prescription_id, member_id, MIN(quantity) AS q FROM b_prescriptions WHERE NOT deleted GROUP BY ALL)
SELECT member_id, COUNT(*) AS deals, CAST(SUM(FLOOR(((3899 + q) - 1240) * 365 * 2 / 180.0 + 0.5)) AS BIGINT) AS savings_cents
FROM p WHERE member_id % 9 <> 0 GROUP BY member_id""")
def savings_total(t):
    lines = t.prescriptions.where("NOT deleted").groupBy("prescription_id", "member_id").agg(F.min("quantity").alias("q"))
    members = t.customer.where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("member_id"))
    saved = plan.annual_savings(F.lit(3899) + F.col("q"), F.lit(1240), 90)
    return lines.join(members, "member_id").groupBy("member_id").agg(
        F.count(F.lit(1)).alias("deals"), F.sum(saved).alias("savings_cents")
    )


@query("intake_checks", "DQ-09", "HH-09", oracle="""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 20 WHEN 0 THEN 'Refills:' WHEN 1 THEN ' date ' ELSE repeat('med ', CAST(l_quantity AS INTEGER)) END AS medication,
  repeat('x', CAST(l_quantity AS INTEGER) * 2) AS strength FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([CASE WHEN LENGTH(TRIM(medication)) > 160 THEN 'medication_too_long' END,
  CASE WHEN LENGTH(strength) > 80 THEN 'strength_too_long' END], lambda v: v IS NOT NULL), ',') AS problems
FROM x WHERE l_partkey % 20 > 1""")
def intake_checks(t):
    n = F.col("l_quantity").cast("int")
    drug = F.when(F.col("l_partkey") % 20 == 0, "Refills:").when(F.col("l_partkey") % 20 == 1, " date ").otherwise(F.repeat(F.lit("med "), n))
    empty = {c: F.lit("") for c in plan.FIELD_LIMITS if c not in ("medication", "strength")}
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", drug.alias("medication"),
                             F.repeat(F.lit("x"), n * 2).alias("strength")).withColumns(empty)
    checked = plan.field_problems(plan.not_headings(rows))
    return checked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("problems", ",").alias("problems"))
