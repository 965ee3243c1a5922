"""Small cases for the jobs: rules, redirects, identity safety, re-keying, sources and sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quotegrain.operators import fingerprint, redirects
from quotegrain.plans import capture, compare, frontier, household, identity, matching, offers, quality, reliability, rekey, research
from quotegrain.sources import captures, sinks

NOW = dt.datetime(2024, 5, 2, 12)
OFFER = (
    "match_status string, content_quantity long, content_unit string, enabled boolean, active boolean, availability string, quote_kind string, "
    "availability_basis string, price_cents long, last_checked_at timestamp_ntz, valid_until timestamp_ntz, quantity long"
)
GOOD = dict(
    match_status="verified", content_quantity=1, content_unit="tablet", enabled=True, active=True, availability="in_stock", quote_kind=None,
    availability_basis=None, price_cents=100, last_checked_at=NOW - dt.timedelta(hours=24), valid_until=None, quantity=30,
)


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, None),
        ({"enabled": False, "match_status": "unmatched"}, "source_disabled"),
        ({"match_status": "unmatched"}, "not_verified"),
        ({"content_unit": None}, "not_verified"),
        ({"active": False, "availability": "unknown"}, "retired"),
        ({"availability": "out_of_stock"}, "out_of_stock"),
        ({"price_cents": None}, "missing_price"),
        ({"last_checked_at": NOW - dt.timedelta(hours=24, seconds=1)}, "stale_or_expired"),
        ({"valid_until": NOW}, "stale_or_expired"),
        ({"valid_until": NOW + dt.timedelta(seconds=1)}, None),
    ],
)
def test_first_failing_reason(spark, change, reason):
    rules = offers.OfferRules(as_of=F.lit(NOW).cast("timestamp_ntz"))
    row = {**GOOD, **change}
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in OFFER.split(", "))], OFFER)
    got = df.select(offers.exclusion_reason(rules).alias("r"), F.coalesce(offers.eligible(rules), F.lit(False)).alias("e")).first()
    assert (got["r"], got["e"]) == (reason, reason is None)


def test_redirects(spark):
    pairs = [(i, i - 1 if i else None) for i in range(25)] + [(100, 101), (101, 100), (200, 999)]
    got = {r["id"]: r["resolved_id"] for r in redirects.resolve(spark.createDataFrame(pairs, "id long, to long"), "id", "to").collect()}
    assert got[0] == 0 and got[20] == 0 and got[21] is None and got[24] is None
    assert got[100] is None and got[101] is None and got[200] is None


def test_chain_needs_a_first_page_and_an_end(spark):
    rows = [
        (1, 1, "a", None, "x"), (2, 2, "a", "x", "y"), (3, 3, "a", "y", None),
        (4, 4, "b", None, "x"), (5, 5, "c", "x", None), (6, 6, "d", None, "z"), (7, 7, "d", "z", "z"),
    ]
    df = spark.createDataFrame(rows, "page_id long, seq long, query_key string, cursor string, next_cursor string")
    assert {r["page_id"] for r in research.complete_pages(df).where("complete").collect()} == {1, 2, 3}


RAW = "medication_id long, name string, strength string, form string, route string, release_type string, brand_name string, ndc string, species array<string>, reviewed boolean"


def test_dose_identities_stay_apart(spark):
    base = ("metoprolol tartrate", "25 mg", "tablet", "oral", "immediate", None, None, [])
    other = [
        ("metoprolol succinate", *base[1:]), (base[0], "50 mg", *base[2:]), (*base[:2], "capsule", *base[3:]),
        (*base[:4], "extended", *base[5:]), (base[0], "25 mg/mL", *base[2:]), (*base[:7], ["dog"]), (*base[:5], "Lopressor", *base[6:]),
    ]
    rows = [(2 * i + j, *v, True) for i, o in enumerate(other) for j, v in enumerate((base, o))]
    keyed = identity.normalize(spark.createDataFrame(rows, RAW)).select(
        F.floor(F.col("medication_id") / 2).alias("pair_id"), F.lit("x").alias("label"), identity.local_key().alias("normalized_key")
    )
    assert keyed.where("normalized_key IS NULL").count() == 0
    assert quality.collapsed_pairs(keyed).count() == 0


def test_approximate_match_never_verifies(spark):
    concepts = identity.prepare_concepts(spark.createDataFrame(
        [(1, "lisinopril 20 mg oral tablet", "SCD", True), (2, "lisinopril 20 mg oral tablet [zestril]", "SBD", True)], "rxcui long, concept_name string, tty string, active boolean"
    ))
    ndc = spark.createDataFrame([("00000000001", 1)], "ndc string, rxcui long")
    rows = [
        (1, "lisinopril", "20mg", "tablet", None, None, None, "00000000001", [], False),
        (2, "lisinopril", "20 mg", "oral tablet", None, None, None, None, [], False),
        (3, "lisinopril", "20mg", "tabs", None, None, None, None, [], False),
        (4, "lisinopril", "40mg", "tablet", None, None, None, "00000000001", [], False),
    ]
    inputs = identity.distinct_inputs(identity.normalize(spark.createDataFrame(rows, RAW)))
    got = {r["medication_id"]: (r["status"], r["method"]) for r in identity.decide(inputs, concepts, ndc).collect()}
    assert got[1] == ("verified", "ndc") and got[2] == ("verified", "rxnorm_exact")
    assert got[3] == ("needs_review", "rxnorm_approximate") and got[4] == ("unmatched", "ndc")


def test_reconcile_never_undeletes_or_reprices(spark):
    line = "doc long, member_id long, line long, nickname string, quantity long"
    old = spark.createDataFrame([(1, 1, 1, "a", 5, 2.0, 10.0, True), (1, 1, 2, "a", 5, 2.0, 10.0, False)], line + ", unit_price double, total double, deleted boolean")
    new = spark.createDataFrame([(1, 1, 1, "b", 9), (1, 2, 3, "c", 1)], line)
    got = {r["line"]: (r["nickname"], r["quantity"], float(r["unit_price"]), r["deleted"]) for r in household.reconcile(old, new, "doc", ["line"], ["quantity"]).collect()}
    assert got == {1: ("b", 9, 2.0, True), 2: ("b", 5, 2.0, True), 3: ("c", 1, 0.0, False)}


def test_streaks(spark):
    passes = [True, True, False, True, True, True]
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i, hours=2), s, p) for i, p in enumerate(passes) for s in (0, 1)]
    grades = spark.createDataFrame(rows, "index long, deadline timestamp_ntz, source_id long, passed boolean")
    at = lambda day: F.lit(dt.datetime(2024, 1, day, 12)).cast("timestamp_ntz")
    row = reliability.streaks(grades, at(6), needed=3).first()
    assert (row["consecutive"], row["best"], row["passed_all"]) == (3, 3, True)
    row = reliability.streaks(grades, at(3)).first()
    assert (row["consecutive"], row["best"]) == (0, 2)


def test_rekey_round_trip(spark):
    canon = "canonical_name string, normalized_key string, strength string, form string, route string, release_type string, rxcui string, term_type string"
    meds = spark.createDataFrame(
        [(i, None, None, None, None, "5MG", "tabs", "oral", "x", None, None) for i in (1, 2, 3)], "medication_id long, status string, superseded_by_id long, " + canon
    )
    listings = spark.createDataFrame([(10 + i, i, "verified", "tabs") for i in (1, 2, 3)], "listing_id long, medication_id long, match_status string, content_unit string")
    decisions = spark.createDataFrame(
        [(10 + i, i, "verified", "tabs", "verified" if i < 3 else "unmatched", None if i < 3 else "no_compatible_concept", "c" if i < 3 else None, "k" if i < 3 else None, "5 mg", "tablet", "oral", "immediate", "7", "SCD") for i in (1, 2, 3)],
        "listing_id long, legacy_id long, listing_status string, content_unit string, status string, reason string, " + canon,
    )
    items = rekey.approve(rekey.group_items(rekey.plan_items(decisions), meds.where("status = 'verified'")), collisions=True)
    new = rekey.apply(meds, listings, items, decisions, "r1")
    state = {r["medication_id"]: (r["status"], r["superseded_by_id"], r["normalized_key"]) for r in new.medications.collect()}
    assert state == {1: ("verified", None, "k"), 2: ("superseded", 1, None), 3: (None, None, None)}
    assert {r["listing_id"]: (r["medication_id"], r["content_unit"]) for r in new.listings.collect()} == {11: (1, "tablet"), 12: (1, "tablet"), 13: (3, "tabs")}
    assert rekey.undo_blockers(new.listings, listings, items, "r1").count() == 0
    assert quality.bad_redirects(new.medications).count() == 0
    back = rekey.undo(new, meds, listings, items, "r1")
    assert fingerprint.differences(meds, back.medications.select(*meds.columns)).count() == 0
    assert fingerprint.differences(listings, back.listings.select(*listings.columns)).count() == 0
    # A later run keeps the marks and components of this one, and its undo takes only its own.
    marked = new.listings.select("listing_id", "medication_id", "match_status", "content_unit", "rekey_run")
    later = rekey.apply(new.medications, marked, items.limit(0), decisions, "r2")
    assert {r["rekey_run"] for r in later.listings.where("listing_id < 13").collect()} == {"r1"}
    both = rekey.Rekeyed(new.medications, new.listings, new.components.unionByName(new.components.withColumn("rekey_run", F.lit("r0"))), new.matches)
    left = rekey.undo(both, meds, listings, items, "r1").components.collect()
    assert {r["rekey_run"] for r in left} == {"r0"} and len(left) == new.components.count()
    foreign = new.listings.unionByName(new.listings.limit(1).withColumn("listing_id", F.lit(99).cast("long")).withColumn("medication_id", F.lit(1).cast("long")))
    assert {r["reason"] for r in rekey.undo_blockers(foreign, listings, items, "r1").collect()} == {"new_reference"}


def test_fingerprint_sees_multiplicity(spark):
    once, twice = spark.createDataFrame([(1, None)], "a long, b string"), spark.createDataFrame([(1, None), (1, None)], "a long, b string")
    first, second = (fingerprint.table_fingerprint(x, "t").first() for x in (once, twice))
    assert first["digest"] != second["digest"] and (first["rows"], second["rows"]) == (1, 2)


def test_attempts_and_due(spark):
    latest = spark.createDataFrame([(1, True), (2, False), (3, False), (4, False)], "source_id long, paused boolean")
    tried = spark.createDataFrame([(2, 100), (3, 1), (3, 2), (3, 3)], "source_id long, manifest_index long")
    got = {r["source_id"]: r["state"] for r in frontier.attempt_state(tried, latest, 100, 3).collect()}
    assert got == {1: "paused", 2: "already_attempted_full_cohort", 3: "process_restart_limit_reached", 4: "may_start"}


def test_readers(spark, tmp_path):
    (tmp_path / "list.txt").write_text("Top drugs\n001. Atorvastatin\n 002.  Lisinopril \nnot an entry\n")
    path = str(tmp_path / "list.txt")
    assert sorted(r["entry"] for r in captures.read_reference_list(spark, path, 2).collect()) == ["Atorvastatin", "Lisinopril"]
    with pytest.raises(ValueError):
        captures.read_reference_list(spark, path)
    model = {"medications": [{"name": "A", "form": "tablet", "doses_per_day": 1, "strengths": [{"strength": "5mg", "acquisition_unit_price_cents": 1.5}, {"strength": "10mg", "acquisition_unit_price_cents": 2}]}]}
    (tmp_path / "model.json").write_text(json.dumps(model, indent=1))
    rows = captures.read_price_model(spark, str(tmp_path / "model.json")).orderBy("position").collect()
    assert [(r["name"], r["strength"], float(r["acquisition_unit_price_cents"])) for r in rows] == [("A", "5mg", 1.5), ("A", "10mg", 2.0)]
    (tmp_path / "cat.json").write_text(json.dumps({"results": [{"ndc": "1", "url": "http://shop.example/a"}, {"ndc": "2", "url": "https://shop.example/b"}]}, indent=1))
    from quotegrain.functions.urls import Site

    known = spark.createDataFrame([("https://shop.example/b",)], "url string")
    new = captures.catalogue_pages(captures.read_catalogue(spark, str(tmp_path / "cat.json")), Site(hosts=["shop.example"]), known)
    assert [(r["url"], r["page_type"]) for r in new.collect()] == [("https://shop.example/a", "product")]
    obs = {"listing": {"source_product_key": "k", "source_name": "n"}, "offers": [{"quantity": "30", "price_cents": "5"}, {"quantity": "60"}], "observed_at": "2024-01-01T00:00:00Z", "complete": True}
    (tmp_path / "obs.json").write_text(json.dumps(obs) + "\n")
    assert captures.flatten_offers(captures.read_observations(spark, str(tmp_path / "obs.json"))).count() == 2


def test_sinks(spark, tmp_path):
    quotes = lambda rows: spark.createDataFrame(rows, "doc long, price long")
    path = str(tmp_path / "quotes")
    sinks.replace_children(quotes([(1, 10), (1, 11), (2, 20)]), path, "doc", spark, buckets=1)
    sinks.replace_children(quotes([(1, 12)]), path, "doc", spark, buckets=1)
    assert sorted((r["doc"], r["price"]) for r in spark.read.parquet(path).collect()) == [(1, 12), (2, 20)]
    # A document with no quote left is cleared, alone in its folder or not.
    cleared = spark.createDataFrame([(1,)], "doc long")
    sinks.replace_children(quotes([]), path, "doc", spark, buckets=1, documents=cleared)
    assert [(r["doc"], r["price"]) for r in spark.read.parquet(path).collect()] == [(2, 20)]
    sinks.replace_children(quotes([]), path, "doc", spark, buckets=1, documents=spark.createDataFrame([(2,)], "doc long"))
    assert spark.read.schema("doc long, price long").parquet(path).count() == 0

    root = str(tmp_path / "table")
    for version in ("v1", "v2"):
        sinks.write_version(quotes([(1, int(version[1]))]), root, version)
        sinks.point_to(spark, root, version)
    assert sinks.current_version(spark, root) == "v2" and sinks.read_current(spark, root).first()["price"] == 2

    blobs = spark.createDataFrame([("s", "k", "b"), ("s", "k", "b"), ("s", "k", "c")], "source string, key string, body string")
    rows = sinks.evidence_rows(blobs)
    assert sinks.new_evidence(rows.limit(0), rows).count() == 2 and sinks.evidence_conflicts(rows).count() == 0
    assert sinks.evidence_conflicts(rows.withColumn("body", F.lit("z"))).count() == 2

    history = spark.createDataFrame([(1, dt.datetime(2024, 1, 2)), (1, dt.datetime(2024, 2, 2))], "listing_id long, observed_at timestamp_ntz")
    sinks.append_history(history, str(tmp_path / "history"))
    assert spark.read.parquet(str(tmp_path / "history")).count() == 2
    sinks.write_report(history, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_scope_filter_finds_long_entries(spark):
    labels = spark.createDataFrame([(1, "the alpha beta gamma delta epsilon zeta eta theta kit"), (2, "alpha beta"), (3, "")], "label_id long, label string")
    entries = spark.createDataFrame([("alpha beta gamma delta epsilon zeta eta theta",), ("alpha beta",)], "entry string")
    got = {r["label_id"]: r["entries"] for r in matching.scope_filter(labels, entries).collect()}
    assert got == {1: 2, 2: 1}
    assert matching.scope_filter(labels, entries.limit(0)).count() == 0


def test_long_documents_are_one_row(spark):
    rows = [(1, m, f"n{m}", k, k) for m in (1, 2) for k in range(1500)]
    lines = spark.createDataFrame(rows, "doc long, member_id long, nickname string, line_no long, medication_id long")
    docs = household.nest(lines, "doc", "line_no", ["medication_id"]).collect()
    assert len(docs) == 1 and [len(m["lines"]) for m in docs[0]["members"]] == [1500, 1500]


def test_quotes_come_from_offers(spark):
    lines = spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "line_id long, medication_id long")
    offers = spark.createDataFrame(
        [(7, "b", True, 500), (7, "b", True, 450), (7, "a", True, 700), (7, "c", False, 1), (8, "a", True, None)], "medication_id long, source string, active boolean, price_cents long"
    )
    got = household.quote_matrix(lines, household.seller_quotes(offers)).collect()
    assert sorted((r["line_id"], r["position"], r["pharmacy"], float(r["price"])) for r in got) == [(1, 0, "a", 7.0), (1, 1, "b", 4.5)]


def test_requested_strength(spark):
    strengths = spark.createDataFrame([("m", 2, "10 MG"), ("m", 1, "5mg"), ("m", 3, "10-mg"), ("n", 4, "1 mg")], "medicine string, position long, strength string")
    asked = spark.createDataFrame([(1, "m", "10 mg"), (2, "m", "7 mg"), (3, "n", None), (4, "x", "1 mg")], "request_id long, medicine string, wanted string")
    got = {r["request_id"]: (r["strength"], r["defaulted"]) for r in compare.pick_strength(strengths, asked).collect()}
    assert got == {1: ("10 MG", False), 2: ("5mg", True), 3: ("1 mg", True)}


def test_offer_keys_with_null_parts(spark):
    kind = "array<struct<quantity:string,price_cents:string,currency:string,availability:string,seller_key:string,location_key:string,program_key:string>>"
    row = lambda location, program: ("30", "5", "USD", "in_stock", "s", location, program)
    rows = [(1, [row(None, "p"), row("p", None)]), (2, [row(None, "p"), row(None, "p")])]
    df = spark.createDataFrame(rows, f"id long, offers {kind}").select("*", F.lit("k").alias("source_product_key"), F.lit("n").alias("source_name"), F.current_timestamp().alias("observed_at"))
    got = {r["id"]: r["reasons"] for r in capture.observation_reasons(df).collect()}
    assert got == {1: [], 2: ["duplicate_quantity_context"]}


def test_strengths_are_dealt_out_before_they_are_priced(spark):
    """one small file of strengths does not become one task's twelvefold rows."""
    from quotegrain.plans import compare

    rows = spark.range(400).coalesce(1).selectExpr(
        "id AS p_partkey", "CAST(id % 50 AS DECIMAL(12,4)) AS acquisition_unit_price_cents", "id % 3 + 1 AS doses_per_day", "id % 4 = 0 AS in_program")
    prices = compare.modelled_prices(rows)
    assert prices.count() == 400 * 12
    assert prices.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert compare.best_value(prices, ["p_partkey"]).count() == 400


def test_lines_are_told_apart_before_they_meet_quotes(spark, tmp_path):
    """F8: repeated lines go before the quotes of their medication are laid out, and each line still has each quote once."""
    import datetime as dt

    import __spark_entry__ as entry

    day = dt.datetime(2000, 1, 1)
    line = [(1, 10, s, 1, 20.0, 100.0, 0.0, 0.0, "N", "O", day) for s in (1, 2, 2)]
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(5, "ann", 3)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(10, "drug", "b", "SMALL", 4, 90.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    found = entry.queries()["rank_quotes"](spark, str(tmp_path))
    got = sorted((r["line_id"], r["pharmacy"], r["rank"]) for r in found.collect())
    assert got == [(110001, "source_1", 1), (110001, "source_2", 2), (110002, "source_1", 1), (110002, "source_2", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # Nothing is made distinct above the generator that lays quotes out.
    lies = next(k for k, text in enumerate(plan) if "Generate posexplode" in text)
    assert not any("Aggregate [prescription_id" in text for text in plan[:lies]) and any("Aggregate [prescription_id" in text for text in plan[lies:])
