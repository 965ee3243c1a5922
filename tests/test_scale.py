"""Steps that must stay small on large tables: what they write, shuffle or give to one task."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotegrain import catalog
from quotegrain.catalog import history
from quotegrain.plans import identity, ingest, matching
from quotegrain.sources import observations, serving
from quotegrain.sources.tables import Tables

catalog.load_all()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A few parts and lines, each table in one file."""
    root = str(tmp_path_factory.mktemp("scale"))
    parts = [(i, f"name {i % 7}", f"Brand#{i % 3}", "ECONOMY", i % 9, 1.0) for i in range(200)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{root}/part.parquet")
    lines = [(i // 4, i % 40, i % 9, i % 7 + 1, float(i % 50 + 1), 1.0, 0.0, 0.0, "NAR"[i % 3], "OF"[i % 2], dt.datetime(1996, 1, 1) + dt.timedelta(days=i % 900)) for i in range(2000)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                                 "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").coalesce(1).write.parquet(f"{root}/lineitem.parquet")
    return root


def shuffles(df):
    df.count()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_documents_are_packed(spark, folder, monkeypatch):
    paths = []
    read = observations.read
    monkeypatch.setattr(observations, "read", lambda s, path, more="": paths.append(path) or read(s, path, more))
    catalog.QUERIES["obs_flatten"](spark, folder)
    files = spark.read.format("binaryFile").load(paths[0]).select("path").collect()
    assert [r for r in files if r["path"].endswith(".json.gz")]


def test_parts_of_one_file_are_dealt_out(spark, folder):
    t = Tables(spark, folder)
    for rows in (t.sql("SELECT p_partkey FROM part", deal=("part",)), t.dealt("part")):
        assert rows.select(F.spark_partition_id()).distinct().count() > 8
    for name in ("captured_offers", "listing_from_search", "concept_candidates"):
        plan = catalog.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan, name


def test_search_meets_few_rows_of_a_name(spark):
    rows = spark.createDataFrame([(i, "red bolt", "b") for i in range(300)] + [(300 + i, "blue bolt", "b") for i in range(3)], "medication_id long, name string, brand_name string")
    found = matching.scored_search(rows, spark.createDataFrame([(1, "bolt"), (2, "red")], "query_id long, query string"), 4)
    assert sorted((r["query_id"], r["place"], r["medication_id"]) for r in found.collect()) == [
        (1, 1, 300), (1, 2, 301), (1, 3, 302), (1, 4, 0), (2, 1, 0), (2, 2, 1), (2, 3, 2), (2, 4, 3)]
    assert "[n#" in "".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines(True) if "WindowGroupLimit" in x)


def test_names_are_looked_up_for_inputs_that_nothing_better_found(spark):
    inputs = spark.createDataFrame([("a", None, "aspirin", "5 mg", "tablet"), ("b", None, "aspirin", "7 mg", "tablet")], "input_hash string, ndc string, name string, strength string, form string")
    inputs = inputs.withColumns({"norm_name": F.col("name"), "route": F.lit(None).cast("string"), "release_type": F.lit(None).cast("string"), "brand_name": F.lit(None).cast("string")})
    concepts = spark.createDataFrame([(1, "aspirin 5 mg tablet", "SCD", True), (2, "aspirin 9 mg tablet", "SCD", True)], "rxcui long, concept_name string, tty string, active boolean")
    codes = spark.createDataFrame([], "ndc string, rxcui long")
    pairs = identity.candidates(inputs, identity.prepare_concepts(concepts), codes)
    assert sorted(map(tuple, pairs.collect())) == [("a", 1, "rxnorm_exact"), ("b", 1, "rxnorm_approximate"), ("b", 2, "rxnorm_approximate")]
    assert "LeftAnti" in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_staged_arrivals_are_not_shuffled_again(spark, folder):
    t = Tables(spark, folder)
    decided = ingest.decide(history.arrivals(t)).select("listing_id", "seq", "outcome")
    assert decided.count() == 2000
    # Only the runs of listings with several identities move.
    assert shuffles(decided) <= 2
    done = ingest.apply(history.arrivals(t), ["quantity"])
    assert shuffles(done.offers) == shuffles(done.history) == 0


def test_hot_listing_is_cut_as_before(spark, folder):
    rows = history.arrivals(Tables(spark, folder))
    keys = ["listing_id", "seq", "outcome"]
    assert sorted(map(tuple, ingest.decide(rows, 20).select(keys).collect())) == sorted(map(tuple, ingest.decide(rows).select(keys).collect()))


def test_serving_rows_carry_what_follows_from_an_offer(spark, folder):
    t = Tables(spark, folder)
    stored = serving.rows(t)
    names = t.offer_rows.columns
    offered = stored.where("offer_id IS NOT NULL").select(*names)
    assert offered.exceptAll(t.offer_rows).isEmpty() and t.offer_rows.exceptAll(offered).isEmpty()
    assert stored.where("offer_id IS NULL AND (location_key IS NOT NULL OR availability_basis IS NOT NULL OR program_key IS NOT NULL)").isEmpty()


def test_serving_buckets_stay_small():
    # A bucket is sorted by one task; 32 MB of lines give about 250 MB to sort.
    assert serving.BUCKET_BYTES <= 32 << 20
