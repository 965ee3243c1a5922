"""Registered queries against their SQL texts on the smallest tables.

The default set is short; QUOTEGRAIN_ALL=1 runs every query.
"""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import NAMES, plain

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "eligible_offers", "exclusions", "exact_quantity", "tier_known", "keyset_page", "cheapest_observed", "source_status",
    "latency_percentiles", "price_changes", "price_timeline", "offers_as_of", "retired_offers", "household_offers",
    "price_households", "reconcile_lines", "rx_document", "modelled_prices", "best_by_days", "identity_reasons",
    "scored_search", "unique_link", "collision_groups", "apply_rekey", "window_grades", "passing_streak", "manifest_checks",
    "page_links", "panel_rows", "validate_observations", "dq_row_checks", "latest_query", "money_text",
]
NAMED = list(entry.oracle_sql()) if os.environ.get("QUOTEGRAIN_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMED)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


def test_every_query_has_a_survey_label_and_sql():
    from quotegrain.catalog import OPERATORS, QUERIES

    assert all(OPERATORS[name] for name in QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def called(fn, seen=None):
    """Functions outside the catalogue that a query reaches through its own module: (module, name) pairs."""
    import inspect
    import types

    seen = set() if seen is None else seen
    if fn in seen:
        return set()
    seen.add(fn)
    out, space = set(), {**fn.__globals__, **inspect.getclosurevars(fn).nonlocals}
    codes = [fn.__code__]
    while codes:
        code = codes.pop()
        codes += [c for c in code.co_consts if isinstance(c, types.CodeType)]
        for name in code.co_names:
            held = space.get(name)
            if isinstance(held, types.FunctionType):
                if held.__module__.startswith("quotegrain.catalog"):
                    out |= called(held, seen)
                elif held.__module__.startswith("quotegrain."):
                    out.add((held.__module__, held.__name__))
            elif isinstance(held, types.ModuleType) and held.__name__.startswith("quotegrain."):
                out |= {(held.__name__, n) for n in code.co_names if callable(getattr(held, n, None))}
    return out


def query_function(name):
    from quotegrain.catalog import QUERIES

    return next(c.cell_contents for c in QUERIES[name].__closure__ if callable(c.cell_contents))


#: Labels of the survey beside the function that has to do their work in the query.
WORK = {
    "obs_flatten": "read", "upsert_state": "replace", "public_listing": "public_listing", "metadata_merge": "merged_map", "row_hashes": "offer_key",
    "in_scope": "in_scope", "normalization_coverage": "coverage", "intake_batch_sizes": "batch_sizes", "cohort_sizes": "cohort_sizes",
    "rekey_release": "apply_and_publish", "rekey_problems": "apply_problems", "rekey_run_status": "run_status", "stream_price_changes": "changes",
    "stream_expiries": "expiries", "stream_ingest": "ingest_stream", "ingest_outcomes": "run_problem", "version_differences": "differences",
    "scored_search": "scored_search", "best_name_match": "best_name_match", "json_paths": "canonical_json", "medication_offers": "rows",
}


@pytest.mark.parametrize("name", WORK)
def test_label_stands_on_a_query_that_does_the_work(name):
    assert WORK[name] in {n for _, n in called(query_function(name))}


def test_flagship(spark):
    assert entry.entry(spark).columns == [
        "medication_id", "content_unit", "physical_quantity", "min_price", "spread", "source", "offer_id", "offers",
    ]
