"""Data quality: constraints and triggers of a database as checks over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrain.functions import vocab


def row_checks(df: DataFrame, table: str, checks: dict[str, Column]) -> DataFrame:
    """All row predicates of a table in one pass: (table_name, check_name, violations).

    A check that is null does not violate, as in SQL.
    """
    counts = df.agg(*[F.count_if(~condition).alias(name) for name, condition in checks.items()])
    pairs = [F.struct(F.lit(name).alias("check_name"), F.col(name).alias("violations")) for name in checks]
    return counts.select(F.lit(table).alias("table_name"), F.inline(F.array(*pairs)))


def in_domain(column: str, values: list[str]) -> Column:
    return F.col(column).isin(values)


def listing_checks() -> dict[str, Column]:
    known = F.col("medication_id").isNotNull() & F.col("content_quantity").isNotNull() & F.col("content_unit").isNotNull()
    return {
        "match_status_domain": in_domain("match_status", vocab.MATCH_STATUSES),
        "content_quantity_positive": F.col("content_quantity") > 0,
        "verified_is_complete": (F.col("match_status") != "verified") | known,
        "content_unit_domain": in_domain("content_unit", sorted(set(vocab.QUANTITY_UNITS.values()))),
    }


def offer_checks() -> dict[str, Column]:
    return {
        "quantity_positive": F.col("quantity") > 0,
        "price_not_negative": F.col("price_cents") >= 0,
        "availability_domain": in_domain("availability", vocab.AVAILABILITIES),
        "in_stock_has_price": (F.col("availability") != "in_stock") | F.col("price_cents").isNotNull(),
    }


def run_checks() -> dict[str, Column]:
    return {
        "status_domain": in_domain("status", vocab.RUN_STATUSES),
        "finished_after_start": F.col("finished_at") >= F.col("started_at"),
    }


def page_checks() -> dict[str, Column]:
    return {
        "page_type_domain": in_domain("page_type", vocab.PAGE_TYPES),
        "last_result_domain": in_domain("last_result", vocab.PAGE_RESULTS),
        "attempt_not_before_success": F.col("last_attempt_at") >= F.col("last_success_at"),
    }


def duplicate_keys(df: DataFrame, table: str, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys held by more than one row, among rows of ``where`` for conditional uniqueness."""
    scope = df if where is None else df.where(where)
    return (
        scope.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        .withColumn("table_name", F.lit(table))
    )


def orphans(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str]) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    wanted = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_keys, child_keys)]).distinct()
    given = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in child_keys])
    return child.where(given).join(wanted, child_keys, "left_anti")


def bad_redirects(medications: DataFrame) -> DataFrame:
    """Redirects that do not point straight at an active verified identity."""
    target = medications.select(
        F.col("medication_id").alias("_id"), F.col("superseded_by_id").alias("_next"), F.col("status").alias("_status")
    )
    joined = medications.where("superseded_by_id IS NOT NULL").join(
        target, F.col("superseded_by_id") == F.col("_id"), "left"
    )
    reason = (
        F.when(F.col("_id").isNull(), "missing_target")
        .when(F.col("_next").isNotNull(), "target_is_redirect")
        .when(F.col("_status") != "verified", "target_not_verified")
    )
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select("medication_id", "superseded_by_id", "reason")


def evidence_orphans(references: list[DataFrame], archive: DataFrame) -> DataFrame:
    """Evidence paths named anywhere that the archive does not hold."""
    named = reduce(DataFrame.unionByName, [r.select("ref") for r in references])
    pattern = "^(?:storage://evidence/|local://)"
    wanted = named.where(F.col("ref").rlike(pattern)).select(
        F.concat(F.lit("data/evidence/"), F.regexp_replace("ref", pattern, "")).alias("path")
    ).distinct()
    return wanted.join(archive.select("path"), "path", "left_anti")


def collapsed_pairs(identities: DataFrame) -> DataFrame:
    """Identities that must stay apart but share a key. ``identities``: pair_id, label, normalized_key."""
    return (
        identities.where("normalized_key IS NOT NULL")
        .groupBy("pair_id", "normalized_key")
        .agg(F.count(F.lit(1)).alias("sharing"))
        .where("sharing > 1")
    )
