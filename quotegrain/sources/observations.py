"""Observation documents in files: one listing with its identity and all its offers, as captures write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OFFER = "quantity long, price_cents long, availability string, active boolean, terms string, valid_until timestamp_ntz"
SCHEMA = (
    "listing_id long, observed_at timestamp_ntz, run_id timestamp_ntz, complete boolean, source_name string, sold_as string, "
    f"content_quantity long, content_unit string, brand_name string, offers array<struct<{', '.join(c.replace(' ', ':', 1) for c in OFFER.split(', '))}>>"
)


def read(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """Documents as rows, one JSON text a line. The schema is given, so nothing is read to guess it; ``more`` names columns of the capture.

    A line that is no document is a row of nulls with its text in ``_corrupt``.
    """
    schema = ", ".join(filter(None, [SCHEMA, more, "_corrupt string"]))
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def flatten(documents: DataFrame, carried: list[str]) -> DataFrame:
    """One row per offer: listing, time, run, the ``carried`` columns and the offer's own. Documents without offers give none."""
    rows = documents.select("listing_id", "observed_at", "run_id", *carried, F.explode("offers").alias("_o"))
    return rows.select("listing_id", "observed_at", "run_id", *carried, "_o.*")
