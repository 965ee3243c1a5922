"""Readers of captured files and of data embedded in captured text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegrain.functions import urls
from quotegrain.operators import ordered

OFFER = (
    "struct<quantity:string,price_cents:string,currency:string,availability:string,seller_key:string,"
    "location_key:string,program_key:string,terms:map<string,string>,valid_until:timestamp,active:boolean>"
)
OBSERVATION = (
    "listing struct<source_product_key:string,source_name:string,url:string,brand_name:string,sold_as:string,"
    "content_quantity:string,content_unit:string,metadata:map<string,string>>, "
    f"offers array<{OFFER}>, observed_at timestamp, evidence_path string, complete boolean"
)
CATALOGUE = (
    "results array<struct<ndc:string,medication_name:string,brand_name:string,brand_generic:string,strength:string,"
    "form:string,url:string,pill_nonpill:string,medispan_pack_size:string,medispan_pack_size_units:string,medispan_quantity:string>>"
)
PRICE_MODEL = (
    "medications array<struct<name:string,brand_name:string,form:string,route:string,doses_per_day:bigint,"
    "walmart_generics_program:boolean,strengths:array<struct<strength:string,acquisition_unit_price_cents:decimal(12,4),"
    "costplus:struct<ndc:string,slug:string,product_url:string>>>>>"
)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of nested observations with a declared schema, so no inference pass."""
    return spark.read.schema(OBSERVATION).json(path)


def flatten_offers(observations: DataFrame) -> DataFrame:
    return observations.select("listing.*", "observed_at", "evidence_path", "complete", F.inline("offers"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue dump files (one document each) to product rows."""
    return spark.read.schema(CATALOGUE).option("multiLine", True).json(path).select(F.inline("results"))


def catalogue_pages(rows: DataFrame, site: urls.Site, frontier: DataFrame) -> DataFrame:
    """New product pages of a catalogue that the frontier does not know yet."""
    found = rows.select(urls.canonical(F.col("url"), site).alias("c")).where("c IS NOT NULL").select("c.*").distinct()
    return found.join(frontier.select("url"), "url", "left_anti").withColumn(
        "page_type", F.when(F.col("reason").isNull(), "product").otherwise("ignored")
    )


def read_price_model(spark: SparkSession, path: str) -> DataFrame:
    """Price-model catalogue to one row per strength, with its position in the list."""
    medicines = spark.read.schema(PRICE_MODEL).option("multiLine", True).json(path).select(F.inline("medications"))
    return medicines.select("*", F.posexplode("strengths").alias("position", "s")).select(
        *[c for c in medicines.columns if c != "strengths"], "position", "s.*"
    )


def read_reference_list(spark: SparkSession, path: str, expected: int = 200) -> DataFrame:
    """Numbered entries of a reference list; fails unless there are exactly ``expected``."""
    entry = F.regexp_extract("value", r"^\s*[0-9]{3}\.\s+(.+?)\s*$", 1)
    rows = spark.read.text(path).select(entry.alias("entry")).where("entry <> ''")
    found = rows.count()
    if found != expected:
        raise ValueError(f"reference list has {found} entries, expected {expected}")
    return rows


EMBEDDED = r"(?s)var rxSearchResults = (\{.*?\});"


def embedded_results(pages: DataFrame) -> DataFrame:
    """Result lists inside page scripts to rows; incomplete ones are left out.

    ``pages``: probe_id, from_url, html.
    """
    document = F.regexp_extract("html", EMBEDDED, 1)
    parsed = F.from_json(F.when(document != "", document), "drugResults array<struct<drugId:string,drugName:string>>")
    rows = pages.select("probe_id", "from_url", F.inline(parsed["drugResults"]))
    return rows.where("coalesce(drugId, '') <> '' AND coalesce(drugName, '') <> ''")


def directory_sightings(results: DataFrame, detail_url: str) -> DataFrame:
    """One row per detail URL: the first probe that listed it."""
    url = F.concat(
        F.lit(f"{detail_url}?drugId="), urls.encode_component(F.col("drugId")),
        F.lit("&drugName="), urls.encode_component(F.col("drugName")),
    )
    return ordered.earliest(
        results.withColumn("url", url), ["url"], ["probe_id"], ["drugId", "drugName", "from_url", "probe_id"]
    )
