"""Modelled price comparison: strength x supplier x days of supply, exact decimals throughout."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrain.functions import text


@dataclass(frozen=True)
class Supplier:
    slug: str
    unit_price_factor: str
    markup: str = "1"
    dispensing_fee_cents: int = 0
    shipping_cents: int = 0
    minimum_price_cents: int = 0
    tier_unit_discount: dict = field(default_factory=lambda: {30: "1", 90: "0.95", 365: "0.9"})
    max_days_per_fill: int = 90


DAYS_SUPPLY = [30, 90, 365]

# The supplier models, in the order that breaks price ties, and the flat programme.
SUPPLIERS = [
    Supplier("walmart", "11", minimum_price_cents=400),
    Supplier("costco", "7", minimum_price_cents=299),
    Supplier(
        "costplus", "1", markup="1.15", dispensing_fee_cents=500, shipping_cents=525,
        tier_unit_discount={30: "1", 90: "1", 365: "1"},
    ),
    Supplier("amazon", "8.5", minimum_price_cents=500),
]
PROGRAM_SUPPLIER = "walmart"
PROGRAM_CENTS = {30: 400, 90: 1000, 365: 4000}


def fills(days: int, most: int) -> int:
    return max(1, int(days / most + 0.5))


def _price(model: Supplier, days: int, program: dict[int, int], program_supplier: str) -> Column:
    """Struct for one supplier and tier. Supplier numbers are literals, so no join or shuffle is needed."""
    quantity = F.col("doses_per_day") * days
    rate = F.lit(model.unit_price_factor).cast("decimal(6,2)") * F.lit(model.markup).cast("decimal(5,3)")
    unit = F.col("acquisition_unit_price_cents") * rate * F.lit(model.tier_unit_discount[days]).cast("decimal(4,2)")
    refills = fills(days, model.max_days_per_fill)
    fees = (model.dispensing_fee_cents + model.shipping_cents) * refills
    modelled = F.greatest(
        F.round(unit * quantity.cast("decimal(8,0)") + fees, 0).cast("long"), F.lit(model.minimum_price_cents).cast("long")
    )
    price = modelled
    if model.slug == program_supplier:
        flat = F.lit(program[days]).cast("long")
        price = F.when(F.col("in_program") & (flat <= modelled), flat).otherwise(modelled)
    return F.struct(
        F.lit(model.slug).alias("supplier"),
        F.lit(days).alias("days_supply"),
        quantity.cast("long").alias("quantity"),
        F.lit(refills).alias("fills"),
        price.alias("price_cents"),
    )


def modelled_prices(strengths: DataFrame, suppliers=SUPPLIERS, days=DAYS_SUPPLY, program=PROGRAM_CENTS) -> DataFrame:
    """One row per strength, supplier and tier, made inside the row.

    A small file of strengths is one task, and what it makes is sorted there before it is grouped; so strengths are dealt out by their
    content first, in as many parts as the session has for shuffles.
    """
    parts = int(strengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strengths = strengths.repartition(parts, *strengths.columns)
    offers = [
        F.struct(F.lit(s).alias("supplier_pos"), F.lit(d).alias("tier_pos"), _price(model, tier, program, PROGRAM_SUPPLIER).alias("q"))
        for s, model in enumerate(suppliers)
        for d, tier in enumerate(days)
    ]
    rows = strengths.select("*", F.inline(F.array(*offers))).select("*", "q.*").drop("q")
    return rows.withColumns(
        {
            "unit_price_cents": _cents_per(F.col("price_cents"), F.col("quantity")),
            "price_per_day_cents": _cents_per(F.col("price_cents"), F.col("days_supply")),
        }
    )


def _cents_per(price: Column, amount: Column) -> Column:
    """Price per unit to two decimals, half up, from exact integers."""
    return F.round(price.cast("decimal(20,0)") / amount.cast("decimal(10,0)"), 2).cast("decimal(20,2)")


def best_by_tier(prices: DataFrame, keys: list[str]) -> DataFrame:
    """Cheapest supplier per tier; a tie goes to the supplier listed first."""
    best = F.min_by(F.struct("supplier", "price_cents"), F.struct("price_cents", "supplier_pos"))
    return prices.groupBy(*keys, "days_supply").agg(best.alias("b")).select(*keys, "days_supply", "b.*")


def best_value(prices: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest price per day over all suppliers and tiers; ties to the earlier supplier, then tier."""
    order = F.struct("price_per_day_cents", "supplier_pos", "tier_pos")
    best = F.min_by(F.struct("supplier", "days_supply", "price_cents", "price_per_day_cents"), order)
    return prices.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def comparison(prices: DataFrame, keys: list[str]) -> DataFrame:
    """Nested comparison per strength. The array length is suppliers x tiers, a fixed number."""
    quotes = F.sort_array(
        F.collect_list(
            F.struct(
                "supplier_pos", "tier_pos", "supplier", "days_supply", "quantity", "fills", "price_cents",
                "unit_price_cents", "price_per_day_cents",
            )
        )
    )
    nested = prices.groupBy(*keys).agg(quotes.alias("quotes"))
    value = best_value(prices, keys).select(*keys, F.struct("supplier", "days_supply", "price_cents").alias("best_value"))
    return nested.join(value, keys)


def rises_with_supply(prices: DataFrame, keys: list[str]) -> DataFrame:
    """Tiers dearer per day than the next shorter one; each supplier's tiers sit in one short array."""
    tiers = F.array_sort(F.collect_list(F.struct("days_supply", "price_per_day_cents")))
    grouped = prices.groupBy(*keys, "supplier").agg(tiers.alias("t"))
    pairs = F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("a"), F.slice("t", 2, F.size("t") - 1).alias("b"))
    return (
        grouped.select(*keys, "supplier", F.inline(pairs))
        .where(F.col("b.price_per_day_cents") > F.col("a.price_per_day_cents"))
        .select(*keys, "supplier", F.col("b.days_supply").alias("days_supply"))
    )


def pick_strength(strengths: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested strength by normalised text, else the first in the catalogue.

    The catalogue is reduced to its first row per medicine and per strength before any request meets it.
    """
    first = F.min_by("strength", "position")
    keyed = strengths.withColumn("_key", text.catalog_text(F.col("strength")))
    exact = keyed.groupBy("medicine", "_key").agg(first.alias("_exact"))
    default = strengths.groupBy("medicine").agg(first.alias("_first"))
    asked = requests.withColumn("_key", text.catalog_text(F.col("wanted")))
    joined = asked.join(default, "medicine").join(exact, ["medicine", "_key"], "left")
    return joined.select(
        "request_id", "medicine", F.coalesce("_exact", "_first").alias("strength"), F.col("_exact").isNull().alias("defaulted")
    )


def suppliers_by_price(prices: DataFrame, keys: list[str], tier: int) -> DataFrame:
    """Suppliers of each strength ordered by one tier's price; the list has one entry per supplier."""
    order = F.array_sort(F.collect_list(F.struct("price_cents", "supplier_pos", "supplier")))
    grouped = prices.where(F.col("days_supply") == tier).groupBy(*keys).agg(order.alias("o"))
    return grouped.select(*keys, F.posexplode("o").alias("pos", "s")).select(
        *keys, (F.col("pos") + 1).alias("place"), "s.supplier", "s.price_cents"
    )
