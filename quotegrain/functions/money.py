"""Money and quantity text as exact numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_QUANTITY = 1_000_000


def per_unit(cents: Column, amount: Column, places: int = 6) -> Column:
    """Exact price per unit rounded to ``places``; null when either side is unknown or zero."""
    cents = cents.cast("decimal(20,0)")
    amount = F.when(amount > 0, amount).cast("decimal(17,6)")
    return F.round(F.try_divide(cents, amount), places)


def cents(text: Column) -> Column:
    """Dollar text to whole cents; null for malformed, negative or sub-cent amounts."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\$", ""), ",", "")
    whole_cents = bare.rlike(r"^[0-9]+([.][0-9]{1,2}0*)?$")
    # The guard is inside the cast, since a branch of `when` may still be evaluated.
    return (F.when(whole_cents, bare).try_cast("decimal(20,2)") * 100).cast("long")


def cents_reason(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"^\$", ""), ",", "")
    return F.when(~bare.rlike(r"^[0-9]+([.][0-9]+)?$"), "invalid_money").when(
        cents(text).isNull(), "non_cent_total"
    )


def dollars(cents: Column) -> Column:
    """``1234`` to ``$12.34``."""
    whole = F.floor(cents / F.lit(100).cast("decimal(3,0)")).cast("string")
    return F.concat(F.lit("$"), whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def quantity(text: Column) -> Column:
    """Positive exact quantity up to the maximum, else null. Rejects signs, exponents and a seventh decimal."""
    # The guard is inside the cast, and lets through only what the cast keeps exactly.
    value = F.when(text.rlike(r"^[0-9]+([.][0-9]{1,6}0*)?$"), text).try_cast("decimal(20,6)")
    return F.when((value > 0) & (value <= MAX_QUANTITY), value)


def quantity_text(value: Column) -> Column:
    """Canonical text: no exponent, zeros stripped only after a decimal point."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"([.][0-9]*?)0+$", "$1"), r"[.]$", "")
