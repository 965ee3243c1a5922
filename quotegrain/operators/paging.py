"""Keyset pages, literal search and scored search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, key: str, limit: int, cursor: int | None = None) -> DataFrame:
    """One page after ``cursor`` with ``next_cursor`` on every row (null on the last page).

    Only ``limit + 1`` rows reach the page, by a top-k; the extra row shows whether more follow.
    """
    source = df if cursor is None else df.where(F.col(key) > cursor)
    page = source.orderBy(key).limit(limit + 1)
    # The windows below see at most limit + 1 rows.
    whole = Window.partitionBy(F.lit(0))
    place = F.row_number().over(whole.orderBy(key))
    return (
        page.withColumns({"_place": place, "_n": F.count(F.lit(1)).over(whole)})
        .withColumn(
            "next_cursor",
            F.when(F.col("_n") > limit, F.max(F.when(F.col("_place") <= limit, F.col(key))).over(whole)),
        )
        .where(F.col("_place") <= limit)
        .drop("_place", "_n")
    )


def contains_literal(column: Column, text: str) -> Column:
    """Case-insensitive substring test; wildcards in ``text`` mean themselves."""
    return F.contains(F.lower(column), F.lower(F.lit(text)))


def search_score(name: Column, brand: Column, query: Column) -> Column:
    """Lower is better; null when neither name nor brand contains the query."""
    return (
        F.when(name == query, 0)
        .when(F.startswith(name, query), 1)
        .when(brand == query, 2)
        .when(F.startswith(brand, query), 3)
        .when(F.contains(name, query), 4)
        .when(F.contains(brand, query), 5)
    )
