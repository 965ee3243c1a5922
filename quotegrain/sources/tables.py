"""Parquet tables of one data folder, and the model tables derived from them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegrain.operators import ordered
from quotegrain.session import spread
from quotegrain.sources.bridge import AS_OF, VIEWS

OFFER_KEY = ["listing_id", "quantity"]
TIME_ORDER = ["observed_at", "l_orderkey", "l_linenumber", "l_suppkey"]
ARRIVAL_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey"]
#: Tasks for a core when a table is dealt out.
TASKS_PER_CORE = 4


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp_ntz")


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table dealt out over the cores when its files give fewer partitions."""
        return spread(self.table(name))

    def dealt(self, name: str) -> DataFrame:
        """A table dealt out by the content of its rows, for work that costs far more than moving them, however its files are cut."""
        rows = self.table(name)
        return rows.repartition(TASKS_PER_CORE * self.spark.sparkContext.defaultParallelism, *rows.columns)

    def sql(self, text: str, deal: tuple[str, ...] = ()) -> DataFrame:
        """Run SQL whose FROM/JOIN names are tables or views of this folder; the tables of ``deal`` are dealt out first."""
        used: dict[str, DataFrame] = {}

        def place(match):
            name = match.group(2)
            if name.startswith("b_"):
                used[name] = getattr(self, name[2:])
            elif name in RAW:
                used[name] = self.dealt(name) if name in deal else self.table(name)
            else:
                return match.group(0)
            return f"{match.group(1)}{{{name}}}"

        text = text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("{", "{{").replace("}", "}}")
        text = re.sub(r"((?:FROM|JOIN)\s+)(\w+)", place, text)
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.table(name)
        if f"b_{name}" in VIEWS:
            return self.sql(VIEWS[f"b_{name}"])
        raise AttributeError(name)

    @property
    def offers(self) -> DataFrame:
        """Current state: the last observation per offer key at AS_OF, as an aggregate."""
        seen = self.observations.where(F.col("observed_at") <= as_of())
        columns = ["price_cents", "availability", "active", "observed_at"]
        return ordered.latest(seen, OFFER_KEY, TIME_ORDER, columns).withColumnRenamed(
            "observed_at", "last_checked_at"
        )


RAW = set(
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations".split()
)
