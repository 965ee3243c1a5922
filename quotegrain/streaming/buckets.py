"""Current state of a stream as base and delta files per key bucket.

A micro-batch reads and writes only the buckets that its keys fall in. Its rows go to a delta folder per bucket; the newest row of a key
counts. A bucket with ``FOLD`` folders is folded: the batch that touches it next writes all its rows, and the older folders are no
longer named. So a batch costs its own rows and, once in ``FOLD`` batches, the buckets that it meets; untouched buckets are
never read or written. The folders of all tables are published as one release per micro-batch, by its number: a batch that runs again
after a failure reads the release before it and writes the same folders, and one that had published does nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegrain.sources import releases
from quotegrain.sources.releases import Release

#: Folders of a bucket that the next batch folds into one.
FOLD = 4
BUCKETS = 64


@dataclass(frozen=True)
class BucketedState:
    """Tables by name with their key columns; all are bucketed by the columns ``by``, which every key contains."""

    root: str
    keys: dict[str, list[str]]
    by: list[str]
    buckets: int = BUCKETS
    fold: int = FOLD

    def bucket(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets))

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys of ``rows``; at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def before(self, spark: SparkSession, batch_id: int) -> Release | None:
        """What the batches before ``batch_id`` published."""
        return releases.load(spark, self.root, batch_id) if batch_id else None

    def done(self, spark: SparkSession, batch_id: int) -> bool:
        return releases.newest(spark, self.root) > batch_id

    def rows(self, spark: SparkSession, release: Release | None, table: str, touched: list[int] | None = None, among: DataFrame | None = None) -> DataFrame | None:
        """Newest row of every key, of all buckets or the ``touched`` ones; None if there are no files.

        With ``among`` only of keys whose columns ``by`` are in it. A bucket of one folder holds each key once; only the others are merged.
        """
        held = release.tables.get(table, {}) if release else {}
        mine = {b: fs for b, fs in held.items() if fs and (touched is None or int(b) in touched)}
        parts = []
        for many in (False, True):
            stored = self._stored(spark, [f for fs in mine.values() if (len(fs) > 1) is many for f in fs])
            if stored is not None:
                stored = stored if among is None else stored.join(among.select(*self.by), self.by, "left_semi")
                newest = self._newest(stored, self.keys[table], []) if many else stored
                parts.append(newest.select(*self.keys[table], *(c for c in stored.columns if c not in (*self.keys[table], "_batch"))))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _stored(self, spark: SparkSession, folders: list[str]) -> DataFrame | None:
        return spark.read.parquet(*folders) if folders else None

    def _newest(self, rows: DataFrame, keys: list[str], dealt: list[str]) -> DataFrame:
        """Row of the newest batch of every key; rows that lie dealt by ``dealt`` stay where they are."""
        rest = [c for c in rows.columns if c not in (*keys, *dealt)]
        newest = rows.groupBy(*dealt, *keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
        return newest.select(*dealt, *keys, *(F.col(f"_row.{c}").alias(c) for c in rest))

    def write(self, spark: SparkSession, batch_id: int, changed: dict[str, DataFrame], touched: list[int]) -> Release:
        """Publish the ``changed`` rows of the batch (whole rows, one per key) as deltas, folding full buckets."""
        before = self.before(spark, batch_id)
        tables = {}
        for table, rows in changed.items():
            held = dict(before.tables.get(table, {})) if before else {}
            full = [b for b in touched if len(held.get(str(b), [])) >= self.fold]
            out = rows.withColumns({"_batch": F.lit(batch_id), "bucket": self.bucket()})
            if full:
                # Stored rows of the full buckets meet the new ones in the shuffle that writes them; null keys are keys.
                stored = self._stored(spark, [f for b in full for f in held[str(b)]])
                both = out.unionByName(stored.withColumn("bucket", self.bucket())).repartition("bucket")
                out = self._newest(both, self.keys[table], ["bucket"]).withColumn("_batch", F.lit(batch_id))
            else:
                out = out.repartition("bucket")
            folder = f"{self.root}/{table}/batch={batch_id}"
            out.write.mode("overwrite").partitionBy("bucket").parquet(folder)
            for name in releases.names(spark, folder):
                if name.startswith("bucket="):
                    b = name.removeprefix("bucket=")
                    held[b] = ([] if int(b) in full else held.get(b, [])) + [f"{folder}/{name}"]
            tables[table] = held
        return releases.publish(spark, self.root, tables, batch_id)
