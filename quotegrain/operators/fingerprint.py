"""Table fingerprints that do not depend on row order, and comparison of table versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrain.session import cut_lineage

PREFIX = 4
#: Buckets whose digests are compared before any row is.
BUCKETS = 4096


def row_hash(columns: list[str]):
    """SHA-256 of the row as JSON with keys in name order and explicit nulls."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def table_fingerprint(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """One row (table_name, rows, digest).

    Row hashes are counted, grouped by their leading hex digits and combined per group by sums of
    hash slices; the group digests, at most 16^PREFIX of them, are hashed in order. Every step is an
    order-free aggregate, so no task sees the whole table and equal multisets give equal digests.
    """
    columns = columns or df.columns
    hashed = df.select(row_hash(columns).alias("h"))
    slices = [
        F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)
    ]
    groups = hashed.groupBy(F.substring("h", 1, PREFIX).alias("g")).agg(F.count(F.lit(1)).alias("n"), *slices)
    line = F.concat_ws(":", "g", F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(5)])
    whole = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"),
    )
    return whole.select(F.lit(name).alias("table_name"), "rows", "digest")


def snapshot(tables: dict[str, tuple[DataFrame, list[str] | None]]) -> DataFrame:
    """Fingerprints of several tables; a short fixed list of names."""
    parts = [table_fingerprint(df, name, columns) for name, (df, columns) in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def snapshot_hash(fingerprints: DataFrame) -> DataFrame:
    """All fingerprints and counts rolled into one hash."""
    line = F.concat_ws(":", "table_name", F.col("rows").cast("string"), "digest")
    return fingerprints.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("snapshot_hash"))


def reconcile(before: DataFrame, after: DataFrame) -> DataFrame:
    """Compare two fingerprint tables by name: counts and digests."""
    b = before.select("table_name", F.col("rows").alias("before_rows"), F.col("digest").alias("_b"))
    a = after.select("table_name", F.col("rows").alias("after_rows"), F.col("digest").alias("_a"))
    return b.join(a, "table_name", "full").select(
        "table_name",
        "before_rows",
        "after_rows",
        F.col("before_rows").eqNullSafe(F.col("after_rows")).alias("same_count"),
        F.col("_b").eqNullSafe(F.col("_a")).alias("same_content"),
    )


def bucket_digests(df: DataFrame, bucket: Column, columns: list[str]) -> DataFrame:
    """(bucket, n, d0, d1): count and two sums of row hashes per bucket; equal multisets give equal digests. Combined before the shuffle."""
    hashes = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).alias(f"d{seed}") for seed in (0, 1)]
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *hashes)


def differing(before: DataFrame, after: DataFrame, by: list[str], columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket): buckets of ``by`` in which the two sides do not hold the same rows; at most ``buckets`` rows."""
    place = F.pmod(F.xxhash64(*by), F.lit(buckets))
    b, a = (bucket_digests(df, place, columns).select("bucket", F.struct("n", "d0", "d1").alias(side)) for df, side in ((before, "_b"), (after, "_a")))
    return b.join(a, "bucket", "full").where(~F.col("_b").eqNullSafe(F.col("_a"))).select("bucket")


def differences(before: DataFrame, after: DataFrame, by: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows on one side only, with multiplicity.

    Digests are compared first, by buckets of the key columns ``by`` (all columns without any); only rows of buckets whose digests differ
    are shuffled and compared, so equal versions cost an aggregate and one changed row costs its bucket.
    """
    columns = before.columns
    by = by or columns
    place = F.pmod(F.xxhash64(*by), F.lit(buckets))
    # The list of buckets is bounded by their number and read by both sides.
    wrong = cut_lineage(differing(before, after.select(*columns), by, columns, buckets))
    b, a = (df.select(*columns, place.alias("bucket")).join(F.broadcast(wrong), "bucket", "left_semi").select(*columns) for df in (before, after))
    gone = b.exceptAll(a).withColumn("side", F.lit("removed"))
    new = a.exceptAll(b).withColumn("side", F.lit("added"))
    return gone.unionByName(new)
