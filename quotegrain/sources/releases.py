"""Several tables published as one: numbered releases, each a manifest that names the files of every table.

A writer puts its files beside the old ones and publishes last, by renaming a finished manifest to the number after the one that it
started from. The rename fails when that number is taken, so of two writers that started from one release only one can win, and a
writer that dies before it leaves readers where they were. Readers take the manifest with the highest number and see all its tables or none.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Name of the only group of files of a table that is not bucketed.
WHOLE = ""


class Conflict(RuntimeError):
    """Another writer published first."""


@dataclass(frozen=True)
class Release:
    number: int
    tables: dict[str, dict[str, list[str]]]  # table -> bucket -> folders, oldest first


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is absent."""
    fs = _fs(spark, folder)
    if not fs.exists(_path(spark, folder)):
        return []
    return [s.getPath().getName() for s in fs.listStatus(_path(spark, folder))]


def newest(spark: SparkSession, root: str) -> int:
    """Number of the newest release, 0 without one. Lists a folder, reads no table."""
    return max((int(n) for n in names(spark, f"{root}/releases") if n.isdigit()), default=0)


def load(spark: SparkSession, root: str, number: int | None = None) -> Release | None:
    number = newest(spark, root) if number is None else number
    if not number:
        return None
    path = f"{root}/releases/{number:012d}"
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Release(number, json.loads(text))


def publish(spark: SparkSession, root: str, tables: dict[str, dict[str, list[str]]], based_on: int) -> Release:
    """Make ``tables`` the release after ``based_on``; raises ``Conflict`` if that number exists."""
    target, own = f"{root}/releases/{based_on + 1:012d}", f"{root}/releases/.{uuid.uuid4().hex}"
    out = _fs(spark, own).create(_path(spark, own), False)
    try:
        out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    plain = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        context = hadoop.FileContext.getFileContext(_path(spark, own).toUri(), spark._jsc.hadoopConfiguration())
        context.rename(_path(spark, own), _path(spark, target), plain)
    except Py4JJavaError as error:
        _fs(spark, own).delete(_path(spark, own), False)
        if "FileAlreadyExistsException" in str(error.java_exception):
            raise Conflict(f"release {based_on + 1} of {root} was published by another writer") from error
        raise
    return Release(based_on + 1, tables)


def write(df: DataFrame, root: str, table: str) -> dict[str, list[str]]:
    """Write a whole table under a name of its own; nobody reads it before a release names it."""
    folder = f"{root}/{table}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return {WHOLE: [folder]}


def read(spark: SparkSession, release: Release, table: str) -> DataFrame:
    return spark.read.parquet(*[f for folders in release.tables[table].values() for f in folders])


def replace(spark: SparkSession, root: str, frames: dict[str, DataFrame], based_on: Release | None) -> Release:
    """Publish new versions of some tables together; the others stay as ``based_on`` has them."""
    tables = dict(based_on.tables) if based_on else {}
    tables |= {name: write(df, root, name) for name, df in frames.items()}
    return publish(spark, root, tables, based_on.number if based_on else 0)
