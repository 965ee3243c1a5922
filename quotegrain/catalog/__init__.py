"""Registered queries, each beside the SQL text that checks it."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quotegrain.session import tune
from quotegrain.sources.bridge import VIEWS
from quotegrain.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}

MODULES = [
    "offers", "status", "history", "joins", "household", "compare", "identity",
    "rekey", "reliability", "capture", "quality", "research", "expressions", "streams", "files",
]


def _views_for(sql: str) -> list[str]:
    """Views a text needs, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def with_views(sql: str) -> str:
    views = _views_for(sql)
    if not views:
        return sql.strip()
    head = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in views)
    body = sql.strip()
    recursive = re.match(r"(?i)with\s+recursive\s+", body)
    plain = re.match(r"(?i)with\s+", body)
    if recursive:
        return f"WITH RECURSIVE {head},\n{body[recursive.end():]}"
    if plain:
        return f"WITH {head},\n{body[plain.end():]}"
    return f"WITH {head}\n{body}"


def query(name: str, *operators: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``operators`` are survey labels."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            tune(spark)
            return fn(Tables(spark, folder))

        QUERIES[name] = run
        OPERATORS[name] = operators
        if oracle:
            ORACLES[name] = with_views(oracle)
        return fn

    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"quotegrain.catalog.{module}")
