"""Hashes, canonical JSON, maps of metadata and deterministic ids."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha256_text(column: Column) -> Column:
    return F.sha2(column.cast("string"), 256)


def canonical_struct(columns: list[str]) -> Column:
    """JSON with keys in name order and explicit nulls, all inside the JVM."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


class _Number(float):
    """A number of a document with its text."""

    def __new__(cls, text: str):
        out = super().__new__(cls, text)
        out.text = text
        return out


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _printed(value) -> str:
    """Keys sorted, no blanks, numbers as they were written."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_printed(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_printed, value)) + "]"
    return value.text if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def _sorted_json(text: pd.Series) -> pd.Series:
    def one(raw):
        if raw is None:
            return None
        try:
            return _printed(json.loads(raw, parse_float=_Number, parse_int=_Number, parse_constant=_no_constant))
        except (ValueError, RecursionError):  # no JSON, or nested deeper than the reader goes
            return None

    return text.map(one)


# A flat object: names and texts without escapes or control characters, numbers, true, false, null.
_NAME = r'"([^"\\\x00-\x1f]*)"'
_VALUE = r'("[^"\\\x00-\x1f]*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)'
_BLANK = r"[ \t\r\n]*"
_MEMBER = f"{_NAME}{_BLANK}:{_BLANK}{_VALUE}"
_FLAT = rf"^{_BLANK}\{{{_BLANK}(?:{_MEMBER}{_BLANK}(?:,{_BLANK}{_MEMBER}{_BLANK})*)?\}}{_BLANK}\z"


def canonical_json(text: Column) -> Column:
    """Free-form JSON text with sorted keys, numbers as written; null when it is not JSON or nested too deep to read.

    Flat objects, most of what is stored, are taken apart and sorted by built-in functions; only the rest crosses to Python, in Arrow
    batches. Of a key that comes twice the last value counts, which is left to Python, too.
    """
    names, values = (F.regexp_extract_all(text, F.lit(_MEMBER), k) for k in (1, 2))
    members = F.array_sort(F.arrays_zip(names.alias("name"), values.alias("value")))
    line = F.array_join(F.transform(members, lambda m: F.concat(F.lit('"'), m["name"], F.lit('":'), m["value"])), ",")
    flat = text.rlike(_FLAT) & (F.size(F.array_distinct(names)) == F.size(names))
    return F.when(flat, F.concat(F.lit("{"), line, F.lit("}"))).otherwise(_sorted_json(F.when(~flat, text)))


def merged_map(base: Column, over: Column, drop: list[str] = ()) -> Column:
    """``base`` with the entries of ``over`` in place of its own and without the keys ``drop``; a null map is empty."""
    none = F.create_map().cast("map<string,string>")
    base, over = F.coalesce(base, none), F.coalesce(over, none)
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))
    return without_keys(F.map_concat(kept, over), list(drop))


def without_keys(column: Column, hidden: list[str]) -> Column:
    """A map without some keys, such as internal ones before it is shown."""
    return F.map_filter(column, lambda k, _: ~k.isin(hidden)) if hidden else column


def offer_key(quantity: Column, seller: Column, location: Column, program: Column, currency: Column) -> Column:
    """Canonical text of the five fields that tell offers of a listing apart: a JSON array, nulls written."""
    return F.to_json(F.array(*(c.cast("string") for c in (quantity, seller, location, program, currency))), {"ignoreNullFields": "false"})


def deterministic_id(*parts: Column) -> Column:
    """UUID-shaped id that is the same for the same parent and request."""
    h = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut])
