"""Text clean-up and keys as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotegrain.functions import vocab


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def nfkc(text: Column) -> Column:
    """Compatibility form. Plain ASCII text is its own form and crosses to Python as null."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def _clean(text: Column) -> Column:
    s = F.lower(F.regexp_replace(text, "[®™℠]", ""))
    s = F.regexp_replace(s, "([0-9])([a-zµμ%])", "$1 $2")
    s = F.regexp_replace(s, "([a-zµμ])([0-9])", "$1 $2")
    s = F.regexp_replace(s, "[^a-z0-9µμ%/]+", " ")
    s = F.regexp_replace(s, r"\s*/\s*", " / ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def search_text(text: Column) -> Column:
    """Normalised search text.

    Compatibility folding comes first, so a trademark sign becomes the letters "tm" and only the registered
    sign is removed. Results depend on this order.
    """
    return _clean(nfkc(text))


def ascii_search_text(text: Column) -> Column:
    """``search_text`` for text known to be ASCII, with no Python step."""
    return _clean(text)


def alias_key(text: Column) -> Column:
    return alias_from_search(search_text(text))


def alias_from_search(cleaned: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(cleaned, "/", " "), r"\s+", " "))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Code for ``key``, null when unknown. The table is a literal map, so no join is needed."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_contained(padded: Column, entries: list[tuple[str, str]], endings: tuple[str, ...] = ("",)) -> Column:
    """Code of the first entry whose word occurs in ``padded``; null when none does."""
    table = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(c).alias("code")) for w, c in entries])

    def occurs(e):
        hit = F.lit(False)
        for ending in endings:
            hit = hit | F.contains(padded, F.concat(e["word"], F.lit(ending)))
        return hit

    return F.get(F.filter(table, occurs), F.lit(0))["code"]


def form_code(key: Column) -> Column:
    """Direct alias, else the longest alias found as whole words (ties in table order)."""
    longest = sorted(vocab.FORMS.items(), key=lambda item: -len(item[0]))
    entries = [(f" {alias}", code) for alias, code in longest]
    return bind(
        key,
        lambda k: F.coalesce(
            lookup(k, vocab.FORMS),
            first_contained(F.concat(F.lit(" "), k, F.lit(" ")), entries, (" ", "s ")),
        ),
    )


def catalog_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _drug_words(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "&", ";"), "%", " ")
    s = F.regexp_replace(s, r"[^a-z0-9;.\s-]", " ")
    s = F.regexp_replace(s, vocab.DOSAGE_WORDS, " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def drug_parts(text: Column) -> Column:
    """Sorted ingredient names of a drug-list entry."""
    parts = F.transform(F.split(text, ";"), _drug_words)
    return F.array_sort(F.filter(parts, lambda p: p != ""))


def drug_key(text: Column) -> Column:
    return F.array_join(drug_parts(text), ";")


def key_parts(key: Column) -> Column:
    """Parts of a finished key. An entry written with "&" carries blanks into its parts, so it matches nothing."""
    return F.split(key, ";")


def search_key(text: Column) -> Column:
    """``drug_key`` of a search text: commas separate too, and one common short form is spelled out."""
    return drug_key(F.regexp_replace(F.replace(text, F.lit(","), F.lit(";")), r"(?i)\bHCTZ\b", "Hydrochlorothiazide"))


def label_words(text: Column) -> Column:
    return _drug_words(F.regexp_replace(text, "[-/]", " "))


def link_name(text: Column) -> Column:
    s = F.regexp_replace(F.lower(text), "extended[ -]release", "er")
    s = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    return F.regexp_replace(s, r"\ber\s+er\b", "er")


def link_name_with_form(name: Column, form: Column) -> Column:
    """Some labels carry the release marker in the form field; it is never dropped."""
    clean = link_name(name)
    marked = form.rlike(r"(?i)\b(er|extended[ -]release)\b") & ~clean.rlike(r"\ber\b")
    return F.when(F.coalesce(marked, F.lit(False)), F.concat(clean, F.lit(" er"))).otherwise(clean)


def link_strength(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s", "")


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def folded(text: Column) -> Column:
    return F.lower(F.trim(text))


def title_case(text: Column) -> Column:
    """First letter of each word to upper case; the rest stays as it is."""
    words = F.transform(
        F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    )
    return F.array_join(words, " ")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "(^-|-$)", "")


def tokens(cleaned: Column) -> Column:
    return F.array_distinct(F.filter(F.split(cleaned, " "), lambda w: (w != "") & (w != "/")))


def subset(small: Column, large: Column) -> Column:
    return F.size(F.array_except(small, large)) == 0


def valid_actor(text: Column) -> Column:
    """Trimmed length 3 to 120 and no control characters."""
    t = F.trim(text)
    return (F.length(t) >= 3) & (F.length(t) <= 120) & ~t.rlike(r"[\x00-\x1f]")


def word_runs(text: Column, sizes: Column) -> Column:
    """Distinct runs of as many consecutive words as one of ``sizes`` says."""
    words = F.split(text, " ")
    size = F.size(words)

    def of(n):
        return F.transform(F.sequence(F.lit(0), size - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))

    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda n: n <= size), of)))
