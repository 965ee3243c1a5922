"""Pieces of SQL text used by several oracles."""

from quotegrain.functions import vocab


def norm(x: str) -> str:
    """Search text of an ASCII expression."""
    s = f"LOWER({x})"
    s = f"regexp_replace({s}, '([0-9])([a-z%])', '\\1 \\2', 'g')"
    s = f"regexp_replace({s}, '([a-z])([0-9])', '\\1 \\2', 'g')"
    s = f"regexp_replace({s}, '[^a-z0-9%/]+', ' ', 'g')"
    s = f"regexp_replace({s}, '\\s*/\\s*', ' / ', 'g')"
    return f"TRIM(regexp_replace({s}, '\\s+', ' ', 'g'))"


def alias(x: str) -> str:
    return f"TRIM(regexp_replace(REPLACE({norm(x)}, '/', ' '), '\\s+', ' ', 'g'))"


def codes(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def form(key: str) -> str:
    whole = " ".join(
        f"WHEN regexp_matches({key}, '(^| ){a}s?( |$)') THEN '{c}'"
        for a, c in sorted(vocab.FORMS.items(), key=lambda item: -len(item[0]))
    )
    return f"COALESCE({codes(key, vocab.FORMS)}, CASE {whole} END)"


def tokens(cleaned: str) -> str:
    return f"list_distinct(list_filter(string_split({cleaned}, ' '), lambda w: w <> '' AND w <> '/'))"


def title(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: UPPER(w[1:1]) || w[2:]), ' ')"


NUM = r"[0-9]+(?:\.[0-9]+)?"
UNIT = r"[A-Za-z%]+(?:\s+[A-Za-z]+)?"
PATTERN = rf"(?i)^({NUM})\s*({UNIT})\s*(?:/\s*(?:({NUM})\s*)?({UNIT}))?$"


def strength_ctes(source: str, key: str, raw: str) -> str:
    """CTEs ending in ``strengths(key, num, unit, den, den_unit, display, skey)`` with null for no parse."""
    def group(i):
        return f"NULLIF(regexp_extract(TRIM({raw}), '{PATTERN}', {i}), '')"

    def exact(x):
        return (f"CASE WHEN regexp_matches({x}, '[1-9]') THEN regexp_replace(regexp_replace(regexp_replace({x}, '^0+([0-9])', '\\1'),"
                f" '([.][0-9]*?)0+$', '\\1'), '[.]$', '') END")

    u, d = alias("g2"), alias("g4")
    units = codes("u", vocab.STRENGTH_UNITS)
    shown = lambda x: f"COALESCE({codes(x, vocab.UNIT_DISPLAY)}, {x})"
    return f"""
sp1 AS (SELECT {key}, {group(1)} AS g1, {group(2)} AS g2, {group(3)} AS g3, {group(4)} AS g4 FROM {source}),
sp2 AS (SELECT {key}, g4, {exact('g1')} AS num, {u} AS u, {d} AS d, {exact("COALESCE(g3, '1')")} AS den FROM sp1),
sp3 AS (SELECT {key}, g4, num, {units} AS unit, den,
  COALESCE({codes('d', vocab.QUANTITY_UNITS)}, CASE WHEN {codes('d', vocab.STRENGTH_UNITS)} = 'l' THEN 'l' END) AS den_unit FROM sp2),
sp4 AS (SELECT {key}, num, unit, CASE WHEN g4 IS NOT NULL THEN den END AS den, CASE WHEN g4 IS NOT NULL THEN den_unit END AS den_unit,
  num IS NOT NULL AND unit IS NOT NULL AND (g4 IS NULL OR (den_unit IS NOT NULL AND den IS NOT NULL)) AS good FROM sp3),
strengths AS (SELECT {key}, num, unit, den, den_unit, good,
  num || CASE WHEN unit = 'percent' THEN '' ELSE ' ' END || {shown('unit')} ||
    CASE WHEN den_unit IS NULL THEN '' ELSE '/' || CASE WHEN den = '1' THEN '' ELSE den || ' ' END || {shown('den_unit')} END AS display,
  num || ':' || unit || ':' || COALESCE(den, '') || ':' || COALESCE(den_unit, '') AS skey FROM sp4)"""
