"""Standard forms of names, countries and phones, and string similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the published data set's, for equal results.
COUNTRY_ALIASES = {
    "Germany": "DE", "France": "FR", "Brazil": "BR", "Mexico": "MX", "Canada": "CA", "Sweden": "SE", "Spain": "ES", "Switzerland": "CH",
    "Austria": "AT", "Belgium": "BE", "Finland": "FI", "Italy": "IT", "Norway": "NO", "Portugal": "PT", "Denmark": "DK", "Ireland": "IE",
    "Argentina": "AR", "Venezuela": "VE", "Poland": "PL", "Netherlands": "NL", "USA": "US", "UK": "GB", "Japan": "JP", "Australia": "AU",
    "Singapore": "SG", "United States": "US", "United Kingdom": "GB", "Great Britain": "GB", "Brasil": "BR", "Holland": "NL",
    "Schweiz": "CH", "Österreich": "AT", "Deutschland": "DE", "Allemagne": "DE", "Espagne": "ES", "Suisse": "CH",
}

# International calling codes.
DIAL_CODES = {
    "AR": "54", "AT": "43", "BE": "32", "BR": "55", "CA": "1", "CH": "41", "DE": "49", "DK": "45", "ES": "34", "FI": "358", "FR": "33",
    "GB": "44", "IE": "353", "IT": "39", "MX": "52", "NL": "31", "NO": "47", "PL": "48", "PT": "351", "SE": "46", "US": "1", "VE": "58",
}

# Code, name, region, subregion, currency.
COUNTRIES = [
    ("AR", "Argentina", "Americas", "South America", "ARS"),
    ("AT", "Austria", "Europe", "Central Europe", "EUR"),
    ("AU", "Australia", "Oceania", "Australia and New Zealand", "AUD"),
    ("BE", "Belgium", "Europe", "Western Europe", "EUR"),
    ("BR", "Brazil", "Americas", "South America", "BRL"),
    ("CA", "Canada", "Americas", "Northern America", "CAD"),
    ("CH", "Switzerland", "Europe", "Central Europe", "CHF"),
    ("DE", "Germany", "Europe", "Western Europe", "EUR"),
    ("DK", "Denmark", "Europe", "Northern Europe", "DKK"),
    ("ES", "Spain", "Europe", "Southern Europe", "EUR"),
    ("FI", "Finland", "Europe", "Northern Europe", "EUR"),
    ("FR", "France", "Europe", "Western Europe", "EUR"),
    ("GB", "United Kingdom", "Europe", "Northern Europe", "GBP"),
    ("IE", "Ireland", "Europe", "Northern Europe", "EUR"),
    ("IT", "Italy", "Europe", "Southern Europe", "EUR"),
    ("JP", "Japan", "Asia", "Eastern Asia", "JPY"),
    ("MX", "Mexico", "Americas", "Central America", "MXN"),
    ("NL", "Netherlands", "Europe", "Western Europe", "EUR"),
    ("NO", "Norway", "Europe", "Northern Europe", "NOK"),
    ("PL", "Poland", "Europe", "Eastern Europe", "PLN"),
    ("PT", "Portugal", "Europe", "Southern Europe", "EUR"),
    ("SE", "Sweden", "Europe", "Northern Europe", "SEK"),
    ("SG", "Singapore", "Asia", "South-Eastern Asia", "SGD"),
    ("US", "United States", "Americas", "Northern America", "USD"),
    ("VE", "Venezuela", "Americas", "South America", "VES"),
]


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def standardize_country(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """The code of a known alias (stripped, case counts), else the stripped value. Null stays null."""
    bare = F.trim(c)
    return F.coalesce(F.try_element_at(literal_map(COUNTRY_ALIASES if aliases is None else aliases), bare), bare)


def standardize_phone(c: Column, country: Column | None = None) -> Column:
    """+dial-digits where the country is known, else the digits, else (no digits) the value as it is."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    dial = F.try_element_at(literal_map(DIAL_CODES), country) if country is not None else F.lit(None).cast("string")
    return F.when(digits == "", c).when(dial.isNotNull(), F.concat(F.lit("+"), dial, F.lit("-"), digits)).otherwise(digits)


def title_case(c: Column) -> Column:
    """Upper case after any non-letter, lower case elsewhere: d.f. -> D.F. (initcap only looks at white space)."""
    parts = F.split(F.trim(c), r"(?<=\P{L})(?=\p{L})")
    capital = F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20))))
    return F.array_join(capital, "")


def full_name(*parts: Column) -> Column:
    """Parts that are neither empty nor the word null, with single spaces."""
    clean = [F.when(~F.lower(F.trim(p)).isin("", "null"), F.trim(p)) for p in parts]
    return F.concat_ws(" ", *clean)


def jaro_winkler_one(a: str, b: str) -> float:
    """Jaro-Winkler on code points: prefix of up to 4, scale 0.1, boost only above 0.7."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    used = [False] * m
    mine = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    k = len(mine)
    if not k:
        return 0.0
    other = [b[j] for j in range(m) if used[j]]
    swaps = sum(x != y for x, y in zip(mine, other)) // 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((i for i in range(min(4, n, m)) if a[i] != b[i]), min(4, n, m))
    return jaro + prefix * 0.1 * (1 - jaro)


@lru_cache(1)
def _jaro_winkler():
    """Made on first use: a session has to be there."""

    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from starloom.functions.similar import Field

        for x, y in pairs:
            both = Field([*x, *y])
            yield pd.Series(both.similarity(both.of[: len(x)], both.of[len(x) :]), dtype="float64")

    return F.pandas_udf(run, "double")


def jaro_winkler(a: Column, b: Column) -> Column:
    """Arrow batches, scored as arrays."""
    return _jaro_winkler()(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def similarity(a: Column, b: Column) -> Column:
    """Of stripped, lower-cased values: both empty 1, one empty 0."""
    a, b = (F.lower(F.trim(F.coalesce(x.cast("string"), F.lit("")))) for x in (a, b))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(jaro_winkler(a, b))


def match_score(pairs: list[tuple[Column, Column, float]]) -> Column:
    """Weighted sum of similarities, to six places."""
    return F.round(sum((similarity(a, b) * w for a, b, w in pairs), F.lit(0.0)), 6)
