"""Standard forms by rule, in the order of the rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions import text
from starloom.operators.screens import find_column


@dataclass(frozen=True)
class Transform:
    """transform: standardize_country, standardize_phone or title_case."""

    column: str
    transform: str
    output: str | None = None
    country: str | None = None


CUSTOMERS = [
    Transform("country", "standardize_country", "country_code"),
    Transform("city", "title_case"),
    Transform("companyName", "title_case"),
    Transform("phone", "standardize_phone", country="country_code"),
]
PLACES = [Transform("country", "standardize_country", "country_code"), Transform("city", "title_case")]
ENTITY_TRANSFORMS = {
    "customers": CUSTOMERS,
    "employees": PLACES,
    "suppliers": [*PLACES, Transform("companyName", "title_case")],
    "orders": [Transform("shipCountry", "standardize_country", "ship_country_code")],
}


def standardize(df: DataFrame, rules: list[Transform]) -> DataFrame:
    """Rules on absent columns are skipped; null stays null."""
    for r in rules:
        column = find_column(df, r.column)
        if column is None:
            continue
        c: Column = F.col(column).cast("string")
        if r.transform == "standardize_country":
            c = text.standardize_country(c)
        elif r.transform == "title_case":
            c = text.title_case(c)
        elif r.transform == "standardize_phone":
            country = find_column(df, r.country) if r.country else None
            c = text.standardize_phone(c, F.col(country) if country else None)
        else:
            raise ValueError(f"no such transform: {r.transform}")
        df = df.withColumn(r.output or column, c)
    return df


def transforms_from_yaml(path: str, entity: str) -> list[Transform]:
    from starloom.sources.config import load_yaml

    rows = load_yaml(path, "entities").get(entity) or []
    return [Transform(r["column"], r["transform"], r.get("output_column"), r.get("country_column")) for r in rows]


def geography(spark) -> DataFrame:
    """The reference table of countries, keys by sorted code from 1."""
    rows = [(k, *c) for k, c in enumerate(sorted(text.COUNTRIES), 1)]
    return spark.createDataFrame(rows, "geography_sk bigint, country_code string, country_name string, region string, subregion string, primary_currency string")
