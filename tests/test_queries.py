"""Every registered warehouse query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from starloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if pd.isna(x):
            return None
        if hasattr(x, "year"):
            return str(x)[:19].removesuffix(" 00:00:00")
        if isinstance(x, (str, bool)) or type(x).__name__.startswith("bool"):
            return str(x)
        return round(float(x), 6)

    return sorted((tuple(value(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    theirs = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0
    assert normal(ours) == normal(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
