"""Date keys: YYYYMMDD as an integer, 19000101 where there is no date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_DATE = 19000101


def as_date(c: Column | str) -> Column:
    """A date from a date, timestamp or string; null where that fails."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("date")


def date_to_sk(c: Column | str) -> Column:
    d = as_date(c)
    return F.coalesce(F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d), F.lit(NO_DATE)).cast("int")
