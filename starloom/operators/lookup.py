"""Natural key to surrogate key: by equality, or by the version that was valid on a day.

Dimensions are stored tables, whose size Spark knows: it broadcasts those that are small in bytes, and joins the others by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.surrogate import UNKNOWN

class OverlapError(Exception):
    """Versions of a key overlap on a day that a fact has."""


@dataclass(frozen=True)
class Lookup:
    """fact_nk -> output. fact_date set: point in time; None: type 1."""

    dim: str
    fact_nk: str
    nk: str
    sk: str
    output: str
    fact_date: str | None = None
    effective: str = "effective_date"
    expiration: str = "expiration_date"


def one_version_per_day(dim: DataFrame, nk: str, sk: str, effective="effective_date", expiration="expiration_date") -> DataFrame:
    """Versions cut so that no two of a key hold on the same day: the one that starts first keeps the common days.

    So a lookup by range matches at most one version and never multiplies facts. One window over the dimension.
    """
    far = F.lit("9999-12-31").cast("date")
    order = Window.partitionBy(nk).orderBy(F.col(effective).asc_nulls_first(), sk)
    ends = F.max(F.coalesce(F.col(expiration), far)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = dim.select(nk, sk, effective, expiration, ends.alias("_taken"))
    start = F.when(F.col("_taken") >= F.coalesce(F.col(effective), F.lit("0001-01-01").cast("date")), F.when(F.col("_taken") < far, F.date_add("_taken", 1))).otherwise(F.coalesce(F.col(effective), F.lit("0001-01-01").cast("date")))
    return rows.select(F.col(nk).alias("_nk"), F.col(sk).alias("_sk"), start.alias("_from"), F.coalesce(F.col(expiration), far).alias("_to")).filter("_from is not null and _from <= _to and _nk is not null")


def resolve_point_in_time(facts: DataFrame, dim: DataFrame | None, lookup: Lookup, on_overlap: str = "first") -> DataFrame:
    """Adds lookup.output: the key of the version with effective <= day <= expiration (none: open), else -1.

    An equality join on the natural key with the range as its condition. on_overlap: "first" takes the version that
    starts first, "error" raises if versions of a key overlap at all.
    """
    if dim is None or lookup.fact_nk not in facts.columns:
        return facts.withColumn(lookup.output, F.lit(UNKNOWN).cast("long"))
    rows = dim.filter(F.col(lookup.sk) != UNKNOWN)
    if on_overlap == "error":
        following = F.lead(lookup.effective).over(Window.partitionBy(lookup.nk).orderBy(lookup.effective, lookup.sk))
        bad = rows.withColumn("_next", following).filter(F.col("_next").isNotNull() & (F.col(lookup.expiration).isNull() | (F.col("_next") <= F.col(lookup.expiration))))
        if not bad.limit(1).isEmpty():
            raise OverlapError(f"versions of {lookup.dim} overlap")
    spans = one_version_per_day(rows, lookup.nk, lookup.sk, lookup.effective, lookup.expiration)
    day = F.col(lookup.fact_date).try_cast("date")
    on = (F.col(lookup.fact_nk).cast("string") == F.col("_nk").cast("string")) & (F.col("_from") <= day) & (day <= F.col("_to"))
    return facts.join(spans, on, "left").withColumn(lookup.output, F.coalesce("_sk", F.lit(UNKNOWN)).cast("long")).drop("_nk", "_sk", "_from", "_to")


def resolve_type1(facts: DataFrame, dim: DataFrame | None, lookup: Lookup) -> DataFrame:
    """Adds lookup.output: the smallest key of the natural key, else -1."""
    if dim is None or lookup.fact_nk not in facts.columns:
        return facts.withColumn(lookup.output, F.lit(UNKNOWN).cast("long"))
    one = dim.filter(F.col(lookup.sk) != UNKNOWN).groupBy(F.col(lookup.nk).cast("string").alias("_nk")).agg(F.min(lookup.sk).alias("_sk"))
    return facts.join(one, F.col(lookup.fact_nk).cast("string") == F.col("_nk"), "left").withColumn(lookup.output, F.coalesce("_sk", F.lit(UNKNOWN)).cast("long")).drop("_nk", "_sk")


def resolve_batch(facts: DataFrame, dims: dict[str, DataFrame], lookups: list[Lookup]) -> DataFrame:
    for x in lookups:
        facts = (resolve_point_in_time if x.fact_date else resolve_type1)(facts, dims.get(x.dim), x)
    return facts
