"""Slowly changing dimensions, types 1 and 2, as one plan: a join of source and current versions, and unions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.surrogate import UNKNOWN, assign_keys, max_key
from starloom.storage import written


def changed(a: Column, b: Column) -> Column:
    """Values differ as stripped text; null equals null only."""
    return ~F.trim(a.cast("string")).eqNullSafe(F.trim(b.cast("string")))


def any_changed(columns: list[str], left: str, right: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | changed(F.col(f"{left}.{c}"), F.col(f"{right}.{c}"))
    return out


def apply_scd(new: DataFrame, dim: DataFrame, nk: str, sk: str, type2: list[str], type1: list[str], effective: str | date, first_key: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(dimension, change log). The log has nk, action, old_sk, new_sk.

    No current version: INSERT. A type 2 difference: the version ends the day before `effective` and a new one begins
    (UPDATE_T2_EXPIRE, UPDATE_T2_NEW). A type 1 difference: all versions are overwritten, logged as UPDATE_T1 unless
    type 2 differs too. A key that left the source: EXPIRE. Rows with the unknown key stay as they are. Keys of new
    versions follow the largest one of the dimension (or first_key), in the order of the natural key.
    """
    eff = F.lit(str(effective)).cast("date")
    attributes = [c for c in (*type2, *type1) if c in new.columns]
    new = new.select(nk, *attributes).dropDuplicates([nk])
    names = dim.columns
    known = written(dim, "scd")  # the table may be written over by the caller
    unknown, live = known.filter(F.col(sk) == UNKNOWN), known.filter(F.col(sk) != UNKNOWN)
    t2, t1 = [c for c in type2 if c in attributes], [c for c in type1 if c in attributes]
    current = live.filter("is_current").select(F.col(nk).alias("_old_nk"), F.col(sk).alias("_old_sk"), F.struct(*attributes).alias("o"))
    both = new.select(F.col(nk).alias("_new_nk"), F.struct(*attributes).alias("n")).join(current, F.col("_new_nk") == F.col("_old_nk"), "full_outer")
    two, one = any_changed(t2, "n", "o"), any_changed(t1, "n", "o")
    action = (
        F.when(F.col("_old_nk").isNull(), "INSERT").when(F.col("_new_nk").isNull(), "EXPIRE").when(two & one, "BOTH").when(two, "T2").when(one, "T1")
    )
    found = written(both.select(F.coalesce("_new_nk", "_old_nk").alias("_nk"), "n", "_old_sk", action.alias("_action")).filter("_action is not null"), "scd-actions")
    start = first_key - 1 if first_key is not None else max_key(known, sk)
    fresh = written(assign_keys(found.filter("_action in ('INSERT', 'T2', 'BOTH')"), "_sk", ["_nk"], start), "scd-new")
    # versions: end those replaced or gone, overwrite type 1 everywhere
    ends = found.filter("_action in ('T2', 'BOTH', 'EXPIRE')").select(F.col("_old_sk").alias("_end"))
    over = found.filter("_action in ('T1', 'BOTH')").select(F.col("_nk").alias("_over"), F.struct(*(F.col(f"n.{c}").alias(c) for c in t1)).alias("w")) if t1 else None
    kept = live.join(ends, live[sk] == ends["_end"], "left")
    if over is not None:
        kept = kept.join(over, kept[nk] == over["_over"], "left")
    out = []
    for c in names:
        v = F.col(c)
        if c == "expiration_date":
            v = F.when(F.col("_end").isNotNull(), F.date_sub(eff, 1)).otherwise(v)
        elif c == "is_current":
            v = F.when(F.col("_end").isNotNull(), F.lit(False)).otherwise(v)
        elif over is not None and c in t1:
            v = F.when(F.col("_over").isNotNull(), F.col(f"w.{c}")).otherwise(v)
        out.append(v.alias(c))
    kinds = dict(dim.dtypes)
    made = {nk: F.col("_nk"), sk: F.col("_sk"), "effective_date": eff, "expiration_date": F.lit(None), "is_current": F.lit(True)} | {c: F.col(f"n.{c}") for c in attributes}
    versions = fresh.select(*(made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in names))
    result = unknown.unionByName(kept.select(*out)).unionByName(versions)
    rows = found.join(fresh.select(F.col("_nk").alias("_k"), "_sk"), F.col("_nk") == F.col("_k"), "left")
    entry = lambda name, old, new: F.struct(F.lit(name).alias("action"), old.cast("long").alias("old_sk"), new.cast("long").alias("new_sk"))
    none = F.lit(None)
    logged = (
        F.when(F.col("_action") == "INSERT", F.array(entry("INSERT", none, F.col("_sk"))))
        .when(F.col("_action") == "EXPIRE", F.array(entry("EXPIRE", F.col("_old_sk"), none)))
        .when(F.col("_action") == "T1", F.array(entry("UPDATE_T1", F.col("_old_sk"), none)))
        .otherwise(F.array(entry("UPDATE_T2_EXPIRE", F.col("_old_sk"), none), entry("UPDATE_T2_NEW", F.col("_old_sk"), F.col("_sk"))))
    )
    log = rows.select(F.col("_nk").alias("nk"), F.explode(logged).alias("e")).select("nk", "e.*")
    return result, log


def version_faults(dim: DataFrame, nk: str, sk: str) -> DataFrame:
    """(nk, fault) of keys without exactly one current version, or with windows that overlap."""
    from pyspark.sql import Window

    rows = dim.filter(F.col(sk) != UNKNOWN)
    several = rows.groupBy(nk).agg(F.count(F.when(F.col("is_current"), 1)).alias("_n")).filter("_n <> 1").select(F.col(nk).alias("nk"), F.lit("current_count").alias("fault"))
    following = F.lead("effective_date").over(Window.partitionBy(nk).orderBy("effective_date", sk))
    overlap = rows.withColumn("_next", following).filter("_next is not null and (expiration_date is null or _next <= expiration_date)")
    return several.unionByName(overlap.select(F.col(nk).alias("nk"), F.lit("overlap").alias("fault")).distinct())
