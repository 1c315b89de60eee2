"""What arrives late, multi-valued dimensions, and currencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.lookup import Lookup, resolve_point_in_time
from starloom.operators.surrogate import assign_keys, max_key
from starloom.storage import written


def late_facts(facts: DataFrame, dim: DataFrame, lookup: Lookup) -> DataFrame:
    """Facts that arrive late find the version of their own day."""
    return resolve_point_in_time(facts, dim, lookup)


def late_dimension(dim: DataFrame, changes: DataFrame, nk: str, sk: str) -> tuple[DataFrame, DataFrame]:
    """changes: nk, effective_date in the past, and attributes. (dimension, moved): the version that covers the day ends the
    day before it, a new one takes the rest of its window. Several changes within one version share its window out: each
    lasts until the day before the next, and only the last can be current. Of changes of a key on the same day the
    greatest by their attributes holds. moved: nk, old_sk, new_sk, first and last day, to repoint facts."""
    attributes = [c for c in changes.columns if c not in (nk, "effective_date")]
    late = changes.select(F.col(nk).alias("_nk"), F.col("effective_date").cast("date").alias("_day"), F.struct(*attributes).alias("_new"))
    late = late.groupBy("_nk", "_day").agg(F.max("_new").alias("_new"))
    covers = (F.col(nk) == F.col("_nk")) & (F.col("effective_date") <= F.col("_day")) & (F.col("expiration_date").isNull() | (F.col("expiration_date") >= F.col("_day")))
    dim = written(dim, "late-dim")
    following = F.lead("_day").over(Window.partitionBy("_old").orderBy("_day"))
    hit = dim.join(late, covers).withColumn("_old", F.col(sk)).withColumn("_next", following)
    hit = hit.withColumns({"expiration_date": F.coalesce(F.date_sub("_next", 1), "expiration_date"), "is_current": F.col("is_current") & F.col("_next").isNull()})
    fresh = written(assign_keys(hit.drop(sk), sk, [nk, "_day", "_old"], max_key(dim, sk)), "late-new")
    new_rows = fresh.select(*((F.col("_day") if c == "effective_date" else F.col(f"_new.{c}") if c in attributes else F.col(c)).alias(c) for c in dim.columns))
    # cut once, at the first change; a version that starts on that very day is replaced as a whole
    cut = fresh.groupBy("_old").agg(F.min("_day").alias("_cut"))
    old = dim.join(cut, dim[sk] == cut["_old"], "left").filter("_cut is null or effective_date < _cut")
    old = old.withColumn("expiration_date", F.when(F.col("_cut").isNotNull(), F.date_sub("_cut", 1)).otherwise(F.col("expiration_date"))).withColumn("is_current", F.col("is_current") & F.col("_cut").isNull())
    moved = fresh.select(F.col(nk).alias("nk"), F.col("_old").alias("old_sk"), F.col(sk).alias("new_sk"), F.col("_day").alias("first_day"), F.col("expiration_date").alias("last_day"))
    return old.select(*dim.columns).unionByName(new_rows), moved


def repoint(facts: DataFrame, moved: DataFrame, sk: str, day: str) -> DataFrame:
    """Facts of an old key on the days of the new version get the new key."""
    m = moved.select(F.col("old_sk").alias("_old"), F.col("new_sk").alias("_new"), F.col("first_day").alias("_a"), F.col("last_day").alias("_b"))
    on = (F.col(sk) == F.col("_old")) & (F.col(day) >= F.col("_a")) & (F.col("_b").isNull() | (F.col(day) <= F.col("_b")))
    return facts.join(m, on, "left").withColumn(sk, F.coalesce("_new", sk)).select(*facts.columns)


def bridge(links: DataFrame, group: str, member: str) -> DataFrame:
    """group, member, weight = 1 / members of the group, so that weighted sums count a group once."""
    return links.select(group, member).distinct().withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy(group)))


def to_currency(facts: DataFrame, rates: DataFrame, amount: str, currency: str, output: str) -> DataFrame:
    """amount / rate of its currency (units of currency for one of the base); no rate gives null."""
    r = rates.select(F.col("currency").alias("_cur"), F.col("rate").alias("_rate"))
    return facts.join(r, F.col(currency) == F.col("_cur"), "left").withColumn(output, F.round(F.col(amount).cast("decimal(20,4)") / F.col("_rate").cast("decimal(18,6)"), 2)).drop("_cur", "_rate")


def rates_from_json(payload: DataFrame) -> DataFrame:
    """(currency, rate) from a frame whose rates column is a map."""
    return payload.select(F.explode("rates").alias("currency", "rate"))
