"""Surrogate keys: positive, rising, never reused; -1 is the unknown member."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.storage import exists, locked, read_text, write_text, written

UNKNOWN = -1


def assign_keys(df: DataFrame, key: str, order: list[str | Column], offset: int = 0) -> DataFrame:
    """Adds key = offset + 1, 2, ... by `order`, without bringing all rows to one task.

    Rows are range-partitioned by the order; counts of the partitions (one small row each) give each its start.
    """
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = written(df.repartitionByRange(*columns).withColumn("_p", F.spark_partition_id()), "keys")
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row a partition: its number is set by the session, not by the data
    start = counts.select(F.col("_p").alias("_q"), (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    placed = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*columns)))
    out = placed.join(F.broadcast(start), F.col("_p") == F.col("_q"))
    return out.select((F.col("_i") + F.coalesce("_before", F.lit(0)) + offset).cast("long").alias(key), *df.columns)


class KeySequence:
    """The last key given out for each dimension, in a file, changed under a lock. Unreadable or absent files start afresh."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _load(self) -> dict[str, int]:
        try:
            return json.loads(read_text(self.spark, self.path)) if exists(self.spark, self.path) else {}
        except ValueError:
            return {}

    def current(self, dim: str) -> int:
        return int(self._load().get(dim, 0))

    def reserve(self, dim: str, n: int) -> range:
        """n new keys; one write for the whole block."""
        if n < 0:
            raise ValueError("n is negative")
        with locked(self.spark, self.path):
            known = self._load()
            first = int(known.get(dim, 0)) + 1
            known[dim] = first + n - 1
            write_text(self.spark, self.path, json.dumps(known))
        return range(first, first + n)

    def next(self, dim: str) -> int:
        return self.reserve(dim, 1)[0]

    def at_least(self, dim: str, key: int) -> int:
        """Notes that keys up to `key` are taken; returns the last key taken."""
        with locked(self.spark, self.path):
            known = self._load()
            if key > int(known.get(dim, 0)):
                known[dim] = int(key)
                write_text(self.spark, self.path, json.dumps(known))
        return int(known.get(dim, 0))

    def reset(self, dim: str | None = None) -> None:
        with locked(self.spark, self.path):
            known = {k: v for k, v in self._load().items() if dim is not None and k != dim}
            write_text(self.spark, self.path, json.dumps(known))


def max_key(dim: DataFrame | None, key: str) -> int:
    found = dim.agg(F.max(key)).first()[0] if dim is not None else None
    return max(0, int(found or 0))
