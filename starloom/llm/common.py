"""What several training-data operators share: the shared folder, written tables, grouped streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.storage import drop_written, new_path, shared_dir, written

__all__ = ["WORD", "by_group", "drop_written", "groups", "new_path", "shared_dir", "small_batches", "table", "text_or_empty", "written"]

#: ASCII white space; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bounds what a Python worker holds at once: whole texts travel at most `rows` at a time. Spark bounds a batch by bytes as well
    (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set), so long texts travel in smaller batches. Plans read the setting
    when they run, after the operator has returned, so it is only ever lowered here and stays for the session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with an equal, non-null `key` (an integer column), from batches in which such rows are adjacent.

    Holds one group at a time, so memory is bounded by the largest group rather than by the partition.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts = [0, *cuts.tolist(), len(keys)]
        for a, b in zip(starts, starts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, key: str, f: Callable[[pa.Table], pa.RecordBatch | None], schema: str, *order: str) -> DataFrame:
    """One hash exchange on `key`, a sort inside the partitions, then f on each run of equal keys."""

    def run(batches):
        for group in groups(batches, key):
            out = f(group)
            if out is not None and out.num_rows:
                yield out

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)
