"""Where results go: versioned dimensions, quarantine, error events, databases, run metadata."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from starloom.operators.surrogate import assign_keys
from starloom.storage import children, exists, move, read_text, remove, write_text, written

log = logging.getLogger(__name__)


class PublishError(Exception):
    """A dimension cannot be published or found."""


class DimensionStore:
    """Versions of dimensions: {base}/{dim}/{batch}, and a pointer file that names the latest.

    A version is written under another name and renamed; the pointer changes last, so readers see whole versions.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def publish(self, dim: str, df: DataFrame, batch: str) -> str:
        if df.isEmpty():
            raise PublishError(f"{dim}: nothing to publish")
        path = f"{self.base}/{dim}/{batch}"
        part = f"{self.base}/{dim}/.{batch}-{uuid.uuid4().hex}"
        df.write.parquet(part)
        if exists(self.spark, path):
            move(self.spark, path, f"{self.base}/{dim}/.old-{batch}-{uuid.uuid4().hex}")
        move(self.spark, part, path)
        write_text(self.spark, f"{self.base}/{dim}/_latest", batch)
        return path

    def versions(self, dim: str) -> list[str]:
        return [n for n in children(self.spark, f"{self.base}/{dim}") if not n.startswith(("_", "."))]

    def version(self, dim: str, batch: str) -> DataFrame:
        if batch not in self.versions(dim):
            raise PublishError(f"{dim} has no version {batch}")
        return self.spark.read.parquet(f"{self.base}/{dim}/{batch}")

    def latest(self, dim: str) -> DataFrame:
        pointer = f"{self.base}/{dim}/_latest"
        if not exists(self.spark, pointer):
            raise PublishError(f"{dim} was never published")
        return self.version(dim, read_text(self.spark, pointer))


def _beside(path: str, what: str) -> str:
    """A hidden sibling of a table."""
    folder, slash, name = path.rstrip("/").rpartition("/")
    return f"{folder}{slash}.{what}-{name}"


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A table at path. Overwriting writes the new one beside it and then swaps folders: df may read the old table, and a crash
    on the way leaves a whole one, which restore_table() puts back if need be."""
    if mode != "overwrite":
        df.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)
        return
    spark = df.sparkSession
    part, old = _beside(path, uuid.uuid4().hex), _beside(path, "old")
    df.write.partitionBy(*(partition_by or [])).parquet(part)
    restore_table(spark, path)
    if exists(spark, path):
        move(spark, path, old)
    move(spark, part, path)
    remove(spark, old)


def restore_table(spark: SparkSession, path: str) -> None:
    """After a crash between the two renames of write_table the old table has another name: gives it back its own."""
    old = _beside(path, "old")
    if not exists(spark, old):
        return
    if exists(spark, path):
        remove(spark, old)
    else:
        move(spark, old, path)


def append_error_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def append_error_events_jdbc(events: DataFrame, url: str, table: str, properties: dict[str, str]) -> bool:
    """Error events to a database as well; a database that fails is logged and does not stop the run. True if written."""
    try:
        write_jdbc(events, url, table, properties)
    except Exception as e:
        log.warning("error events not written to %s: %s", table, str(e).splitlines()[0] if str(e) else type(e).__name__)
        return False
    return True


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], mode: str = "append", batch_size: int = 1000) -> None:
    df.write.option("batchsize", batch_size).jdbc(url, table, mode=mode, properties=properties)


def insert_ignore_jdbc(df: DataFrame, url: str, table: str, keys: list[str], properties: dict[str, str]) -> None:
    """Appends the rows whose key the table does not have yet. Of the table's keys only those between the least and the greatest
    new first key are read."""
    new = written(df.dropDuplicates(keys), "jdbc-new")
    low, high = new.agg(F.min(keys[0]), F.max(keys[0])).first()
    if low is None and high is None:
        write_jdbc(new, url, table, properties)
        return
    known = df.sparkSession.read.jdbc(url, table, properties=properties).select(*keys).filter(F.col(keys[0]).between(low, high))  # pushed down
    write_jdbc(new.join(known, keys, "left_anti"), url, table, properties)


def save_crc_index(indexed: DataFrame, folder: str, entity: str) -> None:
    write_table(indexed, f"{folder}/{entity}_crc")


def load_crc_index(spark: SparkSession, folder: str, entity: str) -> DataFrame | None:
    path = f"{folder}/{entity}_crc"
    return spark.read.parquet(path) if exists(spark, path) else None


def write_run(spark: SparkSession, folder: str, batch: str, run: dict) -> None:
    write_text(spark, f"{folder}/{batch}.json", json.dumps(run, indent=1, default=str))


def produce_kafka(events: DataFrame, servers: str, topic: str) -> int:
    """Events (key, value) to a topic; returns how many the job has delivered. Needs Spark's Kafka package on the class path."""
    seen = Observation()
    rows = events.selectExpr("cast(key as string) as key", "cast(value as string) as value").observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    return int(seen.get["n"])


def produce_files(events: DataFrame, folder: str) -> int:
    """Events (value) as JSON lines, for streams over files; returns how many were written."""
    seen = Observation()
    events.select("value").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").text(folder)
    return int(seen.get["n"])


def produce_paced(events: DataFrame, send: Callable[[DataFrame], int], per_batch: int, seconds: float, sleep: Callable[[float], None] = time.sleep) -> int:
    """Sends events in batches of `per_batch`, in the order of their key, with a pause after each but the last. Returns how many were sent.

    send: produce_files or produce_kafka with their target bound. The events are written once, so that all batches see the same ones.
    """
    numbered = written(assign_keys(events, "_number", ["key"]), "paced")
    whole, sent = numbered.count(), 0
    for first in range(0, whole, per_batch):
        if first:
            sleep(seconds)
        sent += send(numbered.filter((F.col("_number") > first) & (F.col("_number") <= first + per_batch)).drop("_number"))
        log.info("sent %d of %d", sent, whole)
    return sent
