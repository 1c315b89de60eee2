"""Streams into Parquet: exactly once by checkpoint, bad events apart; and windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starloom.streaming.events import PAYLOAD_NAMES, decode, flatten


def read_lines(spark: SparkSession, folder: str, files_per_batch: int | None = 100) -> DataFrame:
    """JSON lines of a folder as a stream of value."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def ingest(lines: DataFrame, output: str, checkpoint: str, columns: list[str] | None = None, dead_letters: str | None = None, once: bool = True, seconds: int = 30) -> list[StreamingQuery]:
    """Starts the stream, and with dead_letters a second one for bad events. once: takes what is there and ends; else a batch every `seconds`.

    Each writes through the file sink's log with its own checkpoint, so a restart neither loses nor repeats events.
    Dead letters are (value, problem).
    """
    columns = columns or list(PAYLOAD_NAMES.values())
    events = decode(lines)

    def start(rows: DataFrame, path: str, name: str) -> StreamingQuery:
        writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{checkpoint}/{name}").outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()

    out = [start(flatten(events, columns), output, "good")]
    if dead_letters:
        out.append(start(events.filter("problem is not null").select("value", "problem"), dead_letters, "dead"))
    return out


def tumbling_counts(events: DataFrame, time: str = "event_timestamp", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by window and key; timestamps without a zone are read as UTC. On a stream in update or append mode the watermark bounds the state."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late) if rows.isStreaming else rows
    window = F.window("_t", width, slide) if slide else F.window("_t", width)
    return rows.groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def save_windows(counts: DataFrame, output: str, checkpoint: str, once: bool = True, seconds: int = 30) -> StreamingQuery:
    """Starts a stream of tumbling_counts into output: each batch writes the windows it changed to a folder of its own, so a batch
    that runs again writes the same. State holds only windows that the watermark has not passed."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def latest_windows(spark: SparkSession, output: str, keys: list[str]) -> DataFrame:
    """What save_windows wrote, each window and key as of its last batch."""
    rows = spark.read.parquet(output)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*(F.max_by(c, "batch").alias(c) for c in rest))


def sessions(events: DataFrame, user: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late) if rows.isStreaming else rows
    return rows.groupBy(user, F.session_window("_t", gap).alias("s")).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def once_each(events: DataFrame, key: str = "event_id", time: str = "event_timestamp", late: str = "1 hour") -> DataFrame:
    """Drops repeats of an event; on streams within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
