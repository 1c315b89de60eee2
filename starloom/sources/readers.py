"""Scans: files, databases, streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from starloom.storage import children, exists


def header_schema(spark: SparkSession, path: str) -> StructType:
    """All columns of a CSV as strings, by its header."""
    return StructType([StructField(f.name, StringType()) for f in spark.read.csv(path, header=True, inferSchema=False).schema.fields])


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, skip_malformed: bool = True, header: bool = True) -> DataFrame:
    """CSV with a header, malformed rows skipped, the text NULL as null. Without a schema all columns are strings, named as in
    the header without surrounding blanks.

    The schema is always explicit and whole: with column pruning other rows could count as malformed.
    """
    mode = "DROPMALFORMED" if skip_malformed else "PERMISSIVE"
    rows = spark.read.csv(path, schema=schema or header_schema(spark, path), header=header, mode=mode, nullValue="NULL", enforceSchema=not header)
    return rows if schema else rows.toDF(*(c.strip() for c in rows.columns))


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def files_with_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of each file of a folder, computed where the files are."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str], schema: StructType | str | None = None, key: str | None = None, partitions: int = 8) -> DataFrame:
    """A database table; with a numeric key, in parallel ranges of it. A table that is missing gives an empty frame if a schema is known."""
    try:
        if key:
            low, high = spark.read.jdbc(url, f"(SELECT min(\"{key}\") AS lo, max(\"{key}\") AS hi FROM {table}) t", properties=properties).first()
            if low is not None:
                return spark.read.jdbc(url, table, column=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=partitions, properties=properties)
        return spark.read.jdbc(url, table, properties=properties)
    except Exception as e:
        if schema is None or not (isinstance(e, AnalysisException) or "java.sql" in str(e)):
            raise
        return spark.createDataFrame([], schema)


def max_key(spark: SparkSession, url: str, table: str, key: str, properties: dict[str, str]) -> int:
    """The largest key of a table, asked of the database; 0 if the table is empty or out of reach."""
    try:
        found = spark.read.jdbc(url, f"(SELECT max(\"{key}\") AS m FROM {table}) t", properties=properties).first()[0]
    except Exception as e:
        if "java.sql" not in str(e):
            raise
        return 0
    return int(found or 0)


def latest_in(spark: SparkSession, folder: str) -> str | None:
    """Path of the last snapshot folder by name."""
    names = [n for n in children(spark, folder) if not n.startswith(("_", "."))]
    return f"{folder}/{names[-1]}" if names else None


def read_kafka(spark: SparkSession, servers: str, topic: str, most_per_batch: int = 100_000) -> DataFrame:
    """A topic from its start, as a stream of string keys and values. Needs Spark's Kafka package on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(most_per_batch), "failOnDataLoss": "true"}
    return spark.readStream.format("kafka").options(**options).load().select(F.col("key").cast("string"), F.col("value").cast("string"))
