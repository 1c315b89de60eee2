"""Tables that cut a lineage: written to the folder all executors share, and read back."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a temporary folder if the master is
    local, and an error on a cluster: executors do not share the driver's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="starloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _made:
        made.append(path)
    return path


#: Paths given out inside each scratch() that is open, the innermost last.
_made: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession, keep: list[DataFrame] | None = None) -> Iterator[list[DataFrame]]:
    """Removes the tables made inside by written() and new_path() at the end, but for the written tables put into the list it gives."""
    kept, made = list(keep or []), []
    _made.append(made)
    try:
        yield kept
    finally:
        _made[:] = [m for m in _made if m is not made]
        stays = {df._starloom_path for df in kept if hasattr(df, "_starloom_path")}
        for path in made:
            if path not in stays:
                remove(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The frame that make() gives, written; the tables it needed on the way are removed."""
    with scratch(spark) as kept:
        out = written(make(), name)
        kept.append(out)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of df: writes it as Parquet to the shared folder and reads it back.

    The table stays until drop_written(), or the end of the scratch() it was made in.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._starloom_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes a table made by written() once no later plan reads it."""
    if path := getattr(df, "_starloom_path", None):
        remove(df.sparkSession, path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object, so any store that Spark reaches will do."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = filesystem(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = filesystem(spark, path)
    return fs.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, where = filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def move(spark: SparkSession, old: str, new: str) -> None:
    fs, where = filesystem(spark, old)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot rename {old} to {new}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = filesystem(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A whole file at once: under another name first, then renamed."""
    fs, where = filesystem(spark, path)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(part), True)
    out.write(bytearray(content))
    out.close()
    if fs.exists(where):
        fs.delete(where, True)
    move(spark, part, path)


@contextmanager
def locked(spark: SparkSession, path: str, seconds: float = 30) -> Iterator[None]:
    """Holds a lock file beside path; whoever finds it waits, up to so many seconds."""
    fs, where = filesystem(spark, f"{path}.lock")
    until = time.monotonic() + seconds
    while True:
        try:
            fs.create(where, False).close()
            break
        except Exception as e:
            if "exist" not in str(e).lower():
                raise
            if time.monotonic() > until:
                raise TimeoutError(f"{path} is locked; remove {path}.lock if its owner is gone") from e
            time.sleep(0.05)
    try:
        yield
    finally:
        fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = filesystem(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
