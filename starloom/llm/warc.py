"""WARC archives and their monolithic gzip normaliser (operator 7).

Pages become WARC/1.1 records: of the records with equal payloads the one with the largest id is the response,
the others are revisits that refer to it. Each task writes its records as archives of one gzip stream a file,
rolling over at `roll` bytes of records. The normaliser inflates such a file once, as a stream, rewrites every
record as a gzip member of its own, and writes a sidecar index (offset, length, id, kind), through which a reader
can seek to any record. The archives are then read back by the index.

All files lie in the shared folder, each under a name that only one attempt of one task uses. Which of them count is told by
tables that Spark commits, so a task that runs twice, late or beside itself never touches a file that another one reads;
files of attempts that lost stay unread and go with the folder. Memory is bounded by one record.

Equal payloads are found by SHA-1, a second hash and the length. Only those three and ids are grouped; payloads do not move
while the groups of several pages are few enough to broadcast, and are joined with them once beyond that.

Defined cases: null html is an empty payload; payloads below `least` bytes are all responses; a null id is
written as an empty one and read back as null, and sorts below all others; of rows that repeat id and payload one
is the response and the others revisit it; ids that are no integers are refused; an empty table gives no archive. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.common import new_path, small_batches, table, written

ROLL = 64 << 20
LEVEL = 6  # of the members that stay
FAST = 1  # of the monolithic streams, which are read once
#: Schemes that Arrow spells otherwise than Hadoop.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, leads: bool = True, refers_to: int | None = None) -> bytes:
    """A response, or if it does not lead a revisit of the page refers_to."""
    kind = "response" if leads else "revisit"
    named = lambda x: f"<urn:starloom:page:{'' if x is None else x}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if leads else b"")
    clean = "".join(c for c in url or "" if c > " ")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {named(page)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if not leads:
        lines += [f"WARC-Refers-To: {named(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def inflated(source, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members."""
    one = zlib.decompressobj(31)
    while data := source.read(chunk):
        while data:
            yield one.decompress(data)
            data = one.unused_data
            if one.eof:
                one = zlib.decompressobj(31)
    yield one.flush()


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, from inflated bytes cut anywhere."""
    held = bytearray()
    need = 0  # length of the next record, once known
    for part in stream:
        held += part
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 8 + next(int(x[16:]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length: "))
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


class Store:
    """Files under a folder that Spark shares: local or mounted disks, HDFS (by libhdfs), S3, Google and Azure stores, as Arrow knows them."""

    def __init__(self, folder: str):
        from pyarrow import fs

        scheme, _, rest = folder.partition("://")
        where = f"{ARROW_SCHEMES.get(scheme, scheme)}://{rest}" if rest or "://" in folder else "file://" + folder.removeprefix("file:")
        try:
            self.fs, self.root = fs.FileSystem.from_uri(where)
        except pa.ArrowInvalid as e:
            raise ValueError(f"archives cannot be written to {folder}: {e}") from e
        self.fs.create_dir(self.root, recursive=True)

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.root}/{name}")

    def write(self, name: str):
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def delete(self, name: str):
        """Also where an earlier attempt has done it."""
        if self.fs.get_file_info(f"{self.root}/{name}").type.name != "NotFound":
            self.fs.delete_file(f"{self.root}/{name}")


def _attempt() -> tuple[int, str]:
    from pyspark import TaskContext

    t = TaskContext.get()
    return t.partitionId(), f"{t.stageId()}-{t.taskAttemptId()}"


def with_revisits(pages: DataFrame, id_col="page_id", payload_col="html", url_col: str | None = "url", least: int = 0) -> DataFrame:
    """id, url, payload (binary), sha1 (hex), best (id of the response of its group, if several share it), leads (whether it is the response)."""
    if pages.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {pages.schema[id_col].dataType.simpleString()}: number the pages by integers first")
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    url = F.col(url_col) if url_col else F.lit("")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.cast("string").alias("url"), payload.alias("payload")).withColumns({"sha1": F.sha1("payload"), "mark": F.xxhash64("payload"), "size": F.length("payload")})
    key = ["sha1", "mark", "size"]
    by_id = rows.filter(F.col("size") >= least).groupBy(*key, "id").agg(F.count("*").alias("c"))
    several = by_id.groupBy(*key).agg(F.max("id").alias("best"), F.sum("c").alias("n"), F.max_by("c", F.struct(F.col("id").isNotNull(), "id")).alias("same")).filter("n > 1")
    several = written(several.select(F.col("sha1").alias("_sha1"), F.col("mark").alias("_mark"), F.col("size").alias("_size"), "best", "n", "same"), "shared-payloads")
    rows = rows.join(several, (F.col("sha1") == F.col("_sha1")) & (F.col("mark") == F.col("_mark")) & (F.col("size") == F.col("_size")), "left")
    leads = F.col("n").isNull() | F.col("id").eqNullSafe(F.col("best"))
    if several.filter("same > 1").limit(1).count():  # of rows that repeat the best id, one leads
        place = F.row_number().over(Window.partitionBy(*key, "id").orderBy("url"))
        leads = F.col("n").isNull() | (F.col("id").eqNullSafe(F.col("best")) & (place == 1))
    return rows.select("id", "url", "payload", "sha1", "best", leads.alias("leads"))


def write_archives(rows: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """One row per monolithic archive: name, records. Writes now."""
    small_batches(rows.sparkSession, 256)

    def run(batches):
        store, (partition, attempt) = Store(folder), _attempt()
        out, name, size, count, part = None, "", 0, 0, 0
        done: list[tuple[str, int]] = []

        def close():
            nonlocal out
            if out is not None:
                out.write(squeeze.flush())
                out.close()
                done.append((name, count))
            out = None

        for batch in batches:
            for page, url, payload, sha1, best, leads in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "sha1", "best", "leads"))):
                if out is None:
                    name, size, count, part = f"mono-{partition:06d}-{part:04d}-{attempt}.warc.gz", 0, 0, part + 1
                    out, squeeze = store.write(name), zlib.compressobj(FAST, zlib.DEFLATED, 31)
                raw = record(page, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), leads, best)
                out.write(squeeze.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= roll:
                    close()
        close()
        if done:
            a, b = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64())], names=["name", "records"])

    return written(rows.mapInArrow(run, "name string, records bigint"), "warc-mono")


def one_each(names: DataFrame) -> DataFrame:
    """A file a task, as long as there are not too many tasks."""
    return names.repartition(min(10_000, max(1, names.count())))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """One row per normalised archive: name, index (name of the sidecar), records. Writes now, then removes the input files."""

    def run(batches):
        store, (_, attempt) = Store(folder), _attempt()
        for batch in batches:
            for name in batch.column("name").to_pylist():
                new = f"part-{name.split('-', 1)[1].removesuffix('.warc.gz')}-{attempt}.warc.gz"
                at, count = 0, 0
                with store.open(name) as source, store.write(new) as out, store.write(f"{new}.idx") as side:
                    for raw in records(inflated(source)):
                        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = squeeze.compress(raw) + squeeze.flush()
                        fields, _ = parse(raw)
                        out.write(member)
                        side.write((json.dumps([at, len(member), fields["warc-record-id"], fields["warc-type"]]) + "\n").encode())
                        at, count = at + len(member), count + 1
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([f"{new}.idx"]), pa.array([count], pa.int64())], names=["name", "index", "records"])

    out = written(one_each(archives.select("name")).mapInArrow(run, "name string, index string, records bigint"), "warc-index")

    def remove(batches):
        store = Store(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                store.delete(name)
            yield batch

    archives.select("name").mapInArrow(remove, "name string").write.format("noop").mode("overwrite").save()
    return out


def read_archives(normalised: DataFrame, folder: str) -> DataFrame:
    """One row per record, by the sidecar index: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""

    def number(urn: str) -> int | None:
        digits = urn.rstrip(">").rpartition(":")[2]
        return int(digits) if digits else None

    def run(batches):
        store = Store(folder)
        for batch in batches:
            for name, index in zip(batch.column("name").to_pylist(), batch.column("index").to_pylist()):
                rows, held = [], 0
                with store.open(index) as side, store.open(name) as source:
                    for line in io.TextIOWrapper(io.BufferedReader(side), "utf-8"):
                        at, length, _, kind = json.loads(line)
                        source.seek(at)
                        fields, block = parse(zlib.decompress(source.read(length), 31))
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if payload is not None and base32_sha1(payload) != digest:
                            raise ValueError(f"{name} at {at}: payload digest differs")
                        refers = number(fields["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((number(fields["warc-record-id"]), int(fields["x-payload-length"]), digest, kind, refers, payload))
                        held += len(payload or b"")
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    return one_each(normalised.select("name", "index")).mapInArrow(run, schema)


def op7_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("payload")


def round_trip(pages: DataFrame, id_col="page_id", payload_col="html", url_col="url", least: int = 0, roll: int = ROLL) -> DataFrame:
    """Writes, normalises and reads back."""
    folder = new_path(pages.sparkSession, "warc")
    archives = write_archives(with_revisits(pages, id_col, payload_col, url_col, least), folder, roll)
    return read_archives(normalise(archives, folder), folder)


#: SHA-1 as base32: five hex digits are 20 bits, four letters.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT // (32 ** (3 - i % 4))::BIGINT % 32)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM h
"""
