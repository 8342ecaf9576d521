"""WARC archives as a Spark data source, and archiving with revisit records.

Reading plans whole files into partitions of about `partition_bytes`.  Equality,
set and prefix predicates on the header columns are pushed into the reader; each
record's header is parsed first, and a record that fails a predicate is passed
over by its length (in a .gz file its bytes are still inflated, since members don't say
how long they are, but neither parsed nor kept).  The payload is only kept if its column is asked for; with
`verify` the payloads that are read are checked against their digests.

Writing makes one file after another of about `file_bytes` per task, under a
name of its own attempt; the driver's commit moves the files of the successful
attempts into place, so that lost or speculative tasks leave nothing.

Options: path, compression (gzip, each record a member, or none), level,
file_bytes, partition_bytes, verify, date.

Defined results: a null payload is empty; null header values are left out; line
breaks in header values become spaces.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from pagemill.runtime import shared_folder, ship_package, small_side, written
from pagemill.sources.files import listed, located

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, date string, content_type string, payload_digest string, block_bytes long, payload_bytes long, path string, record_offset long, payload binary"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest"}
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
END = b"\r\n\r\n"
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


def _header(file, what: str) -> dict[str, str]:
    """Named fields up to the blank line, names in lower case."""
    fields: dict[str, str] = {}
    while True:
        line = file.readline()
        if not line:
            raise ValueError(f"{what}: the header has no end")
        line = line.rstrip(b"\r\n")
        if not line:
            return fields
        name, _, value = line.partition(b":")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()


def _pass_over(file, count: int) -> None:
    while count:
        got = len(file.read(min(count, 1 << 20)))
        if not got:
            raise ValueError("the archive is cut off within a record")
        count -= got


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.columns = schema.names
        self.options = options
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if column not in HEADERS or len(f.attribute) != 1:
                yield f
            elif isinstance(f, EqualTo) and isinstance(f.value, str):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In) and all(isinstance(x, str) for x in f.value):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        most = int(self.options.get("partition_bytes", 64 << 20))
        out: list[list[str]] = []
        room = 0
        for path, size in listed(self.options["path"]):
            if not out or size > room:
                out.append([])
                room = most
            out[-1].append(path)
            room -= size
        return [Files(tuple(x)) for x in out] or [Files(())]

    def _wanted(self, fields: dict[str, str]) -> bool:
        for column, kind, values in self.tests:
            value = _bare(column, fields.get(HEADERS[column]))
            if value is None or not (value in values if kind == "in" else value.startswith(values[0])):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        types = pa.schema([(n, t) for n, t in ARROW if n in self.columns])
        order = [types.field(n) for n in self.columns]
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            for row in self._records(path):
                rows.append(row)
                size += len(row.get("payload") or b"") + 200
                if size > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(order))
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema(order))

    def _records(self, path: str) -> Iterator[dict]:
        system, inner = located(path)
        verify = self.options.get("verify", "false").lower() == "true"
        wants_payload, wants_size = "payload" in self.columns, "payload_bytes" in self.columns
        with system.open_input_stream(inner, compression=None) as raw:
            file = gzip.GzipFile(fileobj=raw, mode="rb") if path.endswith(".gz") else _Counted(raw)
            while True:
                offset = file.tell()
                line = file.readline()
                while line in (b"\r\n", b"\n"):
                    offset = file.tell()
                    line = file.readline()
                if not line:
                    return
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"{path}: no record begins at byte {offset}")
                fields = _header(file, f"{path} at byte {offset}")
                length = int(fields["content-length"])
                if not self._wanted(fields):
                    _pass_over(file, length)
                    continue
                row = {c: _bare(c, fields.get(h)) for c, h in HEADERS.items() if c in self.columns}
                row |= {k: v for k, v in (("path", path), ("record_offset", offset), ("block_bytes", length)) if k in self.columns}
                http = fields.get("content-type", "").startswith("application/http")
                left, stated = length, None
                if http and (wants_payload or wants_size or verify):
                    start = file.tell()
                    stated = _header(file, f"{path} at byte {start}").get("content-length")
                    left = length - (file.tell() - start)
                whole = fields.get("warc-type") != "revisit"
                if wants_size:
                    row["payload_bytes"] = left if whole or stated is None else int(stated)
                if whole and (wants_payload or verify):
                    payload = file.read(left)
                    if verify and (digest := fields.get("warc-payload-digest")) and digest != f"sha1:{base32_sha1(payload)}":
                        raise ValueError(f"{path}: the payload at byte {offset} doesn't have its digest")
                    if wants_payload:
                        row["payload"] = payload
                else:
                    _pass_over(file, left)
                yield row


class _Counted:
    """A stream with readline and tell over one that only reads."""

    def __init__(self, raw):
        self.raw, self.buffer, self.at, self.place = raw, b"", 0, 0

    def tell(self) -> int:
        return self.place

    def read(self, count: int) -> bytes:
        out = self.buffer[self.at : self.at + count]
        self.at += len(out)
        if len(out) < count:
            out += self.raw.read(count - len(out))
        self.place += len(out)
        return out

    def readline(self) -> bytes:
        parts = []
        while True:
            end = self.buffer.find(b"\n", self.at)
            if end >= 0:
                parts.append(self.buffer[self.at : end + 1])
                self.at = end + 1
                break
            parts.append(self.buffer[self.at :])
            self.buffer, self.at = self.raw.read(1 << 16), 0
            if not self.buffer:
                break
        line = b"".join(parts)
        self.place += len(line)
        return line


ARROW = [("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("payload_digest", pa.string()), ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("path", pa.string()), ("record_offset", pa.int64()), ("payload", pa.binary())]


def _bare(column: str, value: str | None) -> str | None:
    """Ids without angle brackets, digests without the algorithm's name."""
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.strip("<>")
    return value.partition(":")[2] if column == "payload_digest" else value


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(record_type: str, record_id: str, target_uri: str | None, refers_to: str | None, date: str, digest_hex: str, payload_bytes: int, payload: bytes) -> bytes:
    """One record; a revisit has the HTTP header of the whole payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    fields = [
        ("WARC-Type", record_type),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target_uri),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest_hex)).decode('ascii')}"),
        ("WARC-Refers-To", f"<{refers_to}>" if refers_to else None),
        ("WARC-Profile", REVISIT_PROFILE if record_type == "revisit" else None),
        ("Content-Type", HTTP_TYPE),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v is not None).encode("utf-8")
    return VERSION + head + b"\r\n" + block + END


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.path = options["path"].rstrip("/")
        self.attempts = f"{self.path}/_attempts-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = located(self.attempts)
        system.create_dir(folder, recursive=True)
        zipped = self.options.get("compression", "gzip") == "gzip"
        level, most = int(self.options.get("level", 1)), int(self.options.get("file_bytes", 128 << 20))
        date = self.options.get("date", "1970-01-01T00:00:00Z")
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                payload = (row["payload"] or "").encode("utf-8") if not isinstance(row["payload"], bytes) else row["payload"]
                data = record(row["record_type"], row["record_id"], row["target_uri"], row["refers_to"], date, row["payload_sha1"], row["payload_bytes"], payload)
                if zipped:
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = packer.compress(data) + packer.flush()
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc{'.gz' if zipped else ''}")
                    out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
                if size >= most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = located(self.attempts)
        _, final = located(self.path)
        system.create_dir(final, recursive=True)
        for message in messages:
            for name in message.names if message else ():
                system.move(f"{folder}/{name}", f"{final}/{name}")
        system.create_dir(folder, recursive=True)
        system.delete_dir(folder)

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = located(self.attempts)
        system.create_dir(folder, recursive=True)
        system.delete_dir(folder)


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path); df.write.format("warc").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(pages: DataFrame, least: int = 0, key: str = "page_id", uri: str = "url", payload: str = "html", scheme: str = "urn:page:") -> DataFrame:
    """Rows to write: equal payloads of at least `least` bytes become revisits of the greatest key's.

    Payloads are grouped by SHA-256 (their digest in the record is SHA-1), pre-aggregated
    before the shuffle. If the groups of two or more are few (counted), they are sent to
    the payloads, which then don't move; else each payload moves once.
    Rows that repeat the greatest key are responses too; rows with a null key are
    responses with an empty id; null and empty payloads are equal; an empty table makes no
    record; a very long payload is one record like any other; of the columns only key,
    address and payload are looked at.
    """
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    base = pages.select(F.col(key).cast("long").alias("k"), F.col(uri).cast("string").alias("target_uri"), data.alias("data"))
    base = base.withColumns({"payload_sha1": F.sha1("data"), "payload_sha256": F.unhex(F.sha2("data", 256)), "payload_bytes": F.octet_length("data").cast("long")})
    groups = base.where(F.col("payload_bytes") >= least).select("k", "payload_sha256").groupBy("payload_sha256").agg(F.max("k").alias("last"), F.min("k").alias("least"))
    shared = small_side(written(groups.where("last > least").select("payload_sha256", "last"), "payloads"))
    known = base.join(shared, "payload_sha256", "left")
    again = F.coalesce(F.col("k") < F.col("last"), F.lit(False))
    named = lambda c: F.concat(F.lit(scheme), F.coalesce(c.cast("string"), F.lit("")))
    return known.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        named(F.col("k")).alias("record_id"),
        "target_uri",
        F.when(again, named(F.col("last"))).alias("refers_to"),
        "payload_sha1",
        "payload_bytes",
        F.when(~again, F.col("data")).alias("payload"),
    )


def archive(pages: DataFrame, folder: str | None = None, least: int = 0, **names: str) -> str:
    """Write a record for each page; the archives' folder."""
    spark = pages.sparkSession
    register(spark)
    folder = folder or shared_folder(spark, "warc")
    records(pages, least, **names).write.format("warc").mode("append").save(folder)
    return folder


def read(spark: SparkSession, folder: str, columns: str = SCHEMA, **options: str) -> DataFrame:
    """The given columns of an archive folder; without `payload`, payloads are passed over."""
    register(spark)
    return spark.read.format("warc").schema(columns).options(**options).load(folder)
