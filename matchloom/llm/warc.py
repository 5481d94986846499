"""WARC archives: a Python data source that reads them, a sink that writes them, and the round trip of a page table.

Reading: one partition per archive file (the sink starts a new file after `maxfilebytes`). Equality and IN filters on headers, and
prefixes, tests for null and comparisons of lengths, are pushed into the reader; it parses a record's headers first and skips the payload of a
record that the filters drop, or whose payload the schema doesn't ask for, without decoding it. Header names count in any case, with or without a
space after the colon. Writing: each task writes its own gzip files, one member per record; the driver lists the files of tasks that
succeeded in ``_files.json``, which it puts in place whole, so files of failed or repeated tasks aren't read. Files are reached by
pyarrow's filesystems (file, hdfs, s3, gs).

Defined results: an empty table gives archives without a file, and these no rows; a null html is an empty payload; a long payload is one record, whole;
of rows alike in id and payload one is the response; columns besides page_id, url and html don't matter.
"""

from __future__ import annotations

import io
import json
import operator
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from matchloom.llm.common import join_split, small_batches, stage, work_dir

#: Column, type and header of what a record has. `headers` are all of them as JSON, `payload` the block without HTTP headers.
FIELDS = {
    "record_id": ("string", "WARC-Record-ID"),
    "record_type": ("string", "WARC-Type"),
    "target_uri": ("string", "WARC-Target-URI"),
    "date": ("string", "WARC-Date"),
    "payload_digest": ("string", "WARC-Payload-Digest"),
    "refers_to": ("string", "WARC-Refers-To"),
    "payload_length": ("long", "X-Payload-Length"),
    "content_length": ("long", "Content-Length"),
}
SCHEMA = ", ".join(f"{k} {kind}" for k, (kind, _) in FIELDS.items()) + ", headers string, payload binary"
#: Bytes of a file after which a task starts another, and rows of a batch that the reader yields.
MAX_FILE_BYTES, READ_ROWS, READ_BYTES = 128 << 20, 500, 4 << 20
#: A date that doesn't depend on when the archive is written, so that files are reproducible.
DATE = "1970-01-01T00:00:00Z"


def filesystem(uri: str):  # noqa: ANN201
    """pyarrow's filesystem for a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class Archive(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


@dataclass
class Written(WriterCommitMessage):
    files: list


def clean(value: object) -> str:
    """A header value stays on its line."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    """A record: headers, block, two line ends. Responses have an HTTP block; other types have the payload as it is."""
    payload = row.get("payload") or b""
    kind = row.get("record_type") or "resource"
    if kind == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        block = b"HTTP/1.1 200 OK\r\n\r\n" if kind == "revisit" else payload
    lines = [b"WARC/1.1", b"Content-Type: application/http;msgtype=response" if kind in ("response", "revisit") else b"Content-Type: application/octet-stream"]
    if kind == "revisit":
        lines.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    for name, (_, header) in FIELDS.items():
        if name != "content_length" and row.get(name) is not None:
            lines.append(f"{header}: {clean(row[name])}".encode())
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, most: int, level: int, overwrite: bool):
        self.path, self.most, self.level = path, most, level
        if overwrite:
            fs, folder = filesystem(path)
            fs.create_dir(folder, recursive=True)
            fs.delete_dir_contents(folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(posixpath.join(folder, files[-1]), compression=None), 0
                packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                member = packer.compress(record(row)) + packer.flush()
                out.write(member)
                size += len(member)
                if size >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        listed = sorted(f for m in messages if m for f in m.files)
        place = posixpath.join(folder, "_files.json")
        if fs.get_file_info(place).is_file:
            with fs.open_input_stream(place) as f:
                listed = sorted({*json.loads(f.read()), *listed})
        new = posixpath.join(folder, f"_files.{uuid.uuid4().hex}")
        with fs.open_output_stream(new) as f:
            f.write(json.dumps(listed).encode())
        fs.move(new, place)  # a crash before this leaves the old list

    def abort(self, messages: list) -> None:
        fs, folder = filesystem(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(posixpath.join(folder, f))


class Stream:
    """Bytes of a file of gzip members, or of a plain one, in order."""

    def __init__(self, raw):  # noqa: ANN001
        self.raw, self.buffer, self.at = raw, b"", 0
        first = raw.read(1 << 16)
        self.unpack = zlib.decompressobj(31) if first[:2] == b"\x1f\x8b" else None
        self.rest = first
        self.ended = not first

    def more(self) -> bool:
        """Add to the buffer; False at the end of the file."""
        while True:
            if self.unpack is None:
                data, self.rest = self.rest or self.raw.read(1 << 20), b""
                made = data
                if not data:
                    return False
            else:
                if self.unpack.eof:
                    self.rest = self.unpack.unused_data
                    self.unpack = zlib.decompressobj(31)
                data = self.unpack.unconsumed_tail or self.rest or self.raw.read(1 << 20)
                if data is self.rest:
                    self.rest = b""
                if not data:
                    return False
                made = self.unpack.decompress(data, 4 << 20)  # however much a few bytes unpack to
            if made:
                self.buffer, self.at = self.buffer[self.at :] + made, 0
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before mark, which is skipped; None if it doesn't come."""
        seen = self.at
        while (end := self.buffer.find(mark, seen)) < 0:
            back = max(0, len(self.buffer) - self.at - len(mark))
            if not self.more():
                return None
            seen = self.at + back
        out, self.at = self.buffer[self.at : end], end + len(mark)
        return out

    def take(self, n: int, keep: bool) -> bytes:
        """The next n bytes, or b"" if they aren't to be kept."""
        if not keep:
            while len(self.buffer) - self.at < n:
                n -= len(self.buffer) - self.at
                self.at = len(self.buffer)
                if not self.more():
                    return b""
            self.at += n
            return b""
        parts = io.BytesIO()
        while n:
            part = self.buffer[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.write(part)
            if n and not self.more():
                break
        return parts.getvalue()


class Headers(dict):
    """A record's headers as they are written; `get` takes a name in any case."""

    def __init__(self, pairs) -> None:  # noqa: ANN001
        super().__init__(pairs)
        self.lower = {k.lower(): v for k, v in self.items()}

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.lower.get(name.lower(), default)


#: Filters that the reader takes, and how each compares a header's value with the filter's.
TESTS = {
    EqualTo: operator.eq,
    In: lambda x, y: x in y,
    StringStartsWith: lambda x, y: x.startswith(y),
    GreaterThan: operator.gt,
    GreaterThanOrEqual: operator.ge,
    LessThan: operator.lt,
    LessThanOrEqual: operator.le,
}


def number(text: str | None) -> int | None:
    """A header's whole number; None for what is none."""
    return int(text) if text and text.isascii() and text.isdigit() else None


def records(raw, wanted, keep_payload: bool) -> Iterator[tuple[dict, bytes | None]]:  # noqa: ANN001
    """Headers and payload of the records that wanted(headers) accepts; the others' blocks are passed over."""
    stream = Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.lstrip(b"\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = Headers((name.strip(), value.strip()) for name, _, value in (line.decode("utf-8", "replace").partition(":") for line in lines[1:]))
        n = int(headers.get("Content-Length") or 0)
        keep = wanted(headers)
        block = stream.take(n, keep and keep_payload)
        stream.take(4, False)
        if keep:
            if keep_payload and (headers.get("WARC-Type") or "").lower() in ("response", "revisit"):
                block = block.partition(b"\r\n\r\n")[2]
            yield headers, block if keep_payload else None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.tests = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of a header with a value, and tests whether there is one; Spark tests the rest."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (*TESTS, IsNull, IsNotNull)) and len(f.attribute) == 1 else None
            if name not in FIELDS:
                yield f
            elif isinstance(f, IsNull | IsNotNull):
                self.tests.append((name, type(f), None))
            else:
                self.tests.append((name, type(f), tuple(f.value) if isinstance(f, In) else f.value))

    def wanted(self, headers: Headers) -> bool:
        """Whether a record passes the filters taken; a header that isn't there passes only the test for null."""
        for name, kind, value in self.tests:
            kind_of, header = FIELDS[name]
            found = headers.get(header) if kind_of == "string" else number(headers.get(header))
            if kind is IsNull or kind is IsNotNull:
                if (found is None) != (kind is IsNull):
                    return False
            elif found is None or not TESTS[kind](found, value):
                return False
        return True

    def partitions(self) -> list[Archive]:
        fs, folder = filesystem(self.path)
        place = posixpath.join(folder, "_files.json")
        if fs.get_file_info(place).is_file:
            with fs.open_input_stream(place) as f:
                return [Archive(posixpath.join(folder, x)) for x in json.loads(f.read())] or [Archive("")]
        from pyarrow.fs import FileSelector

        info = fs.get_file_info(folder)
        found = [info] if info.is_file else fs.get_file_info(FileSelector(folder, recursive=True))
        return [Archive(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.endswith((".warc", ".warc.gz"))] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return  # Spark wants a partition, and there is no file
        fs, _ = filesystem(self.path)
        names = self.schema.fieldNames()
        kinds = {"long": pa.int64(), "string": pa.string()}
        types = [pa.binary() if n == "payload" else pa.string() if n == "headers" else kinds[FIELDS[n][0]] for n in names]
        keep = "payload" in names

        def value(name: str, headers: dict, payload: bytes | None) -> object:
            if name in ("payload", "headers"):
                return payload if name == "payload" else json.dumps(headers, ensure_ascii=False)
            kind, header = FIELDS[name]
            found = headers.get(header)
            return number(found) if kind == "long" else found

        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        with fs.open_input_stream(partition.path, compression=None) as raw:
            for headers, payload in records(raw, self.wanted, keep):
                rows.append([value(n, headers, payload) for n in names])
                size += len(payload or b"")
                if len(rows) >= READ_ROWS or size >= READ_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """spark.read.format("warc").load(path) after spark.dataSource.register(WarcSource). A schema names any of the columns of SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        if unknown := {*schema.fieldNames()} - {*FIELDS, "headers", "payload"}:
            raise ValueError(f"records have no {sorted(unknown)}")
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("maxfilebytes", MAX_FILE_BYTES)), int(self.options.get("level", 1)), overwrite)


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Records of pages(page_id, url, html): of equal payloads of at least so many bytes the one with the largest page_id is the response.

    Which payloads are equal, their SHA-1 tells. Of rows alike in id and payload one is the response; a null id counts as the smallest. Only digests and ids are grouped (combined before the shuffle); a join on the digest then gives each record its
    response. Records of a payload that a large share of all pages has aren't moved for that (`join_split`).
    """
    payload = F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("target_uri"), payload.alias("payload"))
    number = F.coalesce("page_id", F.lit(-(1 << 63)))
    rows = rows.select("*", F.sha1("payload").alias("sha1"))
    each = rows.groupBy("sha1", number.alias("id")).agg(F.count("*").alias("alike"))
    best = each.groupBy("sha1").agg(F.max(F.struct("id", "alike")).alias("first"), F.sum("alike").alias("n")).where("n > 1")
    first = stage(best.select("sha1", F.col("first.id").alias("first_id"), F.col("first.alike").alias("alike"), "n"))
    other = number != F.col("first_id")
    if not first.where("alike > 1").isEmpty():  # rows alike in id and payload: their places tell them apart, in a stored table that reads the same twice
        rows = stage(rows.withColumn("place", F.monotonically_increasing_id()))
        own = rows.groupBy("sha1", number.alias("first_id")).agg(F.max("place").alias("first_place"))
        first = stage(first.join(own, ["sha1", "first_id"]))
        other = other | (F.col("place") != F.col("first_place"))
    joined = join_split(rows, first, "sha1", "n", pages.count(), "left")
    again = F.coalesce(other, F.lit(False)) & (F.octet_length("payload") >= min_revisit_bytes)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(DATE).alias("date"),
        F.concat(F.lit("sha1:"), base32(F.col("sha1"))).alias("payload_digest"),
        F.when(again, urn(F.when(F.col("first_id") > -(1 << 63), F.col("first_id")))).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write(rows: DataFrame, path: str, max_file_bytes: int = MAX_FILE_BYTES) -> None:
    """Write records (any of the columns of SCHEMA) as archives below path."""
    rows.sparkSession.dataSource.register(WarcSource)
    small_batches(rows.sparkSession)
    rows.write.format("warc").mode("append").option("maxfilebytes", str(max_file_bytes)).save(path)


def read(spark, path: str, columns: str = SCHEMA) -> DataFrame:  # noqa: ANN001
    """Records of the archives below path; columns is a schema of those that are wanted. Switches the session's push-down to Python sources on."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(columns).load(path)


def base32(hexadecimal: F.Column) -> F.Column:
    """Base32 of a 160-bit hexadecimal column: five digits make four letters."""
    digits = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for at in range(1, 41, 5):
        number = F.conv(F.substring(hexadecimal, at, 5), 16, 10).cast("int")
        parts += [F.substring(digits, F.shiftright(number, k).bitwiseAND(31) + 1, F.lit(1)) for k in (15, 10, 5, 0)]
    return F.concat(*parts)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write pages(page_id, url, html) as archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    payload_bytes and payload_digest of a response are those of the payload that was read, so a damaged archive shows; a revisit has those
    its headers give. A null html is an empty payload; a null page_id stays null.
    """
    spark, place = pages.sparkSession, path or f"{work_dir(pages.sparkSession)}/warc"
    write(with_revisits(pages, min_revisit_bytes), place)
    found = read(spark, place, "record_id string, record_type string, payload_digest string, refers_to string, payload_length long, payload binary")
    number = lambda c: F.when(F.col(c) != "<urn:page:null>", F.regexp_extract(c, "^<urn:page:(-?\\d+)>$", 1).cast("long"))
    response = F.col("record_type") == "response"
    digest = F.when(response, base32(F.sha1("payload"))).otherwise(F.substring("payload_digest", 6, 32))
    return found.select(number("record_id").alias("page_id"), F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
