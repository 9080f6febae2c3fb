"""WARC archives as a Spark data source, in Python.

Writing: each partition appends records to files of its own in a temporary folder; the commit moves the files of the
successful attempts into place, so a lost task leaves nothing behind. Each record is a gzip member of its own, as is
usual for ``.warc.gz``, and carries the member's length in its gzip header, where other readers ignore it.

Reading: files are dealt to partitions by size. Of a record only the header is unpacked first. Filters on the record
type and other header fields are pushed down; a record that they refuse, or whose payload isn't asked for, is passed
over by its length without unpacking the rest. Members without that length (other writers' archives) are unpacked.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, Not, WriterCommitMessage

from codeloom.llm.scratch import Scratch

#: What a written table must have, and what reading gives (in this order unless another schema is given).
SCHEMA = "record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"
FILE_BYTES = 128 << 20
PART_BYTES = 32 << 20
LEAST_PAYLOAD = 0
_MAGIC = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"  # a gzip member with an extra field
_EXTRA = struct.Struct("<2sHQ")  # subfield id, its length, the member's length
_HEAD = 4096


def member(data: bytes) -> bytes:
    """data as one gzip member that tells its own length."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    length = len(_MAGIC) + 2 + _EXTRA.size + len(body) + 8
    extra = struct.pack("<H", _EXTRA.size) + _EXTRA.pack(b"WL", 8, length)
    return _MAGIC + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, page_id: int | None, url: str | None, refers_to: int | None, size: int, digest: str, payload: bytes | None) -> bytes:
    """One WARC/1.1 record. A response holds an HTTP answer around the payload; a revisit holds only its headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", urllib.parse.quote(url, safe="".join(map(chr, range(0x21, 0x7F))).replace("%", ""))))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    for name, value in (("X-Page-ID", page_id), ("X-Refers-To-Page-ID", refers_to), ("X-Payload-Length", size)):
        if value is not None:
            fields.append((name, str(value)))
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema):
        self.path, self.names = path, [f.name for f in schema.fields]
        self.temporary = f"{path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = _store(self.temporary)
        store.create_dir(folder, recursive=True)
        files: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                    data = member(record(row["record_type"], row["page_id"], row["url"], row["refers_to"], row["payload_bytes"], row["payload_digest"], row["payload"]))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, temporary = _store(self.temporary)
        _, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        for m in messages:
            for f in m.files if m else []:
                store.move(f"{temporary}/{f}", f"{folder}/{f}")
        self.abort([])

    def abort(self, messages: list[_Written | None]) -> None:
        store, temporary = _store(self.temporary)
        if store.get_file_info(temporary).type != pafs.FileType.NotFound:
            store.delete_dir(temporary)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.names = path, [f.name for f in schema.fields]
        self.tests: list = []

    def pushFilters(self, filters: list):
        """Tests of header fields are done while reading; what is left is done by Spark."""
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            known = isinstance(inner, EqualTo | EqualNullSafe | In | IsNull | IsNotNull) and len(inner.attribute) == 1 and inner.attribute[0] in self.names and inner.attribute[0] != "payload"
            if known:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, folder = _store(self.path)
        found = store.get_file_info(pafs.FileSelector(folder, recursive=True))
        files = sorted(((f.size, f.path) for f in found if f.is_file and "/_temporary-" not in f.path and f.path.endswith((".warc", ".warc.gz"))), reverse=True)
        parts, size = [], PART_BYTES
        for n, path in files:
            if size + n > PART_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        types = {"payload": pa.binary()} | dict.fromkeys(("page_id", "refers_to", "payload_bytes"), pa.int64())
        schema = pa.schema([(n, types.get(n, pa.string())) for n in self.names])
        store, _ = _store(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as source:
                for row in _records(source, self.keeps, "payload" in self.names):
                    rows.append(row)
                    held += 300 + len(row.get("payload") or b"")
                    if held > 8 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    def keeps(self, row: dict) -> bool:
        return all(_passes(t, row) for t in self.tests)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _passes(test, row: dict) -> bool:
    if isinstance(test, Not):
        inner = _test(test.child, row)
        return inner is False
    return _test(test, row) is True


def _test(test, row: dict) -> bool | None:
    value = row.get(test.attribute[0])
    if isinstance(test, IsNull):
        return value is None
    if isinstance(test, IsNotNull):
        return value is not None
    if isinstance(test, EqualNullSafe):
        return value == test.value
    if value is None:
        return None
    return value in test.value if isinstance(test, In) else value == test.value


def _fields(head: bytes) -> dict:
    """The columns that a record's header tells."""
    named = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        named[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    number = lambda k: int(named[k]) if k in named else None
    url = named.get("warc-target-uri")
    digest = named.get("warc-payload-digest", "")
    return {
        "record_type": named.get("warc-type"), "page_id": number("x-page-id"), "url": urllib.parse.unquote(url) if url is not None else None, "refers_to": number("x-refers-to-page-id"),
        "payload_bytes": number("x-payload-length"), "payload_digest": digest.partition(":")[2] or None, "_length": number("content-length") or 0,
    }


def _payload(row: dict, block: bytes) -> bytes | None:
    if row["record_type"] == "revisit":
        return None
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def _records(source: pa.NativeFile, keeps, wanted: bool) -> Iterator[dict]:
    size, at = source.size(), 0
    while at < size:
        source.seek(at)
        start = source.read(_HEAD)
        if start[:2] != b"\x1f\x8b":
            at, row = _plain(source, at, size, keeps, wanted)
        elif start[: len(_MAGIC)] == _MAGIC and start[12:14] == b"WL":
            length = _EXTRA.unpack_from(start, 12)[2]
            row = _member(source, at, start, length, keeps, wanted)
            at += length
        else:
            yield from _stream(source, at, keeps, wanted)
            return
        if row is not None:
            yield row


def _member(source: pa.NativeFile, at: int, start: bytes, length: int, keeps, wanted: bool) -> dict | None:
    unpack = zlib.decompressobj(-15)
    body = len(_MAGIC) + 2 + _EXTRA.size
    data, read = unpack.decompress(start[body:length]), min(len(start), length)
    while b"\r\n\r\n" not in data and read < length - 8:
        more = source.read(min(_HEAD, length - read))
        read += len(more)
        data += unpack.decompress(more)
    head, _, rest = data.partition(b"\r\n\r\n")
    row = _fields(head)
    if row["record_type"] == "warcinfo" or not keeps(row):
        return None
    if wanted and row["record_type"] != "revisit":
        if read < length:
            rest += unpack.decompress(source.read(length - read))
        row["payload"] = _payload(row, rest[: row["_length"]])
    return row


def _plain(source: pa.NativeFile, at: int, size: int, keeps, wanted: bool) -> tuple[int, dict | None]:
    """A record that isn't packed, and where the next one begins."""
    source.seek(at)
    data = b""
    while b"\r\n\r\n" not in data and at + len(data) < size:
        data += source.read(_HEAD)
    head = data.partition(b"\r\n\r\n")[0]
    row = _fields(head.lstrip(b"\r\n"))
    begin = at + len(head) + 4
    after = begin + row["_length"] + 4
    if row["record_type"] in (None, "warcinfo") or not keeps(row):
        return after, None
    if wanted and row["record_type"] != "revisit":
        source.seek(begin)
        row["payload"] = _payload(row, source.read(row["_length"]))
    return after, row


def _stream(source: pa.NativeFile, at: int, keeps, wanted: bool) -> Iterator[dict]:
    """Records of a file packed by another writer, from a position on."""
    source.seek(at)
    unpack, data, ended = zlib.decompressobj(31), b"", False

    def more() -> None:
        nonlocal unpack, data, ended
        raw = unpack.unused_data if unpack.eof else b""
        raw = raw or source.read(1 << 16)
        if not raw:
            ended = True
            return
        if unpack.eof:
            unpack = zlib.decompressobj(31)
        data += unpack.decompress(raw)

    while True:
        data = data.lstrip(b"\r\n")
        while b"\r\n\r\n" not in data and not ended:
            more()
        head, found, rest = data.partition(b"\r\n\r\n")
        if not found:
            return
        row, data = _fields(head), rest
        while len(data) < row["_length"] and not ended:
            more()
        block, data = data[: row["_length"]], data[row["_length"] :]
        if row["record_type"] not in (None, "warcinfo") and keeps(row):
            if wanted:
                row["payload"] = _payload(row, block)
            yield row


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _base32(sha1_hex: Column) -> Column:
    """The upper-case base32 of 40 hex digits: five digits are four letters."""
    letters = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.conv(F.substring(sha1_hex, i * 5 + 1, F.lit(5)), 16, 32), 4, "0"))
    return F.translate(F.array_join(letters, ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archive_records(pages: DataFrame, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """The record for each row of ``pages`` (page_id, url, html), in the columns of ``SCHEMA``.

    Of rows with equal payloads of at least ``least_payload`` bytes, those with the smallest page_id are responses
    and the others revisits that refer to it and carry no payload; smaller payloads are all responses. A null html is
    an empty payload. A null page_id is larger than any; if no row of a payload has an id, all are responses.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"), F.sha1(body).alias("_sha"), F.octet_length(body).cast("long").alias("payload_bytes"))
    # only digests are aggregated, and only those that stand more than once go into the join
    first = told.select("page_id", "_sha", "payload_bytes").groupBy("_sha", "payload_bytes").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    shared = first.where((F.col("_n") > 1) & F.col("_first").isNotNull() & (F.col("payload_bytes") >= least_payload)).select("_sha", "_first")
    met = told.join(shared, "_sha", "left")
    again = F.coalesce(F.col("page_id") != F.col("_first"), F.col("_first").isNotNull())
    return met.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), "page_id", "url", F.when(again, F.col("_first")).alias("refers_to"),
        "payload_bytes", _base32(F.col("_sha")).alias("payload_digest"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    archive_records(pages).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """The records of all archives under a path; payloads are unpacked only if ``columns`` has payload."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives, reads them back: responses with their payload, whose size and digest are told anew, revisits by header."""
    scratch = Scratch(spark, "warc")
    path = f"{scratch.root}/archives"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    full = read_archives(spark, path, "record_type string, page_id long, payload binary").where("record_type = 'response'")
    full = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), _base32(F.sha1("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read_archives(spark, path, "record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string").where("record_type = 'revisit'")
    return scratch.keep(full.unionByName(again))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to FROM b
"""
