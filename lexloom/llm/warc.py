"""WARC archives as a Spark data source, written in Python.

Reading plans one partition for each group of files, takes record-type and header predicates from Spark's filters, reads
a record's headers first and decodes its payload only if the record is wanted. Compressed archives hold one gzip member
per record; members that this module writes carry their compressed length in the extra field that the WARC standard
gives for it, so that an unwanted record is skipped without inflating more than its headers.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import local_path, saved

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Columns that headers alone decide.
HEADER_COLUMNS = frozenset(("record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest"))
#: Bytes of files that one reading task takes, and after which a writing task starts another file.
FILE_BYTES = 64 << 20
#: Rows and payload bytes that a reading task hands to Spark at once.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
MANIFEST = "_files"
#: Repeated digests (some hundred bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_CHUNK, _FED = 1 << 16, 1 << 11


class Store:
    """Files of a folder: this machine's or a shared mount's directly, other stores through pyarrow."""

    def __init__(self, uri: str):
        self.fs = None
        if (path := local_path(uri)) is None:
            from pyarrow import fs

            self.fs, path = fs.FileSystem.from_uri(uri)
        self.root = path.rstrip("/")

    def files(self) -> list[tuple[str, int]]:
        """Archives: those of the manifest where there is one, else by their names."""
        if self.fs is None:
            found = [(self.root, os.path.getsize(self.root))] if os.path.isfile(self.root) else [(e.path, e.stat().st_size) for e in os.scandir(self.root) if e.is_file()]
        else:
            from pyarrow import fs

            info = self.fs.get_file_info(self.root)
            every = [info] if info.type == fs.FileType.File else self.fs.get_file_info(fs.FileSelector(self.root))
            found = [(i.path, i.size) for i in every if i.type == fs.FileType.File]
        if any(os.path.basename(p).startswith(MANIFEST) for p, _ in found):
            named = {n for p, _ in found if os.path.basename(p).startswith(MANIFEST) for n in self.open(p).read().decode().split()}
            return sorted((p, n) for p, n in found if os.path.basename(p) in named)
        return sorted((p, n) for p, n in found if re.search(r"\.warc(\.gz)?$", p))

    def open(self, path: str):
        return open(path, "rb") if self.fs is None else self.fs.open_input_file(path)

    def create(self, name: str):
        if self.fs is None:
            os.makedirs(self.root, exist_ok=True)
            return open(f"{self.root}/{name}", "wb")
        self.fs.create_dir(self.root)
        return self.fs.open_output_stream(f"{self.root}/{name}")

    def remove(self, name: str) -> None:
        if self.fs is None:
            os.path.exists(f"{self.root}/{name}") and os.remove(f"{self.root}/{name}")
        else:
            self.fs.delete_file(f"{self.root}/{name}")


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Head:
    """A record's headers; names are matched without regard to case, and lines that aren't headers are passed over."""

    def __init__(self, raw: bytes):
        lines = raw.decode("utf-8", "replace").split("\r\n")
        self.fields = {k.strip().lower(): v.strip() for k, sep, v in (line.partition(":") for line in lines[1:]) if sep}

    @property
    def length(self) -> int:
        return int(self.fields.get("content-length") or 0)

    def columns(self) -> dict:
        get = self.fields.get
        digest = get("warc-payload-digest")
        return {
            "record_id": bare(get("warc-record-id")),
            "record_type": get("warc-type"),
            "target_uri": bare(get("warc-target-uri")),
            "date": get("warc-date"),
            "refers_to": bare(get("warc-refers-to")),
            "payload_digest": hexadecimal(digest) if digest else None,
        }


def bare(uri: str | None) -> str | None:
    return uri[1:-1] if uri and uri[0] == "<" and uri[-1] == ">" else uri


def hexadecimal(digest: str) -> str:
    """A digest header's value as lower-case hex; Base32 is what the standard's examples have."""
    value = digest.rpartition(":")[2]
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


class Inflated:
    """One gzip member at a time as a stream that is inflated only as far as it is read, in time linear in what is read."""

    def __init__(self, f):
        self.f, self.raw = f, b""
        self.base, self.next = f.tell(), 0  # where raw begins in the file, and how much of raw is used

    def more(self) -> bool:
        got = self.f.read(_CHUNK)
        self.base += self.next
        self.raw, self.next = self.raw[self.next :] + got, 0
        return bool(got)

    def open_member(self) -> bool:
        """Goes to the next member; False at the end. Takes the length of the whole member if its extra field has it."""
        while len(self.raw) < self.next + 24 and self.more():
            pass
        head = self.raw[self.next : self.next + 24]
        if not head.strip(b"\0"):
            return False
        self.whole = None
        if len(head) == 24 and head[:2] == b"\x1f\x8b" and head[3] & 4 and head[12:14] == b"sl" and head[14:16] == b"\x08\0":
            self.whole = struct.unpack("<I", head[16:20])[0]
        self.start, self.z, self.out = self.base + self.next, zlib.decompressobj(31), b""
        return True

    def read(self, n: int) -> bytes:
        parts, have = [self.out], len(self.out)
        while have < n and not self.z.eof:
            fed = self.z.unconsumed_tail
            if not fed:
                if self.next >= len(self.raw) and not self.more():
                    break
                fed = self.raw[self.next : self.next + (_FED if n - have <= _CHUNK else _CHUNK)]
                self.next += len(fed)
            got = self.z.decompress(fed, max(_CHUNK, n - have))
            parts.append(got)
            have += len(got)
            if self.z.eof:
                self.next -= len(self.z.unused_data)
        whole = b"".join(parts)
        got, self.out = whole[:n], whole[n:]
        return got

    def head(self) -> bytes:
        raw = self.read(2048)
        while (end := raw.find(b"\r\n\r\n")) < 0 and (more := self.read(_CHUNK)):
            raw += more
        if end < 0:
            raise ValueError("a WARC record without an end of its headers")
        self.out = raw[end + 4 :] + self.out
        return raw[:end].lstrip(b"\r\n")

    def skip_member(self) -> None:
        if not self.whole:
            while not self.z.eof and self.read(_CHUNK):
                pass
            return
        self.next = self.start + self.whole - self.base
        if self.next > len(self.raw):
            self.base, self.raw, self.next = self.f.seek(self.start + self.whole), b"", 0


def records(f, compressed: bool, wanted) -> Iterator[tuple[Head, bytes | None]]:
    """Each record's head, and its block if wanted(head), else None without reading it."""
    if compressed:
        stream = Inflated(f)
        while stream.open_member():
            head = Head(stream.head())
            block = stream.read(head.length) if wanted(head) else None
            yield head, block
            stream.skip_member()
        return
    f = f if isinstance(f, io.BufferedIOBase) else io.BufferedReader(f)
    while True:
        lines = []
        while (line := f.readline()) and (line.strip() or not lines):
            if line.strip():
                lines.append(line.rstrip(b"\r\n"))
        if not lines:
            return
        head = Head(b"\r\n".join(lines))
        if wanted(head):
            yield head, f.read(head.length)
        else:
            f.seek(head.length, io.SEEK_CUR)
            yield head, None


def payload_of(head: Head, block: bytes) -> bytes:
    """Without the HTTP head where the block has one."""
    if "msgtype=response" in head.fields.get("content-type", "") and (end := block.find(b"\r\n\r\n")) >= 0:
        return block[end + 4 :]
    return block


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "true") != "false"
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Keeps predicates on header columns; the rest, which need the payload, go back to Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADER_COLUMNS and isinstance(f, (EqualTo, EqualNullSafe)):
                self.filters.append((column, "in", (f.value,)))
            elif column in HEADER_COLUMNS and isinstance(f, In):
                self.filters.append((column, "in", tuple(f.value)))
            elif column in HEADER_COLUMNS and isinstance(f, StringStartsWith):
                self.filters.append((column, "prefix", f.value))
            elif column in HEADER_COLUMNS and isinstance(f, IsNotNull):
                self.filters.append((column, "known", None))
            else:
                yield f

    def passes(self, row: dict) -> bool:
        for column, kind, value in self.filters:
            own = row[column]
            if own is None and not (kind == "in" and None in value):
                return False
            if kind == "in" and own not in value or kind == "prefix" and not own.startswith(value):
                return False
        return True

    def partitions(self):
        groups: list[list[str]] = []
        size = FILE_BYTES
        for path, n in Store(self.path).files():
            if size + n > FILE_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition):
        schema = pa.schema([pa.field(n, pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string()) for n in (c.split()[0] for c in SCHEMA.split(", "))])
        store, rows, held = Store(self.path), [], 0
        for path in partition.paths:
            with store.open(path) as f:
                passed = {}

                def wanted(head, passed=passed):
                    passed["row"] = row = head.columns()
                    passed["kept"] = self.passes(row)
                    return self.payload and passed["kept"]

                for head, block in records(f, path.endswith(".gz"), wanted):
                    if not passed["kept"]:
                        continue
                    row = passed["row"]
                    row["payload"] = None if block is None else payload_of(head, block)
                    stated = head.fields.get("x-payload-length")
                    row["payload_bytes"] = int(stated) if stated else None if block is None else len(row["payload"])
                    rows.append(row)
                    held += len(block or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Writer(DataSourceArrowWriter):
    """Writes the columns of SCHEMA; payload_digest and payload_bytes are worked out where they are null.

    Each task writes files of its own name; only those of tasks that the driver commits are named in the manifest, so
    tasks that ran twice or failed leave no record behind.
    """

    def __init__(self, options, schema: StructType):
        self.path, self.names = options["path"], set(schema.names)
        self.compressed = options.get("compression", "gzip") == "gzip"
        if missing := {"record_type", "payload"} - self.names:
            raise ValueError(f"columns are missing: {sorted(missing)}")

    def write(self, iterator) -> WriterCommitMessage:
        store, names, f, size = Store(self.path), [], None, 0
        for row in (row for batch in iterator for i in range(0, batch.num_rows, 64) for row in batch.slice(i, 64).to_pylist()):
            if f is None or size >= FILE_BYTES:
                if f:
                    f.close()
                names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compressed)
                f, size = store.create(names[-1]), 0
            raw = record(row)
            raw = member(raw) if self.compressed else raw
            f.write(raw)
            size += len(raw)
        if f:
            f.close()
        return Written(names)

    def commit(self, messages) -> None:
        with Store(self.path).create(f"{MANIFEST}-{uuid.uuid4().hex}") as f:
            f.write("\n".join(n for m in messages if m for n in m.names).encode())

    def abort(self, messages) -> None:
        store = Store(self.path)
        for m in messages:
            for name in m.names if m else ():
                store.remove(name)


def record(row: dict) -> bytes:
    payload, kind = row["payload"] or b"", row["record_type"] or "resource"
    http = kind in ("response", "revisit")
    digest = row.get("payload_digest") or hashlib.sha1(payload).hexdigest()
    size = row.get("payload_bytes")
    size = len(payload) if size is None else size
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() if http else b"") + (b"" if kind == "revisit" else payload)
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{row.get('record_id') or uuid.uuid4().urn}>",
        "WARC-Date": row.get("date") or "1970-01-01T00:00:00Z",
        "WARC-Target-URI": row.get("target_uri"),
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None,
        "WARC-Refers-To": f"<{row['refers_to']}>" if row.get("refers_to") else None,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "X-Payload-Length": size,
        "Content-Type": "application/http;msgtype=response" if http else "application/octet-stream",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {one_line(v)}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def one_line(value) -> str:
    return " ".join(str(value).splitlines()) if isinstance(value, str) else str(value)


def member(raw: bytes) -> bytes:
    """A gzip member whose extra field `sl` has its compressed and uncompressed length."""
    z = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, whole & 0xFFFFFFFF if whole < 1 << 32 else 0, len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class Warc(DataSource):
    """Options: path (a file or folder); payload=false to read headers only; compression=gzip or none to write."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return Writer(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


PREFIX = "urn:page:"


def archive(pages: DataFrame, path: str, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for each row to path, the html in UTF-8 as payload (null: empty).

    Of records with equal payloads of at least `least` bytes, that with the largest id is a response and the others are
    revisits of it; rows that share that id are all responses, and so is every record without an id where no equal one
    has an id. Smaller ones are all responses.
    """
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("target_uri"), F.coalesce(pages[html_col], F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    kept = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    kept = saved(kept, "repeated")  # digests only: broadcast where they are few, so that payloads needn't be shuffled
    rows = rows.join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("keeper").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper")))
    rows = rows.select(
        F.concat(F.lit(PREFIX), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisit, F.concat(F.lit(PREFIX), F.col("keeper").cast("string"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    register(pages.sparkSession)
    rows.write.format("warc").mode("append").save(path)


def archived(spark: SparkSession, path: str) -> DataFrame:
    """Of each archived page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are measured by the payload that is read back. Revisits, which hold none, are read without payloads.
    """
    register(spark)

    def page(column: str):
        return F.regexp_extract(column, f"^{PREFIX}(-?[0-9]+)$", 1)

    def number(column: str):
        return F.when(page(column) != "", page(column).cast("long"))

    responses = spark.read.format("warc").load(path).where("record_type = 'response'")
    revisits = spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'revisit'")
    columns = [F.col("record_type"), number("refers_to").alias("refers_to")]
    return responses.select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), *columns).unionByName(
        revisits.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", *columns)
    )
