"""WARC archives as a Spark data source, written and read by executors.

A file is a series of gzip members, one per record. Each member's header carries its own length (an
extra field, which other readers skip), so a reader inflates a record's headers, judges them by the
filters that were pushed down, and steps over the rest of an unwanted record without inflating it.
Files without that field, and plain ``.warc`` files, are read too.

Paths may be of any file system that pyarrow opens by URI. Tasks write under names of their own
below ``_temporary``; files of the attempts that count are moved into place at commit, many at once.
Files are read through a buffer, so the small reads of headers are few requests. A file is never
split: archives of about a gigabyte, as is usual, make even partitions.

Defined results
    null html: an empty payload; null url: no target URI; a null page_id is written as such and
    never referred to; page rows that repeat are records of their own, those with the largest
    page_id of equal payloads all responses; an empty table gives no records; line breaks and other
    control characters in a URL are percent-encoded; payloads are whole; other columns of the pages, also of
    clashing names, are ignored. A foreign record without a
    Content-Length ends where its gzip member does or, uncompressed, where the next record begins.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .shared import lean, scratch, staged

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, headers map<string,string>, payload binary"
#: Columns that are headers, and so can be judged before a payload is read.
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
_ARROW = pa.schema([(c, pa.string()) for c in HEADERS] + [("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
_EXTRA = b"WL"


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: Sequence[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field holds the member's length."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    extra = _EXTRA + struct.pack("<HQ", 8, 12 + 12 + len(body) + 8)
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


# --- reading ---------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class _Member:
    """The bytes of one gzip member, inflated as far as asked for."""

    def __init__(self, file, chunk: int = 1 << 14):
        self.file, self.chunk, self.at = file, chunk, file.tell()
        self.inflate = zlib.decompressobj(31)
        self.out, self.taken = bytearray(), 0

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.file.read(self.chunk)
        if not data:
            raise EOFError("a record is cut short")
        self.taken += len(data)
        self.out += self.inflate.decompress(data)
        return True

    def length(self) -> int | None:
        self.file.seek(self.at)
        head = self.file.read(24)
        self.file.seek(self.at + self.taken)
        if len(head) == 24 and head[3] & 4 and head[12:14] == _EXTRA:
            return struct.unpack("<Q", head[16:24])[0]
        return None

    def rest(self) -> bytes:
        while self.more():
            pass
        self.file.seek(self.at + self.taken - len(self.inflate.unused_data))
        return bytes(self.out)

    def skip(self) -> None:
        n = self.length()
        if n is None:
            self.rest()
        else:
            self.file.seek(self.at + n)


def _parsed(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if colon:
            found[k.strip().lower()] = v.strip()
    return found


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """Without the HTTP head where the block is an HTTP message."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _length(headers: dict[str, str]) -> int | None:
    n = headers.get("content-length", "")
    return int(n) if n.isascii() and n.isdigit() else None


def _up_to_next(file, at: int) -> bytes:
    """What stands before the next uncompressed record."""
    file.seek(at)
    found = bytearray()
    while (cut := found.find(b"\r\n\r\nWARC/")) < 0 and (more := file.read(1 << 12)):
        found += more
    return bytes(found[:cut] if cut >= 0 else found).rstrip(b"\r\n")


def records(file, size: int, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and payload of each record that ``wanted(headers)`` accepts."""
    while file.tell() < size:
        at = file.tell()
        zipped = file.read(2) == b"\x1f\x8b"
        file.seek(at)
        if zipped:
            part = _Member(file)
            while (cut := part.out.find(b"\r\n\r\n")) < 0 and part.more():
                pass
            headers = _parsed(bytes(part.out[:cut]))
            if wanted(headers) and payloads:
                block = part.rest()[cut + 4 :]
                n = _length(headers)
                yield headers, _payload(headers, block.removesuffix(b"\r\n\r\n") if n is None else block[:n])
            else:
                part.skip()
                if wanted(headers):
                    yield headers, None
        else:
            head = bytearray()
            while (cut := head.find(b"\r\n\r\n")) < 0:
                if not (more := file.read(1 << 12)):
                    return
                head += more
            headers = _parsed(bytes(head[:cut]).lstrip(b"\r\n"))
            n, begin = _length(headers), at + cut + 4
            block = None
            if n is None:
                block = _up_to_next(file, begin)
                n = len(block)
            elif wanted(headers) and payloads:
                file.seek(begin)
                block = file.read(n)
            if wanted(headers):
                yield headers, _payload(headers, block) if payloads else None
            file.seek(begin + n)
            while file.tell() < size and file.read(1) in (b"\r", b"\n"):
                pass
            if file.tell() < size:
                file.seek(file.tell() - 1)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.bytes = int(options.get("partitionbytes", 64 << 20))
        self.rows, self.filled = int(options.get("batchrows", 256)), int(options.get("batchbytes", 8 << 20))
        self.buffer = int(options.get("bufferbytes", 1 << 18))
        self.accepted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership on header columns are applied here; the rest goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.accepted.append((HEADERS[name], frozenset([f.value])))
            elif name in HEADERS and isinstance(f, In):
                self.accepted.append((HEADERS[name], frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Whole files, small ones together up to ``partitionBytes``."""
        fs, path = _opened(self.path)
        infos = [i for i in fs.get_file_info(pafs.FileSelector(path, recursive=False)) if i.is_file and i.base_name.endswith((".warc", ".warc.gz"))]
        groups: list[list[str]] = []
        room = 0
        for i in sorted(infos, key=lambda i: i.path):
            if not groups or i.size > room:
                groups.append([])
                room = self.bytes
            groups[-1].append(i.path)
            room -= i.size
        return [Files(tuple(g)) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        wanted = lambda h: all(h.get(k) in values for k, values in self.accepted)
        rows, filled = [], 0
        for path in partition.paths if partition else ():
            with fs.open_input_file(path) as raw:
                for headers, payload in records(io.BufferedReader(raw, self.buffer), raw.size(), wanted, self.payloads):
                    rows.append([*(headers.get(k) for k in HEADERS.values()), list(headers.items()), payload])
                    filled += len(payload or b"")
                    if len(rows) >= self.rows or filled >= self.filled:
                        yield self._batch(rows)
                        rows, filled = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


# --- writing ---------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Rows of ``page_id, url, payload, digest, refers_to`` to records; a row that refers to a page is a revisit."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.level, self.most = int(options.get("level", 3)), int(options.get("filebytes", 1 << 30))
        self.job = uuid.uuid4().hex

    def _record(self, page_id, url, payload: bytes, refers_to) -> bytes:
        digest = digest_of(payload)
        headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:x-page:{page_id}>"), ("WARC-Date", self.date), ("WARC-Payload-Digest", f"sha1:{digest}")]
        if url is not None:
            headers.append(("WARC-Target-URI", "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url)))
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        headers.append(("Content-Type", "application/http; msgtype=response"))
        if refers_to is None:
            return record(headers, http + payload)
        headers += [("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Payload-Length", str(len(payload)))]
        return record(headers, http)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = _opened(self.path)
        folder = posixpath.join(path, "_temporary", self.job)
        fs.create_dir(folder, recursive=True)
        names, file = [], None
        try:
            for batch in iterator:
                for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    if file is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        file = fs.open_output_stream(posixpath.join(folder, names[-1]), compression=None)
                    file.write(member(self._record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()), self.level))
                    if file.tell() >= self.most:
                        file.close()
                        file = None
        finally:
            if file is not None:
                file.close()
        return Written(tuple(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = _opened(self.path)
        names = [name for m in messages if m for name in m.files]
        with ThreadPoolExecutor(32) as movers:
            list(movers.map(lambda name: fs.move(posixpath.join(path, "_temporary", self.job, name), posixpath.join(path, name)), names))
        self._clear(fs, path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, fs: pafs.FileSystem, path: str) -> None:
        folder = posixpath.join(path, "_temporary", self.job)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``; options: path, payloads (false: never decoded), partitionBytes, batchRows, batchBytes, bufferBytes; to write: date, level, fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool):
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# --- jobs ------------------------------------------------------------------


def deduplicated(pages: DataFrame, least_bytes: int = 0, most_broadcast: int = 1_000_000) -> DataFrame:
    """``page_id, url, payload, refers_to``: the page to refer to, null for a response.

    Digests that occur twice or more are counted on narrow rows and written out. If they are at most
    ``most_broadcast`` (under 100 MB in a task) they go to every task and no payload is moved; more
    are joined by a shuffle, in which a digest of very many pages is split as a skewed one.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    again = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    again = staged(again.filter("n > 1").select("digest", "keeper"), "repeated-payloads", narrow=True)
    again = F.broadcast(again) if again.count() <= most_broadcast else again.hint("merge")
    refers = F.when((F.octet_length("payload") >= least_bytes) & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return rows.join(again, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    register(pages.sparkSession)
    deduplicated(lean(pages), least_bytes).write.format("warc").mode("append").save(path)


def _page(col: str):
    return F.col(col).substr(F.lit(13), F.length(col) - 13).try_cast("long")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``: of responses measured on the payloads read, of revisits from their headers."""
    register(spark)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column("payload").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([len(p) for p in payloads], pa.int64()), pa.array([digest_of(p) for p in payloads], pa.string())], names=["page_id", "payload_bytes", "payload_digest"])

    full = spark.read.format("warc").load(path).filter("record_type = 'response'").select(_page("record_id").alias("page_id"), "payload")
    full = full.mapInArrow(measure, "page_id long, payload_bytes long, payload_digest string").select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = spark.read.format("warc").option("payloads", "false").load(path).filter("record_type = 'revisit'")
    again = again.select(
        _page("record_id").alias("page_id"), F.col("headers")["x-payload-length"].cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type", _page("refers_to").alias("refers_to"),
    )
    return full.unionByName(again)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_pages(pages, path, least_bytes)
    return read_pages(spark, path)
