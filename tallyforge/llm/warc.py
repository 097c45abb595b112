"""WARC archives as a Python data source of Spark: ``format("warc")`` reads and writes them, with filters pushed down.

Reading. ``partitions`` plans tasks over files, small ones together. A task reads a record's header first; filters on
record type, target, date, ids, digest or any other header (pushed down by Spark) decide there. The payload of an unwanted
record, and of every record where the schema has no column ``payload``, is passed over: plain files by Content-Length,
gzip members by the length they carry in their own header (extra field ``sl``), so nothing after the header is inflated.
Foreign members without that field are inflated and thrown away. Files are read in blocks, never whole.

Writing. A task writes gzip files of one member a record, begins a new one after ``max_file_bytes``, and hands their names
to the commit, which writes one manifest; readers of a folder with manifests see files named there alone, so attempts that
were lost or ran twice leave nothing to see.

Columns. ``SCHEMA`` below by default. A schema given with ``.schema(...)`` chooses among those; any other column, of strings or
whole numbers, is the header of that name with dashes (``x_page_id``: X-Page-Id), in both directions.

``archive_pages`` writes one record per page. Of the pages with one payload of at least ``LEAST_BYTES`` bytes, that of the
smallest id is a response with its HTTP header, the others are revisits that refer to it and have no payload. Ids find
their group by a join on the digest, salted ``SALTS`` times: a payload that a third of all pages have is not one task.

Defined cases. Null html: empty payload. Null url: no target. Null page_id: no original for pages that have an id; where no
page of a group has one, all are responses. Repeated rows with the smallest id: all are responses. Line ends and controls in a
header's value are percent-encoded. Very long payloads are one cell of one batch; batches are cut by bytes. An empty table
gives an archive without records. Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.llm.common import shared_path

LEAST_BYTES = 100
SALTS = 16
#: Bytes of a block that a reader holds, of input that a task gets, of a written file, of an Arrow batch.
BLOCK = 1 << 20
TASK_BYTES = 128 << 20
FILE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
SCHEMA = (
    "file string, offset long, record_type string, record_id string, target_uri string, date string, content_type string, content_length long, "
    "payload_digest string, refers_to string, headers map<string,string>, payload binary"
)
#: Columns that are headers under another name.
NAMES = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
HTTP = "application/http; msgtype=response"
MANIFEST = "_committed-"


# ---------------------------------------------------------------------------------------------------------------------
# Files


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; ``file:/x``, ``file:///x`` and plain paths are local."""
    path = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path))
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def archive_files(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a folder's committed archives, of all its archives where it has no manifest, or of one file."""
    fs, root = located(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(root, info.size)]
    found = {f.path: f.size for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File}
    manifests = [f for f in found if f.rsplit("/", 1)[-1].startswith(MANIFEST)]
    if manifests:
        names = [n for m in manifests for n in json.loads(fs.open_input_stream(m).read())]
        return sorted((f"{root}/{n}", found[f"{root}/{n}"]) for n in names)
    return sorted((f, n) for f, n in found.items() if re.search(r"\.warc(\.gz)?$", f))


class Window:
    """Bytes of a file from any place on, read ahead by blocks and let go as the place moves."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.start, self.held = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at``; fewer at the end of the file alone."""
        if not (self.start <= at and at + n <= self.start + len(self.held)):
            self.held = self.file.read_at(max(n, min(BLOCK, self.size - at)), at) if at < self.size else b""
            self.start = at
        return self.held[at - self.start : at - self.start + n]


# ---------------------------------------------------------------------------------------------------------------------
# Records


class Member:
    """One record's bytes in order, plain or from a gzip member."""

    def __init__(self, window: Window, at: int):
        self.window, self.at, self.length = window, at, None
        head = window.get(at, 24)
        self.zip = head[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.zip else None
        self.ready, self.next = b"", at
        if self.zip and len(head) >= 24 and head[3] & 4 and head[10:16] == b"\x0c\x00sl\x08\x00":
            self.length = struct.unpack("<I", head[16:20])[0] or None

    def more(self, n: int) -> bytes:
        """The next bytes, about ``n`` of them; none at the end."""
        if not self.zip:
            out = self.window.get(self.next, n)
            self.next += len(out)
            return out
        while not self.inflate.eof:
            fresh = self.inflate.unconsumed_tail
            if not fresh:
                most = self.length - (self.next - self.at) if self.length else self.window.size - self.next
                fresh = self.window.get(self.next, min(n if n < BLOCK else BLOCK, most))
                self.next += len(fresh)
                if not fresh:
                    raise EOFError(f"a gzip member is cut off at {self.at}")
            out = self.inflate.decompress(fresh, n)
            if out:
                return out
        return b""

    def upto(self, mark: bytes, most: int = 1 << 24) -> bytes | None:
        """The bytes up to and with ``mark``; None where there are no bytes at all."""
        buf, seen = self.ready, 0
        while (i := buf.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(buf)
            fresh = self.more(1024)
            if not fresh:
                if buf.strip(b"\r\n"):
                    raise ValueError(f"a record's header is cut off at {self.at}")
                return None
            buf += fresh
            if len(buf) > most:
                raise ValueError(f"no end of a record's header at {self.at}")
        self.ready = buf[i + len(mark) :]
        return buf[: i + len(mark)]

    def take(self, n: int) -> bytes:
        parts, have = [self.ready[:n]], min(n, len(self.ready))
        self.ready = self.ready[n:]
        while have < n:
            fresh = self.more(max(1024, n - have))
            if not fresh:
                raise EOFError(f"a record's block is cut off at {self.at}")
            parts.append(fresh[: n - have])
            self.ready = fresh[n - have :]
            have += len(parts[-1])
        return b"".join(parts)

    def end(self, block: int) -> int:
        """Where the next record begins, with ``block`` bytes of this one's block not taken."""
        if not self.zip:
            at = self.next - len(self.ready) + block
            while self.window.get(at, 1) in (b"\r", b"\n"):
                at += 1
            return at
        if self.length:
            return self.at + self.length
        while self.more(BLOCK):
            pass
        return self.next - len(self.inflate.unused_data)


def parsed(head: bytes) -> dict[str, str]:
    """Headers under their names as written; a line that begins with white space goes on with the one before."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip()] = value.strip()
    return out


def records(fs: pafs.FileSystem, path: str, wanted: Callable[[Callable], bool], payload: bool) -> Iterator[tuple[int, dict, dict, bytes | None]]:
    """(offset, headers, headers by lower-case name, payload) of the wanted records of a file."""
    window, at = Window(fs, path), 0
    while at < window.size:
        member = Member(window, at)
        head = member.upto(b"\r\n\r\n")
        if head is None:
            at = member.end(0)
            continue
        headers = parsed(head.lstrip(b"\r\n"))
        low = {k.lower(): v for k, v in headers.items()}
        left, body = int(low.get("content-length", 0)), None
        if wanted(low.get):
            if payload:
                body, left = member.take(left), 0
                if low.get("content-type", "").startswith("application/http"):
                    body = body.partition(b"\r\n\r\n")[2]
            yield at, headers, low, body
        at = member.end(left)


def clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]|^ | $", lambda m: f"%{ord(m[0]):02X}", value)


def member(headers: Iterable[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member that tells its own length in the extra field ``sl``."""
    raw = b"".join([b"WARC/1.1\r\n", *[f"{k}: {clean(v)}\r\n".encode("utf-8", "replace") for k, v in headers], b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"])
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 12 + 12 + len(body) + 8
    told = (size, len(raw)) if max(size, len(raw)) < 1 << 32 else (0, 0)
    return struct.pack("<4BIBBH2sHII", 31, 139, 8, 4, 0, 0, 255, 12, b"sl", 8, *told) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


# ---------------------------------------------------------------------------------------------------------------------
# The data source


@dataclass
class Files(ds.InputPartition):
    files: list[str]


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[str]


#: Filters that can be decided on a header: a test of its value (never null) and the filter's.
TESTS = {
    ds.EqualTo: lambda x, v: x == v, ds.EqualNullSafe: lambda x, v: x == v, ds.In: lambda x, v: x in v,
    ds.GreaterThan: lambda x, v: x > v, ds.GreaterThanOrEqual: lambda x, v: x >= v, ds.LessThan: lambda x, v: x < v, ds.LessThanOrEqual: lambda x, v: x <= v,
    ds.StringStartsWith: lambda x, v: x.startswith(v), ds.StringEndsWith: lambda x, v: x.endswith(v), ds.StringContains: lambda x, v: v in x,
}


def header_of(column: str) -> str:
    return NAMES.get(column, column.replace("_", "-")).lower()


def value_of(low: Callable, column: str, numbers: frozenset):
    """A header as the column shows it: ids without their angle brackets, numbers where the schema has them."""
    value = low(header_of(column))
    if value is None:
        return None
    if column in numbers:
        return int(value)
    return value[1:-1] if column in ("record_id", "refers_to", "target_uri") and value.startswith("<") and value.endswith(">") else value


def decides(f: ds.Filter, value) -> bool | None:
    """What a filter says of a value, by SQL's rules for null."""
    if isinstance(f, ds.Not):
        inner = decides(f.child, value)
        return None if inner is None else not inner
    if isinstance(f, ds.IsNull | ds.IsNotNull):
        return (value is None) == isinstance(f, ds.IsNull)
    given = getattr(f, "value", None)
    if value is None or given is None:
        return value is None and given is None if isinstance(f, ds.EqualNullSafe) else None
    return TESTS[type(f)](value, given)


class WarcReader(ds.DataSourceReader):
    def __init__(self, path: str, schema: StructType, task_bytes: int):
        self.path, self.schema, self.task_bytes = path, schema, task_bytes
        self.filters: list[tuple[str, ds.Filter]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            bare = f.child if isinstance(f, ds.Not) else f
            column = getattr(bare, "attribute", ("",))
            # strings compare by code point here and by UTF-8 bytes in Spark, which is the same order
            if len(column) == 1 and column[0] not in ("file", "offset", "headers", "payload", "") and (type(bare) in TESTS or isinstance(bare, ds.IsNull | ds.IsNotNull)):
                self.filters.append((column[0], f))
            else:
                yield f

    def partitions(self) -> list[ds.InputPartition]:
        tasks, size = [[]], 0
        for name, n in archive_files(self.path):
            if tasks[-1] and size + n > self.task_bytes:
                tasks, size = [*tasks, []], 0
            tasks[-1].append(name)
            size += n
        return [Files(t) for t in tasks]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, _ = located(self.path)
        schema = to_arrow_schema(self.schema)
        names = schema.names
        numbers = frozenset(f.name for f in schema if pa.types.is_integer(f.type))
        wanted = lambda low: all(decides(f, value_of(low, c, numbers)) for c, f in self.filters)
        special = {"file", "offset", "headers", "payload"}
        for path in partition.files:
            columns, size = {n: [] for n in names}, 0
            for at, headers, low, body in records(fs, path, wanted, "payload" in names):
                for n in names:
                    columns[n].append({"file": path, "offset": at, "headers": list(headers.items()), "payload": body}[n] if n in special else value_of(low.get, n, numbers))
                size += len(body or b"") + 256
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
                    columns, size = {n: [] for n in names}, 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


class WarcWriter(ds.DataSourceArrowWriter):
    """Columns as in ``SCHEMA``; record_type and payload are needed, others become headers where they are not null."""

    def __init__(self, path: str, overwrite: bool, file_bytes: int):
        self.path, self.overwrite, self.file_bytes = path, overwrite, file_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = located(self.path)
        fs.create_dir(root, recursive=True)
        done, out, size = [], None, 0
        try:
            for batch in batches:
                names = [n for n in batch.schema.names if n not in ("payload", "headers", "file", "offset", "content_length")]
                for i in range(batch.num_rows):
                    if out is None or size > self.file_bytes:
                        if out is not None:
                            out.close()
                        done.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/{done[-1]}", compression=None), 0
                    record = self.record({n: batch.column(n)[i].as_py() for n in names}, batch.column("payload")[i].as_py())
                    out.write(record)
                    size += len(record)
        finally:
            if out is not None:
                out.close()
        return Written(done)

    @staticmethod
    def record(values: dict[str, str | None], payload: bytes | None) -> bytes:
        block = payload or b""
        headers = []
        for n, v in values.items():
            if v is not None:
                name = NAMES.get(n) or "-".join(x.capitalize() for x in n.split("_"))
                headers.append((name, f"<{v}>" if n in ("record_id", "refers_to") else str(v)))
        if values.get("record_type") == "response" and (values.get("content_type") or "").startswith("application/http"):
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(block) + block
        return member(headers, block)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = located(self.path)
        fs.create_dir(root, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith(MANIFEST)] if self.overwrite else []
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([n for m in messages if m for n in m.files]).encode())
        for f in old:
            fs.delete_file(f)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = located(self.path)
        for m in messages:
            for n in m.files if m else []:
                fs.delete_file(f"{root}/{n}")


class WarcSource(ds.DataSource):
    """Options: path; task_bytes when reading; max_file_bytes when writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("task_bytes", TASK_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("max_file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    """Makes ``format("warc")`` known to a session, filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---------------------------------------------------------------------------------------------------------------------
# Pages


def page_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The records of ``pages`` (page_id, url, html), ready to be written."""
    rows = pages.select(F.col("page_id").cast("long").alias("id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    first = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies")).where("copies > 1 and least is not null")
    first = first.select("digest", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(first, ["digest", "salt"], "left")
    again = F.col("least").isNotNull() & ~F.col("id").eqNullSafe(F.col("least"))
    named = lambda i: F.concat(F.lit("urn:page:"), i.cast("string"))
    return dealt.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(named(F.col("id")), F.concat(F.lit("urn:sha256:"), "digest")).alias("record_id"), F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"), F.lit(HTTP).alias("content_type"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, named(F.col("least"))).alias("refers_to"),
        F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest").alias("warc_profile"),
        F.col("id").cast("string").alias("x_page_id"), F.when(again, F.col("n").cast("string")).alias("x_payload_length"),
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str) -> None:
    """Writes ``pages`` as an archive in the folder ``path``."""
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).load(path)


def page_report(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive of pages.

    Responses are measured on the payloads read back, against their headers too; revisits have their header alone.
    """
    heads = "record_type string, payload_digest string, refers_to string, x_page_id string, x_payload_length long"
    told = F.regexp_extract("payload_digest", "^sha256:([0-9a-f]{64})$", 1)
    whole = read_archive(spark, path, f"{heads}, payload binary").where("record_type = 'response'")
    digest = F.sha2("payload", 256)
    sound = F.when(digest == told, digest).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ in record of page "), F.coalesce("x_page_id", F.lit("null")))))
    responses = whole.select("x_page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), sound.alias("payload_digest"), "record_type", "refers_to")
    revisits = read_archive(spark, path, heads).where("record_type = 'revisit'").select("x_page_id", F.col("x_payload_length").alias("payload_bytes"), told.alias("payload_digest"), "record_type", "refers_to")
    refers = F.regexp_extract("refers_to", r"^urn:page:(-?\d+)$", 1)
    return responses.union(revisits).select(F.col("x_page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), refers.cast("long")).alias("refers_to"))


def warc_report(pages: DataFrame) -> DataFrame:
    """Pages as an archive in the shared folder, and what is read back from it."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    archive_pages(pages, path)
    return page_report(spark, path)


ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), q AS (
  SELECT page_id, strlen(html)::BIGINT AS n, sha256(html) AS digest FROM p
), f AS (
  SELECT digest, min(page_id) AS least FROM q WHERE n >= {LEAST_BYTES} GROUP BY digest
)
SELECT q.page_id, q.n AS payload_bytes, q.digest AS payload_digest, CASE WHEN f.least IS NOT NULL AND q.page_id IS DISTINCT FROM f.least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN q.page_id IS DISTINCT FROM f.least THEN f.least END AS refers_to
FROM q LEFT JOIN f ON q.digest = f.digest
"""
