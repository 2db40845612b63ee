"""WARC archives as a PySpark data source (``format("warc")``).

Writing.  Each task writes archives of at most ``max_file_bytes`` under unique names; a manifest that lists the
files of the tasks that succeeded is put in place last, so files of lost or repeated tasks are never read.  An
overwrite names in its manifest what it replaces; the old archives are gone for readers in the same moment, and
are deleted after it.  Records are gzip members of their own (or plain, with ``compress=false``); each member names
its compressed and plain lengths in an extra field ``sl``, so a reader can step over it.

Reading.  The driver plans partitions of whole files, small ones together.  Files with names of this writer count
only if a manifest lists them; all other ``*.warc`` and ``*.warc.gz`` files of the folder are foreign archives and
are read too.  Predicates on ``record_type``, ``record_id``, ``target_uri``, ``warc_date`` and ``refers_to`` are pushed
into the reader, which parses a record's headers first and steps over the rest of a record that they exclude.
With a schema that has no ``payload`` (see ``read_archives``), payloads are never kept, and members with ``sl``
never inflated.  A gzip member may hold any number of records; its checksum and length are verified whenever it
is read to its end.

Both sides reach files through Arrow's file systems, so the path may be local, ``file://``, ``hdfs://``,
``s3://`` and so on, as long as the driver and all executors see it.

Edge cases: a null payload counts as empty; null header values are left out; control characters in header
values are percent-encoded; header names are matched in any case; headers that repeat are joined by ", "; a
record that is cut short, has no Content-Length, or fails its checksum is an error that names the file; lines may
end in a bare line feed; records of any length are written and read whole; no rows give a manifest without files
and an empty table; rows may repeat; columns that ``SCHEMA`` doesn't name are not written.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from sparkloom.llm.common import scratch, ship, stored, table

SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, "
    "content_type string, content_length bigint, headers map<string,string>, http_headers map<string,string>, payload binary"
)
_ARROW = {
    "record_type": pa.string(),
    "record_id": pa.string(),
    "target_uri": pa.string(),
    "warc_date": pa.string(),
    "refers_to": pa.string(),
    "payload_digest": pa.string(),
    "content_type": pa.string(),
    "content_length": pa.int64(),
    "headers": pa.map_(pa.string(), pa.string()),
    "http_headers": pa.map_(pa.string(), pa.string()),
    "payload": pa.binary(),
}
#: Header of each column, in the order in which they are written.
_NAMED = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "warc_date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
_FILTERED = frozenset(("record_type", "record_id", "target_uri", "warc_date", "refers_to"))
_ARCHIVE, _OWN = re.compile(r"\.warc(\.gz)?$"), re.compile(r"part-[0-9a-f]{32}\.warc(\.gz)?")
_MANIFEST = re.compile(r"_committed-[0-9a-f]{32}\.json")
MAX_FILE_BYTES = 64 << 20
PARTITION_BYTES = 32 << 20
_BATCH_BYTES, _BATCH_ROWS = 8 << 20, 2_000


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _member(record: bytes, level: int) -> bytes:
    """A gzip member whose extra field ``sl`` holds its compressed and plain lengths."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + len(tail)
    if size >= 1 << 32 or len(record) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, size, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H", len(extra)) + extra + body + tail


@dataclass
class _Files(WriterCommitMessage):
    names: list = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path = options["path"]
        self.columns, self.overwrite = columns, overwrite
        self.compress = str(options.get("compress", "true")).lower() == "true"
        self.level = int(options.get("level", 1))
        self.limit = int(options.get("max_file_bytes", MAX_FILE_BYTES))

    def _record(self, row: dict) -> bytes:
        payload = row.get("payload") or b""
        block = payload
        http = row.get("http_headers")
        if http is not None:
            lines = [f"{_clean(k)}: {_clean(v)}" for k, v in http if v is not None and not k.startswith(":")]
            status = next((v for k, v in http if k == ":status"), None) or "HTTP/1.1 200 OK"
            block = ("\r\n".join([_clean(status), *lines]) + "\r\n\r\n").encode() + payload
        head = ["WARC/1.1"]
        head += [f"{h}: {_clean(row[c])}" for c, h in _NAMED.items() if row.get(c) is not None]
        head += [f"{_clean(k)}: {_clean(v)}" for k, v in row.get("headers") or [] if v is not None]
        head.append(f"Content-Length: {len(block)}")
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        fs, root = _file_system(self.path)
        fs.create_dir(root, recursive=True)
        done, out, held = _Files(), None, 0
        suffix = ".warc.gz" if self.compress else ".warc"
        try:
            for batch in iterator:
                for begin in range(0, batch.num_rows, 256):
                    for row in batch.slice(begin, 256).to_pylist():
                        if out is None or held >= self.limit:
                            if out is not None:
                                out.close()
                            done.names.append([f"part-{uuid.uuid4().hex}{suffix}", 0])
                            out, held = fs.open_output_stream(f"{root}/{done.names[-1][0]}", compression=None), 0
                        record = self._record(row)
                        data = _member(record, self.level) if self.compress else record
                        out.write(data)
                        held += len(data)
                        done.names[-1][1] = held
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list) -> None:
        fs, root = _file_system(self.path)
        fs.create_dir(root, recursive=True)
        old = [x.base_name for x in fs.get_file_info(pafs.FileSelector(root)) if _MANIFEST.fullmatch(x.base_name) or _ARCHIVE.search(x.base_name)]
        fresh = [n for m in messages if m is not None for n in m.names]
        replaced = sorted({*old} - {n for n, _ in fresh}) if self.overwrite else []
        # written aside and moved, so that nobody reads half a manifest
        name = f"_committed-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{root}/_writing-{name}") as out:
            out.write(json.dumps({"files": fresh, "replaces": replaced}).encode())
        fs.move(f"{root}/_writing-{name}", f"{root}/{name}")
        # archives first: the manifest that replaces them must outlive the manifests that list them
        for n in sorted(replaced, key=lambda n: bool(_MANIFEST.fullmatch(n))):
            fs.delete_file(f"{root}/{n}")

    def abort(self, messages: list) -> None:
        fs, root = _file_system(self.path)
        for m in messages:
            for name, _ in m.names if m is not None else ():
                fs.delete_file(f"{root}/{name}")


@dataclass
class _Group(InputPartition):
    files: tuple

    def __init__(self, files: tuple):
        self.files = files


def _fields(head: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def _joined(named: list[tuple[str, str]]) -> dict[str, str]:
    """One value per name as it is first written; repeated ones (in any case) are joined."""
    spelt: dict[str, str] = {}
    out: dict[str, str] = {}
    for name, value in named:
        key = spelt.setdefault(name.lower(), name)
        out[key] = f"{out[key]}, {value}" if key in out else value
    return out


def _length(named: list[tuple[str, str]]) -> int:
    for name, value in named:
        if name.lower() == "content-length":
            return int(value)
    raise ValueError("a WARC record has no Content-Length")


class _Plain:
    """A buffered file as a source of records."""

    def __init__(self, file):
        self.file = file
        self.line = file.readline
        at = file.tell()
        self.end = file.seek(0, io.SEEK_END)
        file.seek(at)

    def take(self, size: int, keep: bool) -> bytes | None:
        if not keep:
            if self.file.tell() + size > self.end:
                raise ValueError("a WARC record is cut short")
            self.file.seek(size, io.SEEK_CUR)
            return None
        data = self.file.read(size)
        if len(data) < size:
            raise ValueError("a WARC record is cut short")
        return data


class _Member:
    """The plain bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, file):
        self.file, self.begin = file, file.tell()
        head = file.read(10)
        if len(head) < 10 or head[2] != 8:
            raise ValueError("not a gzip member")
        flags, self.size, self.plain = head[3], None, None
        if flags & 4:
            extra, k = file.read(struct.unpack("<H", file.read(2))[0]), 0
            while k + 4 <= len(extra):
                length = struct.unpack_from("<H", extra, k + 2)[0]
                if extra[k : k + 2] == b"sl" and length == 8:
                    self.size, self.plain = struct.unpack_from("<II", extra, k + 4)
                k += 4 + length
        for bit in (8, 16):  # name, comment
            while flags & bit and file.read(1) not in (b"\0", b""):
                pass
        if flags & 2:
            file.read(2)
        self.inflate = zlib.decompressobj(-15)
        self.held, self.crc, self.total, self.step, self.ended = b"", 0, 0, 1024, False

    def _more(self, most: int) -> bool:
        """Inflate a little more; False at the member's end, whose checksum and length are then verified."""
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.file.read(self.step)
            if not data:
                raise ValueError("a gzip member is cut short")
            got = self.inflate.decompress(data, most)
            self.step = min(self.step * 2, 1 << 16)
            if got:
                self.crc, self.total = zlib.crc32(got, self.crc), self.total + len(got)
                self.held += got
                return True
        if not self.ended:
            self.ended = True
            self.file.seek(self.file.tell() - len(self.inflate.unused_data))
            tail = self.file.read(8)
            if len(tail) < 8:
                raise ValueError("a gzip member is cut short")
            if struct.unpack("<II", tail) != (self.crc, self.total & 0xFFFFFFFF):
                raise ValueError("a gzip member fails its checksum")
        return False

    def line(self) -> bytes:
        at = 0
        while (end := self.held.find(b"\n", at)) < 0:
            at = len(self.held)
            if not self._more(16384):
                end = len(self.held) - 1
                break
        out, self.held = self.held[: end + 1], self.held[end + 1 :]
        return out

    def take(self, size: int, keep: bool) -> bytes | None:
        parts = []
        while size:
            if not self.held and not self._more(1 << 20):
                raise ValueError("a WARC record is cut short")
            part, self.held = self.held[:size], self.held[size:]
            size -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts) if keep else None

    def step_over(self) -> None:
        self.file.seek(self.begin + self.size)

    def only(self, head: int, block: int) -> bool:
        """Whether the member is known to hold just the record with these lengths."""
        return self.size is not None and self.plain == head + block + 4


def records(file, wanted, payloads: bool) -> Iterator[tuple[list[tuple[str, str]], bytes | None]]:
    """(headers, block or None) of each record that ``wanted`` takes by its headers; file is a buffered reader."""
    while True:
        at = file.tell()
        magic = file.read(2)
        if not magic:
            return
        file.seek(at)
        if magic == b"\x1f\x8b":
            yield from _records_of(_Member(file), wanted, payloads)
        else:
            yield from _records_of(_Plain(file), wanted, payloads)


def _records_of(source, wanted, payloads):
    while True:
        line = source.line()
        if not line:
            return
        if line in (b"\r\n", b"\n"):  # between records
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        lines, size = [], len(line)
        while (line := source.line()) not in (b"\r\n", b"\n"):
            if not line.endswith(b"\n"):
                raise ValueError("a WARC record ends inside its headers")
            lines.append(line)
            size += len(line)
        named = _fields(b"".join(lines))
        length = _length(named)
        take = wanted(named)
        if not (take and payloads) and isinstance(source, _Member) and source.only(size + len(line), length):
            source.step_over()
            if take:
                yield named, None
            return
        block = source.take(length, take and payloads)
        if take:
            yield named, block


def _test(f: Filter):
    """A test of a header value, or None if the filter can't be pushed."""
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in _FILTERED:
        return None
    name = _NAMED[f.attribute[0]]
    if isinstance(f, EqualTo):
        return name, lambda v, x=f.value: v is not None and v == x
    if isinstance(f, EqualNullSafe):
        return name, lambda v, x=f.value: v == x
    if isinstance(f, In):
        return name, lambda v, x=frozenset(f.value): v is not None and v in x
    if isinstance(f, IsNotNull):
        return name, lambda v: v is not None
    if isinstance(f, IsNull):
        return name, lambda v: v is None
    if isinstance(f, StringStartsWith):
        return name, lambda v, x=f.value: v is not None and v.startswith(x)
    if isinstance(f, StringEndsWith):
        return name, lambda v, x=f.value: v is not None and v.endswith(x)
    if isinstance(f, StringContains):
        return name, lambda v, x=f.value: v is not None and x in v
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.target = int(options.get("partition_bytes", PARTITION_BYTES))
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def partitions(self) -> list[_Group]:
        fs, root = _file_system(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            files = [(root, info.size)]
        else:
            found = fs.get_file_info(pafs.FileSelector(root, recursive=False))
            lists = {}
            for x in found:
                if _MANIFEST.fullmatch(x.base_name):
                    with fs.open_input_stream(x.path) as file:
                        lists[x.base_name] = json.loads(file.read())
            replaced = {n for held in lists.values() for n in held["replaces"]}
            files = [(f"{root}/{n}", size) for name, held in lists.items() if name not in replaced for n, size in held["files"] if n not in replaced]
            files += [
                (x.path, x.size) for x in found
                if _ARCHIVE.search(x.base_name) and not _OWN.fullmatch(x.base_name) and x.base_name not in replaced
            ]
        groups, now, held = [], [], 0
        for path, size in sorted(files):
            if now and held + size > self.target:
                groups.append(_Group(tuple(now)))
                now, held = [], 0
            now.append(path)
            held += size
        return [*groups, _Group(tuple(now))]

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(self.path)
        tests = [_test(f) for f in self.pushed]
        payloads = "payload" in self.columns or "http_headers" in self.columns

        def wanted(named: list[tuple[str, str]]) -> bool:
            if not tests:
                return True
            values = {k.lower(): v for k, v in _joined(named).items()}
            return all(test(values.get(name.lower())) for name, test in tests)

        rows: list[dict] = []
        held = 0
        schema = pa.schema([(c, _ARROW[c]) for c in self.columns])
        for path in partition.files:
            with io.BufferedReader(fs.open_input_file(path), 1 << 20) as file:
                found = records(file, wanted, payloads)
                while True:
                    try:
                        named, block = next(found)
                    except StopIteration:
                        break
                    except (ValueError, zlib.error) as problem:
                        raise ValueError(f"{path}: {problem}") from problem
                    values = _joined(named)
                    spelt = {k.lower(): k for k in values}
                    row = {c: values.pop(spelt.get(h.lower()), None) for c, h in _NAMED.items()}
                    row["content_length"] = int(values.pop(spelt["content-length"]))
                    row["headers"] = list(values.items())
                    http = None
                    if block is not None and (row["content_type"] or "").lower().startswith("application/http"):
                        top, _, block = block.partition(b"\r\n\r\n")
                        status, _, rest = top.partition(b"\r\n")
                        http = [(":status", status.decode("utf-8", "replace")), *_joined(_fields(rest)).items()]
                    row["http_headers"], row["payload"] = http, block
                    rows.append(row)
                    held += len(block or b"")
                    if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist([{c: r[c] for c in self.columns} for r in rows], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in self.columns} for r in rows], schema=schema)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_archives(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records below ``path``; with ``columns``, only those are parsed (and payloads stepped over if not among them)."""
    register(spark)
    full = StructType.fromDDL(SCHEMA)
    reader = spark.read.format("warc")
    if columns:
        reader = reader.schema(StructType([full[c] for c in columns]))
    return reader.load(path)


def write_archives(rows: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Write records; ``rows`` may have any of the columns of ``SCHEMA`` (content_length is computed)."""
    register(rows.sparkSession)
    known = [f.name for f in StructType.fromDDL(SCHEMA) if f.name in rows.columns and f.name != "content_length"]
    full = StructType.fromDDL(SCHEMA)
    cast = rows.select(*(F.col(c).cast(full[c].dataType) for c in known))
    cast.write.format("warc").mode(mode).options(**options).save(path)


REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 100


def archive_pages(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, **options) -> None:
    """Archive (page_id, url, html): of equal payloads of at least ``min_revisit_bytes`` the page with the
    least id is a response and the others revisit it.  Rows that share that least id are all responses."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = stored(
        rows.where(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        "warc-firsts",
    )
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    made = rows.join(firsts, "digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.lit("application/http;msgtype=response").alias("content_type"),
        F.create_map(
            F.lit("X-Page-Id"), F.col("page_id").cast("string"), F.lit("WARC-Profile"), F.when(revisit, REVISIT),
            F.lit("X-Payload-Bytes"), F.octet_length("payload").cast("string"),
        ).alias("headers"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html; charset=utf-8"),
            F.lit("Content-Length"), F.octet_length("payload").cast("string"),
        ).alias("http_headers"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    write_archives(made, path, **options)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """What the archives say of each page.  Payloads of responses are measured; revisits speak by their headers, so
    theirs are asked for without payloads.  Either side's record type is pushed into the reader."""
    full = read_archives(spark, path, ["record_type", "headers", "payload"]).where("record_type = 'response'")
    responses = full.select(
        F.col("headers")["X-Page-Id"].cast("bigint").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("bigint").alias("refers_to"),
    )
    heads = read_archives(spark, path, ["record_type", "refers_to", "payload_digest", "headers"]).where("record_type = 'revisit'")
    revisits = heads.select(
        F.col("headers")["X-Page-Id"].cast("bigint").alias("page_id"),
        F.col("headers")["X-Payload-Bytes"].cast("bigint").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type",
        F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1).cast("bigint").alias("refers_to"),
    )
    return responses.unionByName(revisits)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_pages(spark, path)


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
