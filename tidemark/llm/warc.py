"""WARC archives as a Spark data source: a writer with gzip members for records and a splittable reader.

Reading: each task gets a byte range of one file, looks for the gzip magic, validates a candidate by decoding its WARC
header (and that of the member behind it), and owns the records whose first byte lies in its range. Writing: a task
writes one file under a temporary name that holds its attempt; the driver moves the files of committed tasks only, so
a lost executor leaves no half archive in the result. Paths may be anything that pyarrow's file systems open.

Archives of other writers: ids are kept as they are (record_id, refers_to_id), page_id and refers_to are those of our own
alone; records of every type are given; a digest that is missing or of another kind is null, and digest_ok says of the
others whether the payload has it; a member may hold several records. The payload is what stands behind the HTTP header,
or the whole block where there is none; a revisit has none. A payload that is kept uncompressed and is an archive itself,
of two members in a row at least, can't be told from records by a task that starts inside it.

Null payload counts as empty, a null url is left out, a null page_id is kept as the id "null". Rows that repeat a
page_id are separate records. Of equal payloads, every row with the largest page_id is a response. An empty table
gives an archive without records. A very long page is one record, held whole by its task. Other columns are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .common import shared_dir, stored, table

MAGIC = b"\x1f\x8b\x08"
LEAST_REVISIT = 1000
URN = "urn:page:"
READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string, offset long, record_id string, refers_to_id string, content_type string, digest_ok boolean"


def _record(page_id, url, payload: bytes, length: int, digest: str, refers_to) -> bytes:
    """One record as a gzip member. A revisit (refers_to given) keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:").replace("//", "/"))


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.tmp = path.rstrip("/"), f"{path.rstrip('/')}/_temporary-{uuid.uuid4().hex}"

    def write(self, rows) -> _Written:
        fs, tmp = _opened(self.tmp)
        fs.create_dir(tmp, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        with fs.open_output_stream(f"{tmp}/{name}", compression=None) as out:
            for r in rows:
                payload = (r.payload or "").encode()
                out.write(_record(r.page_id, r.url, payload, len(payload) if r.refers_to is None else r.payload_bytes, r.payload_digest, r.refers_to))
        return _Written(name)

    def commit(self, messages) -> None:
        fs, path = _opened(self.path)
        _, tmp = _opened(self.tmp)
        fs.create_dir(path, recursive=True)
        for m in messages:
            if m is not None:
                fs.move(f"{tmp}/{m.name}", f"{path}/{m.name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, tmp = _opened(self.tmp)
        if fs.get_file_info(tmp).type != pafs.FileType.NotFound:
            fs.delete_dir(tmp)


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    end: int


class _Source:
    """Bytes of an open file by position, fetched in pieces."""

    def __init__(self, f, size: int, piece: int = 1 << 18):
        self.f, self.size, self.piece = f, size, piece

    def at(self, pos: int, n: int) -> bytes:
        self.f.seek(pos)
        return self.f.read(max(0, min(n, self.size - pos)))


def _head_ok(src: _Source, pos: int) -> bool:
    """Whether a gzip member that begins with a WARC header starts at pos."""
    raw = src.at(pos, 4096)
    if raw[:3] != MAGIC:
        return False
    try:
        return zlib.decompressobj(31).decompress(raw, 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _member(src: _Source, pos: int) -> tuple[bytes, int] | None:
    """The content of the member at pos and the position behind it; None if it isn't whole."""
    z, parts, at = zlib.decompressobj(31), [], pos
    try:
        while not z.eof:
            raw = src.at(at, src.piece)
            if not raw:
                return None
            at += len(raw)
            parts.append(z.decompress(raw))
    except zlib.error:
        return None
    return b"".join(parts), at - len(z.unused_data)


def _first(src: _Source, start: int, end: int) -> int | None:
    """The first true member start in [start, end)."""
    pos = start
    while pos < end:
        raw = src.at(pos, src.piece)
        k = raw.find(MAGIC)
        if k < 0 or pos + k >= end:
            if len(raw) < src.piece or pos + src.piece >= end + 2 or k >= 0:
                return None
            pos += src.piece - 2
            continue
        pos += k
        if _head_ok(src, pos) and (m := _member(src, pos)) and (m[1] >= src.size or _head_ok(src, m[1])):
            return pos
        pos += 1
    return None


def _sha1(told: str | None) -> str | None:
    """The lower-case hex digits of a SHA-1 digest as headers have them: base 32, or hex."""
    kind, _, value = (told or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch("[0-9A-Fa-f]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def _own(ident: str | None) -> int | None:
    """The page of an id that write_warc made."""
    m = re.fullmatch(f"<{URN}(-?\\d+)>", ident or "")
    return int(m[1]) if m else None


def _records(content: bytes, file: str, offset: int) -> Iterator[tuple]:
    """The records of one member, all with the member's offset."""
    at = 0
    while content.startswith(b"WARC/", at):
        stop = content.find(b"\r\n\r\n", at)
        if stop < 0:
            raise ValueError(f"{file} at {offset}: a record's header doesn't end")
        lines = content[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = fields.get("content-length", "")
        block = content[stop + 4 : stop + 4 + int(length)] if length.isdecimal() else content[stop + 4 :].removesuffix(b"\r\n\r\n")
        at = stop + 4 + len(block) + 4
        kind, digest, ok = fields.get("warc-type", ""), _sha1(fields.get("warc-payload-digest")), None
        http = fields.get("content-type", "").lower().startswith("application/http")
        head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        size: int | None = len(payload)
        if kind == "revisit":
            told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            size, payload = int(told[1]) if told else None, None
        elif digest is not None:
            ok = hashlib.sha1(payload).hexdigest() == digest
        ids = fields.get("warc-record-id"), fields.get("warc-refers-to")
        yield _own(ids[0]), fields.get("warc-target-uri"), kind, _own(ids[1]), size, digest, payload, file, offset, *ids, fields.get("content-type"), ok


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int, with_payload: bool):
        self.path, self.split, self.with_payload = path, split, with_payload

    def partitions(self) -> list[_Range]:
        fs, path = _opened(self.path)
        info = fs.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path))
        files = sorted((f for f in files if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        return [_Range(f.path, a, min(a + self.split, f.size)) for f in files for a in range(0, f.size, self.split)] or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        if not part.file:
            return
        fs, _ = _opened(self.path)
        with fs.open_input_file(part.file) as f:
            src = _Source(f, f.size())
            pos = _first(src, part.start, part.end)
            while pos is not None and pos < part.end:
                m = _member(src, pos)
                if m is None:
                    raise ValueError(f"{part.file}: the member at {pos} isn't whole")
                for row in _records(m[0], part.file, pos):
                    yield row if self.with_payload else (*row[:6], None, *row[7:])
                pos = m[1] if m[1] < src.size else None


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path); options splitbytes (16 MB) and withpayload (true)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("splitbytes", 16 << 20)), self.options.get("withpayload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and refers_to: what the writer takes."""
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", text.alias("payload"), F.octet_length(text).cast("long").alias("payload_bytes"), F.sha1(F.encode(text, "UTF-8")).alias("payload_digest"))
    first = stored(rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    refers = F.when((F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return rows.join(first, "payload_digest", "left").withColumn("refers_to", refers).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload"))).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")


def write_warc(pages: DataFrame, path: str) -> None:
    pages.sparkSession.dataSource.register(WarcDataSource)
    with_revisits(pages).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, split_bytes: int = 16 << 20, with_payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("splitbytes", split_bytes).option("withpayload", str(with_payload).lower()).load(path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS f FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f IS NULL OR f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
"""
