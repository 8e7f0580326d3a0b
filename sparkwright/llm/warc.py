"""WARC archives: a writer that records repeated payloads as revisits, and a Python data source.

Each record is a gzip member of its own whose extra field "sl" holds the lengths of the member,
compressed and not. So a reader inflates a record's first bytes, parses the headers, and where the
pushed predicates turn the record away it seeks to the next one without inflating the payload.
Archives without that field, and uncompressed ones, are read as well; one that ends inside a record
is an error, as its records can't be told from a whole archive's.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from sparkwright.llm.common import discard, new_folder, stored

DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 256 << 20
HEAD = 2048
#: More payloads with copies than this and they meet their rows by shuffle instead of being sent to each executor.
BROADCAST_COPIES = 500_000
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes bigint, "
    "refers_to string, content_length bigint, headers map<string,string>, payload binary"
)
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
_KIND = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "date", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def _files(uri: str):
    """The file system and the path of a URI; executors use it too, so the folder must be one they share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str) -> str:
    """A header value in one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {clean(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with the extra field sl: the length of the member and of the data (0 where they pass 32 bits)."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 12 + 12 + len(body) + 8
    long = size >> 32 or len(data) >> 32
    extra = b"sl" + struct.pack("<HII", 8, 0 if long else size, 0 if long else len(data))
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def page_record(page_id: int | None, url: str | None, payload: bytes, sha: str, keep: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:x-page:{page_id}>"), ("WARC-Date", DATE)]
    headers += [("WARC-Target-URI", url)] if url is not None else []
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:x-page:{keep}>")]
    return record(headers, http if revisit else http + payload)


def parse_head(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, found, value = line.partition(":")
        if found:
            out[name.strip()] = value.strip()
    return out


@dataclass
class Archive(InputPartition):
    path: str


def _get(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(FIELDS[column])
    if value is not None and column == "payload_digest":
        value = value.removeprefix("sha1:")
    return value.strip("<>") if value is not None and column in ("record_id", "refers_to") else value


class WarcReader(DataSourceReader):
    """A partition for each archive. Options: path (a folder or file URI), paths (a JSON list of URIs), payload: true
    (the default), false (never inflate it) or digest (inflate it, take payload_digest and payload_bytes from it and
    hold the digest against the header's, but return no payload).
    """

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in FIELDS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in FIELDS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in FIELDS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        if "paths" in self.options:
            return [Archive(p) for p in json.loads(self.options["paths"])] or [Archive("")]
        from pyarrow import fs

        uri = self.options["path"]
        files, path = _files(uri)
        info = files.get_file_info(path)
        if info.type == fs.FileType.File:
            return [Archive(uri)]
        found = files.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(x.path for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz")))
        return [Archive(uri.rstrip("/") + n[len(path.rstrip("/")) :]) for n in names] or [Archive("")]

    def wanted(self, headers: dict[str, str]) -> bool:
        for column, how, values in self.tests:
            value = _get(headers, column)
            if value is None or (value not in values if how == "in" else not value.startswith(values)):
                return False
        return True

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, path = _files(partition.path)
        rows, held = [], 0
        mode = self.options.get("payload", "true").lower()
        with files.open_input_file(path) as f:
            for headers, block in records(f, self.wanted, mode != "false"):
                body = None if block is None else block.partition(b"\r\n\r\n")[2] if "application/http" in headers.get("Content-Type", "") else block
                if headers.get("WARC-Type") == "revisit":
                    body = None
                row = {c: _get(headers, c) for c in FIELDS} | {"headers": list(headers.items()), "payload": body}
                size = headers.get("X-Payload-Length")
                row["payload_bytes"] = len(body) if body is not None else int(size) if size is not None else None
                row["content_length"] = int(headers.get("Content-Length", 0))
                if mode == "digest" and body is not None:
                    own = digest(body)
                    if headers.get("WARC-Payload-Digest", "").startswith("sha1:") and row["payload_digest"].upper() != own:
                        raise ValueError(f"{partition.path}: the payload of {row['record_id']} isn't that of its digest")
                    row |= {"payload_digest": own, "payload": None}
                rows.append(row)
                held += row["content_length"] if mode == "true" else 0
                if len(rows) >= 1000 or held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _KIND)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _KIND)


def records(f, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and block of each wanted record; the rest of others is skipped. f: a seekable file. A cut one raises ValueError."""
    end, at = f.size(), 0
    while at < end:
        f.seek(at)
        start = f.read(24)
        if start[:2] != b"\x1f\x8b":
            headers, head = _plain_head(f, at)
            length = int(headers.get("Content-Length", 0))
            if at + head + length > end:
                raise _cut(at)
            if wanted(headers):
                f.seek(at + head)
                yield headers, (f.read(length) if payload else None)
            at += head + length + 4
            continue
        size = struct.unpack("<I", start[16:20])[0] if len(start) >= 20 and start[3] & 4 and start[12:14] == b"sl" else 0
        if at + size > end:
            raise _cut(at)
        f.seek(at)
        z, data = zlib.decompressobj(31), b""
        while b"\r\n\r\n" not in data and not z.eof:
            more = z.unconsumed_tail or f.read(HEAD if size else 1 << 16)
            if not more:
                raise _cut(at)
            data += z.decompress(more, 1 << 13)
        head = data.find(b"\r\n\r\n")
        if head < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers = parse_head(data[:head])
        keep = wanted(headers)
        if size and not (keep and payload):
            at += size
        else:
            parts = [data]
            while not z.eof:
                more = z.unconsumed_tail or f.read(max(HEAD, size) if size else 1 << 16)
                if not more:
                    raise _cut(at)
                parts.append(z.decompress(more, 1 << 20))
            at = f.tell() - len(z.unused_data)
            data = b"".join(parts)
        if keep:
            yield headers, (data[head + 4 : head + 4 + int(headers.get("Content-Length", 0))] if payload else None)


def _cut(at: int) -> ValueError:
    return ValueError(f"the archive ends inside the record at byte {at}")


def _plain_head(f, at: int) -> tuple[dict[str, str], int]:
    f.seek(at)
    data = b""
    while b"\r\n\r\n" not in data:
        more = f.read(HEAD)
        if not more:
            raise ValueError(f"no WARC record at byte {at}")
        data += more
    head = data.index(b"\r\n\r\n")
    return parse_head(data[:head]), head + 4


class WarcSource(DataSource):
    """spark.read.format("warc"): see WarcReader for options and SCHEMA for columns."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, paths: list[str] | str, payload: bool | str = True) -> DataFrame:
    """Archives of a folder or a list of files; filters on record type and headers are pushed to the reader (the
    session's option for it is set for good, as the plan is made when the result is used). payload: see WarcReader.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("payload", str(payload).lower())
    return reader.load(paths) if isinstance(paths, str) else reader.option("paths", json.dumps(paths)).load()


def write_pages(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> list[str]:
    """Writes a record for each row of pages(page_id, url, html) and returns the archives' URIs.

    Of equal payloads the largest page_id's is the response. Only digests and ids are grouped: what stands
    once is written where it is read, and the digests of payloads with copies are sent to the executors. If
    they are more than BROADCAST_COPIES, payloads move once, to meet them, and a frequent payload's rows are
    split like any skewed join's. A task writes files of its own names; the manifest holds those of the attempts that ended well, so
    what a lost executor left is never read.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("sha", F.unhex(F.sha1("payload")))
    copies = own.select("page_id", "sha").groupBy("sha").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 and keep is not null").select("sha", "keep")
    copies = stored(copies, "copies")
    few = copies.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
    both = own.join(F.broadcast(copies) if few else copies, "sha", "left")
    both = both.select("page_id", "url", "payload", "sha", F.when(F.length("payload") >= min_bytes, F.col("keep")).alias("keep"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        out, name, written, made = None, "", 0, []
        for b in batches:
            page, url, payload, sha, keep = b.columns
            for i in range(b.num_rows):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    files.create_dir(path, recursive=True)
                    out, written = files.open_output_stream(f"{path}/{name}", compression=None), 0
                p, k = page[i].as_py(), keep[i].as_py()
                data = member(page_record(p, url[i].as_py(), payload[i].as_py(), base64.b32encode(sha[i].as_py()).decode(), k, k is not None and p != k))
                out.write(data)
                written += len(data)
                if written >= file_bytes:
                    out.close()
                    made.append(f"{folder}/{name}")
                    out = None
        if out is not None:
            out.close()
            made.append(f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["uri"])

    both.mapInArrow(work, "uri string").write.parquet(f"{folder}-manifest")
    discard(copies)
    found = pages.sparkSession.read.schema("uri string").parquet(f"{folder}-manifest")
    return sorted(r.uri for r in found.collect())


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html, ...) -> one row for each input row, from the archives read back:
    page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html counts as empty; a null url has no header. Rows of a null page_id are responses only if no
    row with an id has their payload; of equal largest page_ids all are responses. Further columns are
    ignored, and an empty table gives no row. A response's digest and length are taken from the payload that
    the archive holds, by the reader, which has its bytes.
    """
    spark = pages.sparkSession
    paths = write_pages(pages, new_folder(spark, "warc"), min_bytes)
    if not paths:
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    read = read_warc(spark, paths, "digest").where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^urn:x-page:(-?[0-9]+)$', 1) as bigint)")
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
k AS (SELECT h, max(page_id) AS keep FROM d GROUP BY h)
SELECT page_id, payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j:
  ((instr('0123456789abcdef', substr(h, 1 + ((5 * i + j) // 4)::INT, 1)) - 1) >> (3 - (5 * i + j) % 4)::INT & 1) << (4 - j)::INT))::INT, 1)), '') AS payload_digest,
 CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d JOIN k USING (h)"""
