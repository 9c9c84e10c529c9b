"""WARC archives: one gzip member per record, written by partition and read back sequentially.

Records with equal payloads of at least MIN_REVISIT bytes are written once as `response`; the others become `revisit`
records that name the first one and carry no payload. The writer makes archives of bounded size; the reader walks an
archive member by member with incremental zlib decompression, from bytes or from a file handle, frames each record by its
Content-Length and verifies what digests it has: SHA-256, SHA-1 or MD5, in hexadecimal or base32. Archives of other
writers are read as they are: digests, HTTP headers and target may be missing, record ids may be of any kind, bodies may
be chunked, and records of all types come out with their type.

Defined results: null html is an empty payload; a null url becomes an empty target; null page_id sorts last and is
written without a number; rows that repeat a page_id, or have none, get record ids of their own, by task and place; rows
that repeat the response's page_id and payload are responses too; an empty table gives no archives and no rows; extra
columns are ignored. What is no archive, cut short, badly framed or differs from a digest raises WarcError.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 100
#: Bytes of an archive after which the next one begins. An archive holds one record at least.
ARCHIVE_BYTES = 8 << 20
#: Fixed, so that equal input gives equal archives.
DATE = "2000-01-01T00:00:00Z"
CHUNK = 1 << 16


class WarcError(ValueError):
    """An archive is cut short, badly framed, or a digest doesn't match."""


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_id(page_id: int | None, own: str = "") -> str:
    """Id of a record; own tells records of one page_id apart."""
    return f"<urn:page:{'' if page_id is None else page_id}{own and ':'}{own}>"


def page_of(urn: str | None) -> int | None:
    """The page_id in a record id of this writer."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)(?::[^>]*)?>", urn or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str, payload: bytes, kind: str, refers_to: int | None, digest: str, own: str = "") -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, with the length of the full payload, and drops the body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, own)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return _member("\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n")


def members(archive: bytes | memoryview | BinaryIO) -> Iterator[bytes]:
    """The decompressed gzip members of an archive, one after the other, fed in chunks from bytes or from a file handle."""
    source = archive if hasattr(archive, "read") else io.BytesIO(archive)
    rest = source.read(CHUNK)
    while rest:
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest:
                raise WarcError("the archive ends inside a record")
            try:
                out.append(unpacker.decompress(rest))
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            rest = unpacker.unused_data if unpacker.eof else source.read(CHUNK)
        yield b"".join(out)
        rest = rest or source.read(CHUNK)


def _fields(head: bytes) -> dict[str, str]:
    """Header lines but the first; names in lower case, folded lines put together."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode(errors="replace")).split("\n")[1:]
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}


def _same_digest(stated: str, data: bytes) -> bool | None:
    """Whether data has a digest as stated, `algorithm:value`; None for an algorithm that isn't known."""
    name, _, value = stated.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha256", "sha1", "md5"):
        return None
    raw = hashlib.new(name, data, usedforsecurity=False).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError as e:
            raise WarcError("bad chunk of a body") from e
        if end < 0 or (size and end + 2 + size > len(body)):
            raise WarcError("a chunked body is cut short")
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header, HTTP header (empty where the record holds none) and payload of a record, after its framing and digests are verified."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        raise WarcError("not a WARC record")
    fields = _fields(head)
    length = fields.get("content-length", "")
    if not length.isdecimal() or rest[int(length) :] != b"\r\n\r\n":
        raise WarcError("content length doesn't frame the record")
    block = rest[: int(length)]
    if _same_digest(fields.get("warc-block-digest", ""), block) is False:
        raise WarcError("block digest differs")
    own, payload = {}, block
    if block.startswith(b"HTTP/") and fields.get("warc-type") in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        own = _fields(http)
    if fields.get("warc-type") == "response":
        stored, size = payload, own.get("content-length", "")
        if "chunked" in own.get("transfer-encoding", "").lower():
            payload = _unchunked(payload) if re.match(rb"[0-9A-Fa-f]+[;\r]", payload) else payload  # some writers leave the header on a plain body
        elif size.isdecimal() and int(size) != len(payload) and "warc-truncated" not in fields:
            raise WarcError("payload length differs")
        stated = fields.get("warc-payload-digest", "")
        if "warc-truncated" not in fields and _same_digest(stated, payload) is False and _same_digest(stated, stored) is False:
            raise WarcError("payload digest differs")
    return fields, own, payload


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages with payload, its digest, the first page_id of equal payloads where there are several, and whether a page_id stands once."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page_id = F.col("page_id").cast("long").alias("page_id")
    base = pages.select(page_id, F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    long = pages.select(page_id, F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).filter(F.col("n") >= min_revisit)
    repeated = common.cut(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    again = common.cut(pages.select(page_id).dropna().groupBy("page_id").count().filter("count > 1").select("page_id", F.lit(False).alias("once")))
    return base.join(common.small(repeated), "digest", "left").join(common.small(again), "page_id", "left").withColumn("once", F.coalesce("once", F.col("page_id").isNotNull()))


def write_archives(pages: DataFrame, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, records, body): gzip WARC archives of bounded size, as rows that any shared store can keep."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts, size, place = [], 0, 0
        task = getattr(TaskContext.get(), "partitionId", lambda: 0)()

        def flush() -> pa.RecordBatch:
            body = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(body).hexdigest()[:32] + ".warc.gz"]), pa.array([len(parts)], pa.int64()), pa.array([body], pa.binary())], ["archive", "records", "body"])

        for batch in batches:
            for page_id, url, html, digest, first, once in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "once")), strict=True):
                kind = "revisit" if first is not None and page_id != first else "response"
                place += 1
                parts.append(record(page_id, url, html, kind, first, digest, "" if once else f"{task}-{place}"))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield flush()
                    parts, size = [], 0
        if parts:
            yield flush()

    planned = plan_records(pages, min_revisit).select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "first", "once")
    return planned.mapInArrow(write, "archive string, records long, body binary")


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(path, records) of the .warc.gz files written under a folder that driver and executors share, as a mounted path; a task that is repeated writes the same files."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("save_archives writes to mounted folders; for other stores keep the archives as a table")
    root = folder.removeprefix("file://")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(root, exist_ok=True)
        for batch in batches:
            paths = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                path = f"{root}/{name}"
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(body.as_buffer())
                os.replace(part, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), batch.column(1)], ["path", "records"])

    return common.cut(archives.select("archive", "records", "body").mapInArrow(save, "path string, records long"))


NAMES = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "payload")
TYPES = ("long", "string", "long", "string", "string", "long", "string", "binary")


def _rows(source: bytes | memoryview | BinaryIO, columns: int) -> Iterator[pa.RecordBatch]:
    """Records of one archive, in batches of bounded size."""
    rows, size = [], 0
    for raw in members(source):
        fields, http, payload = parse(raw)
        kind = fields.get("warc-type", "")
        stated, length = fields.get("warc-payload-digest", ""), http.get("content-length", "")
        whole = int(length) if kind == "revisit" and length.isdecimal() else len(payload)
        digest = stated[7:].lower() if re.fullmatch(r"(?i)sha256:[0-9a-f]{64}", stated) else hashlib.sha256(payload).hexdigest() if kind != "revisit" else stated or None
        rows.append((page_of(fields.get("warc-record-id")), fields.get("warc-target-uri", ""), whole, digest, kind, page_of(fields.get("warc-refers-to")), fields.get("warc-record-id"), payload)[:columns])
        size += len(payload) * (columns == len(NAMES))
        if len(rows) >= 4096 or size >= ARCHIVE_BYTES:
            yield _batch(rows, columns)
            rows, size = [], 0
    if rows:
        yield _batch(rows, columns)


def _batch(rows: list[tuple], columns: int) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[TYPES[i]]) for i in range(columns)], list(NAMES[:columns]))


def _schema(columns: int) -> str:
    return ", ".join(f"{n} {t}" for n, t in zip(NAMES[:columns], TYPES, strict=False))


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of archives (a column `body`, as from write_archives()), verified one by one.

    payload_digest is the SHA-256 of the payload, as stated or computed; a revisit of another writer keeps its digest as stated.
    """
    columns = len(NAMES) if with_payload else len(NAMES) - 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                yield from _rows(body.as_buffer(), columns)

    return archives.select("body").mapInArrow(read, _schema(columns))


def read_warc_files(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Records of .warc.gz files under a path that Spark reads.

    Files under file: paths, which the workers must see, are read as streams, whatever their size. Those of other stores
    come through Spark, whole, 2 GB at most each.
    """
    columns = len(NAMES) if with_payload else len(NAMES) - 1
    listed = spark.read.format("binaryFile").load(path)
    first = listed.select("path").first()
    if first is not None and not first["path"].startswith("file:"):
        return read_archives(listed.select(F.col("content").alias("body")), with_payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open(unquote(urlparse(name).path), "rb") as f:
                    yield from _rows(f, columns)

    return listed.select("path").mapInArrow(read, _schema(columns))
