"""WARC derivatives: metadata and plain-text conversion records that refer to their response records.

Records are rows: record_id, record_type, target_uri, refers_to, warc_date, content_type, content_length,
block_digest, payload_digest, header (the WARC header block) and block (bytes).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Batches, frugal, slices
from .dom import parse, plain_text

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, header string, block binary"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in SCHEMA.split(", ")])
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
BREAK = "\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324 - the format's digest


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join('' if p is None else str(p) for p in parts))}>"


def record(kind: str, rid: str, uri: str | None, date: str, content_type: str, block: bytes, refers_to: str | None = None, payload: bytes | None = None) -> tuple:
    block_digest, payload_digest = digest(block), digest(payload) if payload is not None else None
    head = [("WARC-Type", kind), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Record-ID", rid), ("WARC-Refers-To", refers_to), ("WARC-Block-Digest", block_digest), ("WARC-Payload-Digest", payload_digest), ("Content-Type", content_type), ("Content-Length", len(block))]
    lines = ["WARC/1.0", *(f"{k}: {_one_line(v)}" for k, v in head if v is not None)]
    return rid, kind, uri, refers_to, date, content_type, len(block), block_digest, payload_digest, BREAK.join(lines) + BREAK, block


def _one_line(value: object) -> str:
    return str(value).replace("\r", " ").replace("\n", " ")


def response(page_id: object, url: str | None, page: str | None, date: str) -> tuple:
    payload = (page or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: {len(payload)}{BREAK}{BREAK}".encode()
    return record("response", record_id("response", page_id, url), url, date, "application/http; msgtype=response", http + payload, payload=payload)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields in order, payload; a block without an empty line is all header."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *rest = head.decode("utf-8", "replace").split(BREAK)
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in rest) if k.strip()], payload


def derive(rid: str, uri: str | None, date: str, block: bytes, payload_digest: str | None) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    status, fields, payload = split_http(block or b"")
    root, title, links = parse(payload.decode("utf-8", "replace"))
    text = plain_text(root).encode("utf-8", "surrogatepass")
    described = {
        "status": status,
        "headers": fields,
        "payload-length": len(payload),
        "payload-digest": payload_digest or digest(payload),
        "payload-digest-verified": payload_digest is None or payload_digest == digest(payload),
        "title": title,
        "links": [{"path": tag, "url": to} for tag, to in links],
        "conversion": record_id("conversion", rid),
    }
    meta = json.dumps(described, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")
    return [
        record("metadata", record_id("metadata", rid), uri, date, "application/json", meta, refers_to=rid),
        record("conversion", record_id("conversion", rid), uri, date, "text/plain", text, refers_to=rid, payload=text),
    ]


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of stored pages, with ids that follow from (page id, url).

    A null page has an empty payload, a null url no target; very long pages are stored whole; repeated rows give
    repeated records with equal ids; an empty table gives no rows; other columns are not read."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, "h", 1 << 21):
                yield _batch([response(i, u, h, date) for i, u, h in zip(*(part.column(c).to_pylist() for c in "iuh"), strict=True)])

    return pages.selectExpr(f"`{id_col}` i", f"cast(`{url_col}` as string) u", f"cast(`{html_col}` as string) h").mapInArrow(frugal(run), SCHEMA)


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record; records of other types give none.

    Repeated responses give repeated derivatives with equal ids; null blocks count as empty; very long ones are read
    whole; an empty table gives no rows; columns beyond those of a record are not read. A payload digest that does not match is recorded as such.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, "block", 1 << 21):
                rows = zip(*(part.column(c).to_pylist() for c in ("record_id", "target_uri", "warc_date", "block", "payload_digest")), strict=True)
                yield _batch([d for r in rows for d in derive(*r)])

    return records.where("record_type = 'response'").select("record_id", "target_uri", "warc_date", "block", "payload_digest").mapInArrow(frugal(run), SCHEMA)


def page_derivatives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """responses() and derivatives() in one pass over the pages, each derivative with its page's id: two rows a page.

    Null, empty and very long pages, repeats and empty tables as there; other columns are not read."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, "h", 1 << 21):
                ids, out = [], []
                for i, u, h in zip(*(part.column(c).to_pylist() for c in "iuh"), strict=True):
                    r = response(i, u, h, date)
                    made = derive(r[0], u, date, r[10], r[8])
                    out += made
                    ids += itertools.repeat(i, len(made))
                got = _batch(out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *got.columns], names=[id_col, *FIELDS])

    return pages.selectExpr(f"cast(`{id_col}` as bigint) i", f"cast(`{url_col}` as string) u", f"cast(`{html_col}` as string) h").mapInArrow(frugal(run), f"`{id_col}` long, {SCHEMA}")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(FIELDS), ARROW, strict=True)], schema=ARROW)


def encode(header: str, block: bytes) -> bytes:
    """A record as it stands in a file, one gzip member."""
    return gzip.compress(header.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n", mtime=0)


def write_records(records: DataFrame, path: str) -> list[tuple[str, int]]:
    """Writes part-….warc.gz files with a gzip member a record into the folder `path`; returns (file, records) by name.

    Every task writes its own file under a name of its attempt and renames it when it is whole, so lost and repeated
    tasks leave one file each. `path` is a folder that all executors reach (a mounted one, or an address that
    pyarrow's file systems know) and that holds no files yet. Null headers and blocks count as empty; an empty
    partition gives an empty file."""
    where, base = _file_system(path)
    if where.get_file_info(base).type == pafs.FileType.Directory and where.get_file_info(pafs.FileSelector(base)):
        raise FileExistsError(path)

    def run(batches: Batches) -> Batches:
        files, folder = _file_system(path)
        files.create_dir(folder, recursive=True)
        at = TaskContext.get()
        name = f"part-{at.partitionId():05d}"
        draft, count = f"{folder}/.{name}-{at.taskAttemptId()}", 0
        with files.open_output_stream(draft) as out:
            for batch in batches:
                for h, b in zip(batch.column("header").to_pylist(), batch.column("block").to_pylist(), strict=True):
                    out.write(encode(h or "", b or b""))
                    count += 1
        files.move(draft, f"{folder}/{name}.warc.gz")
        yield pa.record_batch([pa.array([f"{name}.warc.gz"]), pa.array([count], pa.int64())], names=["file", "records"])

    return sorted(tuple(r) for r in records.select("header", "block").mapInArrow(frugal(run), "file string, records long").collect())


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.rstrip("/")


BROKEN = "broken"


def parse_record(data: bytes) -> tuple[tuple | None, int]:
    """(record, its bytes) of data that starts with "WARC/"; None where it has no header or stops short, with the bytes
    it would take (0: unknown)."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/"):
        return None, 0
    head = data[:end].decode("utf-8", "replace")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split(BREAK)[1:])}
    size = fields.get("content-length", "0") or "0"
    if not size.isdigit() or not fields.get("warc-type"):
        return None, 0
    need = end + 4 + int(size)
    if need > len(data):
        return None, need
    f, block = fields.get, data[end + 4 : need]
    return (f("warc-record-id"), f("warc-type"), f("warc-target-uri"), f("warc-refers-to"), f("warc-date"), f("content-type"), len(block), f("warc-block-digest"), f("warc-payload-digest"), head + BREAK, block), need


def broken_record(data: bytes) -> tuple:
    """Bytes that make no record, kept as they are."""
    return (None, BROKEN, None, None, None, None, len(data), None, None, None, data)


#: What ends a record and starts the next.
NEXT = b"\r\n\r\nWARC/"


def records_of(rows: Iterator[bytes]) -> Iterator[tuple]:
    """Records of a stream that was cut at NEXT. Where a block holds NEXT itself, its parts are put together again as
    long as they do not exceed the stated length; what stays short or too long is broken, and reading goes on behind it."""
    waiting: list[bytes] = []
    for row in rows:
        waiting.append(row)
        yield from _settle(waiting, ended=False)
    yield from _settle(waiting, ended=True)


def _settle(waiting: list[bytes], ended: bool) -> Iterator[tuple]:
    while waiting:
        opened = waiting[0] if waiting[0].startswith(b"WARC/") else b"WARC/" + waiting[0]
        got, need = parse_record(opened)
        used = 1
        if got is None and need > len(opened):
            size = len(opened)
            while used < len(waiting) and size < need and not waiting[used].startswith(b"WARC/"):
                size += len(NEXT) + len(waiting[used])
                used += 1
            whole = size >= need
            if not whole and used == len(waiting) and not ended:
                return  # the rest may still come
            joined = NEXT.join([opened, *waiting[1:used]]) if whole else opened
            got, need = parse_record(joined)
            if got is not None and not joined[need:].strip(b"\r\n"):
                opened = joined
            else:
                got, used = None, 1
        rest = opened[need:] if got is not None else b""
        if got is not None:
            yield got
            if rest.strip(b"\r\n"):
                yield broken_record(rest)
        elif waiting[0].strip(b"\r\n"):
            yield broken_record(opened)
        del waiting[:used]


def members(data: bytes) -> Iterator[bytes]:
    """What the gzip members of data hold, one by one; a member that breaks off gives what could be read, and reading
    goes on at the next one's magic number. Data that is not compressed comes out whole."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while 0 <= at < len(data):
        reader, out, pos = zlib.decompressobj(31), [], at
        try:
            while pos < len(data) and not reader.eof:
                out.append(reader.decompress(data[pos : pos + (1 << 20)]))
                pos += 1 << 20
        except zlib.error:
            pass
        yield b"".join(out)
        at = min(pos, len(data)) - len(reader.unused_data) if reader.eof else at + 1
        at = data.find(b"\x1f\x8b\x08", at)


def scan(spark: SparkSession, path: str, damaged: bool = False) -> DataFrame:
    """The records of WARC files (plain or .gz) as rows of SCHEMA.

    Spark's text reader cuts the stream between records, so a task holds a record at a time and a file may have any size.
    Only a file's beginning tells records from what merely looks like one inside a block, so the parts of a plain file
    that Spark splits are brought together again, in order, before they are read: the records are the same whatever the
    size of splits. Bytes that make no record (no header, no type, a length that does not fit) come as rows
    of record_type `broken` with the bytes in block, and reading goes on behind them; empty files give no rows.
    damaged: for compressed files that do not decompress to their end (which fail otherwise). Each file of at most
    2 GB is then one task's unit, read member by member; a member that breaks off gives a `broken` row too.
    """
    if damaged:

        def whole(batches: Batches) -> Batches:
            for batch in batches:
                for content in batch.column("content"):
                    data = content.as_py() or b""
                    for part in members(data):
                        if part:
                            yield _batch(list(records_of(iter(part.split(NEXT)))))

        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(frugal(whole), SCHEMA)

    def run(batches: Batches) -> Batches:
        held, size = [], 0
        for got in records_of(row.as_py() for batch in batches for row in batch.column("v")):
            held.append(got)
            size += len(got[10])
            if size > 1 << 22 or len(held) == 1000:
                yield _batch(held)
                held, size = [], 0
        yield _batch(held)

    reader = spark.read.option("lineSep", NEXT.decode())
    value = F.col("value").cast("binary").alias("v")
    files = reader.text(path).inputFiles()
    plain = [f for f in files if not f.endswith((".gz", ".bz2", ".zst"))]
    packed = [f for f in files if f not in set(plain)]
    parts = [reader.text(packed).select(value)] if packed or not files else []
    if plain:
        at = F.col("_metadata")
        rows = reader.text(plain).select(value, at.file_path.alias("file"), at.file_block_start.alias("block"), (at.file_block_length < at.file_size).alias("cut"), F.monotonically_increasing_id().alias("row"))
        parts.append(rows.where(~F.col("cut")).select("v"))
        parts.append(rows.where("cut").repartition("file").sortWithinPartitions("file", "block", "row").select("v"))
    return reduce(DataFrame.unionByName, [p.where(F.length("v") > 0).mapInArrow(frugal(run), SCHEMA) for p in parts]) if parts else spark.createDataFrame([], SCHEMA)
