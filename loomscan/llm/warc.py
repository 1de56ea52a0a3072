"""WARC archives as chunked record tables.

A payload passes as rows (record, chunk number, data) whose digest grows with every chunk: a page's bytes are sliced where
they lie, the writer appends each slice to a gzip member, and the reader yields chunk rows again, so that no step puts a
record together. What a record is (a response, or a revisit of an equal payload) follows from values alone, page_id and
digest, never from row numbers: a task that runs again, or in another order, writes the same records. Archives are
written through the file system of their URI into a shared folder; a file counts only once its line is in the manifest.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.plans.shared import materialize, new_path

CHUNK_BYTES = 1 << 16
FILE_BYTES = 1 << 28
BATCH_BYTES = 1 << 22
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payloads(column) -> Iterator[memoryview]:
    """The bytes of each text where they lie in the batch; null texts are empty."""
    for x in column:
        yield memoryview(x.as_buffer()) if x.is_valid else memoryview(b"")


def _digest(payload: memoryview) -> str:
    digest = hashlib.sha256()
    for at in range(0, len(payload), CHUNK_BYTES):
        digest.update(payload[at : at + CHUNK_BYTES])
    return digest.hexdigest()


def _digested(names: list[str]):
    """Adds payload_bytes and payload_digest of html; keeps the named columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for x in _payloads(batch.column("html")):
                sizes.append(len(x))
                digests.append(_digest(x))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=[*names, "payload_bytes", "payload_digest"])

    return work


def plan_records(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Rows of (page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of at least min_bytes, rows of the least page_id are responses and the others revisit it. A row
    without a page_id is a response unless a page has its payload. Only payloads that several pages share are looked up.
    """
    sized = pages.select("page_id", "html").mapInArrow(_digested(["page_id"]), "page_id long, payload_bytes long, payload_digest string")
    shared = sized.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("payload_digest", "first")
    # written, so that its size is known before the pages are dealt: a small table is sent to them instead
    firsts = materialize(shared, "payloads")
    rows = pages.select("page_id", "url", "html").mapInArrow(_digested(["page_id", "url", "html"]), "page_id long, url string, html string, payload_bytes long, payload_digest string")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "payload_digest", "left").select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


PLANNED = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "html")
CHUNKS = "record string, page_id long, url string, record_type string, refers_to long, declared_bytes long, declared_digest string, chunk int, data binary, bytes_so_far long, digest string, last boolean"
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
_COLUMNS = [x.split() for x in CHUNKS.split(", ")]


def _rows_to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), _COLUMNS, strict=True)], names=[n for n, _ in _COLUMNS])


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, so that a revisit can name the record it refers to; random without a page."""
    return str(uuid.uuid4() if page_id is None else uuid.UUID(hashlib.sha256(f"{page_id} {digest}".encode()).hexdigest()[:32]))


def _chunk_rows(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple]:
    """Rows of the chunk table, each slice copied when it is reached; the digest grows with the slices of a payload."""
    for batch in batches:
        about = batch.select([c for c in batch.schema.names if c != "html"]).to_pylist()
        for row, payload in zip(about, _payloads(batch.column("html")), strict=True):
            if row["record_type"] == "revisit":
                payload = memoryview(b"")
            name = record_id(row["page_id"], row["payload_digest"])
            fixed = (name, row["page_id"], row["url"], row["record_type"], row["refers_to"], row["payload_bytes"], row["payload_digest"])
            digest, seen = hashlib.sha256(), 0
            for chunk, at in enumerate(range(0, max(1, len(payload)), chunk_bytes)):
                part = payload[at : at + chunk_bytes]
                digest.update(part)
                seen += len(part)
                last = seen == len(payload)
                yield (*fixed, chunk, part.tobytes(), seen, digest.hexdigest() if last else None, last)


def chunked(planned: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Planned rows to the chunk table, the rows of a record in order and together; digest is set in the last chunk. Revisits have one empty chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in _chunk_rows(batches, chunk_bytes):
            rows.append(row)
            held += len(row[8]) + 200
            if held >= BATCH_BYTES:
                yield _rows_to_batch(rows)
                rows, held = [], 0
        if rows:
            yield _rows_to_batch(rows)

    return planned.select(*PLANNED).mapInArrow(work, CHUNKS)


def _head(row: dict, date: str) -> bytes:
    own = row["record_type"] == "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['declared_bytes']}\r\n\r\n"
    fields = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<urn:uuid:{row['record']}>",
        "WARC-Date": date,
        "WARC-Target-URI": (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{row['declared_digest']}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(http) + (row["declared_bytes"] if own else 0),
        "X-Page-ID": "" if row["page_id"] is None else row["page_id"],
        "X-Payload-Length": row["declared_bytes"],
    }
    if not own:
        fields |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<urn:uuid:{record_id(row['refers_to'], row['declared_digest'])}>", "X-Refers-To-Page": row["refers_to"]}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n" + http).encode("utf-8", "surrogatepass")


#: Schemes by which Spark's connectors name stores that Arrow's file systems know by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI and the path in it: local, S3, Google and Azure stores by Arrow itself, HDFS where libhdfs is."""
    scheme, colon, rest = folder.partition("://")
    return pafs.FileSystem.from_uri(SCHEMES.get(scheme.lower(), scheme) + colon + rest)


def _written(rows: Iterator[tuple], folder: str, date: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Appends chunk rows to archives, a gzip member a record; gives a manifest row for each file that is closed."""
    system, base = file_system(folder)
    names = [n for n, _ in _COLUMNS]
    number, data = names.index("chunk"), names.index("data")
    out = path = zipper = None
    size = records = 0

    def put(part: bytes):
        nonlocal size
        out.write(part)
        size += len(part)

    def close_member():
        nonlocal zipper
        if zipper is not None:
            put(zipper.compress(_END) + zipper.flush())
            zipper = None

    def manifest():
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    for row in rows:
        if row[number] == 0:
            close_member()
            if out is not None and size > file_bytes:
                out.close()
                yield manifest()
                out = None
            if out is None:
                system.create_dir(base, recursive=True)
                path, size, records = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                out = system.open_output_stream(path, compression=None)
            zipper = zlib.compressobj(1, zlib.DEFLATED, 31)
            put(zipper.compress(_head(dict(zip(names, row, strict=True)), date)))
            records += 1
        put(zipper.compress(row[data]))
    close_member()
    if out is not None:
        out.close()
        yield manifest()


_MANIFEST = "path string, records long, bytes long"


def _now() -> str:
    return dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_chunks(chunks: DataFrame, folder: str, date: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a chunk table, the rows of a record in order and together, as gzipped WARC files under folder; returns the manifest (path, records, bytes).

    date is every record's WARC-Date, by default the time of the call.
    """
    date = date or _now()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        return _written(rows, folder, date, file_bytes)

    return materialize(chunks.select(*[n for n, _ in _COLUMNS]).mapInArrow(work, _MANIFEST), "manifest")


def write_warc(pages: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = 100, date: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of (page_id, url, html), its chunks passing straight to the file; returns the manifest."""
    date = date or _now()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _written(_chunk_rows(batches, chunk_bytes), folder, date, file_bytes)

    return materialize(plan_records(pages, min_bytes).select(*PLANNED).mapInArrow(work, _MANIFEST), "manifest")


def _bytes(source, step: int) -> Iterator[tuple[bytes, bool]]:
    """(data, member ended) of a file of gzip members."""
    unzip, data = zlib.decompressobj(31), b""
    while True:
        if not data:
            data = source.read(step)
            if not data:
                return
        out = unzip.decompress(data, step)
        if unzip.eof:
            yield out, True
            data, unzip = unzip.unused_data, zlib.decompressobj(31)
        else:
            data = unzip.unconsumed_tail
            yield out, False


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def records_of(source, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """Chunk rows of a WARC file: header fields, chunk number, data, bytes and digest so far, last. HTTP heads are taken off payloads."""
    head, http, buffer, left, chunk, digest, seen = None, False, b"", 0, 0, None, 0
    for data, ended in _bytes(source, chunk_bytes):
        buffer += data
        if head is None and (at := buffer.find(_END)) >= 0:
            head = _fields(buffer[:at])
            buffer, left, chunk, seen, digest = buffer[at + 4 :], int(head["content-length"]), 0, 0, hashlib.sha256()
            http = left > 0 and head.get("content-type", "").startswith("application/http")
            if not left:
                yield {"head": head, "chunk": 0, "data": b"", "seen": 0, "digest": digest.hexdigest(), "last": True}
        if head is not None and http and (at := buffer[:left].find(_END)) >= 0:
            buffer, left, http = buffer[at + 4 :], left - at - 4, False
            if not left:
                yield {"head": head, "chunk": 0, "data": b"", "seen": 0, "digest": digest.hexdigest(), "last": True}
        if head is not None and not http and left and buffer:
            part, buffer = buffer[:left], buffer[left:]
            digest.update(part)
            seen, left = seen + len(part), left - len(part)
            yield {"head": head, "chunk": chunk, "data": part, "seen": seen, "digest": digest.hexdigest() if not left else None, "last": not left}
            chunk += 1
        if ended:
            head, buffer = None, b""


def read_warc(manifest: DataFrame, folder: str, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in manifest.

    digest is that of the payload read, set in a record's last chunk; declared_bytes and declared_digest are what the
    record's header says of the full payload. Without with_data only last chunks are returned, and no data.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                with system.open_input_stream(path, compression=None) as source:
                    for x in records_of(source):
                        if not (with_data or x["last"]):
                            continue
                        h = x["head"]
                        refers = h.get("x-refers-to-page")
                        rows.append((
                            h["warc-record-id"][10:-1], int(h["x-page-id"]) if h["x-page-id"] else None, h["warc-target-uri"], h["warc-type"], int(refers) if refers else None, int(h["x-payload-length"]),
                            h["warc-payload-digest"].split(":")[1], x["chunk"], x["data"] if with_data else None, x["seen"], x["digest"], x["last"],
                        ))
                        if len(rows) >= (64 if with_data else 4096):
                            yield _rows_to_batch(rows)
                            rows = []
                if rows:
                    yield _rows_to_batch(rows)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(work, CHUNKS)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) and reads the archives back.

    One row per row: page_id, payload_bytes, payload_digest, record_type, refers_to. Responses give what was read from
    their payload, revisits what their header declares of it. Null html is an empty payload; empty and short payloads are all
    responses. Repeated rows of a least page_id are all responses, under one record id. Other columns are ignored.
    """
    folder = new_path(spark, "warc")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"))
    back = read_warc(write_warc(rows, folder, min_bytes=min_bytes), folder, with_data=False).where("last")
    own = F.col("record_type") == "response"
    return back.select("page_id", F.when(own, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"), F.when(own, F.col("digest")).otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type", "refers_to")
