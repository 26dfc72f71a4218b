"""WARC archives of pages, and the assembly of their transactions.

A capture is three records: a request, a response (or a revisit of an equal payload), and metadata. Request and metadata
name the response in WARC-Concurrent-To; a revisit names the response whose payload it repeats in WARC-Refers-To. Records are
gzip members of one archive a task, written to a temporary name in the shared folder and then moved, so a repeated task
leaves the same archive.

read() takes archives record by record (memory: one record and one piece of _CHUNK bytes); assemble() joins the records of a
capture through their concurrent-to identifiers into one nested row, and captures() joins revisits to their responses through
WARC-Refers-To. Keys are identifiers of single captures, so no group grows but that of the revisits of one payload, which are joined
to a single row.

Defined results: null html is an empty payload; payloads under LEAST bytes are always responses; null page ids work like
others, after all numbers, and null urls are written as empty. Record ids are made of page_id, url and payload, so rows that differ in
any of these are captures of their own; equal rows are captures with equal records, a row each. Of rows with the smallest page_id of
a payload all are responses, and revisits name the one with the smallest url. An empty table makes no archive and no row.
Payloads are held whole, one at a time. Only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, small

LEAST = 100
DATE = "2024-01-01T00:00:00Z"
RECORDS = "record_id string, concurrent_to string, refers_to string, type string, uri string, date string, digest string, payload_bytes long, fields map<string,string>, payload binary"
_CRLF = b"\r\n"
_CHUNK = 1 << 20


def _record(kind: str, record_id: str, uri: str, headers: dict[str, str], content_type: str, block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, "WARC-Target-URI": uri, **headers, "Content-Type": content_type, "Content-Length": str(len(block))}
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + _CRLF + block + _CRLF + _CRLF
    return pack.compress(raw) + pack.flush()


def _line(text: str | None) -> str:
    return " ".join((text or "").split())


def _urn(*parts: object) -> str:
    h = hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def capture(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_to_url: str | None, revisit: bool) -> bytes:
    """The three records of a capture."""
    uri = _line(url)
    main = _urn(page_id, url, digest)
    label = f"sha256:{digest}"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    extra = {"WARC-Payload-Digest": label}
    if revisit:
        extra |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _urn(refers_to, refers_to_url, digest), "WARC-Refers-To-Target-URI": _line(refers_to_url)}
    near = {"WARC-Concurrent-To": main}
    host, _, path = uri.split("://")[-1].partition("/")
    request = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    fields = {} if page_id is None else {"page-id": page_id}
    return (
        _record("request", _urn("request", page_id, url, digest), uri, near, "application/http; msgtype=request", request)
        + _record("revisit" if revisit else "response", main, uri, extra, "application/http; msgtype=response", head if revisit else head + payload)
        + _record("metadata", _urn("metadata", page_id, url, digest), uri, near, "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode())
    )


def write(pages: DataFrame, work: Workspace) -> DataFrame:
    """Archives of pages (page_id, url, html), as a table of path and captures."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # a null page id comes after all numbers
    low = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    shared = rows.where(F.length("payload") >= LEAST).groupBy("digest").agg(low.alias("low"), F.count("*").alias("n")).where("n > 1")
    shared = shared.select("digest", F.col("low.page_id").alias("first_page"), F.col("low.url").alias("first_url"), F.lit(True).alias("shared"))
    shared = work.table(shared, "shared")
    rows = rows.join(small(shared, shared.count()), "digest", "left").select("page_id", "url", "payload", "digest", "first_page", "first_url", (F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_page"))).alias("revisit"))
    root = work.mkdirs("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, folder = fs.FileSystem.from_uri(root)
        task, n, out = TaskContext.get(), 0, None
        name = f"{folder}/part-{task.partitionId():05d}.warc.gz"
        temporary = f"{name}.tmp-{task.taskAttemptId()}"
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or where.open_output_stream(temporary, compression=None)
                out.write(capture(*r))
                n += 1
        if out is not None:
            out.close()
            where.move(temporary, name)
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{task.partitionId():05d}.warc.gz"]), pa.array([n])], ["name", "captures"])

    return work.table(rows.mapInArrow(run, "name string, captures long"), "manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip WARC stream."""
    def pieces() -> Iterator[bytes]:
        unpack, rest = zlib.decompressobj(31), b""
        while data := rest or stream.read(_CHUNK):
            yield unpack.decompress(data, _CHUNK)
            rest = unpack.unconsumed_tail
            if unpack.eof:
                rest, unpack = unpack.unused_data, zlib.decompressobj(31)

    held = bytearray()
    more = pieces()

    def need(n: int) -> bool:
        while len(held) < n:
            piece = next(more, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not need(len(held) + 1):
                return
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        size = int(headers["content-length"])
        if not need(end + 4 + size + 4):
            raise EOFError("a record ends early")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size + 4]
        yield headers, block


def read(manifest: DataFrame, root: str, with_payload: bool = False) -> DataFrame:
    """RECORDS of the archives named in manifest.name under root; a task for each archive."""
    names = manifest.select("name")
    files = names.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        columns = [x.split()[0] for x in RECORDS.split(", ")]
        types = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        where, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0

                def done(rows: list) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], columns)

                with where.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for h, block in records(stream):
                        kind, fields, payload = h["warc-type"], None, None
                        digest, length = h.get("warc-payload-digest", "").rpartition(":")[2] or None, None
                        if kind == "metadata":
                            fields = [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if x]
                        elif kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
                        rows.append((h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), kind, h.get("warc-target-uri"), h.get("warc-date"), digest, length, fields, payload if with_payload else None))
                        size += len(block)
                        if len(rows) >= 5000 or size > 16 * _CHUNK:
                            yield done(rows)
                            rows, size = [], 0
                yield done(rows)

    return names.repartition(max(1, files)).mapInArrow(run, RECORDS)


def assemble(found: DataFrame) -> DataFrame:
    """One row for each capture: record_id, type, uri, date, digest, payload_bytes, payload, refers_to, and request and metadata as structs (null if there is none)."""
    main = found.where("type in ('response', 'revisit')").drop("concurrent_to", "fields")
    def side(kind: str, *columns: str) -> DataFrame:
        rows = found.where(F.col("type") == kind).where("concurrent_to is not null")
        # equal captures have equal identifiers and equal records
        return rows.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.first(F.struct(*columns)).alias(kind))
    return main.join(side("request", "record_id", "uri"), "record_id", "left").join(side("metadata", "record_id", "fields"), "record_id", "left")


def captures(pages: DataFrame, work: Workspace | None = None) -> DataFrame:
    """Archives pages, reads the archives and returns a row for each capture.

    page_id is from its metadata; a revisit's refers_to_page and payload_bytes are those of the response that it names.
    """
    work = work or Workspace(pages.sparkSession, "warc")
    manifest = write(pages, work)
    found = work.table(read(manifest, work.path("archives")), "records")
    rows = assemble(found).withColumn("page_id", F.col("metadata.fields")["page-id"].cast("long"))
    # the responses that are named, one row each, of the records alone
    named = found.where("type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    page = found.where("type = 'metadata'").select(F.col("concurrent_to").alias("record_id"), F.col("fields")["page-id"].cast("long").alias("refers_to_page")).join(named, "record_id").dropDuplicates(["record_id"])
    sizes = found.where("type = 'response'").select("record_id", F.col("payload_bytes").alias("named_bytes")).join(named, "record_id").dropDuplicates(["record_id"])
    target = work.table(sizes.join(page, "record_id", "left").withColumnRenamed("record_id", "refers_to"), "targets")
    out = rows.join(small(target, target.count()), "refers_to", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "named_bytes"))
    return out.select("record_id", *[c for c in out.columns if c not in ("record_id", "named_bytes")])
