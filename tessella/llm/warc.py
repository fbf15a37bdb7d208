"""WARC archives with revisit resolution.

``resolve_revisits`` shuffles headers, (id, digest) without payload: the digests are grouped (partial sums first, so that a hot
digest arrives as one row a task), the smallest id of each repeated digest becomes the original response, and
the headers of the others, the revisits, are joined to it. Records then find their verdict by id, of which none is hot. ``write_archives`` writes each record as its own gzip member with fresh headers;
a revisit carries no payload. Files are written under names of their own attempt and only those in the manifest
count, so a lost or repeated task leaves no record twice. ``read_archives`` parses by Content-Length and joins nothing.

Defined results: a null payload is empty; payloads under ``least`` bytes are all responses; equal ids with equal
payloads are records of their own, the one that revisits nothing being any of them that has the smallest id; an
empty table gives no files and no rows. Extra columns stay out of the archives.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, drop, join_counted, shared_path, written

LEAST = 100
FILE_BYTES = 64 << 20
MOST_READERS = 10_000
READ = "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, block binary"
_READ_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("block", pa.binary())])
_EMPTY = hashlib.sha256(b"").hexdigest()


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Rows (id, uri, payload, payload_bytes, payload_digest, original): original is the response's id for a revisit, else null."""
    payload = F.coalesce(col(payload_col).cast("string"), F.lit(""))
    records = pages.select(
        col(id_col).alias("id"), col(uri_col).cast("string").alias("uri"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest")
    )
    heads = written(records.filter(F.col("payload_bytes") >= least).select("id", F.unhex("payload_digest").alias("digest")), "headers")
    repeated = written(heads.groupBy("digest").agg(F.min("id").alias("original"), F.count("*").alias("n")).filter("n > 1"), "repeated")
    revisits = join_counted(heads, repeated, "digest", "n", heads.count()).filter("id != original").select("id", "digest", "original").distinct()
    verdicts = written(revisits.withColumnsRenamed({"id": "own", "digest": "d"}), "verdicts")
    drop(heads, repeated)
    return records.join(verdicts, (F.col("id") == F.col("own")) & (F.unhex("payload_digest") == F.col("d")), "left").drop("own", "d")


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def _uri(text: str | None) -> str:
    """The URI with white space and unprintable characters percent-encoded, so that it stays on its header line."""
    return "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in text or "")


def write_archives(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the rows of resolve_revisits as .warc.gz files under path (any URI that pyarrow knows) and gives the manifest (file, records, bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        out, name, n, size, files = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                files.append((name, n, size))
                out = None

        for batch in batches:
            for id_, uri, payload, length, digest, original in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, n, size = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                head = [
                    ("WARC-Type", "response" if original is None else "revisit"),
                    ("WARC-Record-ID", f"<urn:page:{'' if id_ is None else id_}>"),
                    ("WARC-Target-URI", _uri(uri)),
                    ("WARC-Payload-Digest", f"sha256:{digest}"),
                    ("X-Payload-Length", str(length)),
                    ("Content-Type", "text/html; charset=utf-8"),
                ]
                if original is not None:
                    head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{original}>")]
                data = _member(head, b"" if original is not None else payload.encode("utf-8"))
                out.write(data)
                n += 1
                size += len(data)
                if size >= file_bytes:
                    close()
        close()
        columns = list(zip(*files)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    columns = [F.col(c) if c != "id" and c != "original" else F.col(c).cast("string").alias(c) for c in ("id", "uri", "payload", "payload_bytes", "payload_digest", "original")]
    return records.select(*columns).mapInArrow(write, "file string, records long, bytes long")


def parse_members(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a .warc.gz stream, one gzip member each or several, found by Content-Length alone."""
    plain, inflater = bytearray(), zlib.decompressobj(31)
    at = 0

    def records() -> Iterator[tuple[dict[str, str], bytes]]:
        nonlocal at
        while True:
            end = plain.find(b"\r\n\r\n", at)
            if end < 0:
                return
            lines = plain[at:end].decode("utf-8").split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            begin, length = end + 4, int(head["Content-Length"])
            if len(plain) < begin + length + 4:
                return
            yield head, bytes(plain[begin : begin + length])
            at = begin + length + 4

    for chunk in chunks:
        while chunk:
            plain += inflater.decompress(chunk)
            chunk = inflater.unused_data if inflater.eof else b""
            if inflater.eof:
                inflater = zlib.decompressobj(31)
                yield from records()
                del plain[:at]
                at = 0
    yield from records()
    if len(plain) > at:
        raise ValueError("the archive ends inside a record")


def read_archives(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Records of the manifest's files: (record_id, record_type, target_uri, payload_bytes, payload_digest, refers_to, block)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for head, block in parse_members(iter(lambda: f.read(1 << 20), b"")):
                        ref = head.get("WARC-Refers-To")
                        digest = hashlib.sha256(block).hexdigest() if head["WARC-Type"] == "response" else head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if digest != head["WARC-Payload-Digest"].removeprefix("sha256:"):
                            raise ValueError(f"{name}: the payload of {head['WARC-Record-ID']} doesn't match its digest")
                        rows.append((head["WARC-Record-ID"][10:-1] or None, head["WARC-Type"], head["WARC-Target-URI"], int(head["X-Payload-Length"]), digest, ref and ref[10:-1], block))
                        size += len(block)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ_ARROW.types)], schema=_READ_ARROW)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ_ARROW.types)], schema=_READ_ARROW)

    # by number, since adaptive execution would read short rows of file names in one task
    files = max(1, min(MOST_READERS, manifest.count()))
    return manifest.select("file").repartition(files, "file").mapInArrow(read, READ)


def archive(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = LEAST, path: str | None = None) -> tuple[str, DataFrame]:
    """Writes pages as deduplicated archives; gives their folder and manifest (a written table beside them)."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    write_archives(resolve_revisits(pages, id_col, uri_col, payload_col, least), path).write.parquet(f"{path}-manifest")
    return path, spark.read.parquet(f"{path}-manifest")
