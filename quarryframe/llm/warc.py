"""WARC archives as a chunked record table.

Records are written as gzip members (WARC/1.1, an HTTP response block each) into the shared folder, and read back as rows of
(record, chunk number): a payload is never held whole by the reader, each chunk carries the SHA-1 of the payload up to and
with itself, so that the last chunk's is the record's. Equal payloads are written once: the record with the largest
page_id is the response and the others are revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, table, work_path

#: Groups of equal payloads up to this count are broadcast (about 20 MB).
BROADCAST_GROUPS = 200_000
MANIFEST = "path string, n_records long, n_bytes long"
CHUNKS = (
    "path string, record_no long, record_id string, page_id long, url string, record_type string, refers_to long, "
    "declared_digest string, declared_bytes long, chunk_no long, is_last boolean, data binary, bytes_so_far long, digest_so_far string"
)
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
CHUNKS_ARROW = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in CHUNKS.split(", ")])


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def with_record_types(pages: DataFrame, min_bytes: int = 0, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """page_id, url, payload, sha1 (hex), record_type, refers_to.

    Of rows whose payloads are equal and have at least min_bytes bytes, that with the largest page_id is the response. A
    null html is an empty payload; a null page_id is smaller than any; rows that repeat the largest page_id with the same
    payload are responses too."""
    d = columns(pages, page_id="long", url="string", html="string")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    d = d.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    groups = d.filter(F.octet_length("payload") >= min_bytes).groupBy(F.col("sha1").alias("g"), F.octet_length("payload").alias("gn"))
    groups = groups.agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    if groups.limit(broadcast_groups + 1).count() <= broadcast_groups:
        groups = F.broadcast(groups)
    d = d.join(groups, (F.col("sha1") == F.col("g")) & (F.octet_length("payload") == F.col("gn")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return d.select("page_id", "url", "payload", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def _record_head(page_id: int | None, url: str | None, n: int, digest: str, kind: str, refers_to: int | None) -> tuple[bytes, bytes]:
    """The header lines of a record without Content-Length, and the HTTP part of its block."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127))).replace("%", "")))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines.append("Content-Type: application/http; msgtype=response")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
    return "\r\n".join(lines).encode(), http.encode()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path in it. Hadoop's names for an object store are Arrow's s3."""
    for name in ("s3a://", "s3n://"):
        if uri.startswith(name):
            uri = "s3://" + uri[len(name) :]
    return pafs.FileSystem.from_uri(uri) if ":" in uri.partition("/")[0] else (pafs.LocalFileSystem(), uri)


def write_warc(records: DataFrame, path: str, file_bytes: int = 64 << 20, step: int = 1 << 20) -> DataFrame:
    """Writes rows of with_record_types() below path, in files of about file_bytes, and returns the stored manifest.

    A task names its files anew on each attempt, and only files in the manifest of finished tasks are ever read: a task that
    is lost or runs twice leaves an unused file at most."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        out, name, size, count = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, kind, refers_to = (batch.column(c)[i] for c in ("page_id", "url", "payload", "record_type", "refers_to"))
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}")
                body = memoryview(payload.as_buffer())
                head, http = _record_head(page_id.as_py(), url.as_py(), len(body), b32(hashlib.sha1(body).digest()), kind.as_py(), refers_to.as_py())
                if kind.as_py() == "revisit":
                    body = body[:0]
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                size += out.write(z.compress(head + b"\r\nContent-Length: %d\r\n\r\n" % (len(http) + len(body)) + http))
                for at in range(0, len(body), step):
                    size += out.write(z.compress(body[at : at + step]))
                size += out.write(z.compress(b"\r\n\r\n") + z.flush())
                count += 1
                if size >= file_bytes:
                    out.close()
                    done.append((f"{path}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", count, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "n_records", "n_bytes"])

    manifest = f"{path}-manifest"
    records.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(write, MANIFEST).write.parquet(manifest)
    return records.sparkSession.read.schema(MANIFEST).parquet(manifest)


class _Stream:
    """Decompressed bytes of a file of gzip members, read in bounded steps."""

    def __init__(self, raw, step: int):
        self.raw, self.step, self.z, self.pending, self.buffer, self.ended = raw, step, None, b"", bytearray(), False

    def fill(self) -> bool:
        """Adds at most about one step to the buffer; False at the end."""
        while not self.ended:
            if not self.pending:
                self.pending = self.raw.read(self.step)
                if not self.pending:
                    self.ended = True
                    if self.z is not None and not self.z.eof:
                        raise EOFError("a gzip member is cut short")
                    return False
            if self.z is None or self.z.eof:
                self.z = zlib.decompressobj(31)
            more = self.z.decompress(self.pending, self.step)
            self.pending = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if more:
                self.buffer += more
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with mark; None at the end of the file."""
        at, seen = -1, 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self.fill():
                if self.buffer.strip():
                    raise EOFError("a record's header is cut short")
                return None
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, most: int) -> bytes:
        """At least one and at most `most` bytes."""
        if not self.buffer and not self.fill():
            raise EOFError("a record's block is cut short")
        out = bytes(self.buffer[:most])
        del self.buffer[:most]
        return out

    def exactly(self, n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            out += self.take(n - len(out))
        return bytes(out)


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _page(uri: str | None) -> int | None:
    tail = (uri or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def records_of(raw, chunk_bytes: int) -> Iterator[dict]:
    """The chunk rows of one open archive, in order."""
    from urllib.parse import unquote

    s, number = _Stream(raw, min(chunk_bytes, 1 << 20)), 0
    while (head := s.until(b"\r\n\r\n")) is not None:
        h = _headers(head.lstrip())
        left = int(h["content-length"])
        http = s.until(b"\r\n\r\n")
        left -= len(http)
        row = {
            "record_no": number, "record_id": h.get("warc-record-id", "").strip("<>"), "page_id": _page(h.get("warc-record-id")), "record_type": h.get("warc-type"),
            "url": unquote(h["warc-target-uri"]) if "warc-target-uri" in h else None, "refers_to": _page(h.get("warc-refers-to")),
            "declared_digest": h.get("warc-payload-digest", "").partition(":")[2], "declared_bytes": int(_headers(http).get("content-length", left)),
        }
        sha, so_far, chunk_no = hashlib.sha1(), 0, 0
        while True:
            want, piece = min(left, chunk_bytes), bytearray()
            while len(piece) < want:
                piece += s.take(want - len(piece))
            left -= want
            sha.update(piece)
            so_far += want
            yield row | {"chunk_no": chunk_no, "is_last": left == 0, "data": bytes(piece), "bytes_so_far": so_far, "digest_so_far": b32(sha.copy().digest())}
            chunk_no += 1
            if not left:
                break
        if s.exactly(4) != b"\r\n\r\n":
            raise ValueError(f"record {number} doesn't end where its length says")
        number += 1


def read_chunks(manifest: DataFrame, chunk_bytes: int = 256 << 10, files_per_task: int = 1) -> DataFrame:
    """The chunk table of the archives in a manifest (any rows with a path)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, local = file_system(path)
                rows: list[dict] = []
                size = 0
                with fs.open_input_stream(local) as raw:
                    for row in records_of(raw, chunk_bytes):
                        rows.append({"path": path} | row)
                        size += len(row["data"]) + 300
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, CHUNKS_ARROW)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, CHUNKS_ARROW)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts).mapInArrow(read, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from its chunks: digest and length of what was read; a revisit's are those it declares."""
    per = chunks.groupBy("path", "record_no").agg(
        F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("record_type").alias("record_type"), F.first("refers_to").alias("refers_to"),
        F.first("declared_digest").alias("declared_digest"), F.first("declared_bytes").alias("declared_bytes"), F.count("*").alias("n_chunks"),
        F.sum(F.octet_length("data")).alias("n_read"), F.max_by("digest_so_far", "chunk_no").alias("digest"),
    )
    own = F.col("record_type") == "response"
    return per.select(
        "page_id", "url", F.when(own, F.col("n_read")).otherwise(F.col("declared_bytes")).cast("long").alias("payload_bytes"),
        F.when(own, F.col("digest")).otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type", "refers_to", "n_chunks",
        (~own | (F.col("digest") == F.col("declared_digest"))).alias("digest_ok"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_record_types(table(spark, sf_dir, "pages"), min_bytes=0)
    manifest = write_warc(pages, work_path(spark, "warc"))
    return records(read_chunks(manifest)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
m AS (SELECT body, max(page_id) AS keep FROM p GROUP BY body),
h AS (SELECT p.page_id, octet_length(encode(p.body)) AS n, sha1(p.body) AS hex, m.keep FROM p JOIN m ON p.body = m.body)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}', ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM h
"""
