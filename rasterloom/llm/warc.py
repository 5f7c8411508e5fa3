"""WARC archives as chunked record tables.

Writing: every payload becomes rows of record identifier, chunk number and at most CHUNK bytes; tasks get them in
order and stream them into archives, one gzip member per record, so no task builds a whole record. Reading: archives
are streamed back into chunk rows that carry the number and the SHA-1 digest of the payload's bytes so far; the last
row of a record thus has the digest of the full payload. Of records with equal payloads of at least `dedup_bytes`
bytes the one with the smallest identifier is written in full, others as revisits of it.

Archives are files in a folder that all executors share (a local path or any URI that Arrow's file systems open). Each
task attempt writes files of its own name, and the manifest lists those of the attempts that counted, so retries and
lost executors leave no half-written archive in it.

Nulls: a null payload is an empty one; a null identifier sorts after all others and gives a null identifier back, and
records refer to it by null. Rows equal in identifier and payload: the first copy (by URI, null last) is the response
(or revisits the response), each further one revisits it, under its own URI. A URI with control characters, or with white
space at an end, is written percent-encoded beside a field that says so, and read back as it was. Empty payloads are equal to each other. An empty table gives an empty manifest
and no records. Only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise, new_folder, partitions

#: Bytes of a chunk, and of an archive (uncompressed) after which its task begins another.
CHUNK, ARCHIVE = 1 << 16, 1 << 30
#: The chunk number of rows that come after all chunks.
AFTER = (1 << 31) - 1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long, bytes long"
RECORDS = (
    "archive string, record_no long, record_id string, record_type string, target_uri string, refers_to string, "
    "chunk_no int, chunk binary, bytes_so_far long, digest_so_far string, last boolean"
)


def open_folder(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def record_uri(ident: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:record:{'' if ident is None else ident}:{digest}:{copy}>"


_UNSAFE = re.compile(r"[\x00-\x1f\x7f]|^\s|\s$")
_ESCAPED = re.compile(r"[\x00-\x1f\x7f%]|^\s|\s$")
ENCODED = "X-Target-URI-Encoding"


def uri_fields(uri: str | None) -> dict[str, str | None]:
    """Header fields of a URI, none of which can end its line."""
    if uri is None or not _UNSAFE.search(uri):
        return {"WARC-Target-URI": uri}
    escaped = lambda m: "".join(f"%{b:02X}" for b in m[0].encode())
    return {"WARC-Target-URI": _ESCAPED.sub(escaped, uri), ENCODED: "percent"}


def uri_of(fields: dict[str, str]) -> str | None:
    uri = fields.get("warc-target-uri")
    return unquote(uri) if uri and ENCODED.lower() in fields else uri


class _Archive:
    """One gzip member per record, streamed."""

    def __init__(self, files, path: str):
        self.out, self.path, self.records, self.bytes = files.open_output_stream(path, compression=None), path, 0, 0

    def begin(self, fields: dict[str, object], length: int) -> None:
        self.member = zlib.compressobj(1, zlib.DEFLATED, 31)
        head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": length}).items() if v is not None)
        self.put(f"WARC/1.1\r\n{head}\r\n".encode())
        self.records += 1

    def put(self, data: bytes) -> None:
        self.bytes += len(data)
        if packed := self.member.compress(data):
            self.out.write(packed)

    def end(self) -> None:
        self.put(b"\r\n\r\n")
        self.out.write(self.member.flush())


def write_warc(df: DataFrame, id_col: str, payload_col: str, uri_col: str | None = None, dedup_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Write a record per row; returns the manifest (archive, records, bytes), itself in the shared folder."""
    spark = df.sparkSession
    folder = folder or new_folder(spark, "warc")
    base = df.select(
        F.col(id_col).alias("id"), (F.col(uri_col) if uri_col else F.lit(None)).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    # Payloads too small to be shared are written in full each, so equal rows become records of their own.
    small = F.when(F.col("size") < dedup_bytes, F.row_number().over(Window.partitionBy("id", "sha", "size").orderBy("uri")) - 1).otherwise(0) if dedup_bytes > 0 else F.lit(0)
    base = base.withColumn("copy", small)
    # Of an identifier and payload, one URI's row comes before the chunks, the others after them.
    nth = F.row_number().over(Window.partitionBy("id", "sha", "size", "copy").orderBy(F.col("uri").asc_nulls_last()))
    rows = base.groupBy("id", "sha", "size", "copy", "uri").agg(F.count(F.lit(1)).alias("copies")).withColumn("chunk_no", F.when(nth == 1, -1).otherwise(AFTER))
    first = rows.groupBy("sha", "size").agg(F.min("id").alias("first_id"))
    heads = rows.join(first, ["sha", "size"]).select(
        "id", "sha", "copy", "chunk_no", "size", "copies", "uri", F.when(F.col("size") >= dedup_bytes, F.col("first_id")).otherwise(F.col("id")).alias("first_id"),
        F.lit(None).cast("binary").alias("data"),
    )
    last = F.greatest(F.ceil(F.col("size") / CHUNK).cast("int") - 1, F.lit(0))
    none = lambda kind: F.lit(None).cast(kind)
    chunks = base.where("size > 0").select("id", "sha", "copy", "size", "payload", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no")).select(
        "id", "sha", "copy", "chunk_no", "size", none("long").alias("copies"), none("string").alias("uri"), none("long").alias("first_id"),
        F.expr(f"substring(payload, chunk_no * {CHUNK} + 1, {CHUNK})").alias("data"),
    )
    dealt = heads.unionByName(chunks).repartition(partitions(spark), "id", "sha").sortWithinPartitions("id", "sha", "copy", "chunk_no", F.col("uri").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        files.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}"
        done: list[_Archive] = []
        now: _Archive | None = None
        record = None  # of the open one: (bytes still to come, next chunk, function that ends it)

        def close() -> None:
            """End the open record; further copies of its row revisit it."""
            nonlocal record
            if record:
                if record["left"]:
                    raise ValueError(f"record {record['id']}: {record['left']} bytes of its payload are missing")
                if record["open"]:
                    now.end()
                    record["open"] = False
                    record["copies"] -= 1
                while record["copies"]:
                    revisit()

        def fields(kind: str) -> dict[str, object]:
            digest = base64.b32encode(record["sha"]).decode()
            name = record_uri(record["id"], digest, record["written"])
            record["written"] += 1
            return {
                "WARC-Type": kind, "WARC-Record-ID": name, "WARC-Date": date, **uri_fields(record["uri"]), "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response",
            }

        def revisit() -> None:
            record["copies"] -= 1
            refers = record_uri(record["first"], base64.b32encode(record["sha"]).decode())
            now.begin(fields("revisit") | {"WARC-Refers-To": refers, "WARC-Profile": PROFILE, "X-Payload-Length": record["size"]}, len(HTTP))
            now.put(HTTP)
            now.end()

        for b in batches:
            for row in zip(*(b.column(i) for i in range(b.num_columns))):
                ident, sha, copy, no, size, copies, uri, first_id, data = row
                if no.as_py() == AFTER:  # the same record under another URI
                    close()
                    record |= {"uri": uri.as_py(), "copies": copies.as_py()}
                elif no.as_py() < 0:
                    close()
                    if now is None or now.bytes > ARCHIVE:
                        if now:
                            now.out.close()
                        now = _Archive(files, f"{root}/{name}-{len(done):04d}.warc.gz")
                        done.append(now)
                    record = {"id": ident.as_py(), "sha": sha.as_py(), "size": size.as_py(), "uri": uri.as_py(), "first": first_id.as_py(), "next": 0, "copies": copies.as_py(), "written": copy.as_py()}
                    record["open"] = record["id"] == record["first"]
                    record["left"] = record["size"] if record["open"] else 0
                    if record["open"]:
                        now.begin(fields("response"), len(HTTP) + record["size"])
                        now.put(HTTP)
                elif record["open"] and no.as_py() == record["next"]:  # further copies bring the same chunks again
                    now.put(data.as_py())
                    record["left"] -= len(data.as_py())
                    record["next"] += 1
        close()
        if now:
            now.out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{x.path.rpartition('/')[2]}" for x in done], pa.string()), pa.array([x.records for x in done], pa.int64()), pa.array([x.bytes for x in done], pa.int64())],
            ["archive", "records", "bytes"],
        )

    return materialise(dealt.mapInArrow(run, MANIFEST), "manifest")


def read_warc(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """Chunk rows of every archive in the manifest's column `archive`; without payload, rows carry counts and digests only."""

    def records(path: str) -> Iterator[tuple]:
        folder, _, name = path.rpartition("/")
        files, root = open_folder(folder)
        with files.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
            n = 0
            while line := f.readline():
                if not line.strip():
                    continue
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"{path}: record {n} has no version line")
                fields = {}
                while (line := f.readline()).strip():
                    k, _, v = line.rstrip(b"\r\n").decode().partition(":")
                    fields[k.lower()] = v.strip(" \t")
                left, kind = int(fields["content-length"]), fields["warc-type"]
                if fields.get("content-type", "").startswith("application/http"):
                    while line := f.readline():
                        left -= len(line)
                        if not line.strip():
                            break
                said = (path, n, fields.get("warc-record-id"), kind, uri_of(fields), fields.get("warc-refers-to"))
                if kind == "revisit":
                    f.read(left)
                    yield *said, 0, None, int(fields.get("x-payload-length", 0)), fields["warc-payload-digest"].partition(":")[2], True
                else:
                    digest, size, no = hashlib.sha1(), 0, 0
                    while True:
                        chunk = f.read(min(left, CHUNK))
                        left -= len(chunk)
                        digest.update(chunk)
                        size += len(chunk)
                        yield *said, no, chunk if payload else None, size, base64.b32encode(digest.digest()).decode(), not left
                        no += 1
                        if not left:
                            break
                        if not chunk:
                            raise ValueError(f"{path}: record {n} is cut short")
                n += 1

    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        rows, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                for row in records(path):
                    rows.append(row)
                    size += len(row[7] or b"") + 200
                    if size > 8 << 20:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    return manifest.select("archive").repartition(partitions(manifest.sparkSession)).mapInArrow(run, RECORDS)


def record_rows(manifest: DataFrame) -> DataFrame:
    """One row per record: record_id's number, payload_bytes, payload_digest, record_type, refers_to."""
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:record:(-?[0-9]*):', 1) AS long)")
    return read_warc(manifest, payload=False).where("last").select(
        number("record_id").alias("id"), F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")
    )


def _base32(hex_: str) -> str:
    """SQL for the base-32 form of 40 hexadecimal digits: five of them are four characters."""
    value = lambda i: f"CAST(('0x' || substr({hex_}, {5 * i + 1}, 5)) AS BIGINT)"
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({value(i)} >> {s}) & 31 AS INTEGER) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))


ORACLE = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id FROM p
)
SELECT page_id, payload_bytes, {_base32("h")} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
