"""Operator 5, WARC archives with revisit resolution.

Payload digests are shuffled without their payloads; of the records with one digest the
one with the largest id is the original response and the others become revisit records
that refer to it.  The archives are then written with fresh headers, one gzip member per
record, and a manifest (the index of a crawl) lists every record's file, offset and length.

Files are written by the tasks straight into a folder all executors share, each under a
name of its own task attempt.  Only what the manifest lists counts: Spark commits the
manifest rows of successful attempts only, so files of a lost or repeated attempt are
never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import hot_split_join, scratch_dir, ship, written

#: An archive file is closed and a new one begun beyond this many bytes.
FILE_BYTES = 256 << 20
CRLF = b"\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _fs(uri: str):
    return pafs.FileSystem.from_uri(uri)


def record_uri(page_id, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>"


def resolve_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """``pages`` as (_doc, _id, _payload, _sha, response_id): which record each row refers to.

    ``response_id`` is null and ``_revisit`` false for rows that stay responses: payloads
    below ``min_bytes``, payloads of one record, and the largest id of each digest.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    wide = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_doc"),
                        F.col(id_col).alias("_id"), payload.alias("_payload"),
                        F.sha1(payload).alias("_sha"),
                        F.octet_length(payload).cast("bigint").alias("_bytes"))
    heads = (wide.where(F.col("_bytes") >= min_bytes).groupBy("_sha", "_bytes")
             .agg(F.max("_id").alias("response_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    heads = written(heads, "headers")
    repeats = heads.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    joined = hot_split_join(wide, heads, ["_sha", "_bytes"], "_n", repeats)
    revisit = F.col("_n").isNotNull() & ~F.col("_id").eqNullSafe(F.col("response_id"))
    return joined.withColumn("_revisit", revisit)


def _record(kind: str, fields: list[tuple[str, bytes]], block: bytes) -> bytes:
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode()]
    head += [k.encode() + b": " + v for k, v in fields]
    head.append(b"Content-Length: " + str(len(block)).encode())
    return CRLF.join(head) + CRLF * 2 + block + CRLF * 2


def _clean(value: str) -> bytes:
    return re.sub(r"[\x00-\x1f\x7f]+", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]),
                  value).encode("utf-8", "surrogatepass")


def _page_record(page_id, url, payload: bytes, revisit: bool, refers, date: bytes) -> bytes:
    digest = base32_sha1(payload)
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(payload)).encode() + CRLF * 2)
    fields = [("WARC-Record-ID", record_uri(page_id, digest).encode()), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    fields += [("WARC-Payload-Digest", b"sha1:" + digest.encode()),
               ("Page-ID", b"" if page_id is None else str(page_id).encode()),
               ("Payload-Length", str(len(payload)).encode()),
               ("Content-Type", b"application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", PROFILE),
                   ("WARC-Refers-To", record_uri(refers, digest).encode())]
        return _record("revisit", fields, http)
    return _record("response", fields, http + payload)


def write_archives(records: DataFrame, folder: str, url_col: str, date: str | None = None) -> DataFrame:
    """Write ``resolve_revisits`` rows as .warc.gz files; returns the written manifest."""
    stamp = (date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")).encode()

    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        out, name, at, number = None, "", 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, payload, revisit, refers in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    name = f"part-{part:05d}-{attempt}-{number:04d}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    info = _record("warcinfo", [
                        ("WARC-Record-ID", f"<urn:file:{name}>".encode()), ("WARC-Date", stamp),
                        ("Content-Type", b"application/warc-fields")],
                        b"format: WARC File Format 1.1\r\n")
                    at = out.write(_gzip(info)) or out.tell()
                    at, number = out.tell(), number + 1
                member = _gzip(_page_record(page_id, url, payload.encode("utf-8", "surrogatepass"),
                                            revisit, refers, stamp))
                out.write(member)
                rows.append((name, at, len(member)))
                at += len(member)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in zip(*rows)], names=["file", "offset", "length"])
        if out is not None:
            out.close()

    cols = records.select("_id", F.col(f"_doc.`{url_col}`").cast("string").alias("_url"), "_payload",
                          "_revisit", "response_id")
    return written(cols.mapInArrow(run, "file string, offset bigint, length bigint"), "manifest")


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(CRLF * 2)
    lines = head.split(CRLF)
    fields = dict(x.decode("utf-8", "replace").split(": ", 1) if b": " in x
                  else (x.decode("utf-8", "replace").rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if not lines[0].startswith(b"WARC/") or rest[size:] != CRLF * 2:
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def read_archives(manifest: DataFrame, folder: str, chunk: int = 512) -> DataFrame:
    """Every record the manifest lists: page_id, record_type, digest, payload_bytes, refers_to, payload.

    A task reads runs of neighbouring records, so several tasks may share a file.  The digest
    of a response is checked against its header.
    """
    ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        name, src = None, None
        for batch in batches:
            rows = []
            for file, at, length in zip(*[c.to_pylist() for c in batch.columns]):
                if file != name:
                    if src is not None:
                        src.close()
                    name, src = file, fs.open_input_file(f"{root}/{file}")
                fields, block = parse_record(zlib.decompress(src.read_at(length, at), 31))
                kind = fields["WARC-Type"]
                payload = block.partition(CRLF * 2)[2] if kind == "response" else None
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(fields["Payload-Length"])
                if payload is not None and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"damaged record in {file} at {at}")
                refers = re.match(r"<urn:page:(-?\d+):", fields.get("WARC-Refers-To", ""))
                rows.append((int(fields["Page-ID"]) if fields["Page-ID"] else None, kind, digest, size,
                             int(refers[1]) if refers else None, payload))
                if len(rows) >= chunk:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return manifest.mapInArrow(run, "page_id bigint, record_type string, payload_digest string, "
                                    "payload_bytes bigint, refers_to bigint, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Write ``pages`` as deduplicated archives and read them back: one row per page.

    A null payload counts as empty and is archived; a null id is archived without one and
    loses against any other as response; a null url leaves the target out.  Rows with the
    same id and the same payload are one capture written twice: where it is the response,
    both are.  Other columns are not read.  An empty table writes nothing and gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    folder = scratch_dir(spark, "warc")
    records = resolve_revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col, min_bytes)
    return read_archives(write_archives(records, folder, url_col, date), folder)
