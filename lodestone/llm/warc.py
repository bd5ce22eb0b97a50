"""WARC archives: one gzip member per record, written and read sequentially.

``write_archives`` turns each task's rows into archives of about ``roll_bytes`` in the shared
folder and returns a manifest (path, records); ``read_archives`` decompresses each archive piece
by piece, frames records by Content-Length, and verifies the SHA-1 of every payload it holds.
Neither side has more than one record and one buffer in memory. An archive's name has the task
attempt in it and only archives of committed attempts are in the manifest, so a retried task
never yields a record twice. Files go through the file system that the folder's URI names.

Of pages with equal payloads, the one with the largest id is written as ``response``, the others
as ``revisit`` records without a payload (null ids are always responses). Null html is an empty
payload. Rows that repeat an id get a record each. A null url is empty, line breaks in one are escaped. Payloads of any length are
records of one member. Extra columns are ignored; an empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, task_count

CRLF = b"\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_fs(uri: str):
    """(file system, path) of a folder or file URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode("utf-8", "replace") for k, v in [*headers, ("Content-Length", str(len(block)))]]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(CRLF.join(lines) + CRLF + CRLF + block + CRLF + CRLF) + z.flush()


def page_record(page_id, url, payload: bytes, refers_to, length: int, digest: str) -> bytes:
    revisit = refers_to is not None
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(length)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return record(head, HTTP_HEAD if revisit else HTTP_HEAD + payload)


def members(stream, size: int = 1 << 16) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    z, out, begun = zlib.decompressobj(31), bytearray(), False
    while data := stream.read(size):
        while data:
            out += z.decompress(data)
            data, begun = b"", True
            if z.eof:
                yield bytes(out)
                data, z, out, begun = z.unused_data, zlib.decompressobj(31), bytearray(), False
    # a member may end before any of its bytes came out
    if begun:
        raise ValueError("the archive ends within a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; the framing must match Content-Length exactly."""
    head, sep, rest = member.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not sep or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != CRLF + CRLF:
        raise ValueError(f"record of {len(rest) - 4} bytes instead of {n}")
    return headers, rest[:n]


def page_of(member: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload)."""
    h, block = parse(member)
    ident = lambda x: int(x[len("<urn:page:"):-1]) if x and x != "<urn:page:>" else None
    digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
    payload = block.partition(CRLF + CRLF)[2]
    if kind == "response" and (payload_digest(payload) != digest or len(payload) != int(h["warc-payload-length"])):
        raise ValueError(f"payload of {h['warc-record-id']} doesn't match its digest")
    return ident(h["warc-record-id"]), int(h["warc-payload-length"]), digest, kind, ident(h.get("warc-refers-to")), payload


def with_references(pages: DataFrame, broadcast_groups: int = 1_000_000) -> DataFrame:
    """(page_id, url, payload, refers_to): the page with the same payload and the largest id, if another.

    Up to ``broadcast_groups`` groups of equal payloads go to the pages, so that no payload is moved and a payload that many pages
    share is no hot key; beyond that they meet in a join.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("d", F.sha2("payload", 256))
    # the digests alone decide; a hot group is one partial row per task
    best = rows.groupBy(F.col("d").alias("g")).agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = cut(best.select("g", "best"))
    joined = rows.join(F.broadcast(best) if best.count() <= broadcast_groups else best, F.col("d") == F.col("g"), "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("best"), F.col("best")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, *, roll_bytes: int = 64 << 20) -> DataFrame:
    """Writes (page_id, url, payload, refers_to) and returns the manifest (path, records)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        sink, written, n, done = None, 0, 0, []
        for batch in batches:
            for page_id, url, payload, refers in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"], strict=True):
                if sink is None:
                    path = f"{root}/{name}-{len(done):05d}.warc.gz"
                    sink, written, n = fs.open_output_stream(path, compression=None), 0, 0
                payload = bytes(payload)
                data = page_record(None if pd.isna(page_id) else int(page_id), url, payload, None if pd.isna(refers) else int(refers), len(payload), payload_digest(payload))
                sink.write(data)
                written, n = written + len(data), n + 1
                if written >= roll_bytes:
                    sink.close()
                    done.append((path, n))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((path, n))
        yield pd.DataFrame(done, columns=["path", "records"])

    ids = rows.select(F.col("page_id").cast("long").cast("string").alias("page_id"), "url", "payload", F.col("refers_to").cast("long").cast("string").alias("refers_to"))
    return ids.mapInPandas(write, "path string, records long")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives in ``manifest``, digests verified."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = open_fs(folder)
        cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

        def frame(rows: list) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=cols)
            return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

        for batch in batches:
            for path, records in zip(batch["path"], batch["records"], strict=True):
                rows, seen = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        rows.append(page_of(member)[:5])
                        seen += 1
                        if len(rows) == 10_000:
                            yield frame(rows)
                            rows = []
                if seen != records:
                    raise ValueError(f"{path} has {seen} of {records} records")
                yield frame(rows)

    tasks = task_count(manifest.sparkSession)
    return manifest.repartition(tasks).mapInPandas(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(cut(write_archives(with_references(pages), folder)), folder)


ORACLE = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
                  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM p
"""
