"""WARC archives: a writer with revisit records and a splittable reader (operator 4).

Writer: of records with equal payloads (same SHA-1 and length), the one of largest id is a response and the
others are revisit records that refer to it. The digests alone are grouped, with partial sums before the
shuffle. Each task writes its rows into one archive in the shared folder, a gzip member a record, under a
temporary name that is renamed at the end, so a task that is run again or twice leaves one whole archive.

Reader: archives are cut into byte ranges, and a task reads one. It looks for gzip magic, and validates a
candidate by inflating its beginning to a WARC version line; what looks like magic inside a member doesn't.
It owns the records that start in its range, also if they end beyond it, and after each member expects the
next where that one ends. So any cut gives every record once.

Defined cases: a null or empty payload is a payload of 0 bytes; rows with a null id are responses always, and
never referred to; rows that repeat an id and payload are one page's copies: all responses or all revisits;
an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.common import fresh, map_arrow, written

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
RANGE_BYTES = 32 << 20
#: Tasks that read, one range each; with more ranges, several.
MOST_TASKS = 100_000
DATE = "2024-01-01T00:00:00Z"


# ------------------------------------------------------------------ records
def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "" if page_id is None else str(page_id)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode()}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Bytes: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parsed(data: bytes) -> dict:
    """The fields of an inflated record; payload is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or not lines[0].startswith("WARC/"):
        raise ValueError("a record is cut short")
    number = lambda x: int(x.rpartition(":")[2].rstrip(">")) if x and x.rpartition(":")[2].rstrip(">") else None
    kind = fields.get("warc-type", "")
    payload = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    return {"type": kind, "page_id": number(fields.get("warc-record-id", "")), "url": fields.get("warc-target-uri", ""), "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "bytes": int(fields.get("x-payload-bytes", len(block))), "refers_to": number(fields.get("warc-refers-to", "")), "payload": payload}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ------------------------------------------------------------------ files
def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system that executors and driver reach by the URI."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def marked(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """The pages with __refers: the id of the response that each revisits, else null."""
    digest = F.sha1(F.coalesce(F.col(payload_col), F.lit("")).cast("binary"))
    size = F.octet_length(F.coalesce(F.col(payload_col), F.lit("")))
    one = pages.select(F.col(id_col).cast("long").alias("__id"), digest.alias("__digest"), size.alias("__size")).where((F.col("__size") >= least) & F.col("__id").isNotNull())
    groups = one.groupBy("__digest", "__size").agg(F.max("__id").alias("__last"), F.min("__id").alias("__first"))
    groups = written(groups.where("__first != __last").drop("__first"), "warc-groups")
    rows = pages.select(F.col(id_col).cast("long").alias("__id"), "*", digest.alias("__digest"), size.alias("__size"))
    return rows.join(groups, ["__digest", "__size"], "left").withColumn("__refers", F.expr("if(__id != __last, __last, null)"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write a record for each row; gives (path, bytes, records), one row an archive. least: bytes from which payloads are compared."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    rows = marked(pages, id_col, payload_col, least)
    rows = rows.select("__id", "__refers", (F.col(url_col).cast("string") if url_col in pages.columns else F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))

    def make():
        state: dict = {"n": 0}
        part = TaskContext.get().partitionId()
        final, temporary = f"{path}/part-{part:06d}.warc.gz", f"{path}/.part-{part:06d}-{uuid.uuid4().hex}"
        own, _ = filesystem(folder)

        def run(b: pa.RecordBatch):
            if b.num_rows and "out" not in state:
                state["out"] = own.open_output_stream(temporary, compression=None)
            for page_id, refers, url, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                state["out"].write(record(page_id, url, payload, sha1_base32(payload), refers))
                state["n"] += 1
            return ()

        def close():
            if "out" not in state:
                return
            state["out"].close()
            if isinstance(own, pafs.LocalFileSystem):
                os.replace(temporary, final)
            else:
                own.move(temporary, final)
            uri = f"{folder.rstrip('/')}/{final.rpartition('/')[2]}"
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([own.get_file_info(final).size], pa.int64()), pa.array([state["n"]], pa.int64())], names=["path", "bytes", "records"])

        run.close = close
        return run

    return written(map_arrow(rows, make, "path string, bytes long, records long"), "warc-archives")


def records_in(f: pa.NativeFile, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated record) of the members that start in [start, end).

    Within the range's first bytes candidates are tried until one is a record; from there on, and from a file's
    beginning, each member must follow the one before it, or the archive is damaged or cut off and this raises."""
    buf, base = b"", start  # buf: bytes of the file from base on
    f.seek(start)

    def more() -> bool:
        nonlocal buf
        new = f.read(BLOCK)
        buf += new
        return bool(new)

    at, chained = start, start == 0
    while at < end:
        # find magic at or after `at`
        i = buf.find(MAGIC, at - base)
        if i < 0 and not chained:
            at = max(at, base + len(buf) - len(MAGIC) + 1)
            buf, base = buf[at - base :], at
            if not more():
                return
            continue
        if chained:
            while len(buf) < len(MAGIC) and more():
                pass
            if not buf:
                return  # the file's end
            i = 0
        at = base + i
        if at >= end:
            return
        buf, base = buf[i:], at
        out, used = _inflated(lambda n: (more() if len(buf) < n else True) and buf, size - base)
        if out is None:
            if chained:
                raise ValueError(f"no whole record at {at} of {size} bytes: the archive is damaged or cut off")
            at += 1
            continue
        yield at, out
        at += used
        buf, base, chained = buf[used:], at, True


def _inflated(view, most: int) -> tuple[bytes | None, int]:
    """The record whose member begins the view, and the member's length; (None, 0) if there is none."""
    z = zlib.decompressobj(31)
    out, fed = [], 0
    checked = False
    while not z.eof:
        got = view(fed + 1)
        if not got or len(got) <= fed:
            return None, 0  # ends within a member
        piece = got[fed : fed + (512 if not checked else BLOCK)]
        try:
            out.append(z.decompress(piece))
        except zlib.error:
            return None, 0
        fed += len(piece)
        if not checked and sum(map(len, out)) >= 5:
            if not b"".join(out).startswith(b"WARC/"):
                return None, 0
            checked = True
    if not checked and not b"".join(out).startswith(b"WARC/"):
        return None, 0
    return b"".join(out), fed - len(z.unused_data)


def read_archives(spark: SparkSession, archives: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Records of archives (path, bytes): (path, offset, page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload)."""
    ranges = archives.select("path", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {range_bytes}L)")).alias("start"))
    # a number of its own, or a range's few bytes would have all ranges put together in one task
    ranges = ranges.repartitionByRange(max(1, min(ranges.count(), MOST_TASKS)), "path", "start")

    def make():
        def run(b: pa.RecordBatch):
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, name = filesystem(path)
                rows: list[tuple] = []
                held = 0
                with fs.open_input_file(name) as f:
                    for offset, data in records_in(f, start, min(size, start + range_bytes), size):
                        r = parsed(data)
                        if r["payload"] is not None and (sha1_base32(r["payload"]) != r["digest"] or len(r["payload"]) != r["bytes"]):
                            raise ValueError(f"{path} at {offset}: the payload is not that of its digest")
                        rows.append((path, offset, r["page_id"], r["url"], r["type"], r["digest"], r["bytes"], r["refers_to"], r["payload"] if payloads else None))
                        held += len(data)
                        if held > 8 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

        return run

    return map_arrow(ranges, make, "path string, offset long, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["path", "offset", "page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def all_read(records: DataFrame, archives: DataFrame) -> DataFrame:
    """The records (with their path), once it is certain that of each archive as many were read as were written to it."""
    records = written(records, "warc-records")
    short = archives.join(records.groupBy("path").agg(F.count("*").alias("n")), "path", "left").where(F.coalesce("n", F.lit(0)) != F.col("records")).first()
    if short:
        raise ValueError(f"{short.path}: {short.n or 0} records read, {short.records} written")
    return records


def round_trip(pages: DataFrame, least: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back."""
    spark = pages.sparkSession
    archives = write_archives(pages, fresh(spark, "warc"), least=least)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return all_read(read_archives(spark, archives, range_bytes, payloads=False).select("path", *columns), archives).select(*columns)


# DuckDB has SHA-1 in hexadecimal only; base 32 is spelt out over 8 groups of 5 hexadecimal digits (20 bits, 4 letters).
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, upper(sha1(coalesce(html, ''))) AS x FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INT) + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM p JOIN g ON p.h = g.h
"""
