"""WARC archives: a writer with one gzip member per record, and a reader that salvages damaged ones.

Archives are written by Spark's own text writer, so that they reach any file system that Spark reaches and
survive lost executors: a row is a member with a record's header and block, and the line separator is a
member with the two line ends that close a record. The reader checks each record: member checksum,
version line, declared length, closing line ends, and digests of block and payload. After a failed check it looks for the
next member or version line from which a record reads well, and logs the bytes between as a gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.skew import attach
from ..plans.storage import materialize, scratch_path

#: Payloads from this size on are stored once; level of compression.
LEAST_SHARED, LEVEL = 100, 5
#: Payloads of up to so many bytes, and how many such records go to a file: so no file has more than 128 MB, or one record.
FILE_RECORDS = {1 << 14: 8192, 1 << 18: 512, 1 << 22: 32, 1 << 40: 1}
VERSION = b"WARC/1.0"
_MAGIC = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "archive string, start long, size long, kind string, record_id string, uri string, payload binary, payload_bytes long, payload_digest string, refers_to string, problem string"


def _member(data: bytes, level: int = LEVEL) -> bytes:
    """One gzip member without time or name, so that equal data give equal bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record_bytes(kind: str, record_id: str, uri: str | None, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """A record without its closing line ends. A revisit has the header of its response, but no payload."""
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "")
    block = _HTTP + (payload if kind == "response" else b"")
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + _END + block


@dataclass
class Record:
    start: int
    size: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    problem: str | None = None


def _parse(data: bytes, at: int) -> tuple[Record, int] | str:
    """The plain record at `at` with the place behind it, or what is wrong with it."""
    if not _VERSION_LINE.match(data, at):
        return "no version line"
    end = data.find(_END, at)
    if end < 0:
        return "header without end"
    if re.search(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", data[at:end]):
        return "control character in header"
    headers: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "header line without colon"
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        return "no content length"
    block = end + len(_END)
    stop = block + int(headers["content-length"])
    if stop > len(data):
        return "block is cut off"
    body = data[block:stop]
    algorithm, _, digest = headers.get("warc-block-digest", "").partition(":")
    if algorithm == "sha256" and hashlib.sha256(body).hexdigest() != digest:
        return "block digest differs"
    if headers.get("content-type", "").startswith("application/http"):
        _, mark, payload = body.partition(_END)
        if not mark:
            return "HTTP header without end"
    else:
        payload = body
    algorithm, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if algorithm == "sha256" and headers.get("warc-type") != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
        return "payload digest differs"
    return Record(at, 0, headers, payload), stop


def _inflate(data: bytes, at: int) -> tuple[bytes, int] | None:
    """A gzip member's content and the place behind it; None if it is damaged or cut off."""
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(data[at : at + (1 << 20)])
        end = at + (1 << 20)
        parts = [out]
        while not d.eof and end < len(data):
            parts.append(d.decompress(data[end : end + (1 << 20)]))
            end += 1 << 20
    except zlib.error:
        return None
    return (b"".join(parts), min(end, len(data)) - len(d.unused_data)) if d.eof else None


def _next_start(data: bytes, at: int) -> int:
    """The next place at which a gzip member or a version line may start, or the end."""
    member = data.find(_MAGIC, at)
    line = _VERSION_LINE.search(data, at)
    found = [x for x in (member, line.start() if line else -1) if x >= 0]
    return min(found, default=len(data))


def read_archive(data: bytes) -> Iterator[Record]:
    """Records of an archive's bytes in order, and gaps (records with a problem). Plain and compressed records may be mixed.

    Empty input gives nothing. Members that hold only line ends close a record and are not reported.
    """
    at, gap, why = 0, -1, ""
    while at < len(data):
        got: tuple[Record, int] | str
        if data.startswith(_MAGIC, at):
            inner = _inflate(data, at)
            if inner is None:
                got = "damaged member"
            elif not inner[0].strip(b"\r\n"):
                if gap < 0:
                    at = inner[1]
                    continue
                got = why
                if data.startswith(_MAGIC, inner[1]) or inner[1] == len(data):  # the gap ends with the separator that it was cut off from
                    yield Record(gap, at - gap, problem=why)
                    gap, at = -1, inner[1]
                    continue
            else:
                got = _parse(inner[0], 0)
                if not isinstance(got, str):
                    got = got[0], inner[1]
        elif gap < 0 and data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        else:
            got = _parse(data, at)
            if not isinstance(got, str) and got[1] < len(data) and not data.startswith((_END, _MAGIC), got[1]):
                got = "record isn't closed"
        if isinstance(got, str):
            if gap < 0:
                gap, why = at, got
            at = _next_start(data, at + 1)
            continue
        if gap >= 0:
            yield Record(gap, at - gap, problem=why)
            gap = -1
        got[0].start, got[0].size = at, got[1] - at
        yield got[0]
        at = got[1]
    if gap >= 0:
        yield Record(gap, len(data) - gap, problem=why)


def _bracketed(x: str | None) -> str | None:
    return x.strip("<>") if x else None


def write_warc(records: DataFrame, path: str, file_records: int = 8192) -> None:
    """Writes records(kind, record_id, uri, payload string, payload_bytes, payload_digest, refers_to) as WARC files of at most so many records below `path`."""

    @F.pandas_udf("binary")
    def member(kind: pd.Series, rid: pd.Series, uri: pd.Series, payload: pd.Series, size: pd.Series, digest: pd.Series, refers: pd.Series) -> pd.Series:
        return pd.Series([_member(record_bytes(k, i, u, p.encode("utf-8", "surrogatepass") if p else b"", s, d, r)) for k, i, u, p, s, d, r in zip(kind, rid, uri, payload, size, digest, refers, strict=True)], dtype=object)

    payload = F.when(F.col("kind") == "response", F.col("payload"))
    members = records.select(member("kind", "record_id", "uri", payload, "payload_bytes", "payload_digest", "refers_to").cast("string").alias("value"))
    members.write.option("lineSep", _member(_END).decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", file_records).text(path)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """RECORD rows of all files below `path`: records, and gaps (kind "gap", with `problem`, `start` and `size`).

    Each file is read whole by one task; archive_pages() bounds its files by bytes. An undamaged archive has no gaps, an
    empty one no rows. Without `payloads` that column is null; its size and digest are still
    taken from the bytes, or for a revisit from its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in RECORD.split(", ")]
        schema = pa.schema([(n, pa.int64() if n in ("start", "size", "payload_bytes") else pa.binary() if n == "payload" else pa.string()) for n in names])
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows: list[tuple] = []
                held = 0
                for r in read_archive(content.as_py()):
                    h = r.headers
                    kind = "gap" if r.problem else h.get("warc-type", "unknown")
                    n, digest = len(r.payload), None
                    if kind == "revisit":
                        n, digest = int(h["x-payload-length"]) if h.get("x-payload-length", "").isdigit() else None, h.get("warc-payload-digest", "").partition(":")[2]
                    elif kind != "gap":
                        digest = hashlib.sha256(r.payload).hexdigest()
                    rows.append((name, r.start, r.size, kind, _bracketed(h.get("warc-record-id")), h.get("warc-target-uri"), r.payload if payloads and kind != "gap" else None, n, digest, _bracketed(h.get("warc-refers-to")), r.problem))
                    held += len(r.payload) if payloads else 100
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD)


def _urn(c: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))


def page_records(pages: DataFrame) -> tuple[DataFrame, list[int]]:
    """Records for write_warc() from pages(page_id, url, html), and the payload bytes of FILE_RECORDS that occur.

    Pages whose payloads are equal and of at least LEAST_SHARED bytes: that of the smallest page_id is a
    response (every row of that id, if it is repeated), the others revisit it. A null html is an empty
    payload; a null page_id is never referred to unless all equal pages lack one, and then all are responses.
    Which pages revisit is decided on ids and digests. The list of them grows with the pages, so it is merged
    with the pages at every size, and not broadcast while it happens to be small.
    """
    html = F.coalesce("html", F.lit(""))
    full = pages.select("page_id", "url", html.alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))
    narrow = materialize(full.select("page_id", "payload_bytes", "payload_digest"), "warc-digests")
    limits = sorted(FILE_RECORDS)
    kind = F.lit(limits[-1])
    for x in reversed(limits[:-1]):
        kind = F.when(F.col("payload_bytes") <= x, x).otherwise(kind)
    there = [r[0] for r in narrow.groupBy(kind.alias("k")).count().collect()]
    large = narrow.filter(F.col("payload_bytes") >= LEAST_SHARED)
    shared = materialize(large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL"), "warc-shared")
    again = attach(large.select("page_id", "payload_digest"), shared, "payload_digest", "n", F.xxhash64("page_id")).filter("first IS NOT NULL AND NOT (page_id <=> first)").distinct()
    again = materialize(again.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_d"), "first"), "warc-revisits")
    rows = full.join(again.hint("merge"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_d")), "left")
    revisit = F.col("first").isNotNull()
    records = rows.select(F.when(revisit, "revisit").otherwise("response").alias("kind"), _urn(F.col("page_id")).alias("record_id"), F.col("url").alias("uri"), "payload", "payload_bytes", "payload_digest", F.when(revisit, _urn(F.col("first"))).alias("refers_to"))
    return records, there


def page_id_of(urn: Column) -> Column:
    """The page_id in a record's name; null for the page without one."""
    return F.when(urn != "urn:page:null", F.substring_index(urn, ":", -1)).cast("long")


def archive_pages(pages: DataFrame, path: str | None = None) -> tuple[str, DataFrame]:
    """Writes the pages' archives and returns their path and their records as read back, gaps included. An empty table gives no records."""
    spark = pages.sparkSession
    where = path or scratch_path(spark, "warc")
    records, there = page_records(pages)
    limits = sorted(FILE_RECORDS)
    for below, most in zip([-1, *limits[:-1]], limits, strict=True):
        if most in there:
            write_warc(records.filter((F.col("payload_bytes") > below) & (F.col("payload_bytes") <= most)), f"{where}/up-to-{most}", FILE_RECORDS[most])
    if not there:
        write_warc(records, f"{where}/empty")
    return where, read_warc(spark, where, payloads=False)


def split_gaps(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of read_warc() rows, which are read once and written. gaps: archive, start, size and problem of each span of bytes in quarantine."""
    held = materialize(records, "warc-records")
    return held.filter("kind <> 'gap'"), held.filter("kind = 'gap'").select("archive", "start", "size", "problem")
