"""WARC archives without repeated payloads: revisit records refer to the one response that holds the bytes."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.llm.archives import read_files, write_rows
from crawlmill.llm.common import load, shared_path, short_batches, text_or_empty, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Smaller payloads are always stored.
LEAST_BYTES = 1000
#: Compressed records are written in rows of this many bytes, or one record more, and a file has so many rows.
ROW_BYTES, ROWS_PER_FILE = 2 << 20, 24
_RECORD_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"  # gzip of nothing


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_RECORD_SPACE, f'page:{page_id}:{digest}')}>"


def _header_value(text: str) -> str:
    """Header values hold no control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_to_url: str | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit holds the HTTP headers of its capture, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_header_value(refers_to_url)}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member per record, ending in a zero byte (a member's last byte is the top byte of its size)."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = squeeze.compress(data) + squeeze.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def records(content: bytes) -> Iterator[bytes]:
    """The uncompressed records of a file of gzip members."""
    rest = memoryview(content)
    while len(rest):
        reader = zlib.decompressobj(31)
        data = reader.decompress(rest)
        if not reader.eof:
            raise ValueError("an archive ends within a record")
        rest = rest[len(rest) - len(reader.unused_data) :]
        if data:
            yield data


def parse(data: bytes) -> dict:
    """Headers and payload facts of one record; the payload's digest is computed anew and must agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    h = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    if h["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"the payload of {h['WARC-Record-ID']} does not match its headers")
    page = h.get("X-Page-ID")
    return {"page_id": None if page is None else int(page), "url": h.get("WARC-Target-URI"), "record_id": h["WARC-Record-ID"], "record_type": h["WARC-Type"], "payload_digest": digest, "payload_bytes": length, "refers_to_id": h.get("WARC-Refers-To")}


def resolve(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages with payload digest and size, and ref_id and ref_url of the response where a row is a revisit.

    Headers (digest and id, no payload) are grouped by digest; each task sends one row per digest, so a hot payload
    costs little. The groups of two or more then join the pages.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_or_empty("html").alias("html"))
    heads = pages.select("page_id", "url", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= least_bytes)
    best = heads.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("r"), F.count("*").alias("n")).where("n > 1")
    best = written(best.select("digest", F.col("r.page_id").alias("ref_id"), F.col("r.url").alias("ref_url")), "warc-originals")
    marked = pages.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    joined = marked.join(best, "digest", "left")
    return joined.withColumn("revisit", F.col("ref_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("ref_id")))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = "2026-01-01T00:00:00Z", row_bytes: int = ROW_BYTES) -> None:
    """Write pages (page_id, url, html) as gzipped WARC files without repeated payloads, cut by bytes."""
    short_batches(pages.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                (x,) = b.slice(i, 1).to_pylist()
                held.append(member(record(x["page_id"], x["url"], x["html"], x["digest"], x["ref_id"], x["ref_url"], x["revisit"], date)))
                size += len(held[-1])
                if size >= row_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["members"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["members"])

    rows = resolve(pages, least_bytes).withColumn("html", F.col("html").cast("binary"))
    write_rows(rows.select("page_id", "url", "html", "digest", "ref_id", "ref_url", "revisit").mapInArrow(pack, "members binary"), "members", path, "\0", ROWS_PER_FILE)


_HEADERS = "page_id long, url string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to_id string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives, payloads checked against their digests."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = [parse(x) for x in records(content.as_buffer())]
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to_id", pa.string())])
    return read_files(spark, path).select("content").mapInArrow(unpack, _HEADERS)


def resolve_revisits(heads: DataFrame) -> DataFrame:
    """Join revisit records to the responses that they name; refers_to is the response's page_id."""
    heads = written(heads, "warc-headers")
    named = heads.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("k")).distinct()
    firsts = heads.where("record_type = 'response'").join(named, F.col("record_id") == F.col("k"), "left_semi")
    firsts = firsts.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"))
    return heads.join(firsts, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def deduplicated_archives(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages to archives in the shared folder, read them back, and resolve the revisits.

    One row per page row: page_id, payload_bytes, payload_digest, record_type, refers_to, url. A null html is an empty
    payload. Of equal payloads of least_bytes or more the largest page_id is the response; a null page_id is smaller
    than any other, and rows that repeat the response's page_id and payload are responses too. Other columns are
    ignored; no pages give no rows. Where every page_id of a payload is null, each of its rows is a response.
    """
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return resolve_revisits(read_archives(pages.sparkSession, path))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_archives(load(spark, sf_dir, "pages"))


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS m FROM p WHERE n >= {LEAST_BYTES} GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.m > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.m > p.page_id THEN g.m END AS refers_to, u.url
FROM p JOIN pages u USING (page_id) LEFT JOIN g ON p.d = g.d AND p.n >= {LEAST_BYTES}
"""
