"""WARC: pages written as archives, and a sequential reader with framing and digest checks.

An archive is a row of a table in the shared folder: whole gzip members, one a record, about `blob_bytes` long. (Spark has
no sink for binary files, and executors share no local folder.) The reader takes an archive as a stream of chunks: it
inflates member by member, frames each record by Content-Length, and checks that the member ends with the record and
that block and payload digests hold.

A payload of at least `revisit_bytes` bytes that several pages share is stored once, by the largest page_id; the others
are revisit records, which hold the HTTP header alone and name that page. Smaller payloads are always stored.

Records of other writers are read too, from `.warc.gz` files by read_files (one gzip member a record; a file is one row, so
at most 2 GB, Spark's limit). The payload is what follows the HTTP header in requests and responses of type
application/http, nothing in revisits, and the block in all others (warcinfo, metadata, resource, dns responses and so on).
Digests are optional: md5, sha1, sha256 and sha512 in base 32 or hex are verified where they are given and the payload is
stored as it was sent (WARC-Truncated and chunked payloads have only their block verified); other algorithms are not.

A null html is an empty payload, a null url an empty target. Rows that repeat the largest page_id are each a response.
A page with a null page_id is a record without a page number: a revisit if a numbered page has its payload, else a
response. An empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.shared import joined, small_batches, table, written

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the pages carry no date


#: Digest algorithms that are verified.
DIGESTS = ("md5", "sha1", "sha256", "sha512")


class BadRecord(ValueError):
    """A record that breaks the framing, or whose digest is wrong."""


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324  the format's own digest


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, level: int = 6) -> bytes:
    """One gzip member."""
    body = b"" if refers_to is not None else payload
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + body
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Block-Digest: {_digest(block)}", f"WARC-Payload-Digest: {_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + 2 * CRLF + block + 2 * CRLF) + pack.flush()


def _headers(raw: bytes, charset: str = "utf-8") -> tuple[str, dict[str, str]]:
    first, *rest = raw.decode(charset, "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in rest)}


def _hex(digest: str) -> tuple[str, str]:
    """Algorithm and hex value of a digest that is labelled and written in base 32 or hex; an unreadable value is ''."""
    name, _, value = digest.partition(":")
    name = name.strip().lower().replace("-", "")
    size = hashlib.new(name).digest_size if name in DIGESTS else 0
    if len(value) == 2 * size and re.fullmatch(r"[0-9A-Fa-f]+", value):
        return name, value.lower()
    try:
        return name, base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    except ValueError:
        return name, ""


def _check(what: str, stated: str | None, data: bytes) -> None:
    if stated:
        name, value = _hex(stated)
        if name in DIGESTS and hashlib.new(name, data).hexdigest() != value:
            raise BadRecord(f"wrong {what} digest")


def _parsed(parts: list[bytes]) -> Record:
    whole = b"".join(parts)
    head, gap, rest = whole.partition(2 * CRLF)
    version, headers = _headers(head)
    if not gap or not version.startswith("WARC/1.") or not headers.get("content-length", "").isdigit() or not headers.get("warc-type"):
        raise BadRecord("no WARC header")
    length = int(headers["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) < length or end != 2 * CRLF:
        raise BadRecord(f"the member does not end where Content-Length {length} says")
    _check("block", headers.get("warc-block-digest"), block)
    kind, http, payload = headers["warc-type"].lower(), {}, block
    if kind in ("request", "response", "revisit") and headers.get("content-type", "").lower().startswith("application/http"):
        head, gap, payload = block.partition(2 * CRLF)
        first, http = _headers(head, "latin-1")
        if block and (not gap or "HTTP/" not in first):
            raise BadRecord("no HTTP header")
    if kind == "revisit":
        return Record(headers, http, b"")
    if "warc-truncated" not in headers and "chunked" not in http.get("transfer-encoding", "").lower():
        _check("payload", headers.get("warc-payload-digest"), payload)
        if kind == "response" and http.get("content-length", "").isdigit() and int(http["content-length"]) != len(payload):
            raise BadRecord("wrong payload length")
    return Record(headers, http, payload)


def read_records(chunks: Iterable[bytes], piece: int = 1 << 16) -> Iterator[Record]:
    """Records of a stream of compressed bytes, with one record in memory at a time."""
    inflate, parts, begun = zlib.decompressobj(31), [], False
    for chunk in chunks:
        for i in range(0, len(chunk), piece):
            left = chunk[i : i + piece]
            while left:
                parts.append(inflate.decompress(left))
                begun, left = True, inflate.unused_data
                if inflate.eof:
                    yield _parsed(parts)
                    inflate, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise BadRecord("the last member is cut off")


def write_archives(pages: DataFrame, revisit_bytes: int = 1000, blob_bytes: int = 4 << 20) -> DataFrame:
    """pages(page_id, url, html) as archives(archive, part, data), a table in the shared folder."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= revisit_bytes
    twice = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("digest", "keep")
    kept = joined(rows.withColumn("digest", F.when(large, F.col("digest")).otherwise(F.concat_ws(" ", F.lit("small"), F.col("page_id").cast("string")))), written(twice, "warc-repeated"), "digest", "left")
    refers = F.when(F.col("keep").isNotNull() & ~F.col("keep").eqNullSafe(F.col("page_id")), F.col("keep")).alias("refers_to")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part, held, size = f"pages-{TaskContext.get().partitionId():05d}", 0, [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([b"".join(held)], pa.binary())], names=["archive", "part", "data"])
        for batch in batches:
            for page_id, url, body, other in zip(*batch.columns, strict=True):
                held.append(record(page_id.as_py(), url.as_py(), body.as_py(), other.as_py()))
                size += len(held[-1])
                if size >= blob_bytes:
                    yield pack()
                    part, held, size = part + 1, [], 0
        if held:
            yield pack()

    return written(kept.select(F.col("page_id").cast("long").alias("page_id"), "url", "payload", refers.cast("long").alias("refers_to")).mapInArrow(task, "archive string, part int, data binary"), "warc-archives")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row a record: page_id, url, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to, record_id, and the payload if asked.

    The digest is computed from the payload. A revisit has none: its length and digest are those that it states (null if
    it states none, or no SHA-1). page_id and refers_to are null for other writers' ids, which record_id holds.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "payload"][: 7 + with_payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: 7 + with_payload]

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def row(r: Record) -> tuple:
        kind, stated = r.headers["warc-type"].lower(), r.http.get("content-length", "")
        if kind == "revisit":
            name, value = _hex(r.headers.get("warc-payload-digest", ""))
            size, digest = int(stated) if stated.isdigit() else None, value if name == "sha1" and value else None
        else:
            size, digest = len(r.payload), hashlib.sha1(r.payload).hexdigest()  # noqa: S324
        own = r.headers.get("warc-record-id")
        return number(own), r.headers.get("warc-target-uri"), size, digest, kind, number(r.headers.get("warc-refers-to")), own, *([r.payload] if with_payload else [])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for data in batch.column("data"):
                rows, held = [], 0
                for r in read_records([data.as_py()]):
                    rows.append(row(r))
                    held += len(r.payload) if with_payload else 200
                    if held >= 4 << 20:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    return archives.where(F.octet_length("data") > 0).select("data").mapInArrow(task, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string" + ", payload binary" * with_payload)


def read_files(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the `.warc.gz` files under a path, in read_archives' columns."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return read_archives(files.select(F.col("content").alias("data")), with_payload)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back from it."""
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).drop("url", "record_id")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT html, max(page_id) AS keep FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM p LEFT JOIN k ON p.html = k.html
"""
