"""Legacy web archives: ARC records parsed and converted to WARC, with revisits for repeated payloads.

The converter reads the version-specific header lines of ARC 1 and ARC 2 and the declared lengths, and
synthesises record identifiers, timestamps, types and digests. WARC records are written by Spark as gzipped
files in the shared folder and read back by their declared lengths.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.common import blocks_for, fresh, join_counted, pick, spool, table
from kindred.llm.jaccard_join import by_size

#: Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
FILE_BYTES = 32 << 20


@dataclass
class Record:
    url: str
    ip: str
    date: datetime
    mime: str
    payload: bytes


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_url(url: str | None) -> str:
    """White space would end the header's field, so it's escaped; an ARC record must have some URL."""
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) if b < 128 else f"%{b:02X}" for b in (url or "urn:none").encode("utf-8", "replace")) or "urn:none"


def write_arc(records: list[Record], version: int, name: str = "archive.arc") -> bytes:
    """An ARC file: a version block, then for each record a header line, the payload and a line end."""
    about = f"{version} 0 kindred\n{ARC_FIELDS[version]}\n".encode()
    now = "19960101000000"
    block = lambda *f: " ".join(f).encode() + b"\n"
    if version == 1:
        out = [block(f"filedesc://{name}", "0.0.0.0", now, "text/plain", str(len(about))) + about + b"\n"]
    else:
        out = [block(f"filedesc://{name}", "0.0.0.0", now, "text/plain", "200", "-", "-", "0", name, str(len(about))) + about + b"\n"]
    size = len(out[0])
    for r in records:
        head = [arc_url(r.url), r.ip, r.date.strftime("%Y%m%d%H%M%S"), r.mime]
        if version == 2:
            head += ["200", digest(r.payload), "-", str(size), name]
        out.append(block(*head, str(len(r.payload))) + r.payload + b"\n")
        size += len(out[-1])
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[Record]:
    """The records of an ARC file, by the field names of its own version block. A cut-off or malformed record is an error."""

    def line(at: int) -> tuple[list[str], int]:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"an ARC header line at {at} has no end")
        return data[at:end].decode("latin-1").split(" "), end + 1

    def body(head: list[str], at: int) -> tuple[bytes, int]:
        n = int(head[-1])
        if at + n > len(data):
            raise ValueError(f"an ARC record at {at} declares {n} bytes; {len(data) - at} are left")
        return data[at : at + n], at + n

    head, at = line(0)
    if not head[0].startswith("filedesc://"):
        raise ValueError("an ARC file begins with a filedesc record")
    about, at = body(head, at)
    first, names = about.decode("latin-1").split("\n")[:2]
    version = int(first.split(" ")[0])
    fields = names.split(" ")
    if version not in ARC_FIELDS or fields != ARC_FIELDS[version].split(" "):
        raise ValueError(f"unknown ARC version or fields: {first!r}, {names!r}")
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        head, at = line(at)
        if len(head) != len(fields):
            raise ValueError(f"an ARC {version} header has {len(fields)} fields, not {len(head)}")
        x = dict(zip(fields, head))
        payload, at = body(head, at)
        date = datetime.strptime(x["Archive-date"][:14].ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
        if x.get("Checksum", "-") not in ("-", digest(payload)):
            raise ValueError(f"an ARC record's checksum differs from that of its payload: {x['URL']}")
        yield Record(x["URL"], x["IP-address"], date, x["Content-type"], payload)


def record_id(page_id: int | None, nth: int, payload: bytes = b"") -> str:
    """A UUID that carries the page's number, which copy of it this is, and some bits of the payload's digest."""
    tag = int.from_bytes(hashlib.sha1(payload).digest()[:4], "big") >> 4
    sign = 2 if page_id is None else int(page_id < 0)
    return str(uuid.UUID(int=(8 << 76) | (2 << 62) | tag << 100 | (nth & 0xFFFFF) << 80 | sign << 70 | abs(page_id or 0) & ((1 << 62) - 1) | (abs(page_id or 0) >> 62) << 68))


def page_of(record: str) -> int | None:
    n = uuid.UUID(record).int
    sign, size = n >> 70 & 3, n & ((1 << 62) - 1) | (n >> 68 & 3) << 62
    return None if sign == 2 else -size if sign == 1 else size


def write_warc(r: Record, own_id: str, refers_to: str | None) -> bytes:
    """A response with the payload, or a revisit that names the response and keeps length and digest only."""
    block = b"" if refers_to else r.payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{own_id}>",
        f"WARC-Date: {r.date.strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Target-URI: {r.url}",
        f"WARC-IP-Address: {r.ip}",
        f"WARC-Payload-Digest: sha1:{digest(r.payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(r.payload)}",
        f"Content-Type: {r.mime}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        head += [f"WARC-Refers-To: <urn:uuid:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by the declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"a WARC record at {at} is cut off")
        yield head, block
        at = end + 8 + n


def convert(arc: bytes, identify: Callable[[int, Record], tuple[str, str | None]]) -> Iterator[bytes]:
    """An ARC file's records as WARC records; ``identify`` gives each its identifier and what it refers to."""
    for k, r in enumerate(read_arc(arc)):
        yield write_warc(r, *identify(k, r))


def member(record: bytes) -> bytes:
    """A gzip member. Its last byte is 0, which the writer adds as its line end: that is the uppermost of the length
    in four bytes, and an empty member follows one whose length needs it."""
    pack = lambda x: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + z.flush()
    out = pack(record)
    return out if out[-1] == 0 else out + pack(b"")


def members(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """What the gzip members of a file hold, one after another."""
    at = 0
    while at < len(data):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            chunk = data[at : at + step]
            if not chunk:
                raise ValueError("a gzip member is cut off")
            parts.append(one.decompress(chunk))
            at += len(chunk)
        at -= len(one.unused_data)
        yield b"".join(parts)


def plan(pages: DataFrame, least_bytes: int, parts: int) -> DataFrame:
    """``page_id, url, html, copy, revisit, first`` in ``parts`` partitions: which response each page revisits, if any.

    Digests alone decide; pages move once, by page, so that a payload that a third of them share isn't gathered.
    """
    body = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit(""))).withColumn("sha", F.unhex(F.sha2("html", 256)))
    small = body.select("page_id", "sha", F.octet_length("html").alias("bytes")).where(F.col("bytes") >= least_bytes)
    known = spool(small.groupBy("page_id", "sha").agg(F.count(F.lit(1)).alias("copies")), "digests")
    first = spool(known.groupBy("sha").agg(F.min("page_id").alias("first"), F.sum("copies").alias("times"), F.count(F.lit(1)).alias("ids")).where("times > 1").drop("times"), "first")
    # null ids are told from 0 by a column of their own
    keys = ["key", "none", "sha"]
    keyed = lambda df: df.withColumn("key", F.coalesce("page_id", F.lit(0))).withColumn("none", F.col("page_id").isNull())
    each = keyed(join_counted(known.select("page_id", "sha"), first, "sha", "ids")).select(*keys, "first", F.lit(True).alias("shared"))
    # the window and the join below keep this partitioning
    whole = keyed(body).repartition(parts, *keys)
    numbered = whole.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy("url")))
    joined = numbered.join(each, keys, "left")
    is_first = (F.col("copy") == 1) & F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "copy", (F.coalesce("shared", F.lit(False)) & ~is_first).alias("revisit"), "first")


def to_members(planned: DataFrame) -> DataFrame:
    """One WARC record a row, as a gzip member without its last byte. Pages go through ARC files, odd batches as ARC 1 and even ones as ARC 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        date = datetime(1999, 12, 31, 23, 59, 59, tzinfo=timezone.utc)
        for n, b in enumerate(x for whole in batches for x in by_size(whole, "html")):
            rows = b.to_pylist()
            arc = write_arc([Record(r["url"], "0.0.0.0", date, "text/html", r["html"].encode("utf-8", "replace")) for r in rows], 1 + n % 2)

            def identify(k: int, x: Record) -> tuple[str, str | None]:
                r = rows[k]  # noqa: B023
                return record_id(r["page_id"], r["copy"], x.payload), record_id(r["first"], 1, x.payload) if r["revisit"] else None

            yield pa.RecordBatch.from_arrays([pa.array([member(w)[:-1] for w in convert(arc, identify)], pa.binary())], ["value"])

    return planned.mapInArrow(run, "value binary")


def read_back(files: DataFrame) -> DataFrame:
    """A row for each record of gzipped WARC files (``content``); a response whose payload has another digest than its header is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (c for b in batches for c in b.column("content")):
            out = []
            for head, block in (x for m in members(content.as_py() or b"") for x in read_warc(m)):
                sha, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                if kind == "response" and digest(block) != sha:
                    raise ValueError(f"damaged payload in {head['warc-record-id']}")
                to = head.get("warc-refers-to")
                out.append((page_of(head["warc-record-id"][10:-1]), int(head["x-payload-length"]), sha, kind, page_of(to[10:-1]) if to else None))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.mapInArrow(run, SCHEMA)


def archive(pages: DataFrame, at: str, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as gzipped WARC files below ``at``; returns what reading them back gives.

    A null html is an empty payload. Of equal payloads of at least ``least_bytes`` the smallest page_id is the
    response; among repeated rows of that page, the first by url. Null page_ids come last, and are written. An
    empty table gives an empty result. Extra columns are ignored.
    """
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    planned = plan(pages, least_bytes, blocks_for(total, FILE_BYTES, least=8))
    # the text writer writes bytes as they are, with a line end after each record: the last byte of its member
    to_members(planned).select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(at)
    return read_back(pages.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at).select("content"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"), fresh(spark, "warc"))


OP7_SQL = """
-- DuckDB has no base32, so the digest's five-bit groups are looked up one by one
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x FROM p),
b AS (SELECT page_id, h, x, list_reduce(list_transform(range(0, 40), lambda i: format('{:04b}', instr('0123456789abcdef', x[i + 1]) - 1)), lambda a, c: a || c) AS bits FROM d),
r AS (SELECT page_id, h, list_reduce(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT]), lambda a, c: a || c) AS digest,
  min(page_id) OVER (PARTITION BY h) AS first FROM b)
SELECT page_id, strlen(h) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM r
"""
