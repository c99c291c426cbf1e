"""Legacy archives to WARC: ARC records of versions 1 and 2 are parsed and written again as WARC/1.1 records.

An ARC file begins with a version block, whose third line names the fields of each record's header line; a record
is that line, a line feed, as many bytes as the line's last field declares, and a line feed. The version block becomes a
``warcinfo`` record, HTTP responses become ``response`` records and all else (DNS answers, say) ``resource`` records, each
with an id made from its archive and its place there, a timestamp and SHA-1 digests. Of HTTP records with equal payloads
one is written whole and the others as revisits that name it: that with the largest key, which a header of its own
gives, and among records without keys that with the latest date.

Archives are written by Spark's text sink, one file a task, a record a row, with the record's final CRLF CRLF as the
line separator; bytes go through as they are. They are read with the binary source and cut by declared lengths, so
payloads may hold anything. Records are dealt to files by an even hash, and a file holds about ``ARCHIVE_BYTES``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch_path, table, written

ARCHIVE_BYTES = 32 << 20
ARC_BYTES = 4 << 20
# The field lines of the two versions of the format.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\nX-Record-Key: {key}\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str | None, default: str) -> str:
    """A header field: no blanks, no line ends."""
    return re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", value) if value else default


def arc_record(key, url: str | None, payload: bytes, version: int = 1, date: str = "20000101000000") -> bytes:
    block = HTTP.format(size=len(payload), key="" if key is None else key).encode() + payload
    head = f"{_clean(url, 'unknown:')} 0.0.0.0 {date} text/html "
    head += "" if version == 1 else "200 - - 0 pages.arc "
    return (head + f"{len(block)}\n").encode() + block + b"\n"


def arc_preamble(version: int = 1, date: str = "20000101000000") -> bytes:
    body = f"{version} 0 Archive\n{FIELDS[version]}\n"
    extra = "" if version == 1 else "200 - - 0 pages.arc "
    return f"filedesc://pages.arc 0.0.0.0 {date} text/plain {extra}{len(body)}\n{body}\n".encode()


def parse_arc(content: bytes) -> Iterator[dict]:
    """Header fields, block and offset of each record, the version block first (without URL). Raises ValueError where a length can't hold."""
    at, names = 0, None
    while at < len(content):
        end = content.find(b"\n", at)
        line = content[at:end if end >= 0 else len(content)].decode("utf-8", "replace").rstrip("\r")
        if not line.strip() and end >= 0:  # blank lines between records
            at = end + 1
            continue
        values = line.split(" ")
        if end < 0 or not values[-1].isdigit() or end + 1 + int(values[-1]) > len(content):
            raise ValueError(f"bad ARC record header at byte {at}: {line[:200]!r}")
        block = content[end + 1:end + 1 + int(values[-1])]
        here, at = at, end + 1 + len(block)
        if names is None:
            if not line.startswith("filedesc:"):
                raise ValueError("an ARC file begins with a version block")
            names = block.decode("utf-8", "replace").split("\n")[1].strip().split(" ")
            yield {"URL": None, "Archive-date": values[2] if len(values) > 2 else "", "Content-type": "text/plain", "block": block, "offset": here}
            continue
        if len(values) != len(names):  # blanks inside the URL
            values = [" ".join(values[: len(values) - len(names) + 1]), *values[len(values) - len(names) + 1:]]
        if len(values) != len(names):
            raise ValueError(f"an ARC header line of {len(values)} fields, not {len(names)}: {line[:200]!r}")
        yield dict(zip(names, values)) | {"block": block, "offset": here}


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/{offset}')}>"


def warc_date(arc_date: str) -> str:
    d = (arc_date + "00000101000000"[len(arc_date):])[:14] if arc_date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(r: dict) -> bytes:
    """Without the CRLF CRLF that ends it. ``keeper`` is the id of the record that this one revisits; a revisit holds the HTTP headers alone."""
    block, revisit = r["block"], r["keeper"] is not None
    if revisit:
        block = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
    kind = "revisit" if revisit else {"info": "warcinfo", "http": "response"}.get(r["kind"], "resource")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {r['rid']}", f"WARC-Date: {r['date']}"]
    if r["url"] is not None:
        head += [f"WARC-Target-URI: {r['url']}", f"WARC-Payload-Digest: sha1:{r['digest']}", f"WARC-Payload-Length: {r['size']}"]
    if r["key"] is not None:
        head.append(f"WARC-Record-Key: {r['key']}")
    if revisit:
        head += [f"WARC-Refers-To: {r['keeper']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [] if r["keeper_key"] is None else [f"WARC-Refers-To-Key: {r['keeper_key']}"]
    content = {"info": "application/warc-fields", "http": "application/http; msgtype=response"}.get(r["kind"], r["content_type"])
    head += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers by lower-case name and block of each record; the file is plain or gzip, of one or many members."""
    f = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := f.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:80]!r}")
        head = {}
        while (line := f.readline().rstrip(b"\r\n")):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        block = f.read(size)
        if len(block) < size:
            raise ValueError("a WARC record ends before its declared length")
        yield head, block


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", version: int = 1) -> DataFrame:
    """(content): ARC archives of about ``ARC_BYTES`` with one record for each row of ``pages``."""

    def pack(batches):
        for b in batches:
            parts, size = [arc_preamble(version)], 0
            for key, url, html in zip(b["key"].to_pylist(), b["url"].to_pylist(), b["html"].to_pylist()):
                parts.append(arc_record(key, url, (html or "").encode(), version))
                size += len(parts[-1])
                if size >= ARC_BYTES:
                    yield pa.record_batch({"content": pa.array([b"".join(parts)], pa.binary())})
                    parts, size = [arc_preamble(version)], 0
            if size:
                yield pa.record_batch({"content": pa.array([b"".join(parts)], pa.binary())})

    return pages.select(F.col(f"`{id_col}`").cast("long").alias("key"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(pack, "content binary")


RECORD = "rid string, kind string, key long, url string, date string, content_type string, digest string, size long, block binary"
RECORD_TYPES = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())


def _table(rows: list[tuple], schema: str, types: tuple) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.record_batch({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types))})


def arc_records(archives: DataFrame) -> DataFrame:
    """Rows of ``RECORD`` for all records of ARC files in ``archives.content``, plain or gzip; null contents have none.

    ``kind`` is info for a version block, http for a block that begins with an HTTP status line, else other; the payload,
    of which digest and size are, is what follows the HTTP headers, or the whole block. Ids are made from an archive's bytes
    and row and the record's place, so archives of equal bytes have records of their own; store the rows before using them
    twice, as rows have other numbers when they are dealt otherwise.
    """

    def parse(batches):
        for b in batches:
            for content, number in zip(b["content"].to_pylist(), b["number"].to_pylist()):
                if not content:
                    continue
                if content[:2] == b"\x1f\x8b":
                    content = gzip.decompress(content)
                rows, archive = [], f"{hashlib.sha1(content).hexdigest()}/{number}"
                for r in parse_arc(content):
                    block, kind = r["block"], "info" if r["URL"] is None else "http" if r["block"].startswith(b"HTTP/") else "other"
                    if kind == "info":
                        block = b"software: archive converter\r\nformat: WARC File Format 1.1\r\ndescription: " + block.split(b"\n")[0].strip() + b"\r\n"
                    head, payload = http_parts(block) if kind == "http" else ({}, block)
                    key = head.get("x-record-key") or None
                    rows.append((record_id(archive, r["offset"]), kind, None if key is None else int(key), r["URL"], warc_date(r["Archive-date"]), _clean(r["Content-type"], "application/octet-stream"), base32_sha1(payload), len(payload), block))
                yield _table(rows, RECORD, RECORD_TYPES)

    return archives.select("content", F.monotonically_increasing_id().alias("number")).mapInArrow(parse, RECORD)


def write_warc(records: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes ``records`` (of ``arc_records``) as gzip WARC files under ``path``.

    HTTP payloads of at least ``min_bytes`` that stand more than once are written once. Records of the largest key are
    all written whole, should it stand more than once.
    """
    brief = records.where("kind = 'http'").select("rid", "key", "date", "digest", "size")
    best = brief.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max(F.struct("key", "date", "rid")).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = best.select("digest", F.col("b.rid").alias("keeper"), F.col("b.key").alias("keeper_key"))
    keeps = F.col("key").eqNullSafe(F.col("keeper_key")) & (F.col("key").isNotNull() | (F.col("rid") == F.col("keeper")))
    moved = written(brief.join(best, "digest").where(~keeps).select("rid", "keeper", "keeper_key"), "revisits")
    total = records.agg(F.coalesce(F.sum(F.octet_length("block") + 700), F.lit(0))).first()[0]
    n = max(1, -(-total // ARCHIVE_BYTES))
    d = (records.repartition(n, "rid") if n > 1 else records.coalesce(1)).join(moved.repartition(n, "rid") if n > 1 else moved, "rid", "left")
    d = d if n > 1 else d.coalesce(1)

    def render(batches):
        for b in batches:
            yield pa.record_batch({"value": pa.array([warc_record(r) for r in b.to_pylist()], pa.binary())})

    # the cast leaves bytes as they are
    d.mapInArrow(render, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


WARC_ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string"
WARC_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())


def read_warc_rows(spark, path: str) -> DataFrame:
    """One row for each record of the archives under ``path``. Digests of whole blocks are checked."""

    def read(batches):
        for b in batches:
            for content in b["content"]:
                rows = []
                for head, block in read_warc(content.as_py()):
                    if head["warc-block-digest"] != "sha1:" + base32_sha1(block):
                        raise ValueError(f"block digest of {head['warc-record-id']} does not match")
                    number = lambda k, head=head: int(head[k]) if head.get(k) else None
                    rows.append((
                        number("warc-record-key"), number("warc-payload-length"), head.get("warc-payload-digest", "").removeprefix("sha1:"), head["warc-type"], number("warc-refers-to-key"),
                        head["warc-record-id"], head.get("warc-target-uri"), head["warc-date"],
                    ))
                yield _table(rows, WARC_ROW, WARC_TYPES)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, WARC_ROW)


def convert_pages(pages: DataFrame, id_col: str = "page_id", version: int = 1, min_bytes: int = 0) -> DataFrame:
    """``pages`` (id, url, html) through ARC archives into WARC archives and back, as rows of ``WARC_ROW``.

    Null html is an empty payload, and empty payloads are equal to each other. A null url is written as ``unknown:``.
    Rows with a null id have no key: they revisit a row with a key, or else the latest of their own. Rows equal in id and
    payload are each written, under ids of their own, and are alike of one type. Payloads of any length are taken whole.
    An empty table gives an empty table; other columns don't matter.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    # stored, since each archive is packed from what a task happens to read, and its ids are made from it
    records = written(arc_records(pages_to_arc(pages, id_col, version)), "arc", "zstd")
    write_warc(records, path, min_bytes)
    return read_warc_rows(spark, path).where("record_type <> 'warcinfo'")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back."""
    return convert_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS n, sha1(h) AS hex FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS best FROM s),
d AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda x: CASE x WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011'
  WHEN '4' THEN '0100' WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111' WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011'
  WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END), '') AS bits FROM m)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * CAST(substr(bits, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(bits, i * 5 + 2, 1) AS INT) + 4 * CAST(substr(bits, i * 5 + 3, 1) AS INT)
      + 2 * CAST(substr(bits, i * 5 + 4, 1) AS INT) + CAST(substr(bits, i * 5 + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM d
"""
