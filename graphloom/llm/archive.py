"""Operator 7, WARC: a converter from legacy ARC archives to WARC/1.0 records.

An ARC file is a run of records, each a header line and as many bytes as the line declares. The first record
(filedesc:) names the version: version 1 lines hold URL, IP address, date, content type and length; version 2 lines
hold URL, IP address, date, content type, result code, checksum, location, offset, file name and length. Lines are read
from both ends, so content types may have parameters and URLs spaces. Archives may be compressed, as a whole or record
by record (gzip members). From these the converter synthesises a WARC record: an identifier derived from the record's
own bytes (so a second run gives the same one), an ISO 8601 date, a type (warcinfo for filedesc, response for what
begins with an HTTP status line, resource otherwise), block and payload digests, and the header block.

Results, case by case: a null archive gives no records; a header line that cannot be parsed, or a length that goes
beyond the archive, gives a record of type "metadata" that holds the rest up to the next parsable header line, with
`problem` "header"; so does a gzip member that cannot be read, up to the next member, with `problem` "gzip". A date that
is none, and a record without one, take the date of the record before, or 1970-01-01 where there is none; `problem` is
then "date" unless it is set already. An empty body is a record of length 0; repeated records get the same identifier;
an empty table gives no rows; extra columns are ignored; bodies of any length are converted whole (an archive is one
value, so Spark's limit of 2 GB a value holds for it).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.text import pieces

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_IP = rb"\d{1,3}(?:\.\d{1,3}){3}|-|[0-9A-Fa-f]*:[0-9A-Fa-f:.]+"
_HEADER = re.compile(rb"^(\S[^\n]*?) (" + _IP + rb") (\d{8,14}) ([^\n]*?) ?(\d+)\r?$")
_RESYNC = re.compile(rb"\n(?=[a-z][a-z0-9+.\-]*:[^\n]* (?:" + _IP + rb") \d{8,14} [^\n]*\d\r?\n)")
_MEMBER = b"\x1f\x8b\x08"
OUT_BYTES = 1 << 20
_NO_DATE = "1970-01-01T00:00:00Z"
RECORD = "position int, warc_record_id string, warc_type string, warc_date string, target_uri string, ip_address string, content_type string, content_length long, block_digest string, payload_digest string, problem string, record binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(stamp: str) -> str | None:
    """An ARC date of 8 to 14 digits; what is missing is midnight. None if there is no such date."""
    try:
        return datetime.strptime(stamp.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    except ValueError:
        return None


def unpacked(data: bytes) -> Iterator[tuple[bool, bytes]]:
    """Whether it could be read, and the bytes, of each stretch of gzip members; data as it is, if it isn't compressed."""
    if not data.startswith(_MEMBER):
        yield True, data
        return
    at, good = 0, []
    while at < len(data):
        z = zlib.decompressobj(wbits=31)
        try:
            body = z.decompress(data[at:] if at else data)
            if not z.eof:
                raise zlib.error("cut short")
            good.append(body)
            at = len(data) - len(z.unused_data)
        except zlib.error:
            if good:
                yield True, b"".join(good)
                good = []
            go = data.find(_MEMBER, at + 1)
            yield False, data[at : go if go >= 0 else len(data)]
            at = go if go >= 0 else len(data)
    if good:
        yield True, b"".join(good)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record, by the version that the archive declares (1 if none)."""
    version = "1"
    for fine, part in unpacked(data):
        if not fine:
            yield {"error": "gzip"}, part
            continue
        at = 0
        while at < len(part):
            while part[at : at + 1] in (b"\n", b"\r"):
                at += 1
            if at >= len(part):
                break
            line_end = part.find(b"\n", at)
            m = _HEADER.match(part[at : line_end if line_end >= 0 else len(part)])
            desc = bool(m) and m[1].startswith(b"filedesc:")
            rest = m[4].rsplit(b" ", 5) if m else []
            long = len(rest) == 6 and (version == "2" or desc)
            declared = int(m[5]) if m else -1
            begin = line_end + 1
            if not m or line_end < 0 or begin + declared > len(part) or (version == "2" and not desc and not long):
                go = _RESYNC.search(part, at + 1)
                stop = go.start() + 1 if go else len(part)
                yield {"error": "header"}, part[at:stop]
                at = stop
                continue
            body = part[begin : begin + declared]
            text = [x.decode("utf-8", "replace") for x in rest]
            head = {"url": m[1].decode("utf-8", "replace"), "ip": m[2].decode(), "date": m[3].decode(), "type": (text[0] if long else m[4].decode("utf-8", "replace")).strip()}
            if desc:
                version = body[:1].decode("ascii", "replace")
            if long:
                head |= dict(zip(("code", "checksum", "location", "offset", "filename"), text[1:]))
            yield head, body
            at = begin + declared


def to_warc(head: dict[str, str], body: bytes, before: str | None = None) -> dict:
    """The WARC record; before is the date of the record before."""
    problem, date = head.get("error"), iso_date(head["date"]) if "date" in head else None
    if date is None:
        problem, date = problem or "date", before or _NO_DATE
    if "error" in head:
        kind, uri, ctype = "metadata", None, "application/octet-stream"
    else:
        uri = re.sub(r"\s", "%20", head["url"])
        kind = "warcinfo" if uri.startswith("filedesc:") else "response" if body.startswith(b"HTTP/") else "resource"
        ctype = "application/http; msgtype=response" if kind == "response" else head["type"] if head["type"] not in ("", "-") else "application/octet-stream"
    block = digest(body)
    split = re.search(rb"\r?\n\r?\n", body) if kind == "response" else None
    payload = digest(body[split.end() :]) if split else block if kind == "resource" else None
    ident = f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind} {uri} {date} {block}')}>"
    ip = head.get("ip")
    ip = None if ip in (None, "-", "0.0.0.0") else ip
    lines = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), ("WARC-Filename" if kind == "warcinfo" else "WARC-Target-URI", uri.removeprefix("filedesc://") if kind == "warcinfo" else uri), ("WARC-IP-Address", ip), ("WARC-Block-Digest", block), ("WARC-Payload-Digest", payload), ("Content-Type", ctype), ("Content-Length", str(len(body)))]
    text = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n"
    return {"warc_record_id": ident, "warc_type": kind, "warc_date": date, "target_uri": uri, "ip_address": ip, "content_type": ctype, "content_length": len(body), "block_digest": block, "payload_digest": payload, "problem": problem, "record": text.encode() + body + b"\r\n\r\n"}


def records(arc: bytes) -> Iterator[dict]:
    """The WARC records of an archive."""
    before = None
    for i, (head, body) in enumerate(parse_arc(arc)):
        row = to_warc(head, body, before)
        before = row["warc_date"]
        yield {"position": i} | row


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive_id, arc) of the files of a path: archive_id is the file's own path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive_id"), F.col("content").alias("arc"))


def convert(archives: DataFrame) -> DataFrame:
    """WARC records of a table of archives (archive_id, arc)."""
    id_type = archives.schema["archive_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int32(), *[pa.string()] * 6, pa.int64(), *[pa.string()] * 3, pa.binary()]
        for batch in batches:
            at: list[int] = []
            rows: list[dict] = []
            size = 0
            for r, arc in enumerate(batch.column("arc")):
                for row in records(arc.as_py() or b""):
                    at.append(r)
                    rows.append(row)
                    size += len(row["record"])
                    if size > OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([batch.column("archive_id").take(pa.array(at)), *(pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds))], names=["archive_id", *names])
                        at, rows, size = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("archive_id").take(pa.array(at)), *(pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds))], names=["archive_id", *names])

    return archives.select("archive_id", "arc").mapInArrow(run, f"archive_id {id_type}, {RECORD}")


def write_arc(records: list[tuple[str, str, str, str, bytes]], version: int, name: str) -> bytes:
    """An ARC file of (url, ip, date, content type, body) records."""
    fields = "URL IP-address Archive-date Content-type " + ("Archive-length" if version == 1 else "Result-code Checksum Location Offset Filename Archive-length")
    body = f"{version} 0 Archiver\n{fields}\n".encode()
    more = "" if version == 1 else f" 200 - - 0 {name}"
    out = [f"filedesc://{name} 0.0.0.0 20240101000000 text/plain{more} {len(body)}\n".encode(), body, b"\n"]
    size = sum(map(len, out))
    for url, ip, date, kind, content in records:
        more = "" if version == 1 else f" 200 {hashlib.md5(content).hexdigest()} - {size} {name}"
        out += [f"{url} {ip} {date} {kind}{more} {len(content)}\n".encode(), content, b"\n"]
        size += sum(map(len, out[-3:]))
    return b"".join(out)


def pages_as_arc(pages: DataFrame) -> DataFrame:
    """One archive a page, of version 1 for even ids and 2 for odd ones: the legacy input for a table of pages.

    Null ids count as 0, ids that are no numbers as their checksum, null urls as urn:none, null pages as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for big in batches for part in pieces(big, "html")):
            out = []
            for i, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                n = i if isinstance(i, int) else zlib.crc32(str(i).encode()) if i is not None else 0
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode()
                stamp = f"2024{n // 28 % 12 + 1:02d}{n % 28 + 1:02d}{n % 24:02d}{n % 60:02d}{n // 60 % 60:02d}"
                url = re.sub(r"\s", "%20", url) if url else "urn:none"
                out.append(write_arc([(url, f"10.{n // 65536 % 256}.{n // 256 % 256}.{n % 256}", stamp, "text/html", body)], 1 + n % 2, f"pages-{n}.arc"))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.binary())], names=["archive_id", "arc"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"archive_id {id_type}, arc binary")


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, each page as an archive; the bytes of the records in base64."""
    out = convert(pages_as_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"))).withColumnRenamed("archive_id", "page_id")
    return out.withColumn("record", F.translate(F.base64("record"), "\r\n", ""))


def _digest_sql(blob: str) -> str:
    """SHA-1 of a blob in base 32, in DuckDB's SQL: each five hexadecimal digits are four characters."""
    five = f"CAST(('0x' || substr(sha1({blob}), 1 + 5 * CAST(i // 4 AS INTEGER), 5)) AS INTEGER)"
    return f"'sha1:' || list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ({five} >> CAST(15 - 5 * (i % 4) AS INTEGER)) % 32, 1) for i in range(32)], 'string_agg', '')"


#: Each page's two records: the archive's description and the response.
ORACLE = rf"""
WITH src AS (
  SELECT page_id, coalesce(page_id, 0) AS n, coalesce(regexp_replace(nullif(url, ''), '\s', '%20', 'g'), 'urn:none') AS url, coalesce(html, '') AS html FROM pages
), two AS (
  SELECT page_id, 0 AS position, 'warcinfo' AS warc_type, '2024-01-01T00:00:00Z' AS warc_date, 'filedesc://pages-' || n || '.arc' AS target_uri, NULL AS ip_address,
    'text/plain' AS content_type, NULL AS payload,
    encode(CASE WHEN n % 2 = 0 THEN '1' ELSE '2' END || ' 0 Archiver' || chr(10) || 'URL IP-address Archive-date Content-type ' || CASE WHEN n % 2 = 0 THEN '' ELSE 'Result-code Checksum Location Offset Filename ' END || 'Archive-length' || chr(10)) AS body
  FROM src
  UNION ALL
  SELECT page_id, 1, 'response', printf('2024-%02d-%02dT%02d:%02d:%02dZ', n // 28 % 12 + 1, n % 28 + 1, n % 24, n % 60, n // 60 % 60), url, '10.' || n // 65536 % 256 || '.' || n // 256 % 256 || '.' || n % 256,
    'application/http; msgtype=response', encode(html), encode('HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || html)
  FROM src
), hashed AS (
  SELECT *, octet_length(body) AS content_length, {_digest_sql("body")} AS block_digest, CASE WHEN payload IS NOT NULL THEN {_digest_sql("payload")} END AS payload_digest FROM two
), named AS (
  SELECT *, sha1(from_hex('{_NAMESPACE.hex}') || encode(warc_type || ' ' || target_uri || ' ' || warc_date || ' ' || block_digest)) AS h FROM hashed
), ids AS (
  SELECT *, '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) || '>' AS warc_record_id,
    chr(13) || chr(10) AS nl FROM named
)
SELECT page_id, position, warc_record_id, warc_type, warc_date, target_uri, ip_address, content_type, content_length, block_digest, payload_digest, CAST(NULL AS VARCHAR) AS problem,
  base64(encode('WARC/1.0' || nl || 'WARC-Type: ' || warc_type || nl || 'WARC-Record-ID: ' || warc_record_id || nl || 'WARC-Date: ' || warc_date || nl
    || CASE WHEN position = 0 THEN 'WARC-Filename: ' || substr(target_uri, 12) ELSE 'WARC-Target-URI: ' || target_uri || nl || 'WARC-IP-Address: ' || ip_address END || nl
    || 'WARC-Block-Digest: ' || block_digest || nl || coalesce('WARC-Payload-Digest: ' || payload_digest || nl, '') || 'Content-Type: ' || content_type || nl || 'Content-Length: ' || content_length || nl || nl) || body || encode(nl || nl)) AS record
FROM ids
"""
