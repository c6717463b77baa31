"""Legacy ARC archives, their conversion to WARC, and readers of both.

Pages are first written as ARC files of version 1 or 2; the converter reads them by the field names that the version's header record
declares and by declared lengths, and synthesises what WARC asks for: record ids (UUIDs of page id and address), ISO timestamps, types,
payload and block digests. Of records with equal payloads the one with the smallest page id is the response, the others become revisits
that refer to it and carry its HTTP head only; payloads shorter than ``min_bytes`` are always responses.

An archive is a row of at most about ``ARCHIVE_BYTES`` compressed bytes (or one larger record), each record a gzip member; Spark's text writer puts each row
into a file of its own, so the commit protocol covers lost executors and the path may be any file system Spark knows. A zero
byte, which gzip readers take as padding, ends each file.

Null html is an empty payload; a null page id stays null and is never referred to while another record has the same payload; a null or
empty address becomes urn:page. Repeated rows are records of their own; rows that repeat the smallest page id and its payload are all
responses. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import rows_of, scratch, small_or_shuffled, stored

ARCHIVE_BYTES = 16 << 20
#: The header lines of ARC versions and the profile of revisit records.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _archives(members: Iterable[bytes], first: bytes) -> Iterator[bytes]:
    """Gzip members gathered to archives, each beginning with the given record."""
    parts, size = [], 0
    for data in members:
        packed = gzip.compress(data, compresslevel=1, mtime=0)
        if parts and size + len(packed) > ARCHIVE_BYTES:
            yield b"".join(parts)
            parts, size = [], 0
        if not parts:
            parts, size = [gzip.compress(first, compresslevel=1, mtime=0)], 0
        parts.append(packed)
        size += len(packed)
    if parts:
        yield b"".join(parts)


def _write(archives: DataFrame, folder: str) -> None:
    (archives.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder))


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")


# ---- ARC ----

def arc_header(version: int, name: str, captured: str) -> bytes:
    body = f"{version} 0 pages\n{ARC_FIELDS[version]}\n".encode()
    tail = f"text/plain {len(body)}" if version == 1 else f"text/plain 200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} 0.0.0.0 {captured} {tail}\n".encode() + body + b"\n"


def arc_record(version: int, page_id: int | None, url: str | None, html: str | None, captured: str) -> bytes:
    payload = (html or "").encode("utf-8", "replace")
    page = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    address = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "urn:page"
    tail = f"text/html {len(block)}" if version == 1 else f"text/html 200 - - 0 pages.arc {len(block)}"
    return f"{address} 0.0.0.0 {captured} {tail}\n".encode() + block + b"\n"


def write_arc(pages: DataFrame, folder: str, version: int = 1, captured: str = "20240101000000") -> None:
    """The pages (page_id, url, html) as ARC files of the given version."""
    def pack(batches):
        records = (arc_record(version, None if pd.isna(p) else int(p), u, h, captured) for p, u, h in rows_of(batches, "page_id", "url", "html"))
        for data in _archives(records, arc_header(version, "pages.arc", captured)):
            yield pd.DataFrame({"value": [data]})

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write(rows.mapInPandas(pack, "value binary"), folder)


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields by name, and the block, of each record of an archive; the version's header record sets the names."""
    names: list[str] = []
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        while line := f.readline():
            fields = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
            if fields == [""]:
                continue
            length = int(fields[-1])
            block = f.read(length)
            if len(block) < length:
                raise ValueError(f"record of {fields[0]} ends early")
            if fields[0].startswith("filedesc://"):
                version, declared = block.decode().splitlines()[:2]
                names = declared.split(" ")
                if declared != ARC_FIELDS.get(int(version.split(" ")[0])):
                    raise ValueError(f"unknown ARC version: {version}")
                continue
            if len(fields) != len(names):
                raise ValueError(f"header line has {len(fields)} fields, not {len(names)}")
            yield dict(zip(names, fields, strict=True)), block


def _http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Lower-case HTTP header fields, the head with its blank line, and the payload."""
    head, blank, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.decode().lower().split(": ", 1) for x in head.split(b"\r\n")[1:])
    return fields, head + blank, payload


RECORD = "page_id long, url string, ip string, captured string, payload_bytes long, payload_digest string, packed binary"


def convertible(arcs: DataFrame, with_block: bool = True) -> DataFrame:
    """One row per ARC record: what a WARC record is made of; the block is zlib-compressed, or left out."""
    def parse(batches):
        for (content,) in rows_of(batches, "content"):
            out: list[tuple] = []
            size = 0
            for fields, block in arc_records(content):
                http, _, payload = _http(block)
                page = http.get("x-page-id")
                packed = zlib.compress(block, 1) if with_block else None
                out.append((page and int(page), fields["URL"], fields["IP-address"], fields["Archive-date"].ljust(14, "0"), len(payload), digest(payload), packed))
                size += len(packed or b"")
                if size > ARCHIVE_BYTES or len(out) >= 2000:
                    yield _frame(out)
                    out, size = [], 0
            if out:
                yield _frame(out)

    return arcs.mapInPandas(parse, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RECORD.split(", ")]).astype({"page_id": "Int64"})


# ---- WARC ----

def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}).items())
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, min_bytes: int = 0) -> None:
    """ARC files to WARC files. Payloads that occur more than once are looked up map-side while a count shows them few; beyond that compressed
    blocks are shuffled once, and adaptive execution splits hot payloads."""
    arcs = _read(spark, arc_folder)
    copies = (convertible(arcs, with_block=False).filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
              .agg(F.min(F.struct(F.col("page_id").isNull().alias("no"), "page_id", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    records = convertible(arcs).join(small_or_shuffled(stored(copies, "repeated-payloads")), "payload_digest", "left")
    original = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first.page_id"))
    rows = records.select("page_id", "url", "ip", "captured", "payload_digest", "packed", F.when(~original, F.col("first.page_id")).alias("of"), F.when(~original, F.col("first.url")).alias("of_url"))

    def build(batches):
        def one():
            for page_id, url, ip, captured, sha, packed, of, of_url in rows_of(batches, "page_id", "url", "ip", "captured", "payload_digest", "packed", "of", "of_url"):
                block = zlib.decompress(packed)
                at = f"{captured[:4]}-{captured[4:6]}-{captured[6:8]}T{captured[8:10]}:{captured[10:12]}:{captured[12:14]}Z"
                page_id, of = (None if pd.isna(x) else int(x) for x in (page_id, of))
                fields = {"WARC-Type": "response" if of is None else "revisit", "WARC-Record-ID": record_id(page_id, url), "WARC-Date": at, "WARC-Target-URI": url,
                          "WARC-IP-Address": ip, "WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": "application/http; msgtype=response"}
                if of is not None:
                    block = _http(block)[1]
                    fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(of, of_url), "WARC-Refers-To-Target-URI": of_url, "X-Refers-To-Page-Id": str(of)}
                yield warc_record(fields, block)

        info = warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(None, "warcinfo"), "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"},
                           b"format: WARC File Format 1.0\r\nconverted-from: ARC\r\n")
        for data in _archives(one(), info):
            yield pd.DataFrame({"value": [data]})

    _write(rows.mapInPandas(build, "value binary"), warc_folder)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by declared lengths."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("no WARC record where one should begin")
            fields = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                key, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
                fields[key] = value
            block = f.read(int(fields["Content-Length"]))
            if len(block) < int(fields["Content-Length"]) or f"sha1:{digest(block)}" != fields["WARC-Block-Digest"]:
                raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
            yield fields, block


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, captured string"


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response or revisit record of the archives; digests of responses are computed anew and compared."""
    def parse(batches):
        for (content,) in rows_of(batches, "content"):
            out = []
            for fields, block in warc_records(content):
                if fields["WARC-Type"] == "warcinfo":
                    continue
                http, _, payload = _http(block)
                sha, page, of = fields["WARC-Payload-Digest"].removeprefix("sha1:"), http.get("x-page-id"), fields.get("X-Refers-To-Page-Id")
                if fields["WARC-Type"] == "response" and (digest(payload), len(payload)) != (sha, int(http["content-length"])):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                out.append((page and int(page), int(http["content-length"]), sha, fields["WARC-Type"], of and int(of), fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"]))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in READ.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return _read(spark, folder).mapInPandas(parse, READ)


def archived(pages: DataFrame, version: int = 2, min_bytes: int = 0) -> DataFrame:
    """The pages written as ARC, converted to WARC and read back."""
    spark = pages.sparkSession
    arcs, warcs = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages, arcs, version)
    convert(spark, arcs, warcs, min_bytes)
    return read_warc(spark, warcs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "captured")
