"""WARC archives, index first: records are written with an index, and read back by coalesced byte ranges.

Writing: of records with equal payloads the one with the largest page id is a response, the others are revisits of it
that carry no payload (identical-payload-digest profile). A task writes one archive file, each record a gzip member of
its own, and returns offset, length, URL and digest per record; the index table has the rows of finished tasks only, so
a lost executor leaves a stray file at most. Reading: the index rows wanted are dealt by file and stretch of offsets,
sorted, neighbouring ranges are fetched in one read, and every record is parsed and its digest checked.

Files go to the shared folder through Arrow's file systems, which know file, hdfs, s3 (s3a, s3n), gs and abfs(s) URIs.
Page ids are integers. Null payloads count as empty; rows of one page id and payload are each a response; a row without a
page id revisits one that has one; extra columns are passed by; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_limits

#: Bytes of an archive's stretch that one read task gets, and the widest gap that a coalesced read bridges.
STRETCH, GAP = 8 << 20, 64 << 10
#: An archive file is closed when it has so many bytes.
FILE_BYTES = 512 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path of a URI as Hadoop spells it."""
    scheme, colon, rest = uri.partition("://")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, own: str, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit's block is its HTTP header, with the length of the payload left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c for c in url or "" if c > " ") or "urn:unknown"
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{own}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}


def parse(data: bytes) -> dict:
    """A record's fields and payload (None for a revisit); its digest is checked against the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = fields["warc-record-id"][len("<urn:page:") : -1]
    out = {
        "page_id": int(page) if page else None,
        "url": fields["warc-target-uri"],
        "record_type": fields["warc-type"],
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "payload_bytes": int(_headers(http)["content-length"]),
        "refers_to": None,
        "payload": None,
    }
    if out["record_type"] == "revisit":
        out["refers_to"] = int(fields["warc-refers-to"][len("<urn:page:") : -1])
    else:
        out["payload"] = payload
        if len(payload) != out["payload_bytes"] or digest(payload) != out["payload_digest"]:
            raise ValueError(f"page {page}: the payload isn't the one that was digested")
    return out


def _write(folder: str, level: int):
    names = [f.split()[0] for f in INDEX.split(", ")]
    types = [pa.string() if f.split()[1] == "string" else pa.int64() for f in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out = name = None
        offset = 0
        for batch in batches:
            rows = []
            pages, urls, htmls, targets = (batch.column(i).to_pylist() for i in range(4))
            for page, url, html, target in zip(pages, urls, htmls, targets, strict=True):
                if out is None:
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                payload = (html or "").encode()
                own = digest(payload)
                refers = target if target is not None and (page is None or page < target) else None
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(page, url, payload, own, refers)) + packer.flush()
                out.write(member)
                rows.append((page, url, own, len(payload), "response" if refers is None else "revisit", refers, f"{folder}/{name}", offset, len(member)))
                offset += len(member)
                if offset >= FILE_BYTES:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", level: int = 2) -> DataFrame:
    """Archives of all pages in the shared folder; the index of their records, a written table."""
    arrow_limits(pages.sparkSession)
    html = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"), F.unhex(F.sha1(html)).alias("sum"))
    same = rows.groupBy("sum").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(same, "sum", "left").select("page_id", "url", "html", "target")
    return scratch.save(rows.mapInArrow(_write(scratch.path("archives"), level), INDEX), "index")


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP) -> list[tuple[int, int]]:
    """Sorted (offset, length) ranges joined where no more than ``gap`` bytes lie between them."""
    out: list[list[int]] = []
    for offset, length in ranges:
        if out and offset - sum(out[-1]) <= gap:
            out[-1][1] = max(out[-1][1], offset + length - out[-1][0])
        else:
            out.append([offset, length])
    return [(a, b) for a, b in out]


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(with_payload: bool):
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema([*fields, *[("payload", pa.binary())] * with_payload])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = file_system(file)
                wanted = sorted((r["offset"], r["length"]) for r in ranges)
                rows, at = [], 0
                with system.open_input_file(path) as f:
                    for start, length in coalesce_ranges(wanted):
                        data = f.read_at(length, start)
                        while at < len(wanted) and wanted[at][0] < start + length:
                            a = wanted[at][0] - start
                            rows.append(parse(zlib.decompress(data[a : a + wanted[at][1]], 31)))
                            at += 1
                        if len(rows) >= 256 or at == len(wanted):
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []

    return run


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that ``index`` rows name, parsed; whole files are never read for a few of their records."""
    size = index.agg(F.sum("length")).first()[0] or 0
    stretches = index.groupBy("file", F.floor(F.col("offset") / STRETCH).alias("stretch")).agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))
    # by bytes of archive, not of index: otherwise a few index rows would become one task
    stretches = stretches.select("file", "ranges").repartition(max(1, -(-size // STRETCH)))
    return stretches.mapInArrow(_read(with_payload), READ + ", payload binary" * with_payload)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Every page written as a record, then read back: its payload's size and digest, and what kind of record it is."""
    return read_records(write_archives(pages, Scratch(pages.sparkSession, "warc")))
