"""Legacy web archives (ARC, versions 1 and 2) converted to WARC 1.1.

An archive is a row (path, content), as `spark.read.format("binaryFile")` gives it; what
is written is a Parquet table of the same two columns, each content a whole .warc.gz of
bounded size with one gzip member per record.  So any store that Spark writes to serves,
payloads stay bytes, and Spark's commit protocol covers lost executors.

The converter reads the version block, parses each header line by its version's fields
(five or ten, from the right, since old URLs may hold spaces), and cuts the block by the
declared length.  From these it makes WARC types, dates, identifiers (a UUID of archive
name and offset) and SHA-1 digests of block and payload.  Of equal payloads the first
record stays a response; the others become revisits, which hold the headers alone.

Defined results: a null page is an empty payload; a null url is "-"; pages without id
come after those with one; of repeated rows the first is the response; a declared length
beyond the end is cut there and marked truncated; a line that is no header is skipped;
an empty table gives no archives and no rows; columns but page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import discard, materialize, shared_dir

#: Bytes of records per archive.
ARCHIVE_BYTES = 8 << 20
#: Fixed values of the formats.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION_LINE = re.compile(rb"([12]) [0-9]+ ")

RECORD = "archive string, offset long, url string, date string, type string, truncated boolean, record_id string, page_id string, payload_bytes long, payload_digest string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_header(version: int, name: str, date: str = "20000101000000") -> bytes:
    """The version block that starts an archive."""
    body = f"{version} 0 foliate\n{FIELDS[version]}\n".encode()
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, date: str, block: bytes) -> bytes:
    extra = "" if version == 1 else f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name}"
    return f"{url} 0.0.0.0 {date} text/html{extra} {len(block)}\n".encode() + block + b"\n"


def pages_to_arc(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (path, content) with one HTTP record per row (page_id, url, html); versions 1 and 2 take turns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, count, parts, size, name, version = TaskContext.get().partitionId(), 0, [], 0, "", 1
        for b in batches:
            for page, url, html in zip(b["page_id"], b["url"], b["html"], strict=True):
                if not parts:
                    version = 1 + count % 2
                    name = f"pages-{part:06d}-{count:06d}.arc"
                    parts = [arc_header(version, name)]
                    size = len(parts[0])
                body = (html or "").encode()
                known = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(body)}\r\n\r\n"
                clean = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "-")
                parts.append(arc_record(version, name, size, clean, "20000101000000", head.encode() + body))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"path": [name], "content": [b"".join(parts)]})
                    parts, count = [], count + 1
        if parts:
            yield pd.DataFrame({"path": [name], "content": [b"".join(parts)]})

    picked = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    return picked.mapInPandas(run, "path string, content binary")


def _http(block: bytes) -> tuple[bytes, bytes]:
    """Header lines and payload of an HTTP message."""
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (b"", block)


def _page_id(head: bytes) -> str | None:
    m = re.search(rb"(?im)^X-Page-Id: *([^\r\n]*)", head)
    return m[1].decode() if m else None


def _warc_date(date: str) -> str:
    d = re.sub("[^0-9]", "", date).ljust(14, "0")[:14]
    month, day = ("01" if d[4:6] == "00" else d[4:6]), ("01" if d[6:8] == "00" else d[6:8])
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def parse_arc(name: str, content: bytes) -> Iterator[tuple]:
    """Records of one archive: the columns of RECORD, then HTTP header and payload."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    version, at, end = 1, 0, len(content)
    while at < end:
        eol = content.find(b"\n", at)
        if eol < 0:
            return
        line = content[at:eol].rstrip(b"\r").decode("utf-8", "replace")
        if line.startswith("filedesc://") and (m := _VERSION_LINE.match(content, eol + 1)):
            version = int(m[1])
        fields = line.rsplit(" ", 4 if version == 1 else 9)
        if len(fields) != (5 if version == 1 else 10) or not fields[-1].isdigit():
            at = eol + 1
            continue
        url, date, length, start = fields[0], fields[2], int(fields[-1]), at
        block = content[eol + 1 : eol + 1 + length]
        at = eol + 1 + length
        if url.startswith("filedesc://"):
            continue
        head, payload = _http(block) if url.startswith(("http:", "https:")) or block.startswith(b"HTTP/") else (b"", block)
        kind = "response" if head else "resource"
        identity = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{start}')}>"
        yield (name, start, url, _warc_date(date), kind, len(block) < length, identity, _page_id(head), len(payload), digest(payload), head, payload)


_COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


def read_arc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of ARC archives (path, content); without payload only their description."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = _COLUMNS + (["head", "payload"] if with_payload else [])
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = []
                for r in parse_arc(path.rsplit("/", 1)[-1], content):
                    rows.append(r if with_payload else r[:-2])
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return archives.select("path", "content").mapInPandas(run, RECORD + (", head binary, payload binary" if with_payload else ""))


def mark_revisits(records: DataFrame, described: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add first_id, first_url and first_date to records whose payload another record holds as response.

    Only digests that occur more than once are joined back, as equi-join, so that
    adaptive execution can split the partition of a very common payload.
    """
    page = F.col("page_id").try_cast("bigint")
    order = F.struct(page.isNull(), page, "page_id", "record_id", "url", "date")
    groups = (
        described.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(
            "payload_digest",
            "payload_bytes",
            F.col("first.record_id").alias("first_id"),
            F.col("first.url").alias("first_url"),
            F.col("first.date").alias("first_date"),
        )
    )
    return records.join(groups, ["payload_digest", "payload_bytes"], "left")


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return ("\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def write_warc(marked: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the records as a table of .warc.gz archives (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, count, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pd.DataFrame:
            return pd.DataFrame({"path": [f"records-{part:06d}-{count:06d}.warc.gz"], "content": [b"".join(parts)]})

        for b in batches:
            for r in b.itertuples(index=False):
                if not parts:
                    info = warc_record(
                        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}/{part}/{count}')}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")],
                        b"software: foliate\r\nformat: WARC File Format 1.1\r\n",
                    )
                    parts, size = [gzip.compress(info, 1, mtime=0)], len(info)
                again = isinstance(r.first_id, str) and r.first_id != r.record_id
                block = r.head if again else r.head + r.payload
                fields = [
                    ("WARC-Type", "revisit" if again else r.type),
                    ("WARC-Record-ID", r.record_id),
                    ("WARC-Date", r.date),
                    ("WARC-Target-URI", r.url),
                    ("WARC-Block-Digest", f"sha1:{digest(block)}"),
                    ("WARC-Payload-Digest", f"sha1:{r.payload_digest}"),
                    ("WARC-Truncated", "length" if r.truncated else None),
                    ("Content-Type", "application/http; msgtype=response" if r.head else "application/octet-stream"),
                ]
                if again:
                    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", r.first_id), ("WARC-Refers-To-Target-URI", r.first_url), ("WARC-Refers-To-Date", r.first_date), ("X-Payload-Length", str(r.payload_bytes))]
                raw = warc_record(fields, block)
                parts.append(gzip.compress(raw, 1, mtime=0))
                size += len(raw)
                if size >= archive_bytes:
                    yield archive()
                    parts, count = [], count + 1
        if parts:
            yield archive()

    marked.mapInPandas(run, "path string, content binary").write.option("compression", "uncompressed").parquet(path)


def _members(content: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, decompressed one by one, fed in pieces so that no member copies the rest."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof and at < len(view):
            piece = view[at : at + 4096]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(parts)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record, by declared lengths."""
    for data in _members(content):
        at = 0
        while (begin := data.find(b"WARC/", at)) >= 0:
            stop = data.index(b"\r\n\r\n", begin)
            lines = data[begin:stop].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = int(fields["content-length"])
            yield fields, data[stop + 4 : stop + 4 + length]
            at = stop + 4 + length


WARC_ROW = "record_id string, type string, url string, date string, page_id string, payload_bytes long, payload_digest string, refers_to_id string"


def read_warc(archives: DataFrame) -> DataFrame:
    """Descriptions of the records (but warcinfo) of WARC archives (path, content).

    payload_digest is computed from a response's payload; a revisit's is the one it states.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in WARC_ROW.split(", ")]
        for b in batches:
            for content in b["content"]:
                rows = []
                for f, block in parse_warc(content):
                    kind = f["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, payload = _http(block) if f.get("content-type", "").startswith("application/http") else (b"", block)
                    stated = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    again = kind == "revisit"
                    size = int(f.get("x-payload-length", 0)) if again else len(payload)
                    rows.append((f["warc-record-id"], kind, f.get("warc-target-uri"), f["warc-date"], _page_id(head), size, stated if again else digest(payload), f.get("warc-refers-to")))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return archives.select("content").mapInPandas(run, WARC_ROW)


def convert(archives: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Convert ARC archives to WARC archives under `path`; the table of what was written.

    The archives are written once before they are read twice: record ids come from a
    record's place, and a plan that is run again, wholly or for a lost partition, may deal
    its rows in another order.
    """
    held = materialize(archives.select("path", "content"), "arcs")
    write_warc(mark_revisits(read_arc(held), read_arc(held, with_payload=False), least_bytes), path)
    discard(held)
    return archives.sparkSession.read.schema("path string, content binary").parquet(path)


def round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Pages to ARC, converted to WARC, read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc"
    kind = dict(pages.dtypes)["page_id"]
    back = materialize(read_warc(convert(pages_to_arc(pages), path, least_bytes)), "described")  # read three times below
    first = back.where("type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    first = first.join(back.select("refers_to_id").where("refers_to_id is not null").distinct(), "refers_to_id")
    return back.join(first, "refers_to_id", "left").select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
