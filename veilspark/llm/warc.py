"""Legacy archive converter: ARC files to WARC files, and back to rows (operator 3).

ARC files open with a version block whose fields say how the header lines of all records are laid out: version 1
has five fields, version 2 ten. A record is its header line, then as many bytes as the line declares. Each record becomes a
WARC record: its identifier is made from what identifies the ARC record, its timestamp from the 14-digit date, its type
from what it holds, and payload and block digests are computed. Types: the version block becomes a warcinfo record, which every
WARC file opens with; a block that begins with an HTTP status line becomes a response; any other block (a name look-up, a
file transfer) a resource, whose payload is the whole block.

Of responses with equal payloads of at least LEAST bytes, the one with the smallest id is kept, and the others become revisits, which
name the kept record's identifier, address and date and don't repeat the payload. Digests alone are compared for that. What revisits
refer to is broadcast while it takes FEW_BYTES at most. Beyond that a Bloom filter of the repeated digests goes to all tasks: records
that it rejects stay where they are, and only the others are joined, by their digest, those of hot digests by a broadcast.

Archives are gzip files in the shared folder with a member for each record, so any record can be read on its own; a file ends
after FILE_BYTES, whatever its number of records. ARC files are parsed once: records are kept packed, as they go into the WARC files. Files are
written and read by Spark's own formats, so that any store will do and a lost executor's files are written again.

Defined cases: a null payload is empty; a null url becomes urn:page:<id>; white space and control characters in urls are percent-encoded, as
header fields end at them; a null page_id sorts last and is null again in the result; rows with the same page_id and
payload have the same type, and so have rows equal in all columns; of equal payloads the smallest page_id decides; a very long payload
is held whole, with about six times its bytes; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, drop_written, from_id, hot_join, new_path, remove, to_id, trimmed, written
from .line_dedup import _hits as filter_hits
from .line_dedup import bits_for, build_members, merged_filter

LEAST = 100
#: Bytes of revisits that are broadcast.
FEW_BYTES = 32 << 20
#: Packed bytes after which an archive file ends.
FILE_BYTES = 16 << 20
PIECE, FEED = 1 << 20, 1 << 13

# The field names of the two versions' header lines.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes


class Reader:
    """Reads lines and counted bytes from a gzip stream of any number of members, a piece at a time."""

    def __init__(self, packed: bytes) -> None:
        self.packed, self.at, self.buffer = packed, 0, bytearray()
        self.inflate = zlib.decompressobj(31)
        self.start = 0

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                rest = self.inflate.unused_data
                self.at -= len(rest)
                self.inflate = zlib.decompressobj(31)
            # small pieces: what lies behind a member's end is copied and put back
            piece = self.inflate.unconsumed_tail or self.packed[self.at : self.at + FEED]
            if not piece:
                return False
            if not self.inflate.unconsumed_tail:
                self.at += len(piece)
            got = self.inflate.decompress(piece, PIECE)
            if got:
                if self.start > PIECE:
                    del self.buffer[: self.start]
                    self.start = 0
                self.buffer += got
                return True

    def line(self) -> bytes | None:
        """The next line without its line feed; None at the end."""
        look = self.start
        while (end := self.buffer.find(b"\n", look)) < 0:
            look_from = len(self.buffer) - self.start
            if not self._more():
                rest = bytes(self.buffer[self.start :])
                self.start = len(self.buffer)
                return rest or None
            look = self.start + look_from
        out = bytes(self.buffer[self.start : end])
        self.start = end + 1
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.start < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.buffer[self.start : self.start + n])
        self.start += n
        return out


# ---- ARC


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 veilspark\n{' '.join(ARC_FIELDS[version])}\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 20260101000000 text/plain{extra} {len(body)}\n".encode() + body


def arc_record(version: int, name: str, r: ArcRecord) -> bytes:
    url = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", r.url)
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"{url} {r.ip} {r.date} {r.content_type}{extra} {len(r.block)}\n".encode() + r.block


def read_arc(packed: bytes) -> Iterator[ArcRecord]:
    """The records of a gzipped ARC file of either version."""
    reader = Reader(packed)
    head = reader.line()
    if head is None:
        return
    if not head.startswith(b"filedesc://"):
        raise ValueError("an ARC file opens with a version block")
    block = reader.take(int(head.rsplit(b" ", 1)[1])).split(b"\n")
    version = int(block[0].split(b" ", 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version}")
    fields = block[1].decode().split()
    where = {name: k for k, name in enumerate(fields)}
    while (line := reader.line()) is not None:
        if not line.strip():
            continue
        values = line.decode("utf-8", "surrogateescape").split(" ")
        if len(values) != len(fields):
            raise ValueError(f"a header line with {len(values)} of {len(fields)} fields")
        yield ArcRecord(*(values[where[f]] for f in ARC_FIELDS[1][:4]), reader.take(int(values[where["Archive-length"]])))


# ---- WARC


def record_id(r: ArcRecord, page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{r.url} {r.date} {page}')}>"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def page_of(head: bytes) -> str:
    found = re.search(rb"(?mi)^X-Page-Id: *([^\r\n]*)", head)
    return found[1].decode() if found else ""


def when_of(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def is_http(block: bytes) -> bool:
    return block.startswith(b"HTTP/")


def sha(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record with its block's digest and length."""
    lines = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", sha(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def warc_fields(r: ArcRecord, page: str, digest: str, size: int, http: bool) -> list[tuple[str, str]]:
    """The fields that a record has whatever its type."""
    out = [
        ("WARC-Record-ID", record_id(r, page)),
        ("WARC-Date", when_of(r.date)),
        ("WARC-Target-URI", r.url),
        ("WARC-IP-Address", r.ip),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "application/http; msgtype=response" if http else r.content_type),
    ]
    return [*out, ("X-Page-Id", page)] if http else out


#: What a revisit's profile is called. Fixed value.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def warcinfo(name: str) -> bytes:
    block = b"software: veilspark\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC files\r\n"
    about = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", "2026-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return warc_record("warcinfo", about, block)


def packed(data: bytes) -> bytes:
    """A gzip member whose last byte is 0: so ends the length of anything under 16 MiB, and of the empty member that follows others."""
    out = _member(data)
    return out if out[-1] == 0 else out + _member(b"")


def _member(data: bytes) -> bytes:
    work = zlib.compressobj(1, zlib.DEFLATED, 31)
    return work.compress(data) + work.flush()


def read_warc(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of the records of a gzipped WARC file."""
    reader = Reader(packed)
    while (line := reader.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record opens with its version")
        fields = {}
        while (line := reader.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "surrogateescape").rstrip("\r").partition(":")
            fields[name.lower()] = value.strip()
        yield fields, reader.take(int(fields["content-length"]))


# ---- tasks


def _rows(names_kinds: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names_kinds]
    return pa.record_batch([pa.array(list(c), k) for c, (_, k) in zip(columns, names_kinds)], names=[n for n, _ in names_kinds])


def _chunked(names_kinds: list[tuple[str, pa.DataType]], rows: Iterable[tuple], size_of) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += size_of(row)
        if size > 4 * PIECE or len(part) >= 4096:
            yield _rows(names_kinds, part)
            part, size = [], 0
    if part:
        yield _rows(names_kinds, part)


def to_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, html) to ARC files; versions take turns."""
    version, name = 1, ""

    def opening(k: int) -> bytes:
        nonlocal version, name
        version, name = 1 + k % 2, f"crawl-{k}.arc.gz"
        return arc_version_block(version, name) + b"\n"

    def records() -> Iterator[bytes]:
        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                page_text = "" if page == NO_ID else str(page)
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page_text}\r\n\r\n".encode()
                date = f"20260101{page // 3600 % 24:02d}{page // 60 % 60:02d}{page % 60:02d}"
                own = ArcRecord(f"urn:page:{page_text}" if url is None else url or "urn:page:", "0.0.0.0", date, "text/html", head + (html.as_py() or b""))
                yield own

    # a file's version is set before its first record is asked for
    yield from _chunked([("value", pa.binary())], _in_files(records(), opening, lambda own: packed(arc_record(version, name, own) + b"\n")), lambda r: len(r[0]))


#: What is kept of each record between reading and writing.
KINDS = [
    ("id", pa.int64()),
    ("kind", pa.string()),
    ("digest", pa.binary()),
    ("size", pa.int64()),
    ("url", pa.binary()),
    ("ip", pa.string()),
    ("date", pa.string()),
    ("head", pa.binary()),
    ("member", pa.binary()),
]


def page_text(page: int) -> str:
    return "" if page == NO_ID else str(page)


def arc_parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content) of ARC files to what identifies their records, and the WARC records that they become if they are no revisits, packed."""

    def made() -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column(0):
                for r in read_arc(content.as_py()):
                    http = is_http(r.block)
                    head, payload = split_http(r.block) if http else (b"", r.block)
                    page, digest = page_of(head), hashlib.sha256(payload)
                    kind = "response" if http else "resource"
                    member = packed(warc_record(kind, warc_fields(r, page, digest.hexdigest(), len(payload), http), r.block))
                    yield int(page) if page else NO_ID, kind, digest.digest(), len(payload), r.url.encode("utf-8", "surrogateescape"), r.ip, r.date, head, member

    yield from _chunked(KINDS, made(), lambda r: len(r[7]) + len(r[8]) + 256)


def to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, first_url, first_date, id, digest, size, url, ip, date, head, member) to WARC files: a revisit where `first` is given, else the
    member as it is."""
    name = uuid.uuid4().hex
    plain = lambda raw: raw.decode("utf-8", "surrogateescape")

    def revisit(first: int, first_url: bytes, first_date: str, page: int, digest: bytes, size: int, url: bytes, ip: str, date: str, head: bytes) -> bytes:
        kept = ArcRecord(plain(first_url), "", first_date, "", b"")
        own = warc_fields(ArcRecord(plain(url), ip, date, "", b""), page_text(page), digest.hex(), size, True)
        to = [("WARC-Refers-To", record_id(kept, page_text(first))), ("WARC-Refers-To-Target-URI", kept.url), ("WARC-Refers-To-Date", when_of(first_date)), ("X-Refers-To-Page-Id", str(first))]
        return packed(warc_record("revisit", [("WARC-Profile", PROFILE), *own, *to], head))

    def members() -> Iterator[bytes]:
        for batch in batches:
            *about, member = batch.columns
            for k, first in enumerate(about[0].to_pylist()):
                yield member[k].as_py() if first is None else revisit(*[c[k].as_py() for c in about])

    yield from _chunked([("value", pa.binary())], _in_files(members(), lambda k: warcinfo(f"{name}-{k}.warc.gz"), lambda m: m), lambda r: len(r[0]))


def _in_files(records: Iterable, opening, member) -> Iterator[tuple[bytes]]:
    """Records put together, as gzip members, to files of about FILE_BYTES; opening(k) is the first record of the k-th and is made before the
    members of that file. The last byte, a 0, is left to the line separator of the writer."""
    held: list[bytes] = []
    size, files = 0, 0
    for record in records:
        if not held:
            held.append(packed(opening(files)))
            files += 1
        held.append(member(record))
        size += len(held[-1])
        if size >= FILE_BYTES:
            yield (b"".join(held)[:-1],)
            held, size = [], 0
    if held:
        yield (b"".join(held)[:-1],)


def warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content) of WARC files to a row for each record but the warcinfo; what they hold is measured again."""

    def made() -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column(0):
                for fields, block in read_warc(content.as_py()):
                    kind, name = fields["warc-type"], fields["warc-record-id"]
                    if kind in ("warcinfo", "revisit") and sha(block) != fields["warc-block-digest"]:
                        raise ValueError(f"record {name} does not hold its block")
                    if kind == "warcinfo":
                        continue
                    digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                    if kind != "revisit":
                        payload = split_http(block)[1] if kind == "response" else block
                        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"record {name} does not hold its payload")
                    to, page = fields.get("x-refers-to-page-id"), fields.get("x-page-id")
                    yield int(page) if page else NO_ID, size, digest, kind, int(to) if to else None

    kinds = [("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    yield from _chunked(kinds, made(), lambda r: 128)


# ---- operators


def _save(files: DataFrame, path: str) -> None:
    """Writes whole files from a column of bytes, a row each. The last byte of a gzip file, a 0, is what the writer ends its lines with."""
    files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """pages as ARC files under path, of both versions."""
    rows = pages.select(to_id(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    _save(rows.mapInArrow(trimmed(to_arc), "value binary"), path)


def read_arc_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of the ARC files under path, written to the shared folder: what identifies them, and their WARC records packed."""
    schema = "id long, kind string, digest binary, size long, url binary, ip string, date string, head binary, member binary"
    return written(_files(spark, path).mapInArrow(trimmed(arc_parsed), schema), "records")


def in_filter(shared, bits: int):
    """Whether a column of 16-byte digests may be in a broadcast filter; records themselves don't go through Python for that."""

    def run(digests: pd.Series) -> pd.Series:
        return pd.Series(filter_hits(np.frombuffer(shared.value, np.uint8), b"".join(digests), bits) if len(digests) else [], dtype=bool)

    return F.pandas_udf(run, "boolean")


def write_warc(records: DataFrame, path: str, least: int = LEAST) -> None:
    """Records of read_arc_files() as WARC files under path."""
    seen = records.where("kind = 'response'").select("id", "digest", "size", "url", "date")
    kept = F.min(F.struct("id", "url", "date")).alias("kept")
    first = written(seen.where(F.col("size") >= least).groupBy("digest").agg(kept, F.count("*").alias("n")).where("n > 1"), "repeated")
    held = F.coalesce(F.octet_length("kept.url"), F.lit(0)) + 100
    n, size = first.agg(F.count("*"), F.sum(held)).first()
    if (size or 0) <= FEW_BYTES:
        joined = records.join(F.broadcast(first), "digest", "left")
    else:
        bits = bits_for(n)
        members = first.select(F.substring("digest", 1, 16).alias("key")).mapInArrow(trimmed(build_members(bits)), "seg int, once binary, twice binary")
        shared = records.sparkSession.sparkContext.broadcast(merged_filter(members, bits))
        marked = records.withColumn("_open", in_filter(shared, bits)(F.substring("digest", 1, 16)))
        go = marked.where("_open").drop("_open").withColumn("_place", F.monotonically_increasing_id())  # tells records of a hot digest apart
        go = hot_join(go, first, "digest", seen.count(), "n").drop("_place")
        joined = go.unionByName(marked.where("NOT _open").drop("_open"), allowMissingColumns=True)
    is_response = F.when((F.col("kind") == "response") & (F.col("id") != F.col("kept.id")), F.col("kept.id"))
    out = joined.select(is_response.alias("first"), F.col("kept.url").alias("first_url"), F.col("kept.date").alias("first_date"), "id", "digest", "size", "url", "ip", "date", "head", "member")
    _save(out.mapInArrow(trimmed(to_warc), "value binary"), path)
    drop_written(first)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST) -> None:
    """The ARC files under arc_path as WARC files under warc_path."""
    records = read_arc_files(spark, arc_path)
    write_warc(records, warc_path, least)
    drop_written(records)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the WARC files under path; page_id is null for resources."""
    rows = _files(spark, path).mapInArrow(trimmed(warc_rows), "id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return rows.select(from_id("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", from_id("refers_to").alias("refers_to"))


def archive(pages: DataFrame) -> DataFrame:
    """A row a page, read from the WARC files to which the pages' ARC files were converted."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    records = read_arc_files(spark, arc)
    remove(spark, arc)
    write_warc(records, warc)
    drop_written(records)
    return read_warc_files(spark, warc)
