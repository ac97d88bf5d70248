"""Legacy ARC archives and their conversion to WARC (operator 4).

An ARC file begins with a version block; version 1 headers have five fields, version 2 headers ten, and
both end with the declared length of what follows.  ``read_arc`` parses either by these lengths, and
``to_warc`` synthesises WARC 1.1 records: identifiers (name-based UUIDs of place, time, page and digest),
ISO timestamps, types and SHA-1 digests of block and payload.  A payload of at least ``least`` bytes that
several records have is stored once, with the greatest page_id; the others become revisits without it, which
name the identifier, place and time of the record that has it.  Records without an HTTP head become resources.

Each record is a gzip member of its own, so archives can be read from any record on.  Archives are written and
read by Spark's own writers and readers (a row of raw bytes is a file, whole files), each of about ``FILE``
bytes before compression (or one longer record), so that any file system that Spark knows can hold them and
a task holds one file.  Decisions about records reach their file by one join on its path, in which the file's
compressed bytes travel.

Defined results: a null html is an empty payload; a null url is written as ``-``; characters of a url
that can't stand in a header line (controls, spaces) are percent-encoded, as are bytes that are no UTF-8 in
the header of an ARC record; rows without page_id are responses of their own unless another record with a
page_id has their payload; rows with equal page_id and payload are of one type; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import UTC, datetime, timedelta
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skymesh.llm.frames import apart, scratch, small_batches, written

#: fields of the header line of an ARC record, by version (fixed values of the format)
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE = 16 << 20
STEP = 1 << 13
#: a gzip member without content: what the writer puts after each row (as Latin-1)
NOTHING = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0]).decode("latin-1")
FIRST = datetime(2004, 1, 1, tzinfo=UTC)


# -- ARC ------------------------------------------------------------------------------------------
def arc_version_block(version: int) -> bytes:
    body = f"{version} 0 skymesh\n{' '.join(ARC_FIELDS[version])}\n".encode()
    head = ["filedesc://skymesh.arc", "0.0.0.0", FIRST.strftime("%Y%m%d%H%M%S"), "text/plain"]
    return " ".join([*head, *(["200", "-", "-", "0", "skymesh.arc"] if version == 2 else []), str(len(body))]).encode() + b"\n" + body


def arc_record(version: int, page_id: int | None, url: str | None, html: bytes) -> bytes:
    name = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (name, len(html)) + html
    place = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"
    when = (FIRST + timedelta(seconds=(page_id or 0) % 10**8)).strftime("%Y%m%d%H%M%S")
    more = ["200", hashlib.md5(block).hexdigest(), "-", "0", "skymesh.arc"] if version == 2 else []
    return " ".join([place, "192.0.2.1", when, "text/html", *more, str(len(block))]).encode() + b"\n" + block


def header_text(raw: bytes) -> str:
    """A header line as text; bytes that are no UTF-8 are percent-encoded."""
    return re.sub("[\udc80-\udcff]", lambda m: f"%{ord(m[0]) - 0xDC00:02X}", raw.rstrip(b"\r").decode("utf-8", "surrogateescape"))


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head of a block, with the empty line that ends it, and the payload; no head if it isn't HTTP."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def read_arc(data: bytes):
    """(url, ip, date, type, http head, payload) of each record, by the declared lengths; an empty file
    has none."""
    if not data:
        return
    end = data.index(b"\n")
    length = int(data[:end].rsplit(None, 1)[1])
    version = int(data[end + 1 :].split(None, 1)[0])
    fields = ARC_FIELDS[version]
    at = end + 1 + length
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):  # what closes a record
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        part = dict(zip(fields, header_text(data[at:end]).rsplit(" ", len(fields) - 1), strict=True))
        length = int(part["Archive-length"])
        yield part["URL"], part["IP-address"], part["Archive-date"], part["Content-type"], *split_http(data[end + 1 : end + 1 + length])
        at = end + 1 + length


def http_field(head: bytes, name: bytes) -> int | None:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*(-?\d+)", head)
    return int(found[1]) if found else None


# -- WARC -----------------------------------------------------------------------------------------
def record_id(url: str, when: str, page: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {when} {page} {digest}').urn}>"


def sha1_name(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", sha1_name(hashlib.sha1(block).hexdigest())), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block


def read_warc(data: bytes):
    """(fields, block) of each record, by the declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = [header_text(x) for x in data[at:end].split(b"\r\n")]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        length = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


# -- tasks ----------------------------------------------------------------------------------------
def _files_of(rows, head: bytes, close: bytes, size: int):
    """A row for each file: ``head`` and as many records as make ``size`` bytes, each a gzip member."""
    pack = lambda x: zlib.compress(x + close, 6, 31)
    out, n = [], 0
    for row in rows:
        if out and n + len(row) > size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])
            out, n = [], 0
        out += [pack(row)] if out else [pack(head), pack(row)]
        n += len(row)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])


def _arcs(batches, version: int, size: int):
    def rows():
        for b in batches:
            html = b.column("html").cast(pa.binary())
            for page, url, body in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), html, strict=True):
                yield arc_record(version, page, url, body.as_py() or b"")

    yield from _files_of(rows(), arc_version_block(version), b"\n", size)


def unzipped(data: bytes) -> bytes:
    """All members of a gzip file, or what isn't one as it is.  Read in small steps: what a member leaves of a step is
    copied, so a step must not be a whole file."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, view, at = [], memoryview(data), 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            out.append(member.decompress(view[at : at + STEP]))
            at += STEP
        at = min(at, len(view)) - len(member.unused_data)
        if not member.eof:
            raise ValueError("a gzip member ends too early")
    return b"".join(out)


def iso(date: str) -> str:
    return datetime.strptime(date, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def _digests(batches):
    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            rows = [(i, http_field(head, b"X-Page-Id"), len(payload), hashlib.sha1(payload).hexdigest(), url, iso(date)) for i, (url, _, date, _, head, payload) in enumerate(read_arc(unzipped(data.as_py())))]
            place, page, n, digest, url, when = zip(*rows, strict=True) if rows else ((), (), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(place, pa.int32()), pa.array(page, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(url, pa.string()), pa.array(when, pa.string())], ["path", "place", "page_id", "n", "digest", "url", "date"])


def _warcs(batches, size: int):
    def rows():
        for b in batches:
            for data, repeats in zip(b.column("content"), b.column("repeats").to_pylist(), strict=True):
                other = {r["place"]: r["first"] for r in repeats or ()}
                for i, (url, ip, date, kind, head, payload) in enumerate(read_arc(unzipped(data.as_py()))):
                    page, digest, when = http_field(head, b"X-Page-Id"), hashlib.sha1(payload).hexdigest(), iso(date)
                    fields = [("WARC-Record-ID", record_id(url, when, page, digest)), ("WARC-Date", when), ("WARC-IP-Address", ip), ("WARC-Payload-Digest", sha1_name(digest)), ("WARC-Identified-Payload-Type", kind), ("WARC-Payload-Length", str(len(payload)))]
                    fields.append(("Content-Type", "application/http;msgtype=response" if head else kind))
                    if url != "-":
                        fields.insert(1, ("WARC-Target-URI", url))
                    if i in other:
                        first = other[i]
                        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(first["url"], first["date"], first["page_id"], digest))]
                        if first["url"] != "-":
                            fields.append(("WARC-Refers-To-Target-URI", first["url"]))
                        fields += [("WARC-Refers-To-Date", first["date"]), ("WARC-Refers-To-Page-Id", str(first["page_id"]))]
                        yield warc_record("revisit", fields, head)
                    else:
                        yield warc_record("response" if head else "resource", fields, head + payload)

    info = b"software: skymesh\r\nformat: WARC File Format 1.1\r\n"
    start = warc_record("warcinfo", [("WARC-Record-ID", record_id("warcinfo", "", None, "")), ("WARC-Date", FIRST.strftime("%Y-%m-%dT%H:%M:%SZ")), ("Content-Type", "application/warc-fields")], info)
    yield from _files_of(rows(), start, b"\r\n\r\n", size)


def _records(batches):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "date", "refers_to_record"]
    for b in batches:
        for data in b.column("content"):
            rows = []
            for fields, block in read_warc(unzipped(data.as_py())):
                if fields["WARC-Type"] == "warcinfo":
                    continue
                head, payload = split_http(block) if fields["WARC-Type"] != "resource" else (b"", block)
                digest = base64.b32decode(fields["WARC-Payload-Digest"].split(":")[1]).hex()
                whole = fields["WARC-Type"] != "revisit"
                if whole and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
                n = len(payload) if whole else int(fields["WARC-Payload-Length"])
                refers = fields.get("WARC-Refers-To-Page-Id")
                rows.append((http_field(head, b"X-Page-Id"), n, digest, fields["WARC-Type"], refers and int(refers), fields["WARC-Record-ID"], fields.get("WARC-Target-URI"), fields["WARC-Date"], fields.get("WARC-Refers-To")))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            values = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)


# -- jobs -----------------------------------------------------------------------------------------
def _write(rows: DataFrame, path: str) -> None:
    # the writer puts the bytes of a string out as they are; each row is a file
    rows.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING).option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")


def write_arcs(pages: DataFrame, path: str, version: int, size: int = FILE) -> None:
    """``pages`` (page_id, url, html) as ARC files of a version."""
    own = small_batches(pages).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    _write(own.mapInArrow(partial(_arcs, version=version, size=size), "value binary"), path)


def to_warc(spark: SparkSession, arcs: list[str], path: str, least: int = 1000, size: int = FILE) -> None:
    """The ARC files in the folders ``arcs`` as WARC files in the folder ``path``."""
    seen = written(_files(spark, *arcs).mapInArrow(_digests, "path string, place int, page_id bigint, n bigint, digest string, url string, date string"), "arc-digests")
    last = F.max(F.struct("page_id", "url", "date")).alias("first")
    kept = seen.filter(F.col("n") >= least).groupBy("digest", "n").agg(last, F.count(F.lit(1)).alias("records")).filter("records > 1").select("digest", F.col("n").alias("size"), "first")
    rest = seen.join(apart(kept), "digest").filter("n = size and not (page_id <=> first.page_id)")
    repeats = rest.groupBy("path").agg(F.collect_list(F.struct("place", "first")).alias("repeats"))  # at most a file's records
    rows = _files(spark, *arcs).join(repeats, "path", "left")
    _write(rows.mapInArrow(partial(_warcs, size=size), "value binary"), path)


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record (but warcinfo) of the WARC files in a folder."""
    return _files(spark, path).select("content").mapInArrow(_records, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, target_uri string, date string, refers_to_record string")


def converted(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``pages`` as ARC files of both versions (odd pages: version 2), converted to WARC and read back."""
    spark = pages.sparkSession
    odd = F.coalesce(F.col("page_id") % 2 != 0, F.lit(False))
    arcs = [scratch(spark, "arc1"), scratch(spark, "arc2")]
    write_arcs(pages.filter(~odd), arcs[0], 1)
    write_arcs(pages.filter(odd), arcs[1], 2)
    to_warc(spark, arcs, path := scratch(spark, "warc"), least)
    return read_warcs(spark, path)
