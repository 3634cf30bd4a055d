"""WARC records in ZIP-packaged archives.

Writing: one record per page, each its own gzip member, in WARC files that are stored (not deflated) members of ZIP archives beside an index of their
offsets. Of pages with equal payloads the one of smallest id is a response, the others are revisits of it. Each task writes archives of a bounded
size under names of its own into the shared folder; the table of archives names those of the attempts that succeeded.

Reading: the end record, the ZIP64 locator and record and the central directory are parsed, stored members and their indexes are
located, and single records are read by their byte ranges; nothing is extracted. A payload whose digest is not the recorded one is an error.

Results: a null html is an empty payload; a null url is left out; a null id refers to the smallest id that has the payload, if any, and is
never referred to; repeated rows each have their record, and rows of the smallest id are all responses; a huge payload is a record and, if it fills one, an archive of its own;
an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.files import opened, write_file
from edgeloom.llm.common import map_batches, shared_dir, stored
from edgeloom.shipping import ship

#: Bytes of records after which an archive is closed; a task holds one archive in memory.
ARCHIVE = 8 << 20
#: Payloads of this many bytes on are revisited.
SMALLEST = 0
#: Payloads that occur again, up to which they are sent to every task.
BROADCAST = 500_000
_DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"

# ---------------------------------------------------------------------------------------------- ZIP directories

_END, _LOCATOR, _END64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_ALL32 = 0xFFFFFFFF


def directory(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (method, offset of the local header, stored size, full size) of every member, by the central directory."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(_END)
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at)  # the mark may also occur in the comment
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    disk, _, _, count, length, start = struct.unpack_from("<HHHHII", tail, at + 4)
    end = tail_at + at
    if end >= 20 and (locator := read(end - 20, 20))[:4] == _LOCATOR:
        end64 = struct.unpack_from("<Q", locator, 8)[0]
        record = read(end64, 56)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory where its locator points")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    elif disk not in (0, 0xFFFF):
        raise ValueError("an archive over several disks")
    data, at, out = read(start, length), 0, {}
    for _ in range(count):
        if data[at : at + 4] != _ENTRY:
            raise ValueError("a broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, full, name_len, extra_len, comment_len = struct.unpack_from("<IIHHH", data, at + 20)
        offset = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + name_len].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = data[at + 46 + name_len : at + 46 + name_len + extra_len], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # ZIP64: only the fields that are all ones in the entry, in this order
                values = list(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = values.pop(0) if full == _ALL32 else full
                packed = values.pop(0) if packed == _ALL32 else packed
                offset = values.pop(0) if offset == _ALL32 else offset
            k += 4 + n
        out[name] = (method, offset, packed, full)
        at += 46 + name_len + extra_len + comment_len
    return out


def data_start(read: Callable[[int, int], bytes], offset: int) -> int:
    """Where a member's bytes begin, by its local header."""
    head = read(offset, 30)
    if head[:4] != _LOCAL:
        raise ValueError("no local header where the central directory points")
    name_len, extra_len = struct.unpack_from("<HH", head, 26)
    return offset + 30 + name_len + extra_len


def stored_member(read: Callable[[int, int], bytes], entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """Start and size of a member that is stored."""
    method, offset, packed, full = entry
    if method != 0 or packed != full:
        raise ValueError("a deflated member can't be read by ranges")
    return data_start(read, offset), full


# ---------------------------------------------------------------------------------------------- records


def _clean(value: str) -> str:
    return quote(value, safe="".join(chr(c) for c in range(33, 127)))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member with a response or, if it refers to another page's, a revisit record. A revisit keeps the HTTP head, which tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'null' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    raw = zlib.decompress(data, 31)
    end = raw.find(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC record at this range")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    start = end + 4
    block = raw[start : start + int(headers["content-length"])]
    if len(block) != int(headers["content-length"]):
        raise ValueError("a record is cut short")
    return headers, block


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Bytes and digest of the full payload; the payload itself of a response, whose digest is checked."""
    end = block.find(b"\r\n\r\n")
    body = block[end + 4 :]
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d+)", block[:end])
        return int(length[1]), digest, None
    if base32_sha1(body) != digest:
        raise ValueError(f"the payload of {headers['warc-record-id']} isn't the one that was recorded")
    return len(body), digest, body


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Archive:
    """An archive that is being filled, in memory."""

    def __init__(self):
        self.warc, self.index = io.BytesIO(), []

    def add(self, page_id: int | None, kind: str, data: bytes) -> None:
        self.index.append(json.dumps({"page": page_id, "type": kind, "filename": "data.warc.gz", "offset": self.warc.tell(), "length": len(data)}))
        self.warc.write(data)

    def packed(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, data in (("archive/data.warc.gz", self.warc.getbuffer()), ("indexes/index.cdxj", "\n".join(self.index).encode()), ("datapackage.json", b'{"profile": "data-package"}')):
                with z.open(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), "w", force_zip64=True) as member:
                    member.write(data)
        return out.getvalue()


def read_archive(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every indexed record, each by its own range."""
    with opened(uri) as (read, size):
        members = directory(read, size)
        for name, entry in members.items():
            if not name.startswith("indexes/"):
                continue
            start, length = stored_member(read, entry)
            places = {}
            for line in read(start, length).decode().splitlines():
                at = json.loads(line)
                if at["filename"] not in places:
                    places[at["filename"]] = stored_member(read, members[f"archive/{at['filename']}"])
                base, room = places[at["filename"]]
                if at["offset"] + at["length"] > room:
                    raise ValueError("the index points beyond its WARC file")
                yield parse(read(base + at["offset"], at["length"]))


# ---------------------------------------------------------------------------------------------- tables


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smallest: int = SMALLEST, archive: int = ARCHIVE) -> DataFrame:
    """Writes the pages' archives; uri, records of each."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/edgeloom-{spark.sparkContext.applicationId}/archives-{uuid.uuid4().hex}"
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("binary"), F.lit("").cast("binary")).alias("html")).withColumn("sha1", F.sha1("html"))
    # only payloads that occur again are joined: pages stay where they are while these are few enough to be sent to every task; beyond that pages are shuffled
    # once, and adaptive execution splits a payload that many pages have
    again = rows.filter(F.length("html") >= smallest).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("sha1", "first")
    again = stored(again)
    joined = rows.join(F.broadcast(again) if again.count() <= BROADCAST else again, "sha1", "left")
    own = F.col("first").isNull() | F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    joined = joined.select("page_id", "url", "html", "sha1", F.when(~own, F.col("first")).alias("refers_to"))
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, done = Archive(), []

        def close() -> None:
            nonlocal open_
            uri = f"{folder}/{uuid.uuid4().hex}.zip"
            write_file(uri, open_.packed())
            done.append((uri, len(open_.index)))
            open_ = Archive()

        for batch in batches:
            for page_id, url, html, sha1, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                open_.add(page_id, "response" if refers_to is None else "revisit", record(page_id, url, html, digest, refers_to))
                if open_.warc.tell() >= archive:
                    close()
        if open_.index:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done]), pa.array([n for _, n in done], pa.int64())], names=["uri", "records"])

    return stored(joined.mapInArrow(run, "uri string, records long"))


def read(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri (and payload, null for revisits) of every record of the archives that column uri names."""
    tasks = max(1, min(archives.count(), 20_000))  # a few archives a task, so one that is lost costs little

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for uri in batch.column(0).to_pylist():
            for headers, block in read_archive(uri):
                size, digest, payload = payload_of(headers, block)
                page, other = (_page(headers.get(k)) for k in ("warc-record-id", "warc-refers-to"))
                out.append((page, size, digest, headers["warc-type"], other, headers.get("warc-target-uri"), payload if with_payload else None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ROW, strict=True)], schema=_ROW) if out else None

    rows = map_batches(archives.select("uri").repartition(tasks), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary", rows=1)
    return rows if with_payload else rows.drop("payload")


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])


def _page(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").removeprefix(_ID)
    return int(value) if re.fullmatch(r"-?\d+", value) else None
