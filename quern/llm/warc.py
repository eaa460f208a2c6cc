"""Legacy ARC archives converted to WARC.

An ARC file begins with a version block that says which fields its header lines
have (version 1: five, version 2: ten); records are found by their declared lengths
alone. The converter makes WARC records of them: identifiers from the content's
place, timestamps from archive dates, types from what the record holds, and block
and payload digests. Of records with equal payloads the one with the largest key
stays a response and the others become revisits that refer to it.

Archives are tables of (file, bytes), each row a complete gzip file with a member per
record, some megabytes large, so any store that Spark writes can hold them and a lost
executor's files are written again; :func:`export_files` makes real files of them.
File names are taken to be unique.

Null urls and payloads are empty; repeated rows get records of their own (with equal
keys, all copies with the largest key are responses); rows with a null key come before
all keys. An empty table makes no files. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_bytes, materialize, small, text_or_empty

FILE_BYTES = 4 << 20
LEVEL = 1
#: Header fields of the two ARC versions (fixed values).
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
KEY_HEADER = "X-Archive-Key"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


class ArcError(ValueError):
    """An archive that breaks its own declarations."""


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def gunzip(data: bytes, slice_bytes: int = 1 << 16) -> Iterator[bytes]:
    """The members of a gzip file, one by one; other data are one member as they are."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        if data:
            yield data
        return
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ArcError("the last gzip member is cut off")
            part = view[at : at + slice_bytes]
            try:
                out.append(z.decompress(part))
            except zlib.error as e:
                raise ArcError(f"bad gzip data: {e}") from None
            at += len(part) - len(z.unused_data)
        yield b"".join(out)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC ---------------------------------------------------------------------------------


def arc_version_block(name: str, version: int, date: str) -> bytes:
    fields = FIELDS[version]
    body = f"{version} 0 quern\n{' '.join(fields)}\n".encode()
    plain = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Archive-length": str(len(body)), "Result-code": "200", "Filename": name, "Offset": "0"}
    return " ".join(plain.get(f, "-") for f in fields).encode() + b"\n" + body + b"\n"


def arc_record(url: str, date: str, content: bytes, version: int, name: str = "-", offset: int = 0) -> bytes:
    values = {"URL": quote(url, safe="!#$%&'()*+,/:;=?@[]~") or "-", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Archive-length": str(len(content))}
    values |= {"Result-code": "200", "Filename": name, "Offset": str(offset), "Checksum": hashlib.md5(content).hexdigest()}
    return " ".join(values.get(f, "-") for f in FIELDS[version]).encode() + b"\n" + content + b"\n"


def _header_line(member: bytes, at: int) -> tuple[str, int]:
    """The line at a place, and where the next one begins."""
    end = member.find(b"\n", at)
    if end < 0:
        raise ArcError("a header line has no end")
    return member[at:end].decode("utf-8", "replace").rstrip("\r"), end + 1


def _length(text: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise ArcError(f"a record declares {text!r} bytes")
    return int(text)


def _fields(member: bytes) -> tuple[list[str], int]:
    """The names of the header's fields, from a version block, and where it ends."""
    line, at = _header_line(member, 0)
    values = line.split(" ")
    if not values[0].startswith("filedesc://"):
        raise ArcError("an ARC file must begin with a version block")
    size = _length(values[-1])
    first, at_names = _header_line(member, at)
    fields = _header_line(member, at_names)[0].split(" ")
    if len(fields) != len(FIELDS.get(int(first.split(" ")[0]) if first.split(" ")[0].isdigit() else 0, [])) or len(values) != len(fields):
        raise ArcError(f"unknown ARC version line {first!r}")
    return fields, at + size


def parse_arc(data: bytes, errors: list[tuple[int, int, str]] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, content) of the records of an ARC file, gzipped or plain; the version block sets the header's fields.

    The URL may hold blanks: the other fields are counted from the line's end. What
    breaks its declarations raises :class:`ArcError` or, where ``errors`` is a list, is
    noted there as (gzip member, place in it, what) and the rest of its member is left
    out; reading goes on with the next member.
    """
    fields: list[str] = []
    members, k = gunzip(data), -1
    while True:
        at = 0
        try:
            k += 1
            member = next(members, None)
            if member is None:
                return
            if not fields:
                fields, at = _fields(member)
            while at < len(member):
                if member[at : at + 1] in (b"\n", b"\r"):  # between records
                    at += 1
                    continue
                line, begin = _header_line(member, at)
                values = line.rsplit(" ", len(fields) - 1)
                if len(values) != len(fields):
                    raise ArcError(f"{len(values)} values in a header line of {len(fields)} fields")
                size = _length(values[-1])
                content = member[begin : begin + size]
                if len(content) != size:
                    raise ArcError(f"a record declares {size} bytes and has {len(content)}")
                yield dict(zip(fields, values, strict=True)), content
                at = begin + size
        except ArcError as e:
            if errors is None:
                raise
            errors.append((k, at, str(e)))
            if not fields:
                return  # without a version block no header can be read


def bad_records(arcs: DataFrame) -> DataFrame:
    """(file, member, at, error): what :func:`convert` leaves out when it isn't strict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                errors: list[tuple[int, int, str]] = []
                for _ in parse_arc(data or b"", errors):
                    pass
                if errors:
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(errors), pa.string()), *(pa.array(c) for c in zip(*errors, strict=True))], ["file", "member", "at", "error"])

    return arcs.select("file", "bytes").mapInArrow(run, "file string, member long, at long, error string")


def write_arc(pages: DataFrame, version: int = 2, key: str = "page_id", url: str = "url", html: str = "html", date: str = "20240101000000") -> DataFrame:
    """(file, bytes): ARC files with an HTTP response per row, its key in a header."""
    rows = pages.select(F.col(key).cast("string").alias("key"), text_or_empty(F.col(url)).alias("url"), text_or_empty(F.col(html)).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        name, out, offset = f"part-{part:06d}-{k:06d}.arc.gz", [], 0
        for batch, texts in by_bytes(batches, "html"):
            for page, link, text in zip(batch.column("key").to_pylist(), batch.column("url").to_pylist(), texts, strict=True):
                if not out:
                    out.append(gzip_member(arc_version_block(name, version, date)))
                    offset = len(out[0])
                body = text.encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n" + (f"{KEY_HEADER}: {page}\r\n" if page is not None else "") + "\r\n"
                out.append(gzip_member(arc_record(link, date, http.encode() + body, version, name, offset)))
                offset += len(out[-1])
                if offset >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary())], ["file", "bytes"])
                    k += 1
                    name, out = f"part-{part:06d}-{k:06d}.arc.gz", []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary())], ["file", "bytes"])

    return rows.mapInArrow(run, "file string, bytes binary")


# --- WARC --------------------------------------------------------------------------------


def record_id(*names: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, names)))}>"


def warc_record(headers: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http_head(content: bytes) -> bytes:
    """An HTTP response up to its payload; nothing, if it isn't one."""
    if not content.startswith(b"HTTP/"):
        return b""
    end = content.find(b"\r\n\r\n")
    return content[: end + 4] if end >= 0 else content


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode() if m else None


def iso_date(arc: str) -> str:
    """20240102030405 (or a leading part of it) -> 2024-01-02T03:04:05Z."""
    d = arc + "00000101000000"[len(arc) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


MEMBERS = "key string, id string, date string, uri string, payload_digest string, payload_bytes long, head binary, member binary"


def warc_members(arcs: DataFrame, strict: bool = True) -> DataFrame:
    """A compressed response record per ARC record, with what a revisit in its place needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                rows = []
                for k, (header, content) in enumerate(parse_arc(data or b"", None if strict else [])):
                    head = http_head(content)
                    payload = content[len(head) :]
                    is_http = bool(head)
                    key, own = http_field(head, KEY_HEADER), record_id(file, k)
                    uri, date, sha = header["URL"], iso_date(header["Archive-date"]), digest(payload)
                    fields = {"WARC-Type": "response" if is_http else "resource", "WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": uri, "WARC-IP-Address": header["IP-address"]}
                    fields |= {"WARC-Block-Digest": f"sha1:{digest(content)}", "WARC-Payload-Digest": f"sha1:{sha}", "Content-Type": "application/http; msgtype=response" if is_http else header["Content-type"]}
                    rows.append((key, own, date, uri, sha, len(payload), head, gzip_member(warc_record(fields, content))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k > 5 else None if k == 5 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], [x.split(" ")[0] for x in MEMBERS.split(", ")])

    return arcs.select("file", "bytes").mapInArrow(run, MEMBERS)


def convert(arcs: DataFrame, least_bytes: int = 0, key_order: str = "long", strict: bool = True) -> DataFrame:
    """ARC files (file, bytes) -> WARC files (file, bytes), equal payloads stored once.

    ``key_order`` is the type in which keys are compared. Only digests, keys and HTTP
    heads are joined by digest; what decides whether a payload stays is its record's id,
    so a very common payload makes no hot key for payloads. A bad record ends the job or,
    if not ``strict``, is left out and listed by :func:`bad_records`.
    """
    members = materialize(warc_members(arcs, strict), "warc-members", "none")
    key = F.col("key").cast(key_order)
    narrow = members.drop("member").where(f"payload_bytes >= {least_bytes}")
    first = F.max(F.struct(key.alias("key"), "id", "date", "uri")).alias("kept")
    kept = narrow.groupBy("payload_digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "kept")
    kept = small(materialize(kept, "warc-kept"))
    again = narrow.join(kept, "payload_digest").where(~key.eqNullSafe(F.col("kept.key")))
    again = materialize(again, "warc-revisits")
    stays = members.join(small(again.select("id")), "id", "left_anti")
    own = ["key", "id", "date", "uri", "payload_digest", "payload_bytes"]
    to = {"to_key": "key", "to_id": "id", "to_date": "date", "to_uri": "uri"}
    stays = stays.select(*own, F.lit(None).cast("binary").alias("head"), "member", *(F.lit(None).cast("string").alias(c) for c in to))
    rows = stays.union(again.select(*own, "head", F.lit(None).cast("binary").alias("member"), *(F.col(f"kept.{f}").cast("string").alias(c) for c, f in to.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, out, size = TaskContext.get().partitionId(), 0, [], 0
        name = lambda: f"part-{part:06d}-{k:06d}.warc.gz"
        file = lambda: pa.RecordBatch.from_arrays([pa.array([name()]), pa.array([b"".join(out)], pa.binary())], ["file", "bytes"])
        for batch, _ in by_bytes(batches, "member"):
            for r in batch.to_pylist():
                if not out:
                    about = b"software: quern\r\nformat: WARC File Format 1.0\r\n"
                    out.append(gzip_member(warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name()), "WARC-Date": r["date"], "WARC-Filename": name(), "Content-Type": "application/warc-fields"}, about)))
                member = r["member"]
                if member is None:
                    fields = {"WARC-Type": "revisit", "WARC-Record-ID": r["id"], "WARC-Date": r["date"], "WARC-Target-URI": r["uri"], "WARC-Profile": REVISIT_PROFILE, "WARC-Payload-Digest": f"sha1:{r['payload_digest']}"}
                    fields |= {"WARC-Refers-To": r["to_id"], "WARC-Refers-To-Date": r["to_date"], "WARC-Refers-To-Target-URI": r["to_uri"], "X-Refers-To-Key": r["to_key"], "X-Payload-Length": r["payload_bytes"]}
                    fields |= {"WARC-Block-Digest": f"sha1:{digest(r['head'])}", "Content-Type": "application/http; msgtype=response"}
                    member = gzip_member(warc_record(fields, r["head"]))
                out.append(member)
                size += len(member)
                if size >= FILE_BYTES:
                    yield file()
                    k, out, size = k + 1, [], 0
        if out:
            yield file()

    return rows.mapInArrow(run, "file string, bytes binary")


class WarcError(ValueError):
    """A record whose digest or length is not what it declares."""


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for member in gunzip(data):
        end = member.index(b"\r\n\r\n")
        version, *lines = member[:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines)
        block = member[end + 4 : end + 4 + int(headers["Content-Length"])]
        if not version.startswith("WARC/") or member[end + 4 + len(block) :] != b"\r\n\r\n":
            raise WarcError(f"record {headers.get('WARC-Record-ID')} is not as long as it declares")
        yield headers, block


def read_warc(warcs: DataFrame) -> DataFrame:
    """A row per response, resource and revisit record; digests are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("bytes").to_pylist():
                rows = []
                for headers, block in parse_warc(data):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                        raise WarcError(f"block digest of {headers['WARC-Record-ID']}")
                    head, sha = http_head(block), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = len(block) - len(head)
                    if kind == "revisit":
                        size = int(headers["X-Payload-Length"])
                    elif digest(block[len(head) :]) != sha:
                        raise WarcError(f"payload digest of {headers['WARC-Record-ID']}")
                    to = headers.get("X-Refers-To-Key")
                    rows.append((http_field(head, KEY_HEADER), size, sha, kind, to, headers["WARC-Record-ID"], headers["WARC-Date"], headers["WARC-Target-URI"], headers.get("WARC-Refers-To")))
                if rows:
                    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date", "uri", "refers_to_id"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 1 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], names)

    return warcs.mapInArrow(run, "key string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, date string, uri string, refers_to_id string")


def export_files(archives: DataFrame, folder: str) -> list[str]:
    """Write the archives as files of a local folder, one at a time."""
    paths = []
    for row in archives.toLocalIterator():
        Path(folder).mkdir(parents=True, exist_ok=True)
        path = Path(folder, row["file"])
        path.write_bytes(row["bytes"])
        paths.append(str(path))
    return paths


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, unhex(sha1(html))::bit::varchar as bits from p),
m as (select *, max(page_id) over (partition by bits) as first from d)
select page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(
         list_transform(range(5), lambda j: substr(bits, i * 5 + j + 1, 1)::int), lambda x, y: 2 * x + y), 1)), 'string_agg', '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from m
"""
