"""Media columns stored as content-defined chunks.

A document's bytes are kept as a sound file of 8-bit samples. A rolling gear hash
cuts the file where its last bytes say so, so files that share passages share chunks.
Spark joins find the chunks that several files hold: one file keeps the bytes, the
others only the digest. Files are put together again from their ordered chunk lists,
and every chunk's digest and length is verified.

Only digests are shuffled for that, and for files with chunks kept elsewhere these
chunks' bytes; files whose chunks are all their own are read where they lie. Equal
texts are stored once, by the smallest id, a null id last.

Null texts are empty: a payload of padding alone. Repeated rows each get a row; an
empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_bytes, materialize, settled, small, text_or_empty

UNIT = 576
PAD = b"\xff"
#: Chunk sizes: least, and most; a cut is where the hash's highest CUT_BITS bits are zero.
LEAST, MOST, CUT_BITS = 512, 16_384, 11
WINDOW = 32
#: A random 32-bit number for each byte, by rule.
GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([k]), digest_size=4, person=b"gear").digest() for k in range(256)), dtype="<u4").astype(np.uint32)

#: Where a chunk's bytes are: among the file's own, in its row's pool for other files to fetch, or in another file's pool.
OWN, POOL, ELSEWHERE = 0, 1, 2
CHUNKS = "array<struct<digest:binary,length:int,place:int>>"
PIECES = "array<struct<digest:binary,bytes:binary>>"


def pad(data: bytes) -> bytes:
    """Append bytes 255 up to a positive multiple of the unit."""
    return data + PAD * (-len(data) % UNIT if data else UNIT)


def to_media(payload: bytes, rate: int = 8000) -> bytes:
    """A RIFF WAVE file: one channel of unsigned 8-bit samples."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload


class MediaError(ValueError):
    """Stored bytes that are not what was written."""


def from_media(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise MediaError("not a RIFF WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name == b"fmt " and struct.unpack("<HH", media[at + 8 : at + 12]) + struct.unpack("<H", media[at + 22 : at + 24]) != (1, 1, 8):
            raise MediaError("not one channel of 8-bit samples")
        if name == b"data":
            if len(media) != at + 8 + size:
                raise MediaError("the samples are not as many as declared")
            return media[at + 8 :]
        at += 8 + size + size % 2
    raise MediaError("no samples")


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, h = 2 h + GEAR[byte] in 32 bits, summed by doubling the window."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, 2 * step
    return h


def cut_points(files: list[bytes]) -> list[list[int]]:
    """The ends of each file's chunks."""
    data = np.frombuffer(b"".join(files), dtype=np.uint8)
    marks = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    bounds = np.cumsum([0, *map(len, files)]).tolist()
    out = []
    for a, b, m in zip(bounds, bounds[1:], np.split(marks, np.searchsorted(marks, bounds[1:-1], side="right")), strict=False):
        ends, last = [], 0
        for p in [*(m - a).tolist(), b - a]:
            while p - last > MOST:
                last += MOST
                ends.append(last)
            if p - last >= LEAST or p == b - a > last:
                ends.append(p)
                last = p
        out.append(ends)
    return out


def split(file: bytes, ends: list[int]) -> list[bytes]:
    return [file[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def chunk_digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def describe(payload: bytes) -> str:
    """Whole-number features of the samples, as text."""
    x = np.frombuffer(payload, dtype=np.uint8)
    w = x.astype(np.int64)
    high = x >= 128
    total, square = int(w.sum()), int((w * w).sum())
    return f"mean={total / len(x):.6f};power={square / len(x):.6f};peak={int(x.max())};floor={int(x.min())};crossings={int((high[1:] != high[:-1]).sum())}"


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = text_or_empty(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.unhex(F.sha2(body, 256)).alias("key"))


def chunk_lists(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, n_bytes, digests): the ordered chunk list of each document's file; ``key`` is its text's SHA-256."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, "text"):
            raw = [t.encode() for t in texts]
            files = [to_media(pad(x)) for x in raw]
            digests = [[chunk_digest(c) for c in split(f, ends)] for f, ends in zip(files, cut_points(files), strict=True)]
            n = pa.array([len(x) for x in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), n, pa.array(digests, pa.list_(pa.binary()))], ["doc_id", "key", "n_bytes", "digests"])

    return _rows(docs, doc_id, text).mapInArrow(run, f"doc_id {kind}, key binary, n_bytes long, digests array<binary>")


def sharing(lists: DataFrame) -> DataFrame:
    """Who stores what, for files that are repeated or share chunks with others.

    (key, writer, elsewhere, given): the row that writes the file, the digests of its
    chunks that other files keep, and of those that it keeps for others. A chunk's
    keeper is the smallest key that holds it.
    """
    files = lists.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))).alias("writer"), F.count(F.lit(1)).alias("n"), F.first("digests").alias("digests"))
    files = materialize(files, "media-files")
    held = files.select("key", F.explode(F.array_distinct("digests")).alias("digest"))
    keepers = held.groupBy("digest").agg(F.min("key").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keeper")
    keepers = materialize(keepers, "media-keepers")
    given = keepers.groupBy(F.col("keeper").alias("key")).agg(F.collect_list("digest").alias("given"))
    foreign = held.join(small(keepers), "digest").where("keeper <> key").groupBy("key").agg(F.collect_list("digest").alias("elsewhere"))
    several = files.select("key", "writer", "n").join(foreign, "key", "left").join(given, "key", "left")
    return several.where("n > 1 or elsewhere is not null or given is not null").drop("n")


def store(docs: DataFrame, shared: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, complete, chunks, data, pool): each file's chunk list, its own bytes, and the chunks that others fetch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, "text"):
            files = [to_media(pad(t.encode())) for t in texts]
            lists, data, pools, complete = [], [], [], []
            for f, ends, away, given in zip(files, cut_points(files), batch.column("away").to_pylist(), batch.column("given").to_pylist(), strict=True):
                places = dict.fromkeys(away or [], ELSEWHERE) | dict.fromkeys(given or [], POOL)
                chunks, own, pool, seen = [], [], [], set()
                for c in split(f, ends):
                    d = chunk_digest(c)
                    place = places.get(d, OWN)
                    chunks.append({"digest": d, "length": len(c), "place": place})
                    if place != ELSEWHERE and d not in seen:
                        pool.append({"digest": d, "bytes": c}) if place == POOL else own.append(c)
                    seen.add(d)
                lists.append(chunks), data.append(b"".join(own)), pools.append(pool), complete.append(not away)
            kind = pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32()), ("place", pa.int32())]))
            piece = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))
            columns = [batch.column("key"), pa.array(complete), pa.array(lists, kind), pa.array(data, pa.binary()), pa.array(pools, piece)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "complete", "chunks", "data", "pool"])

    digests = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    rows = _rows(docs, doc_id, text).join(small(shared, weight=1 + digests("elsewhere") + digests("given")), "key", "left")
    rows = rows.where("writer is null or doc_id <=> writer.id").select("key", "text", F.col("elsewhere").alias("away"), "given")
    return rows.mapInArrow(run, f"key binary, complete boolean, chunks {CHUNKS}, data binary, pool {PIECES}")


def restore(stored: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, media): the stored files, put together and verified; a key that was stored twice comes twice."""
    whole = stored.where("complete").select("key", "chunks", "data", "pool", F.lit(None).cast(PIECES).alias("fetched"))
    pool = stored.select(F.explode("pool").alias("p")).select("p.digest", "p.bytes").dropDuplicates(["digest"])
    pool = materialize(pool, "media-pool")
    wanted = shared.where("elsewhere is not null").select("key", F.explode("elsewhere").alias("digest"))
    fetched = wanted.join(pool, "digest").groupBy("key").agg(F.collect_list(F.struct("digest", "bytes")).alias("fetched"))
    parts = stored.where("not complete").join(fetched, "key").select("key", "chunks", "data", "pool", "fetched")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in by_bytes(batches, "data"):
            files = []
            for chunks, data, pool, fetched in zip(*(batch.column(c).to_pylist() for c in ("chunks", "data", "pool", "fetched")), strict=True):
                known = {x["digest"]: x["bytes"] for x in [*(pool or []), *(fetched or [])]}
                at, out = 0, []
                for c in chunks:
                    if c["place"] == OWN and c["digest"] not in known:
                        known[c["digest"]] = data[at : at + c["length"]]
                        at += c["length"]
                    piece = known[c["digest"]]
                    if len(piece) != c["length"] or chunk_digest(piece) != c["digest"]:
                        raise MediaError(f"chunk {c['digest'].hex()}")
                    out.append(piece)
                files.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(files, pa.binary())], ["key", "media"])

    return whole.union(parts).mapInArrow(build, "key binary, media binary")


FEATURES = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, files in by_bytes(batches, "media"):
            rows = []
            for f in files:
                p = from_media(f)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(f), hashlib.sha256(f).hexdigest(), describe(p)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [x.split(" ")[0] for x in FEATURES.split(", ")])

    return media.mapInArrow(run, FEATURES)


@settled("media")
def media_features(docs: DataFrame) -> DataFrame:
    """Store all texts as media, read them back, and return each document's features."""
    lists = materialize(chunk_lists(docs), "media-lists")
    shared = materialize(sharing(lists), "media-shared")
    stored = materialize(store(docs, shared), "media-store")
    found = features(restore(stored, shared))
    found = materialize(found.groupBy("key").agg(*(F.first(c).alias(c) for c in found.columns[1:])), "media-features")
    return lists.select("doc_id", "n_bytes", "key").join(found, "key").drop("key")
