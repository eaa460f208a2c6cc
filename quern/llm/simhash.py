"""SimHash near-duplicates, searched with pigeonring filtering.

Fingerprints are computed over whole texts with numpy. For the search, a
64-bit fingerprint is a ring of five segments. If two differ in at most t bits, then from
some segment on, every chain of l consecutive segments differs in at most
floor(l * t / 5) bits. For t = 4 that is 0, 1, 2, 3, 4: the first segment is equal
and the second differs in one bit at most, so these two make the join key; longer
chains and the full distance are checked on what the join finds. All links are
found this way, and only equal fingerprints, which are one node, are never paired.

``similar_texts`` asks for a similarity instead of a few bits, so budgets are several
bits a segment and no list of probes is complete and affordable. It takes wide
fingerprints, whose bits several shuffled rings cut into segments; a pair that shares
a segment is checked by chains of whole words and the full distance, inside the join.
Segments get longer, and rings more, with the logarithm and a small power of the
number of texts, so that a pair at the wanted similarity is found with probability
``FOUND`` at every size, and nearly surely above it. Texts of a segment first meet one
of them, then only texts of other components, so a group yields no square of links.

``alike_texts``, which ``keep_one`` uses, leaves nothing to such luck: all pairs whose
sizes allow the similarity (below 1) are tested by the ring's chains, and the sets of
shingles themselves decide.

Texts that are null or without words have fingerprint zero and link like others.
Null ids are ignored when a component is named, unless it has no others; repeated
ids and rows each keep a row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, reduce
from itertools import combinations
from math import acos, ceil, comb, log, log1p, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LOWER, by_bytes, materialize, scratch, small, text_or_empty
from quern.llm.graph import components

SHINGLE = 4
SEED = 42
RADIUS = 4
SEGMENTS = (13, 13, 13, 13, 12)

#: The multipliers of XXH64 (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
LONG_SHINGLE = 256
SHINGLES_AT_ONCE = 1 << 18
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def _hash_equal_lengths(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """XXH64 of the rows of ``words`` (little-endian 8-byte words, zero or more bytes beyond ``length``)."""
    s, at = np.uint64(seed), 0
    n = len(words)
    if length >= 32:
        v = [np.full(n, x) for x in (s + P1 + P2, s + P2, s, s - P1)]
        while length - 8 * at >= 32:
            v = [_round(v[k], words[:, at + k]) for k in range(4)]
            at += 4
        h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
        for x in v:
            h = (h ^ _round(np.uint64(0), x)) * P1 + P4
    else:
        h = np.full(n, s + P5)
    h = h + np.uint64(length)
    while length - 8 * at >= 8:
        h = _turn(h ^ _round(np.uint64(0), words[:, at]), 27) * P1 + P4
        at += 1
    rest = length - 8 * at
    if rest:
        tail, low = words[:, at], 0
        if rest >= 4:
            h = _turn(h ^ ((tail & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
            low = 4
        for k in range(low, rest):
            h = _turn(h ^ (((tail >> np.uint64(8 * k)) & np.uint64(0xFF)) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def xxh64_many(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of a byte array."""
    out = np.empty(len(starts), dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(LONG_SHINGLE + 8, dtype=np.uint8)])
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    with np.errstate(over="ignore"):
        for size, a, b in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            rows = order[a:b]
            if size > LONG_SHINGLE:
                out[rows] = [xxhash.xxh64_intdigest(data[s : s + size].tobytes(), seed) for s in starts[rows].tolist()]
                continue
            width = -(-max(size, 1) // 8) * 8
            words = np.lib.stride_tricks.sliding_window_view(padded, width)[starts[rows]].view("<u8")
            out[rows] = _hash_equal_lengths(words, size, seed)
    return out


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with single spaces, words' starts and ends there, and each text's first word (and the number of words)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = SPACE[raw]
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    keep = ~space
    keep[:-1] |= ~space[1:]
    after = np.empty(len(raw), dtype=bool)
    after[0], after[1:] = True, space[:-1]
    first_byte = after & ~space
    words_up_to = np.searchsorted(np.flatnonzero(first_byte), text_ends)
    data = np.where(space, np.uint8(0x20), raw)[keep]
    starts = np.flatnonzero(first_byte[keep])
    blank = np.append(data == 0x20, True)
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return data, starts, ends, np.concatenate([[0], words_up_to])


def shingles_of(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, the shingles' starts, lengths and texts there, and each text's number of shingles."""
    data, starts, ends, bounds = word_spans(texts)
    n_words = np.diff(bounds)
    n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + bounds[:-1][doc]
    last = np.minimum(first + shingle, bounds[1:][doc]) - 1
    return data, starts[first], ends[last] - starts[first], doc, n


#: For each byte, its bits as eight counters of one byte, highest bit first.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def _remixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of hashes (k = 0: themselves)."""
    if k == 0:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * P1
    x = (x ^ (x >> np.uint64(27))) * P2
    return x ^ (x >> np.uint64(31))


def _majorities(hashes: Iterable[tuple[np.ndarray, np.ndarray]], n: np.ndarray, words: int) -> np.ndarray:
    """Bits set in over half of each text's ``n`` hashes, which come in parts of (hashes, ascending texts): (texts, 64-bit words)."""
    counts = np.zeros((len(n), words * 8, 8), dtype=np.int64)
    for h, doc in hashes:
        docs, begin = np.unique(doc, return_index=True)
        runs = -(-np.diff(np.append(begin, len(h))) // 255)  # a counter of one byte holds 255 shingles
        first = np.cumsum(runs) - runs
        starts = np.repeat(begin, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
        for k in range(words):
            by_byte = _remixed(h, k).astype(">u8").view(np.uint8).reshape(-1, 8)
            for j in range(8):
                lanes = np.add.reduceat(LANES[by_byte[:, j]], starts).view(np.uint8).reshape(-1, 8)
                counts[docs, k * 8 + j] += np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
    bits = counts.reshape(len(n), words * 64) * 2 > n[:, None]
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def _parts(size: int) -> Iterator[slice]:
    return (slice(a, a + SHINGLES_AT_ONCE) for a in range(0, size, SHINGLES_AT_ONCE))


def fingerprints(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED, words: int = 1) -> np.ndarray:
    """SimHash of each lower-cased text over its word shingles, repeats included: (texts, 64-bit words)."""
    data, at, size, doc, n = shingles_of(texts, shingle)
    return _majorities(((xxh64_many(data, at[x], size[x], seed), doc[x]) for x in _parts(len(doc))), n, words)


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of lower-cased texts, ascending within a text, their texts, and each text's number of them."""
    data, at, size, doc, _ = shingles_of(texts, shingle)
    h = np.concatenate([np.empty(0, dtype=np.uint64), *(xxh64_many(data, at[x], size[x]) for x in _parts(len(doc)))])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
    return h[new], doc[new], np.bincount(doc[new], minlength=len(texts))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text_or_empty(text))


def with_fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """(doc_id, text_hash, fp), or fp0, fp1, ... of more words: the fingerprint as signed longs."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["fp"] if words == 1 else [f"fp{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, "text"):
            fp = fingerprints([t.encode().translate(LOWER) for t in texts], shingle, words=words).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(fp[:, k])) for k in range(words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns], ["doc_id", "text_hash", *names])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(F.col(text)).alias("text"), text_hash(F.col(text)).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, " + ", ".join(f"{x} long" for x in names))


def _offsets(segments: tuple[int, ...]) -> list[int]:
    return [sum(segments[:k]) for k in range(len(segments))]


def _segment(fp: Column, k: int, segments: tuple[int, ...]) -> Column:
    k %= len(segments)
    return F.shiftrightunsigned(fp, _offsets(segments)[k]).bitwiseAND(F.lit((1 << segments[k]) - 1))


def links(nodes: DataFrame, radius: int = RADIUS, segments: tuple[int, ...] = SEGMENTS) -> DataFrame:
    """nodes (fp), distinct -> (a, b) with a < b: all pairs that differ in at most ``radius`` bits."""
    m = len(segments)
    budget = [(k + 1) * radius // m for k in range(m)]
    keys, probes = [], []
    for i in range(m):
        size = segments[(i + 1) % m]
        here, there = _segment(F.col("fp"), i, segments), _segment(F.col("fp"), i + 1, segments)
        key = lambda x, y, i=i, size=size: F.lit(i) + m * (F.shiftleft(x, size) + y)
        keys.append(key(here, there))
        flips_here = [sum(1 << b for b in c) for r in range(budget[0] + 1) for c in combinations(range(segments[i]), r)]
        for f in flips_here:
            left = budget[1] - f.bit_count()
            for r in range(left + 1):
                for c in combinations(range(size), r):
                    probes.append(key(here.bitwiseXOR(F.lit(f)), there.bitwiseXOR(F.lit(sum(1 << b for b in c)))))
    index = nodes.select(F.col("fp").alias("b"), F.explode(F.array(*keys)).alias("key"))
    probe = nodes.select(F.col("fp").alias("a"), F.explode(F.array(*probes)).alias("key"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    start = (F.col("key") % m).cast("int")
    chain = F.lit(False)
    for i in range(m):
        ok, total = start == i, F.lit(0)
        for step in range(m):
            total = total + F.bit_count(_segment(x, i + step, segments))
            if 1 < step < m - 1:
                ok = ok & (total <= budget[step])
        chain = chain | ok
    found = probe.join(index, (probe["key"] == index["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(x) <= radius)).select("a", "b", probe["key"])
    return found.where(chain).select("a", "b").distinct()


def _named(fps: DataFrame, node: list[str], heads: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``fps`` with ``first``, the least head of the component of their node."""
    roots = components(edges).withColumnRenamed("node", "id")
    roots = small(materialize(roots.union(roots.select("root", "root")).distinct(), "simhash-roots"))
    linked = heads.join(roots, "id").groupBy("root").agg(F.min("head").alias("least"))
    named = heads.join(roots, "id", "left").join(small(materialize(linked, "simhash-least")), "root", "left")
    named = materialize(named.select(*node, F.coalesce("least", "head").alias("first")), "simhash-names")
    return fps.join(named, node)


def _heads(fps: DataFrame, node: list[str]) -> DataFrame:
    """Each node's least row by id, null last, and then by text."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "text_hash")
    return fps.groupBy(*node).agg(F.min(row).alias("head"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, fp, first): ``first`` is the row (id, text_hash) of its component with the smallest id, null last."""
    with scratch():
        fps = materialize(with_fingerprint(docs), "simhash")
        heads = materialize(_heads(fps, ["fp"]).withColumn("id", F.col("fp")), "simhash-heads")
        found = _named(fps, ["fp"], heads, links(heads.select("fp"), radius))
        return materialize(found.select("doc_id", "text_hash", "fp", "first"), "simhash-found", stays=True)


#: The similarity (Jaccard, of shingles) of near copies, and their shingles; 64-bit words of a wide fingerprint.
SIMILAR, WIDE_SHINGLE, WIDE = 0.8, 5, 8
#: How surely a pair of just that similarity shares a segment, and the texts that share a segment with a text by chance.
FOUND, CHANCE = 0.95, 0.25


def differing(similarity: float) -> float:
    """The share of bits in which fingerprints of two equally long texts differ on average."""
    return acos(2 * similarity / (1 + similarity)) / pi


def wide_radius(similarity: float = SIMILAR, words: int = WIDE, deviations: int = 1) -> int:
    """The bits in which texts of that similarity may differ: their mean, and some standard deviations more."""
    share, bits = differing(similarity), 64 * words
    return int(bits * share + deviations * sqrt(bits * share * (1 - share)))


def segments_for(texts: int, similarity: float = SIMILAR, words: int = WIDE) -> list[np.ndarray]:
    """The bits of each segment: rings of all bits, shuffled, and cut."""
    width = min(40, max(12, ceil(log2(max(1, texts) / CHANCE))))
    bits, flips = 64 * words, round(64 * words * differing(similarity))
    number = ceil(log(1 - FOUND) / log1p(-comb(bits - flips, width) / comb(bits, width)))
    found: list[np.ndarray] = []
    for ring in range(number):
        order = np.random.default_rng(SEED + ring).permutation(bits)
        found += [order[k : k + width] for k in range(0, bits - width + 1, width)]
        if len(found) >= number:
            break
    return found[:number]


def with_keys(nodes: DataFrame, segments: list[np.ndarray], fp: list[str]) -> DataFrame:
    """nodes (id, fp0, ...) -> (id, key), a row for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 2048):
                part = batch.slice(a, 2048)
                raw = np.stack([part.column(x).to_numpy() for x in fp], axis=1)
                bits = np.unpackbits(np.ascontiguousarray(raw.astype(">i8")).view(np.uint8), axis=1).astype(np.int64)
                keys = np.empty((len(part), len(segments)), dtype=np.int64)
                for k, s in enumerate(segments):
                    keys[:, k] = (bits[:, s] << np.arange(len(s))).sum(axis=1) * len(segments) + k
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(segments))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], ["id", "keys"])

    return nodes.select("id", *fp).mapInArrow(run, "id long, keys array<long>").select("id", F.explode("keys").alias("key"))


def within(a: list[Column], b: list[Column], radius: int) -> Column:
    """At most ``radius`` bits differ.

    Some word begins a chain along the ring of words whose differences stay within their
    share of the radius; pairs without such a word, nearly all, aren't looked at further.
    """
    words = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)]
    begins = reduce(lambda x, y: x | y, (w <= radius // len(words) for w in words))
    return begins & (reduce(lambda x, y: x + y, words) <= radius)


def similar_links(nodes: DataFrame, similarity: float = SIMILAR, words: int = WIDE) -> DataFrame:
    """nodes (id, fp0, ...), distinct -> (a, b): pairs within the radius that share a segment, enough to join all that such pairs join.

    Two texts alone in a segment are a pair at once. Where there are more, each meets
    the one with the smallest id, and then those that are still in other components.
    """
    fp, radius = [f"fp{k}" for k in range(words)], wide_radius(similarity, words)
    bands = with_keys(nodes, segments_for(nodes.count(), similarity, words), fp)
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    shared = materialize(shared.where("n > 1"), "simhash-shared")
    crowded = small(shared.where("n > 2").select("key", F.col("a").alias("chief")))
    members = materialize(bands.join(crowded, "key"), "simhash-members")
    one, other = (nodes.select(F.col("id").alias(i), *(F.col(x).alias(i + x) for x in fp)) for i in "ab")
    near = within([F.col("a" + x) for x in fp], [F.col("b" + x) for x in fp], radius)
    pairs = shared.where("n = 2").select("a", "b").union(members.where("id <> chief").select(F.col("chief").alias("a"), F.col("id").alias("b"))).distinct()
    first = materialize(pairs.join(one, "a").join(other, "b").where(near).select("a", "b"), "simhash-first")
    roots = small(materialize(components(first).withColumnRenamed("node", "id"), "simhash-roots"))
    members = members.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    members = materialize(members.join(small(materialize(mixed, "simhash-mixed")), "key", "left_semi"), "simhash-mixed-members")
    x = members.select("key", F.col("id").alias("a"), F.col("root").alias("ra")).join(one, "a")
    y = members.select(F.col("key").alias("bkey"), F.col("id").alias("b"), F.col("root").alias("rb")).join(other, "b")
    rest = x.join(y, (F.col("key") == F.col("bkey")) & (F.col("ra") < F.col("rb")) & near)
    return first.union(rest.select("a", "b"))


def similar_texts(docs: DataFrame, similarity: float = SIMILAR, shingle: int = WIDE_SHINGLE, words: int = WIDE) -> DataFrame:
    """(doc_id, text_hash, first), as :func:`near_duplicates`, for texts whose shingles have that similarity by their fingerprints."""
    fp = [f"fp{k}" for k in range(words)]
    with scratch():
        fps = materialize(with_fingerprint(docs, shingle=shingle, words=words), "simhash-wide")
        heads = materialize(_heads(fps, fp).withColumn("id", F.xxhash64(*fp)), "simhash-heads")
        found = _named(fps, fp, heads, similar_links(heads, similarity, words))
        return materialize(found.select("doc_id", "text_hash", "first"), "simhash-found", stays=True)


#: Words of the ring that all pairs of like sizes are tested by, and standard deviations above the mean that its radius allows.
RING, ALLOWED = 4, 4
#: 64-bit words of the parities of a set, which differ in no more bits than the sets in members.
PARITIES = 4
#: Nodes of a block, of which two make a cell, at least and at most, and those compared at once with so many others.
BLOCKS, ROWS, COLUMNS = (1 << 10, 1 << 17), 256, 4096
#: Candidates of a node and cell that a round of the search takes, nearest first; the last round takes all.
ROUNDS = (1, 16, None)
#: Sets up to this size have their share of differing bits computed from binomials.
FEW = 64
#: Candidates that a task holds before it leaves all but the nearest.
HELD = 1 << 20
#: Parts into which the pairs of one node are dealt.
DEALT = 64


def node_columns(words: int) -> list[str]:
    return [*(f"fp{k}" for k in range(words)), *(f"odd{k}" for k in range(PARITIES))]


def with_sets(docs: DataFrame, shingle: int = WIDE_SHINGLE, words: int = WIDE) -> DataFrame:
    """(doc_id, text_hash, id, n, fp0, ..., odd0, ...): a hash of the set of shingles, their number, the set's fingerprint and parities."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names, bits = ["id", "n", *node_columns(words)], 64 * PARITIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, "text"):
            h, doc, n = shingle_sets([t.encode().translate(LOWER) for t in texts], shingle)
            fp = _majorities(((h[x], doc[x]) for x in _parts(len(h))), n, words).view(np.int64)
            sums, ends = np.append(np.uint64(0), np.cumsum(_remixed(h, words))), np.cumsum(n)
            odd = np.bincount(doc * bits + (h % np.uint64(bits)).astype(np.int64), minlength=len(n) * bits) & 1
            odd = np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1).view(np.int64)
            columns = [(sums[ends] - sums[ends - n]).view(np.int64), n, *np.ascontiguousarray(np.concatenate([fp, odd], axis=1).T)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *map(pa.array, columns)], ["doc_id", "text_hash", *names])

    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"), text_hash(F.col("text")).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, " + ", ".join(f"{x} long" for x in names))


@cache
def most_differing(similarity: float, size: int) -> float:
    """The largest mean share of bits in which sets of that similarity differ, of which the larger has ``size`` members."""
    limit, found = differing(similarity), 0.0
    if size > FEW:
        return max(limit, most_differing(similarity, FEW))
    for other in range(ceil(similarity * size - 1e-6), size + 1):
        common = ceil(similarity * (size + other) / (1 + similarity) - 1e-6)
        if common > other:
            continue
        # A bit is set if over half of a set's members have it: the common ones, x, and its own.
        x = np.arange(common + 1)[:, None]
        chance, own = [comb(common, k) / 2**common for k in range(common + 1)], []
        for n in (size, other):
            y = np.arange(n - common + 1)
            odds = np.array([comb(n - common, k) / 2 ** (n - common) for k in y])
            own.append((((x + y) * 2 > n) * odds).sum(axis=1))
        found = max(found, float((chance * (own[0] * (1 - own[1]) + own[1] * (1 - own[0]))).sum()))
    return max(limit, found)


def set_radii(similarity: float, words: int) -> np.ndarray:
    """The bits of ``words`` words in which sets of that similarity may differ, by the larger one's size (the last: all beyond)."""
    bits = 64 * words
    shares = [most_differing(similarity, n) for n in range(FEW + 2)]
    return np.array([int(bits * p + ALLOWED * sqrt(bits * p * (1 - p))) for p in shares])


def on_chains(differ: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For rows of bits that differ by segment: from some segment on, all chains stay within their share of the row's radius."""
    m, found = differ.shape[1], np.zeros(len(differ), dtype=bool)
    for i in range(m):
        sums = np.cumsum(np.roll(differ, -i, axis=1), axis=1, dtype=np.int64)
        found |= (sums * m <= radius[:, None] * np.arange(1, m + 1)).all(axis=1)
    return found


def nearest_few(node: np.ndarray, key: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node's ``number`` smallest keys, of (node, key) in any order."""
    order = np.lexsort((key, node))
    node, key = node[order], key[order]
    begin = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
    rank = np.arange(len(node)) - np.repeat(begin, np.diff(np.append(begin, len(node))))
    return node[rank < number], key[rank < number]


def cells_of(sizes: dict[int, int], block: int) -> list[tuple[int, int, int, int]]:
    """Nodes by class of size -> (class, block, cell, side): blocks of a class and of the next one meet in a cell, as left (0), right (1) or both (2)."""
    blocks = {c: -(-n // block) for c, n in sizes.items()}
    pairs = [((c, i), (d, j)) for c in blocks for d in (c, c + 1) for i in range(blocks[c]) for j in range(i if c == d else 0, blocks.get(d, 0))]
    out = []
    for cell, (one, other) in enumerate(pairs):
        out += [(*one, cell, 2)] if one == other else [(*one, cell, 0), (*other, cell, 1)]
    return out


def ring_pairs(nodes: DataFrame, similarity: float, words: int, nearest: int | None = None, block: int | None = None) -> DataFrame:
    """nodes (id, n, root, fp0, ..., odd0, ...) -> (a, b) with a < b: candidates of that similarity that have different roots.

    They are all pairs whose sizes and parities allow it, whose first ``RING`` words differ by
    no more than their radius, found by chains along the ring, and whose words do by the whole
    one; or of these, each node's ``nearest`` few of a cell.
    """
    names = node_columns(words)
    m = min(RING, words)
    radii, whole = set_radii(similarity, m), set_radii(similarity, words)

    def compare(table: pa.Table) -> pa.Table:
        ids, n, root, side = (table.column(x).to_numpy() for x in ("id", "n", "root", "side"))
        marks = np.stack([table.column(x).to_numpy() for x in names], axis=1).view(np.uint64)
        prints, odd = np.ascontiguousarray(marks[:, :words]), np.ascontiguousarray(marks[:, words:])
        order = np.lexsort((ids, n))
        one, other = order[side[order] != 1], order[side[order] != 0]
        itself, sizes = bool((side == 2).any()), n[other]
        right = np.ascontiguousarray(prints[other, :m].T)
        node, key = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        pairs = [np.empty((0, 2), dtype=np.int64)]
        for p in range(0, len(one), ROWS):
            rows = one[p : p + ROWS]
            left = prints[rows, :m]
            low = np.searchsorted(sizes, ceil(n[rows[0]] * similarity - 1e-6))
            high = int(np.searchsorted(sizes, int(n[rows[-1]] / similarity + 1e-6), side="right"))
            first = int(radii[min(n[rows[0]], FEW + 1) :].max()) // m  # the larger set of a pair is at least as large
            for q in range(max(int(low), p + 1) if itself else int(low), high, COLUMNS):
                columns = other[q : min(high, q + COLUMNS)]
                near = np.zeros((len(rows), len(columns)), dtype=bool)
                for k in range(m):
                    near |= np.bitwise_count(left[:, k, None] ^ right[k, None, q : q + len(columns)]) <= first
                i, j = np.divmod(np.flatnonzero(near), len(columns))
                if itself:
                    after = q + j > p + i
                    i, j = i[after], j[after]
                i, j = rows[i], columns[j]
                apart = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6)
                i, j = i[apart], j[apart]
                able = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * (n[i] + n[j]) + 1e-6
                i, j = i[able], j[able]
                differ = np.bitwise_count(prints[i] ^ prints[j]).astype(np.int64)
                bits = differ.sum(axis=1)
                larger = np.minimum(np.maximum(n[i], n[j]), FEW + 1)
                found = on_chains(differ[:, :m], radii[larger]) & (bits <= whole[larger])
                i, j, bits = i[found], j[found], bits[found]
                if nearest is None:
                    pairs.append(np.stack([ids[i], ids[j]], axis=1))
                    continue
                node, key = np.concatenate([node, i, j]), np.concatenate([key, (bits << 32) | j, (bits << 32) | i])
                if len(node) > max(HELD, 2 * nearest * len(ids)):
                    node, key = nearest_few(node, key, nearest)
        if nearest is not None:
            node, key = nearest_few(node, key, nearest)
            pairs.append(np.stack([ids[node], ids[key & 0xFFFFFFFF]], axis=1))
        found = np.sort(np.concatenate(pairs), axis=1)
        return pa.table({"a": np.ascontiguousarray(found[:, 0]), "b": np.ascontiguousarray(found[:, 1])})

    # A little more than the ratio, so that rounding can't put sizes of just that ratio two classes apart.
    size_class = F.floor(F.ln("n") / (-log(similarity) * 1.0001)).cast("int")
    placed = nodes.where("n > 0").withColumn("class", size_class)
    counts = {r["class"]: r["count"] for r in placed.groupBy("class").count().collect()}
    block = block or min(max(BLOCKS[0], sum(counts.values()) // 32), BLOCKS[1])
    cells = cells_of(counts, block)
    blocks = nodes.sparkSession.createDataFrame([(c, -(-n // block)) for c, n in counts.items()], "class int, blocks int")
    cells_frame = nodes.sparkSession.createDataFrame(cells, "class int, block int, cell int, side int")
    placed = placed.join(F.broadcast(blocks), "class").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    placed = placed.join(small(cells_frame), ["class", "block"]).select("cell", "side", "id", "n", "root", *names)
    tasks = min(200, 1 + 4 * len({c[2] for c in cells}))
    return placed.repartition(tasks, "cell").groupBy("cell").applyInArrow(compare, "a long, b long")


def truly_similar(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """pairs (a, b), texts (id, text) -> (a, b): those whose sets of shingles have that similarity (Jaccard), by the sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chief = np.empty(0, dtype=np.uint64)
        for batch, words in by_bytes(batches, "text"):
            h, _, n = shingle_sets([t.encode().translate(LOWER) for t in words], shingle)
            keep = np.zeros(len(n), dtype=bool)
            for k, (member, end) in enumerate(zip(batch.column("b").is_valid().to_pylist(), np.cumsum(n).tolist(), strict=True)):
                own = h[end - n[k] : end]
                if not member:
                    chief = own
                elif len(chief) and len(own):
                    at = np.minimum(np.searchsorted(chief, own), len(chief) - 1)
                    both = int((chief[at] == own).sum())
                    keep[k] = both >= similarity * (len(chief) + len(own) - both) - 1e-6
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    dealt = pairs.withColumn("part", F.pmod("b", F.lit(DEALT)).cast("int"))
    members = dealt.join(texts, F.col("b") == F.col("id")).select("a", "part", "b", "text")
    chiefs = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("id")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rows = members.union(chiefs).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "text").mapInArrow(run, "a long, b long")


def alike_texts(docs: DataFrame, similarity: float = SIMILAR, shingle: int = WIDE_SHINGLE, words: int = WIDE, block: int | None = None) -> DataFrame:
    """(doc_id, text_hash, first), as :func:`near_duplicates`: texts whose sets of shingles have that similarity, or are equal, link.

    The ring search tests all pairs of like sizes, and the sets themselves decide on what it
    finds. Each node's nearest come first, then more, and at last all that are still in
    different components, so that a group of near copies yields no square of pairs.
    """
    names = node_columns(words)
    with scratch():
        fps = materialize(with_sets(docs, shingle, words), "simhash-sets")
        heads = materialize(_heads(fps, ["id", "n", *names]), "simhash-heads")
        rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"), text_hash(F.col("text")).alias("text_hash"))
        nodes, links, tested = heads.select("id", "n", F.col("id").alias("root"), *names), None, None
        for nearest in ROUNDS:
            pairs = ring_pairs(nodes, similarity, words, nearest, block).distinct()
            pairs = materialize(pairs if tested is None else pairs.join(small(tested), ["a", "b"], "left_anti"), "simhash-pairs")
            if tested is None:  # what has no candidate in the first round has none, and texts are needed of the others only
                asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
                asked = small(materialize(heads.join(small(asked), "id"), "simhash-asked"))
                same = rows["doc_id"].eqNullSafe(F.col("head.id")) & (rows["text_hash"] == F.col("head.text_hash"))
                texts = materialize(rows.join(asked, same).select("id", "text").dropDuplicates(["id"]), "simhash-texts")
            found = materialize(truly_similar(pairs, texts, similarity, shingle), "simhash-alike")
            links, tested = (found, pairs) if links is None else (links.union(found), tested.union(pairs))
            if nearest is not None:
                roots = small(materialize(components(links).withColumnRenamed("node", "id"), "simhash-roots"))
                nodes = asked.join(roots, "id", "left").select("id", "n", F.coalesce("root", "id").alias("root"), *names)
        found = _named(fps.select("doc_id", "text_hash", "id"), ["id"], heads.select("id", "head"), links)
        return materialize(found.select("doc_id", "text_hash", "first"), "simhash-found", stays=True)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """The documents without near copies: of each component its first row stays, once.

    What goes is found by id and text, so other rows that share an id stay.
    """
    stays = F.expr("doc_id <=> first.id and text_hash = first.text_hash")
    with scratch():
        found = alike_texts(docs, similarity)
        gone = materialize(found.where(~stays).select("doc_id", "text_hash").distinct(), "simhash-gone", stays=True)
        twice = found.where(stays).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        twice = materialize(twice.select("doc_id", "text_hash"), "simhash-twice", stays=True)
    gone, twice = small(gone), small(twice)
    wide = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    wide = wide.withColumn("hash", text_hash(F.col("row.text")))
    same = F.expr("d.row.doc_id <=> g.doc_id and d.hash = g.text_hash")
    left = wide.alias("d").join(gone.alias("g"), same, "left_anti")
    again = left.alias("d").join(twice.alias("g"), same, "left_semi")
    again = again.groupBy(F.col("row.doc_id"), "hash").agg(F.first("row").alias("row")).select("row", "hash")
    return left.alias("d").join(twice.alias("g"), same, "left_anti").union(again).select("row.*")
