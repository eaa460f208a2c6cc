"""Nearest neighbours by balanced posting lists.

Centroids are trained on a bounded sample with a penalty on large lists. Every vector
is in the list of its nearest centroid and, if it lies near a boundary, in those of
other centroids that are about as near. A query searches the centroids by an
in-memory graph and reads the lists whose centroid's distance is at most a ratio of
the nearest one's. The ratio is set on the sample, against brute force, so that the
wanted recall is reached there. Lists are gathered in cells of bounded size, and a
list of many equal vectors is cut into several; a query goes once to each cell where
it reads lists. There it meets those lists alone: products in single precision show
which can't be among its nearest, by a bound on their error, and the others' are taken
in double precision, as sums in one order whatever the cell, so equal vectors have
equal scores. Cells' best are merged. What a task holds doesn't grow with the table.

Vectors of unequal length are compared by inner product as by distance after adding
one component that makes all equally long. A vector that is null, zero, or holds null
or non-finite components takes no part, as query or candidate; one with fewer
components than others has zeros for the rest. Equal scores rank by id; rows with a null id take no
part; of rows with one id all are candidates, and as queries they are one, the
largest. A table without vectors gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, settled

NEAREST = 20
#: Vectors read for training, and those of them that set the ratio.
SAMPLE, TRIALS = 20_000, 200
LIST_SIZE, MOST_LISTS = 512, 4_096
#: Vectors of a cell and queries that meet it at most; cells that even a small table has, if they hold FEWEST vectors.
BLOCK_VECTORS, BLOCK_QUERIES = 65_536, 16_384
CELLS, FEWEST = 24, 1_024
#: Rows whose distances to all centroids are held at once, products of a tile, rows of an Arrow batch, cells' results merged at once.
AT_ONCE, TILE, BATCH, MERGED = 1_024, 1 << 20, 4_096, 32
#: A vector is also put in lists whose centroid is at most this much farther, up to COPIES lists in all.
BOUNDARY, COPIES = 0.02, 4
RECALL = 0.97
NEIGHBOURS, BEAM = 16, 64


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vector array<double>): the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))
    least, most = rows.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if least != most:
        rows = rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(most) - F.size("vector"))))
    return rows


def packed(rows: DataFrame, kind: type = np.float64) -> DataFrame:
    """The vectors as bytes of that kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("vector")
            values = v.flatten().to_numpy().reshape(len(batch), -1) if len(batch) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in values.astype(kind)], pa.binary())], ["vec_id", "vector"])

    return rows.mapInArrow(run, "vec_id long, vector binary")


def matrix(vectors: list[bytes], kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype(np.float64, copy=False)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def train_centroids(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """k-means whose assignment pays for lists that are larger than the mean: centroids, and what each costs."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    burden = np.zeros(lists)
    for _ in range(rounds):
        own, least = np.empty(len(x), dtype=np.int64), np.empty(len(x))
        for a in range(0, len(x), AT_ONCE):
            d = squared_distances(x[a : a + AT_ONCE], c)
            own[a : a + AT_ONCE], least[a : a + AT_ONCE] = (d + burden).argmin(1), d.min(1)
        sizes = np.bincount(own, minlength=lists)
        burden = np.maximum(burden + 0.1 * least.mean() * (sizes / (len(x) / lists) - 1), 0)
        for k in np.flatnonzero(sizes):
            c[k] = x[own == k].mean(0)
        for k in np.flatnonzero(sizes == 0):
            c[k] = x[rng.integers(len(x))]
    return c, balance(x, c)


def balance(x: np.ndarray, c: np.ndarray, rounds: int = 40) -> np.ndarray:
    """What lists should cost, beside distances, so that the largest is as small as was found in some rounds."""
    blocks = [squared_distances(x[a : a + AT_ONCE], c).astype(np.float32) for a in range(0, len(x), AT_ONCE)]
    mean, step = len(x) / len(c), float(np.concatenate([d.min(1) for d in blocks]).mean(dtype=np.float64))
    best, least, burden = np.zeros(len(c)), np.inf, np.zeros(len(c))
    for _ in range(rounds):
        sizes = np.bincount(np.concatenate([(d + burden.astype(np.float32)).argmin(1) for d in blocks]), minlength=len(c))
        if sizes.max() < least:
            best, least = burden.copy(), sizes.max()
        burden = np.maximum(burden + step * np.clip(sizes / mean - 1, -1, 1), 0)
        step *= 0.88
    return best


@dataclass
class Index:
    centroids: np.ndarray
    burden: np.ndarray
    longest: float
    ratio: float = 0.0

    def __post_init__(self) -> None:
        d = squared_distances(self.centroids, self.centroids)
        near = np.argsort(d, axis=1, kind="stable")[:, 1 : NEIGHBOURS + 1]
        links = [set(r.tolist()) for r in near]
        for a, row in enumerate(near.tolist()):
            for b in row:
                links[b].add(a)
        # A ring over all centroids keeps the graph in one piece.
        for a in range(len(links)):
            if len(links) > 1:
                links[a] |= {(a + 1) % len(links), (a - 1) % len(links)}
        self.links = [np.array(sorted(s - {a}), dtype=np.int64) for a, s in enumerate(links)]
        self.entries = np.unique(np.linspace(0, len(links) - 1, num=min(8, len(links))).astype(int))

    def lift(self, x: np.ndarray) -> np.ndarray:
        """One component more, which makes all vectors as long as the longest."""
        return np.hstack([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))[:, None]])

    def search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances and numbers of the centroids in reach, nearest first: the graph is searched from all that are in reach at once."""
        far = np.full(len(self.centroids), np.inf)
        seen, done = np.zeros(len(far), dtype=bool), np.zeros(len(far), dtype=bool)
        new = self.entries
        while len(new):
            far[new] = np.sqrt(((self.centroids[new] - q) ** 2).sum(1))
            seen[new] = True
            known = far[seen]
            reach = np.inf if len(known) <= BEAM else max(known.min() * (1 + self.ratio), np.partition(known, BEAM - 1)[BEAM - 1])
            front = np.flatnonzero(seen & ~done & (far <= reach))
            done[front] = True
            near = np.unique(np.concatenate([self.links[k] for k in front])) if len(front) else front
            new = near[~seen[near]]
        found = np.flatnonzero(done)
        found = found[np.argsort(far[found], kind="stable")]
        return far[found], found

    def lists_for(self, q: np.ndarray, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The lists that a query reads: those within the ratio, and more until they hold ``least`` vectors."""
        far, found = self.search(np.append(q, 0.0))
        wanted = far <= far[0] * (1 + self.ratio)
        if sizes is not None:
            held = sizes[found]
            wanted |= np.cumsum(held) - held < least
        return found[wanted].tolist()

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the list of each vector, by distance and the list's cost, and the others at its boundary."""
        rows, lists = [], []
        for a in range(0, len(x), AT_ONCE):
            d = squared_distances(self.lift(x[a : a + AT_ONCE]), self.centroids) + self.burden
            near = np.argsort(d, axis=1, kind="stable")[:, :COPIES]
            dn = np.take_along_axis(d, near, 1)
            ok = dn <= dn[:, :1] * (1 + BOUNDARY) ** 2
            ok[:, 0] = True
            row, col = np.nonzero(ok)
            rows.append(row + a)
            lists.append(near[row, col])
        return np.concatenate(rows), np.concatenate(lists)

    def tune(self, x: np.ndarray, k: int) -> None:
        """Set the least ratio at which the sample's own neighbours are found, by brute force."""
        rows, lists = self.lists_of(x)
        holds = np.zeros((len(x), len(self.centroids)), dtype=bool)
        holds[rows, lists] = True
        trial = x[np.linspace(0, len(x) - 1, num=min(TRIALS, len(x))).astype(int)]
        scores = trial @ x.T
        top = np.argpartition(-scores, min(k, len(x) - 1), axis=1)[:, : k + 1]
        lifted = np.hstack([trial, np.zeros((len(trial), 1))])
        d = np.sqrt(squared_distances(lifted, self.centroids))
        need = np.array([[np.where(holds[j], row, np.inf).min() / row.min() - 1 for j in js] for row, js in zip(d, top, strict=True)])
        self.ratio = float(np.quantile(need, RECALL)) + 1e-9


def build(rows: DataFrame, k: int = NEAREST) -> Index | None:
    """An index trained on the SAMPLE vectors with the smallest hashes."""
    count, longest = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not count:
        return None
    sample = packed(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)).select("vector").toArrow().column("vector").to_pylist()
    x = matrix(sample)
    lists = max(1, min(MOST_LISTS, len(x) // 8, ceil(count / LIST_SIZE)))
    length = float(np.sqrt(longest)) * (1 + 1e-12)
    lifted = np.hstack([x, np.sqrt(np.maximum(length**2 - (x * x).sum(1), 0))[:, None]])
    index = Index(*train_centroids(lifted, lists), length)
    index.tune(x, k)
    return index


def postings(rows: DataFrame, index: Index, kind: type = np.float64) -> DataFrame:
    """(list, vec_id, vector): a row for each list that a vector is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), BATCH):
                part = batch.slice(a, BATCH)
                vectors = part.column("vector")
                row, lists = index.lists_of(matrix(vectors.to_pylist(), kind))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), part.column("vec_id").take(at), vectors.take(at)], ["list", "vec_id", "vector"])

    return packed(rows, kind).mapInArrow(run, "list int, vec_id long, vector binary")


def cells(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each list's first cell and number of cells: small lists share one, larger ones are cut."""
    most = min(BLOCK_VECTORS, max(FEWEST, -(-int(sizes.sum()) // CELLS)))
    first, pieces = np.zeros(len(sizes), dtype=np.int64), np.maximum(1, -(-sizes // most))
    cell, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            cell, held = cell + 1, 0
        first[k], held = cell, held + n
        if pieces[k] > 1:
            cell, held = cell + int(pieces[k]), 0
    return first, pieces


def probes(queries: DataFrame, index: Index, sizes: np.ndarray, least: int, kind: type = np.float64) -> DataFrame:
    """(cell, query_id, vector, lists): a row for each cell in which a query reads lists."""
    first, pieces = cells(sizes)

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[int]]]:
        for j, q in enumerate(matrix(batch.column("vector").to_pylist(), kind)):
            lists = np.sort(np.array(index.lists_for(q, sizes, least), dtype=np.int64))
            starts, begin = np.unique(first[lists], return_index=True)
            for cell, own in zip(starts.tolist(), np.split(lists, begin[1:]), strict=True):
                for piece in range(int(pieces[own[0]])):  # a list that is cut shares its cells with none
                    yield j, cell + piece, own.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch: pa.RecordBatch, found: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
            at, cell, lists = zip(*found, strict=True)
            at = pa.array(at)
            columns = [pa.array(cell, pa.int32()), batch.column("vec_id").take(at), batch.column("vector").take(at), pa.array(lists, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, ["cell", "query_id", "vector", "lists"])

        for batch in batches:
            found: list[tuple[int, int, list[int]]] = []
            for row in rows_of(batch):
                found.append(row)
                if len(found) == BATCH:
                    yield out(batch, found)
                    found = []
            if found:
                yield out(batch, found)

    return packed(queries, kind).mapInArrow(run, "cell int, query_id long, vector binary, lists array<int>")


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores with their ids, each id once, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    keep = order[np.sort(first)][:k]
    return ids[keep], scores[keep]


class Best:
    """The k best of each of some queries, from candidates that come in parts; an id counts once, by its best row."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.most = k, max(4 * k * queries, TILE)
        self.least = np.full(queries, -np.inf)
        self.at, self.ids, self.scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((at, ids, scores))
        self.waiting += len(at)
        if self.waiting > self.most:
            self.settle()

    def settle(self) -> None:
        at, ids, scores = (np.concatenate(c) for c in zip((self.at, self.ids, self.scores), *self.parts, strict=True))
        order = np.lexsort((-scores, ids, at))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(at[order]) != 0) | (np.diff(ids[order]) != 0)
        order = order[new]
        order = order[np.lexsort((ids[order], -scores[order], at[order]))]
        counts = np.bincount(at[order], minlength=len(self.least))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        last = order[rank == self.k - 1]
        self.least[at[last]] = scores[last]
        order = order[rank < self.k]
        self.at, self.ids, self.scores, self.parts, self.waiting = at[order], ids[order], scores[order], [], 0


def best_in_cell(ids: np.ndarray, lists: np.ndarray, x: np.ndarray, asked: np.ndarray, y: np.ndarray, reads: list[np.ndarray], k: int) -> Best:
    """The k best of each query among the vectors (ids, lists, x) of the lists that it reads, but for its own id."""
    best = Best(len(asked), k)
    order = np.lexsort((ids, lists))
    ids, lists, x = ids[order], lists[order], x[order]
    # Unit lengths, so that a product's error in single precision has one bound.
    longest = np.sqrt((x * x).sum(1).max())
    length = np.sqrt((y * y).sum(1))
    xs, ys = (x / longest).astype(np.float32), (y / length[:, None]).astype(np.float32)
    scale, slack = longest * length, (x.shape[1] + 8) * 2.0**-23
    wanted = np.concatenate(reads)
    reader = np.repeat(np.arange(len(asked)), [len(r) for r in reads])[np.argsort(wanted, kind="stable")]
    wanted = np.sort(wanted, kind="stable")
    height, width = 512, TILE // 512
    held, begin = np.unique(lists, return_index=True)
    for number, start, end in zip(held.tolist(), begin.tolist(), [*begin[1:].tolist(), len(lists)], strict=True):
        readers = reader[slice(*np.searchsorted(wanted, (number, number + 1)))]
        for a in range(start, end, width):
            b = min(a + width, end)
            alone, first = np.unique(ids[a:b], return_index=True)
            for r in range(0, len(readers), height):
                rows = readers[r : r + height]
                near = ys[rows] @ xs[a:b].T
                left, right = (np.searchsorted(ids[a:b], asked[rows], side) for side in ("left", "right"))
                for j in np.flatnonzero(left < right).tolist():
                    near[j, left[j] : right[j]] = -np.inf
                floor = best.least[rows] / scale[rows] - slack
                new = np.flatnonzero(np.isneginf(floor))
                if len(new) and len(alone) > k:
                    some = near[new] if len(alone) == b - a else np.maximum.reduceat(near[new], first, axis=1)
                    floor[new] = np.partition(some, len(alone) - k, axis=1)[:, len(alone) - k] - 2 * slack
                # Products of unit vectors are above -2, and those of a query's own rows are below.
                at, column = np.divmod(np.flatnonzero((near >= np.maximum(floor, -2).astype(np.float32)[:, None]).ravel()), b - a)
                for c in range(0, len(at), 1 << 16):
                    q, v = rows[at[c : c + (1 << 16)]], a + column[c : c + (1 << 16)]
                    best.add(q, ids[v], (x[v] * y[q]).sum(axis=1))
        if best.waiting > 2 * k * len(asked):
            best.settle()
    best.settle()
    return best


@settled("ann")
def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products among the other rows."""
    rows = materialize(usable(vectors, vec_id, embedding), "ann-rows")
    index = build(rows, k)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return rows.sparkSession.createDataFrame([], schema)
    kind = np.float32 if vectors.schema[embedding].dataType.simpleString() == "array<float>" else np.float64
    posted = materialize(postings(rows, index, kind), "ann-postings")
    counted = posted.groupBy("list").count().toArrow().to_pydict()
    sizes = np.zeros(len(index.centroids), dtype=np.int64)
    sizes[counted["list"]] = counted["count"]
    queries = rows.where(is_query).groupBy("vec_id").agg(F.max("vector").alias("vector"))
    n = queries.count()
    # Queries are dealt to several tasks, as each is searched for in the graph.
    queries = queries.repartition(max(1, min(200, -(-n // 256))), "vec_id")

    # A cell meets each block of the queries that read in it.
    blocks = max(1, -(-n // BLOCK_QUERIES))
    first, pieces = cells(sizes)
    plan = rows.sparkSession.createDataFrame([(j, int(f), int(m)) for j, (f, m) in enumerate(zip(first, pieces, strict=True))], "list int, first int, pieces int")
    cell = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("pieces"))).cast("int").alias("cell")
    left = probes(queries, index, sizes, COPIES * (k + 1), kind).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    right = posted.join(F.broadcast(plan), "list").select("list", "vec_id", "vector", cell, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"))

    def compare(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "part": pd.Series(dtype="int32"), "ids": pd.Series(dtype=object), "scores": pd.Series(dtype=object)})
        asked, reads = q["query_id"].to_numpy(), [np.asarray(r, dtype=np.int64) for r in q["lists"]]
        x, y = matrix(v["vector"].tolist(), kind), matrix(q["vector"].tolist(), kind)
        best = best_in_cell(v["vec_id"].to_numpy(), v["list"].to_numpy(), x, asked, y, reads, k)
        some, at = np.unique(best.at, return_index=True)
        ids, scores = (np.split(c, at[1:]) if len(some) else [] for c in (best.ids, best.scores))
        return pd.DataFrame({"query_id": asked[some], "part": np.full(len(some), q["cell"].iloc[0], dtype=np.int32), "ids": pd.Series(ids, dtype=object), "scores": pd.Series(scores, dtype=object)})

    keys = ["cell", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, part int, ids array<long>, scores array<double>")

    def gathered(of: DataFrame, *by: str | Column) -> DataFrame:
        lists = of.groupBy("query_id", *by).agg(F.collect_list(F.struct("ids", "scores")).alias("found"))
        return lists.withColumns({"ids": F.flatten("found.ids"), "scores": F.flatten("found.scores")}).drop("found")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
        for batch in batches:
            ids, scores = batch.column("ids"), batch.column("scores")
            bounds = (ids.offsets.to_numpy() - ids.offsets[0].as_py()).tolist()
            i, s = ids.flatten().to_numpy(), scores.flatten().to_numpy()
            if len(batch):
                yield batch, [best_of(i[a:b], s[a:b], k) for a, b in zip(bounds, bounds[1:], strict=False)]

    def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, best in merged(batches):
            ends = pa.array(np.cumsum([0, *(len(x) for x, _ in best)]), pa.int32())
            columns = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c))) for c in zip(*best, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("part"), *columns], ["query_id", "part", "ids", "scores"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, best in merged(batches):
            sizes = [len(x) for x, _ in best]
            at = pa.array(np.repeat(np.arange(len(best)), sizes))
            ranks = np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in sizes])
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), pa.array(ranks), *(pa.array(np.concatenate(c)) for c in zip(*best, strict=True))], ["query_id", "rank", "vec_id", "score"])

    parts = int((first + pieces).max())
    while parts > MERGED:
        found = gathered(found, (F.col("part") / MERGED).cast("int").alias("part")).mapInArrow(fewer, found.schema)
        parts = -(-parts // MERGED)
    return gathered(found).mapInArrow(rank, schema)
