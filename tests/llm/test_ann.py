import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import ann

SCHEMA = "vec_id long, embedding array<float>, vector string, list int"


def frame(spark, items):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in items], SCHEMA)


def brute(items, queries, k):
    ids = np.array([i for i, _ in items])
    x = np.array([v for _, v in items], dtype=np.float32).astype(np.float64)
    out = {}
    for q in queries:
        (at,) = np.flatnonzero(ids == q)
        s = x @ x[at]
        order = [j for j in np.lexsort((ids, -s)) if j != at][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def check(got, want, least):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(want)
    hits = total = 0
    for q, rows in by.items():
        rows.sort()
        assert [r for r, *_ in rows] == list(range(1, len(want[q]) + 1))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(rows, rows[1:], strict=False))
        hits += len({v for _, v, _ in rows} & {v for v, _ in want[q]})
        total += len(want[q])
    assert hits / total >= least


@pytest.mark.parametrize("spread", [0.3, 5.0])
def test_recall(spark, monkeypatch, spread):
    monkeypatch.setattr(ann, "LIST_SIZE", 64)
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(10, 16))
    items = [(i, (centers[i % 10] + spread * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(2500)]
    got = ann.nearest(frame(spark, items), F.col("vec_id") % 50 == 0).collect()
    check(got, brute(items, range(0, 2500, 50), 20), 0.9)


def test_unusable_vectors_and_ties(spark):
    good = [(i, [1.0, float(i % 3)]) for i in range(12)]
    bad = [(20, None), (21, [0.0, 0.0]), (22, [1.0, None]), (23, [float("nan"), 1.0]), (24, [float("inf"), 1.0]), (40, []), (None, [1.0, 1.0])]
    short = [(25, [1.0]), (26, [0.5]), (27, [0.0, 3.0])]
    got = ann.nearest(frame(spark, good + bad + short), F.col("vec_id") % 20 == 0).collect()
    check(got, brute(good + [(i, (v + [0.0])[:2]) for i, v in short], [0], 20), 1.0)


def test_equal_vectors_tie_in_every_block(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 37)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(2)
    few = rng.normal(size=(6, 67)).astype(np.float32)
    items = [(i, few[i % 6].tolist()) for i in range(300)]
    got = ann.nearest(frame(spark, items), F.col("vec_id") % 50 == 0).collect()
    x = few.astype(np.float64)
    for q in range(0, 300, 50):
        products = (x * x[q % 6]).sum(axis=1)
        want = sorted((-products[i % 6], i) for i in range(300) if i != q)[:20]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_lists_are_balanced():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(3000, 8)), 6 + 0.2 * rng.normal(size=(1000, 8))])
    length = float(np.sqrt((x * x).sum(1).max())) * (1 + 1e-12)
    lifted = np.hstack([x, np.sqrt(np.maximum(length**2 - (x * x).sum(1), 0))[:, None]])
    index = ann.Index(*ann.train_centroids(lifted, 20), length)
    plain = np.bincount(ann.squared_distances(lifted, index.centroids).argmin(1), minlength=20)
    row, lists = index.lists_of(x)
    own = np.bincount(lists[np.unique(row, return_index=True)[1]], minlength=20)
    assert own.max() <= plain.max() and own.sum() == len(x) and index.burden.max() > 0


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 50)
    items = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, [float(i), 1.0, 0.0]) for i in range(100)]
    got = ann.nearest(frame(spark, items), F.col("vec_id") % 100 == 0, 5).collect()
    check(got, brute(items, [0, 100, 200, 300, 1000], 5), 0.9)


def test_repeated_ids(spark):
    items = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (2, [0.7, 0.0])]
    got = ann.nearest(frame(spark, items), F.col("vec_id") == 1).collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 2)]


def test_an_id_with_many_rows_leaves_room_for_others(spark):
    items = [(0, [1.0, 0.0])] + [(1, [2.0, 0.0])] * 100 + [(i, [1.0, 0.01 * i]) for i in range(2, 40)]
    got = ann.nearest(frame(spark, items), F.col("vec_id") == 0).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 21))


def test_memory_does_not_grow_with_lists():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8000, 16))
    x /= np.sqrt((x * x).sum(1))[:, None]
    tracemalloc.start()
    index = ann.Index(*ann.train_centroids(np.hstack([x, np.zeros((len(x), 1))]), 1000, rounds=1), 1.0)
    row, _ = index.lists_of(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(np.unique(row)) == len(x) and peak < 8 * len(x) * 1000  # one matrix of all distances


def test_a_query_goes_once_to_a_cell(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 8))
    index = ann.Index(rng.normal(size=(40, 9)), np.zeros(40), 10.0, ratio=100.0)
    sizes = rng.integers(1, 400, size=40)
    sizes[[0, 17]] = 3000, 5000
    first, pieces = ann.cells(sizes)
    sent = ann.probes(ann.usable(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])), index, sizes, 1).collect()
    seen = {(r["query_id"], r["cell"]) for r in sent}
    assert len(seen) == len(sent) == 600 * int((first + pieces).max())
    want = sorted(k for k in range(40) for _ in range(pieces[k]))
    assert all(sorted(k for r in sent if r["query_id"] == q for k in r["lists"]) == want for q in (0, 599))


def test_empty(spark):
    assert ann.nearest(frame(spark, []), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(frame(spark, [(0, [1.0])]), F.col("vec_id") == 0).count() == 0
