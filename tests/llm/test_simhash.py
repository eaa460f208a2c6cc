import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import graph, simhash
from quern.llm.common import LOWER


@given(st.lists(st.binary(max_size=90), min_size=1, max_size=30), st.integers(0, 2**64 - 1))
@settings(deadline=None)
def test_hashes(items, seed):
    items = [*items, b"y" * 300]
    data = np.frombuffer(b"".join(items), dtype=np.uint8)
    size = np.array([len(x) for x in items])
    got = simhash.xxh64_many(data, np.cumsum(size) - size, size, seed)
    assert got.tolist() == [xxhash.xxh64_intdigest(x, seed) for x in items]


def plain(text, k=4):
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints(rows, monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 700)
    texts = [(t or "")[:9000] for _, t, *_ in rows]
    got = simhash.fingerprints([t.encode().translate(LOWER) for t in texts])
    assert got[:, 0].tolist() == [plain(t) for t in texts]
    assert simhash.fingerprints([b"", b"  "]).tolist() == [[0], [0]]
    wide = simhash.fingerprints([t.encode().translate(LOWER) for t in texts], 5, words=3)
    assert wide.shape == (len(texts), 3) and wide[:, 0].tolist() == [plain(t, 5) for t in texts]
    assert len({tuple(w) for w in wide.tolist()}) == len({plain(t, 5) for t in texts})


def test_links_are_complete(spark):
    r = random.Random(3)
    nodes = {r.getrandbits(64) for _ in range(150)} | {0, 1, 2**64 - 1, 2**63}
    for x in list(nodes)[:60]:
        y = x
        for _ in range(6):
            y ^= 1 << r.randrange(64)
            nodes.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in nodes]
    for radius in (2, 4):
        got = {(a, b) for a, b in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius).collect()}
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
        assert got == want and want


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(7, 7), (140, 139)]
    r.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: find(x) for x in parent if find(x) != x}
    assert got == want


def test_near_duplicates(docs, wide, rows):
    got = [(r["doc_id"], r["fp"], r["first"]["id"]) for r in simhash.near_duplicates(wide).collect()]
    fps = [(i, plain(t or "")) for i, t, *_ in rows]
    assert sorted((str(i), f & (2**64 - 1)) for i, f, _ in got) == sorted((str(i), f) for i, f in fps)
    links = {f: {g for _, g in fps if (f ^ g).bit_count() <= 4} for _, f in fps}
    for i, f, component in got:
        seen, todo = set(), [f & (2**64 - 1)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links[x]
        ids = [j for j, g in fps if g in seen and j is not None]
        assert component == min(ids, default=None)


def test_few_bits_of_a_wide_fingerprint(spark):
    r = random.Random(9)
    pairs = []
    for k in range(600):
        x = r.getrandbits(256)
        y = x
        for b in r.sample(range(256), k % 90):
            y ^= 1 << b
        pairs.append((x, y, k % 90))
    longs = lambda x: [(w - (1 << 64) if w >> 63 else w) for w in (x >> 64 * k & (1 << 64) - 1 for k in range(4))]
    frame = spark.createDataFrame([(*longs(x), *longs(y), d) for x, y, d in pairs], ", ".join(f"c{k} long" for k in range(9)))
    near = simhash.within([frame[f"c{k}"] for k in range(4)], [frame[f"c{k}"] for k in range(4, 8)], 44)
    assert {r["c8"]: r["n"] for r in frame.select("c8", near.alias("n")).distinct().collect()} == {d: d <= 44 for d in range(90)}


@pytest.mark.parametrize("texts", [1_000, 200_000, 10**9])
def test_segments_find_what_they_promise(texts):
    segments = simhash.segments_for(texts, words=4)
    rng, bits = np.random.default_rng(1), round(256 * simhash.differing(0.8))
    flips = np.argsort(rng.random((2000, 256)), axis=1)[:, :bits]
    found = sum(any(not hit.intersection(s.tolist()) for s in segments) for hit in map(set, flips.tolist()))
    assert found / 2000 > simhash.FOUND - 0.04
    assert texts / 2 ** len(segments[0]) <= simhash.CHANCE


def variants(seed, copies, changes, words=120):
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(changes):
            w[r.randrange(len(w))] = f"x{r.randrange(5000)}"
        out.append(" ".join(w))
    return out


def test_similar_texts_are_those_of_brute_force(spark):
    texts = [t for k in range(25) for t in variants(k, k % 4, 1 + k % 2)] + variants(99, 60, 2) + [f"alone {k} " + prose(k) for k in range(20)] + ["", None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["first"]["id"] for r in simhash.similar_texts(docs).collect()}
    fps = [int.from_bytes(w.astype(">u8").tobytes(), "big") for w in simhash.fingerprints([(t or "").encode().translate(LOWER) for t in texts], 5, words=simhash.WIDE)]
    want = {}
    for i in range(len(texts)):
        if i not in want:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = i
                    todo += [j for j, f in enumerate(fps) if (f ^ fps[x]).bit_count() <= simhash.wide_radius()]
    assert got == want and len(set(want.values())) < len(texts)


def prose(k):
    r = random.Random(1000 + k)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(60))


def test_one_of_each_stays(docs, wide):
    found = simhash.similar_texts(docs).select("first").distinct().count()
    kept = simhash.keep_one(wide)
    assert kept.columns == wide.columns and kept.count() == found
    texts = {r["text"] for r in kept.collect()}
    assert "another text with the id three" in texts and "no id at all here" in texts


def sets_of(text, k=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def components_of(texts, similarity=0.8):
    sets, first = [sets_of(t) for t in texts], {}
    for i in range(len(texts)):
        todo = [] if i in first else [i]
        while todo:
            x = todo.pop()
            if x not in first:
                first[x] = i
                todo += [j for j, s in enumerate(sets) if s == sets[x] or s and len(s & sets[x]) >= similarity * len(s | sets[x])]
    return first


@pytest.mark.parametrize("block", [None, 7])
def test_alike_texts_are_those_of_the_sets(spark, block):
    r = random.Random(4)
    line = "all of this is said again "
    texts = [line * 80 + prose(k) for k in range(3)]  # repeated lines outvote what differs
    for k in range(90):
        words = [f"v{r.randrange(9000)}" for _ in range(r.choice([5, 8, 30, 200]) + k % 3)]
        more = [f"u{r.randrange(9000)}" for _ in range(int((len(words) - 4) * 0.25))]
        texts += [" ".join(words), " ".join(words + more), " ".join(words + [*more, f"t{k}"])]  # the second at 0.8 or a little more, the third below
    texts += [t for k in range(6) for t in variants(k, 5, 3)] + ["", None, " ", "one", "One", "one two three four five", "one two three four five six"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["first"]["id"] for r in simhash.alike_texts(docs, block=block).collect()}
    assert got == components_of(texts)
    if block is None:
        kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
        assert sorted(kept) == sorted(set(got.values()))


def test_chains_and_cells():
    rng = np.random.default_rng(2)
    differ = rng.integers(0, 30, (3000, 4))
    radius = rng.integers(20, 80, 3000)
    share = lambda d, t: any(all(sum(d[(i + k) % 4] for k in range(n)) <= n * t // 4 for n in range(1, 5)) for i in range(4))
    found = simhash.on_chains(differ.astype(np.uint8), radius)
    assert found.tolist() == [share(d, t) for d, t in zip(differ.tolist(), radius.tolist(), strict=True)]
    assert found[differ.sum(axis=1) <= radius].all()
    cells, met = simhash.cells_of({3: 10, 4: 25, 6: 1}, 10), []
    for cell in {c[2] for c in cells}:
        met.append(frozenset((c, b) for c, b, k, _ in cells if k == cell))
    blocks = [(3, 0), (4, 0), (4, 1), (4, 2), (6, 0)]
    assert sorted(met, key=sorted) == sorted({frozenset((x, y)) for x in blocks for y in blocks if abs(x[0] - y[0]) <= 1}, key=sorted)


@pytest.mark.parametrize("f", [simhash.near_duplicates, simhash.similar_texts, simhash.alike_texts, simhash.keep_one])
def test_empty(no_docs, f):
    assert f(no_docs).count() == 0
