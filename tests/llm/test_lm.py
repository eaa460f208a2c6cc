import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import lm
from quern.llm.common import LOWER

END = b"\n"


def tokens(text):
    return [*(text or "").encode().translate(LOWER).split(), END]


@pytest.mark.parametrize("frequent", [1_000_000, 3])
def test_base_by_brute_force(docs, rows, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "SHORTLIST", (1, min(frequent, 8)))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(t for i, x, *_ in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = []
    for i, x, *_ in rows:
        t = tokens(x)
        want.append((str(i), held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)))
    got = lm.score_texts(docs).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:5], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(r["score"] < 0 for r in got)


def log_p(model):
    (near, far), total = model.tables()
    return near[:, None, :].astype(float) + far[None] - total[..., None]


def test_model_is_normalised_and_learns_order():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(12, 0.2), size=12)
    pairs = np.array([rng.multinomial(3000, p[a]) for a in range(12)])
    model = lm.train(pairs)
    assert np.allclose((10 ** log_p(model)).sum(2), 1, atol=1e-5)
    model.links[1][:] = 0
    got = log_p(model)[:, 0]
    unigram = np.log10((pairs.sum(0) + 0.5) / (pairs.sum() + 6))
    best = np.log10(np.maximum(pairs, 0.01) / pairs.sum(1, keepdims=True))
    mean = lambda q: (pairs * q).sum() / pairs.sum()
    assert mean(got) > mean(np.broadcast_to(unigram, got.shape)) + 0.5 * (mean(best) - mean(np.broadcast_to(unigram, got.shape)))
    assert np.allclose((10 ** log_p(lm.train(np.zeros((3, 3), dtype=int)))).sum(2), 1, atol=1e-5)


def test_second_place_is_learnt():
    """A class that depends on the one two before, not on the one before."""
    rng = np.random.default_rng(0)
    now = np.zeros(60_000, dtype=np.int64)
    for k in range(2, len(now)):
        now[k] = (now[k - 2] + 1) % 6 if rng.random() < 0.9 else rng.integers(6)
    before = [np.concatenate([[5], now[:-1]]), np.concatenate([[5, 5], now[:-2]])]
    pairs = np.bincount(before[0] * 6 + now, minlength=36).reshape(6, 6)
    model = lm.Model.of_flat(lm.train(pairs).flat(), 6)
    mean = lambda: log_p(model)[before[0], before[1], now].mean()
    first = mean()
    d = lm.Descent(model, lm.noise_of(pairs.sum(0).astype(float)), 0)
    for _ in range(20):
        d.learn(now, before)
    assert mean() > first + 0.2 and np.allclose((10 ** log_p(model)).sum(2), 1, atol=1e-5)


def test_weights_are_averaged_by_tokens(spark):
    classes = lm.Classes(np.sort(lm.Tokens.of(["the", "mill"]).hashes))
    texts = spark.createDataFrame([("the mill and the river " * k,) for k in range(1, 9)], "text string").repartition(3)
    start, noise = lm.train(np.ones((classes.size, classes.size), dtype=int), 5), np.full(classes.size, 1 / classes.size)
    parts = texts.rdd.glom().collect()
    want, total = 0, 0
    for k, part in enumerate(parts):
        if part:
            d = lm.Descent(lm.Model.of_flat(start.flat(), classes.size), noise, k)
            now, before, _ = classes.with_ends(lm.Tokens.of([r[0] for r in part]))
            d.learn(now, before)
            want, total = want + d.model.flat().astype(float) * len(now), total + len(now)
    assert np.allclose(lm.refine(texts, classes, start, noise).flat(), want / total, atol=1e-5)


def test_scores_by_brute_force(spark, docs, rows, monkeypatch):
    """Token by token: the softmax of the weights, times the word's share of its bin."""
    monkeypatch.setattr(lm, "SHORTLIST", (8, 8))
    kept = {}
    refine = lm.refine
    monkeypatch.setattr(lm, "refine", lambda *a: kept.setdefault("model", refine(*a)))
    got = lm.score_texts(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    words = lambda x: (x or "").encode().translate(LOWER).split()
    counts = Counter(w for i, x, *_ in rows if not held(i) for w in words(x))
    hashed = {w: lm.Tokens.of([w.decode()]) for i, x, *_ in rows for w in words(x)}
    key = {w: int(t.hashes[0]) for w, t in hashed.items()}
    top = sorted(counts, key=lambda w: (-counts[w], key[w]))[:8]
    number = {w: k for k, w in enumerate(sorted(top, key=key.get))}
    bin_of = {w: int(t.bins[0]) for w, t in hashed.items()}
    rest = [w for w in counts if w not in number]
    size = {b: sum(counts[w] + 0.5 for w in rest if bin_of[w] == b) + 0.5 for b in range(lm.BINS)}
    m, end = kept["model"], 8 + lm.BINS

    def score(text):
        seen, out = [end, end], 0.0
        for w in [*words(text), None]:
            c = end if w is None else number.get(w, 8 + bin_of[w])
            energy = (m.words[seen[-1]] @ m.links[0] + m.words[seen[-2]] @ m.links[1]) @ m.outputs.T + m.bias
            out += (energy[c] - np.log(np.exp(energy).sum())) / np.log(10)
            if w is not None and w not in number:
                out += math.log10((counts[w] + 0.5) / size[bin_of[w]])
            seen.append(c)
        return out

    want = sorted((str(i), len(words(x)) + 1, score(x)) for i, x, *_ in rows)
    by = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in got)
    assert [x[:2] for x in by] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) <= 1e-5 * a[1] + 1e-4 for a, b in zip(by, want, strict=True))
    # Shares within a bin: all its known words, and one unseen.
    assert all(abs(sum((counts[w] + 0.5) / size[b] for w in rest if bin_of[w] == b) + 0.5 / size[b] - 1) < 1e-9 for b in size)


def test_clashing_columns(docs, wide):
    drop = lambda df: sorted(map(tuple, lm.score_texts(df).select("doc_id", "held_out", "n_tokens", "n_known").collect()), key=str)
    assert drop(wide.selectExpr("*", "1 as hash2", "true as held_out", "3 as rare", "4 as c")) == drop(docs)


def test_better_than_base_on_held_out(spark):
    import random

    a, b = [[f"{x}{k}" for k in range(30)] for x in ("anna", "bert")]
    r = random.Random(0)
    texts = [" ".join(r.choice(w) for _ in range(60)) for w in (a, b) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lm.score_texts(docs).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_empty(no_docs, spark):
    assert lm.score_texts(no_docs).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) == (3, 0, 0, 0.0)
