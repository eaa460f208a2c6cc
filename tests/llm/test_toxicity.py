import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import toxicity as tox

SYLLABLES = "the an er on in st re ha th en ly ou wh at ed es ti or nd".split()


def clean(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) + ("." if r.random() < 0.1 else "") for _ in range(n))


def toxic(seed):
    r = random.Random(seed)
    words = clean(seed).split()
    for _ in range(3):
        words.insert(r.randrange(len(words)), r.choice(["moron", "zgrubly", "zgrubnik", "plonker"]))
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    return tox.train([toxic(k) for k in range(60)] + [clean(1000 + k) for k in range(120)], [1] * 60 + [0] * 120)


def test_kernel_is_symmetric_and_tolerates_gaps():
    words = ["moron", "moxron", "m", "river", "mooron"]
    k = tox.Landmarks(words).kernel(words)
    assert np.allclose(k, k.T, atol=1e-6) and k[0, 1] > 0.4 > k[0, 3] and k[0, 4] > 0.5
    assert np.linalg.eigvalsh(k.astype(float)).min() > -1e-5
    # The same by listing subsequences.
    def listed(a, b):
        total = 0
        for order, shapes in tox.SHAPES.items():
            phi = lambda w: {}
            maps = []
            for w in (a, b):
                m, n = phi(w), 0.0
                for s in shapes:
                    for i in range(len(w) - s[-1]):
                        key = tuple(w[i + j] for j in s)
                        m[key] = m.get(key, 0) + tox.DECAY ** (s[-1] + 1)
                        n += tox.DECAY ** (2 * s[-1] + 2)
                maps.append((m, n**0.5))
            (m1, n1), (m2, n2) = maps
            total += sum(v * m2.get(g, 0) for g, v in m1.items()) / (n1 * n2) if n1 and n2 else 0
        return total / len(tox.SHAPES)

    assert k[0, 1] == pytest.approx(listed("moron", "moxron"), abs=1e-5) and k[0, 4] == pytest.approx(listed("moron", "mooron"), abs=1e-5)


def test_held_out_accuracy(model):
    worst = tox.Worst(model)
    bad = model.score(worst(pa.array([toxic(k) for k in range(500, 560)])))
    good = model.score(worst(pa.array([clean(k) for k in range(5000, 5100)])))
    assert (bad >= tox.THRESHOLD).mean() >= 0.95 and (good >= tox.THRESHOLD).mean() <= 0.05


def test_disguised_insults(model):
    worst = tox.Worst(model)
    texts = [f"{clean(9, 10)} {w} {clean(8, 10)}" for w in ("moron", "mo-ron", "m.o.r.o.n", "m o r o n", "MORON", "mor1on", "zgrublyan", "moroon")]
    assert (model.score(worst(pa.array(texts))) >= tox.THRESHOLD).all()
    long = clean(1, 3000) + " x" + "e" * 500 + "moron" + "e" * 500
    assert worst(pa.array([long]))[0] > worst(pa.array([clean(1, 3000)]))[0]
    assert worst(pa.array(["", "12 34", "?!"])).tolist() == [tox.LOWEST] * 3


def test_frames(spark, docs, wide, no_docs, rows):
    texts = [(1000 + k, toxic(k), "en", "s", 1) for k in range(40)] + [(2000 + k, clean(k + 77), "en", "s", 1) for k in range(80)]
    extra = spark.createDataFrame(texts, docs.schema)
    labels = spark.createDataFrame([(i, int(i < 2000)) for i, *_ in texts] + [(None, 1), (5, None), (99999, 1), (1000, 1)], "doc_id long, toxic int")
    both = docs.union(extra)
    got = tox.score_toxicity(both, labels).collect()
    assert len(got) == len(rows) + len(texts)
    by = {r["doc_id"]: r for r in got}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert sum(by[i]["predicted"] for i, *_ in texts if i < 2000) >= 38 and sum(by[i]["predicted"] for i, *_ in texts if i >= 2000) <= 4
    kept = tox.drop_toxic(wide, labels.join(docs.select("doc_id"), "doc_id", "left_anti"))
    assert kept.columns == wide.columns
    assert tox.score_toxicity(no_docs, labels).count() == 0
    none = tox.score_toxicity(docs, labels.where("toxic > 5"))
    assert none.count() == len(rows) and none.agg({"score": "max"}).first()[0] == 0
    assert tox.drop_toxic(docs, labels.where("toxic > 5")).count() == len(rows)


def test_training_reads_one_text_of_an_id_and_ignores_other_columns(spark):
    docs = spark.createDataFrame([(3, "b text", "x"), (3, "a text", "y"), (3, None, "z"), (4, "bad", "x"), (4, "bad", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(3, 0), (4, 1), (4, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    for n in (1, 7):
        assert tox.training_sample(docs.repartition(n), labels) == (["", "bad"], [0, 1])
    wide = docs.selectExpr("doc_id", "text", "'x' as toxic", "1 as margin", "2.0 as score", "true as held_out", "7 as text_hash")
    assert tox.score_toxicity(wide, labels).columns == ["doc_id", "text_hash", "held_out", "score", "predicted", "margin"]
    assert tox.score_toxicity(wide, labels).count() == 5


def test_long_glued_words_are_learnt():
    texts = [clean(k) + " " + clean(k + 7, 8).replace(" ", "") + "zgrubly" for k in range(40)] + [clean(900 + k) + " " + clean(k, 8).replace(" ", "") for k in range(80)]
    assert tox.train(texts, [1] * 40 + [0] * 80).margins(["theanerzgrublyoninstreha"])[0] > 0
