import duckdb
import pytest

from quern.llm import mixing


def water_fill(totals, weights, most=3):
    """Targets by sharing again and again."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(totals.values()))
    while open_:
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * totals[s] or (share[s] == most * totals[s])}
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * totals[s])
            rest -= target[s]
        open_ -= over
    return target


def test_targets_match_repeated_sharing(spark):
    for totals in ({"a": 10, "b": 1000, "c": 5, None: 40}, {"a": 0, "b": 0}, {"x": 7}, {chr(97 + i): (i * 37) % 11 for i in range(20)}):
        df = spark.createDataFrame([(s, n) for s, n in totals.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = water_fill(totals, (1, 2, 3))
        assert got == pytest.approx(want)


def test_taken_meets_targets(docs, wide, rows):
    got = mixing.mix_taken(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for of in by.values():
        short = int(of[0]["target"]) - sum(r["taken"] for r in of)
        assert 0 <= short < 3  # less than a word for each of equal rows
    again = mixing.mix_taken(wide.repartition(3)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_same_as_sql(spark, tmp_path):
    docs = spark.createDataFrame([(i, " w" * (i * 13 % 90), f"s{i * i % 7}" if i % 11 else None) for i in range(400)], "doc_id long, text string, source string")
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    want = sorted(con.sql(mixing.ORACLE).fetchall(), key=str)
    got = sorted((tuple(r) for r in mixing.mix_taken(docs).collect()), key=str)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_documents_hold_what_is_taken(docs, wide):
    taken = {}
    for r in mixing.mix_taken(docs).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    out = mixing.mix_documents(wide)
    assert out.columns == wide.columns
    held, texts = {}, {r["text"] for r in docs.collect() if r["text"]}
    for r in out.collect():
        n = len((r["text"] or "").encode().split())
        held[r["source"]] = held.get(r["source"], 0) + n
        assert not r["text"] or any(t.startswith(r["text"]) for t in texts)
    assert {s: n for s, n in taken.items() if n} == {s: n for s, n in held.items() if n}


def test_empty(no_docs):
    assert mixing.mix_taken(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0
