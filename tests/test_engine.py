from datetime import datetime, timedelta

import pytest

from quern.errors import AnalysisError, Unsupported
from quern.operators.kv import RevisionRegress
from quern.session import Engine


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}")


def rows(e, sql):
    return [tuple(r) for r in e.sql(sql).collect()]


@pytest.fixture(scope="module")
def logs(spark):
    """24 hours of rows: level ERROR each third hour, latency ten times the hour."""
    e = Engine(spark)
    t0 = datetime(2024, 1, 1)
    data = [(t0 + timedelta(hours=h), "ERROR" if h % 3 == 0 else "INFO", 10 * h) for h in range(24)]
    e.register("logs", spark.createDataFrame(data, "ts timestamp, level string, lat long"))
    return e


def test_aggregates_of_logs(logs):
    assert rows(logs, "SELECT SUM(lat), AVG(lat), MAX(lat) FROM logs") == [(2760, 115.0, 230)]
    assert rows(logs, "SELECT COUNT(*) FROM logs WHERE ts >= '2024-01-01T00:00:00Z' AND ts < '2024-01-01T06:00:00Z' AND level = 'ERROR'") == [(2,)]
    assert rows(logs, "SELECT SUM(lat) FROM logs WHERE level LIKE 'ERRO%'") == [(840,)]
    assert rows(logs, "SELECT AVG(lat) FROM logs WHERE level LIKE 'INFO%'") == [(120.0,)]
    assert rows(logs, "SELECT COUNT(*) FROM logs WHERE ts < '9999-12-31T23:59:59Z'") == [(24,)]
    got = rows(logs, "SELECT level, COUNT(*) FROM logs WHERE ts >= '2024-01-01T06:00:00Z' AND ts < '2024-01-01T18:00:00Z' GROUP BY level ORDER BY level")
    assert got == [("ERROR", 4), ("INFO", 8)]


def test_time_buckets(logs):
    got = rows(logs, "SELECT time_bucket('1h30m', '2024-01-01T01:45:00Z'), time_bucket(3600, '2024-01-01T01:45:00Z')")[0]
    assert got == (datetime(2024, 1, 1, 1, 30), datetime(2024, 1, 1, 1))
    got = rows(logs, "SELECT time_bucket('12h', ts) AS b, COUNT(*), COUNT_IF(level = 'ERROR') FROM logs GROUP BY b ORDER BY b")
    assert got == [(datetime(2024, 1, 1), 12, 4), (datetime(2024, 1, 1, 12), 12, 4)]
    assert rows(logs, "SELECT time_bucket('7d', '2024-01-03T00:00:00Z')") == [(datetime(2024, 1, 1),)]


def test_nulls_and_casts(logs):
    assert rows(logs, "SELECT NOT NULL, NULL + 1, abs(NULL), NULL = NULL, concat(NULL, 'a'), CAST(NULL AS int)") == [(None, None, None, None, "a", None)]
    assert rows(logs, "SELECT CAST(' 12 ' AS int), CAST(-2.9 AS int), CAST('true' AS bool), CAST(1.5 AS string), CAST(TRUE AS int)") == [(12, -2, True, "1.5", 1)]
    assert rows(logs, "SELECT 7 / 2, -7 / 2, 7 / 2.0, 1 < 1.5, 'b' > 'a', 5 = '5'") == [(3, -3, 3.5, True, True, True)]
    assert rows(logs, "SELECT substr('hello', -3, 2), substr('hello', 9), length('äé')") == [("he", "", 2)]
    for bad in ("SELECT CAST(1.5 AS bool)", "SELECT nosuch(1)", "SELECT abs('x')", "SELECT lat FROM logs WHERE level", "SELECT x FROM logs", "SELECT SUM(SUM(lat)) FROM logs", "SELECT 1 FROM nosuch", "SELECT lat FROM logs HAVING lat > 1", "SELECT time_bucket(ts, ts) FROM logs"):
        with pytest.raises(AnalysisError):
            logs.sql(bad)


def test_like_has_no_escape(spark, logs):
    logs.register("t", spark.createDataFrame([("a%b",), ("a\\b",), ("axb",), ("a\nb",)], "s string"))
    assert {r[0] for r in rows(logs, "SELECT s FROM t WHERE s LIKE 'a\\%'")} == {"a\\b"}
    assert len(rows(logs, "SELECT s FROM t WHERE s LIKE 'a_b'")) == 4


def test_now_can_be_fixed(spark):
    e = Engine(spark, now=datetime(2024, 5, 6, 7, 8, 9))
    assert rows(e, "SELECT now(), unixepoch()") == [(datetime(2024, 5, 6, 7, 8, 9), 1714979289)]


def test_plans_push_down(spark):
    e = Engine(spark)
    e.register_parquet("events", "/root/testdata/sf0.001/events.parquet")
    frame = e.sql("SELECT user_id FROM events WHERE event_type LIKE 'cl%' AND ts >= '2024-01-05T00:00:00Z'")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "StringStartsWith(event_type,cl)" in pushed and "GreaterThanOrEqual(ts," in pushed and "props" not in plan and "Python" not in plan
    assert "TakeOrderedAndProject" in e.sql("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 3")._jdf.queryExecution().toString()


def test_upsert_update_delete(engine):
    e = engine
    e.run_script("CREATE TABLE r (id int PRIMARY KEY, v string, score int); " + f"INSERT INTO r VALUES {', '.join(f"({i}, 'r{i}', {10 * i})" for i in range(1, 11))}")
    assert e.execute("UPDATE r SET score = score + 1 WHERE id >= 3 AND id < 7").affected == 4
    assert [r[0] for r in rows(e, "SELECT score FROM r WHERE id >= 3 AND id < 7 ORDER BY id")] == [31, 41, 51, 61]
    assert e.execute("UPDATE r SET v = NULL, score = id WHERE v = 'r1'").affected == 1
    assert rows(e, "SELECT v, score FROM r WHERE id = 1") == [(None, 1)]
    assert e.execute("INSERT INTO r VALUES (2, 'x', 0), (2, 'y', 1)").affected == 2
    assert rows(e, "SELECT v, score FROM r WHERE id = 2") == [("y", 1)]
    assert e.execute("DELETE FROM r WHERE id > 8").affected == 2
    assert e.execute("UPDATE r SET id = id + 100 WHERE id = 8").affected == 1
    e.execute("INSERT INTO r (id) VALUES (9)")
    before = rows(e, "SELECT * FROM r ORDER BY id")
    assert [r[0] for r in before] == [1, 2, 3, 4, 5, 6, 7, 9, 108] and before[-2] == (9, "", 0)
    e.execute("ADMIN COMPACT")
    assert rows(e, "SELECT * FROM r ORDER BY id") == before
    assert rows(e, "SELECT COUNT(*) AS n FROM r") == [(9,)]
    e.execute("UPDATE r SET v = 'z' WHERE id = 9")
    e.execute("DELETE FROM r WHERE id = 1")
    assert rows(e, "SELECT COUNT(*) AS n FROM r") == [(8,)]
    again = Engine(e.spark, e.catalog.root)
    assert rows(again, "SELECT v, score FROM r WHERE id = 9") == [("z", 0)]
    again.storage.vacuum(again.catalog.table("r"))
    assert len(rows(again, "SELECT * FROM r")) == 8


def test_compaction_sets_in_by_itself(engine):
    e = engine
    e.execute("CREATE TABLE t (id int PRIMARY KEY, g int)")
    for i in range(12):
        e.execute(f"INSERT INTO t VALUES ({i}, {i})")
    t = e.catalog.table("t")
    assert t.base and len(t.deltas) < 10 and rows(e, "SELECT COUNT(*), SUM(g) FROM t") == [(12, 66)]


def test_composite_keys_and_errors(engine):
    e = engine
    e.execute("CREATE TABLE ev (user_id int, ts timestamp, v string NOT NULL, PRIMARY KEY (user_id, ts))")
    e.execute("INSERT INTO ev VALUES (1, '2024-01-01T00:00:00Z', 'a'), (1, '2024-01-01T01:00:00+01:00', 'b'), (2, '2024-01-01T00:00:00Z', 'c')")
    assert rows(e, "SELECT user_id, v FROM ev ORDER BY user_id") == [(1, "b"), (2, "c")]
    for bad in ("INSERT INTO ev (user_id, v) VALUES (1, NULL)", "INSERT INTO ev (nosuch) VALUES (1)", "UPDATE ev SET nosuch = 1", "INSERT INTO ev VALUES (1)", "CREATE TABLE ev (a int)", "DROP TABLE nosuch", "DROP INDEX nosuch", "KV GET ev 'a'", "ADMIN NONSENSE"):
        with pytest.raises(AnalysisError):
            e.execute(bad)
    with pytest.raises(Unsupported):
        e.execute("ADMIN JOIN n1")
    e.execute("CREATE INDEX IF NOT EXISTS i ON ev (v)")
    e.execute("DROP INDEX i ON ev")
    e.execute("DROP TABLE ev")
    e.execute("DROP TABLE IF EXISTS ev")


def test_retention(engine):
    e = engine
    e.execute("CREATE TABLE logs (ts timestamp PRIMARY KEY, v string) RETENTION='2h'")
    e.execute("INSERT INTO logs VALUES ('2024-01-01T00:00:00Z', 'old'), ('2024-01-01T03:00:00Z', 'new')")
    assert e.run_retention(datetime(2024, 1, 1, 4)) == {"logs": 1}
    assert rows(e, "SELECT v FROM logs") == [("new",)]


def test_retention_where_rows_share_a_time(engine):
    e = engine
    e.execute("CREATE TABLE logs (ts timestamp, id int, v string, PRIMARY KEY (ts, id)) RETENTION='2h'")
    e.execute("INSERT INTO logs VALUES ('2024-01-01T00:00:00Z', 1, 'old'), ('2024-01-01T00:00:00Z', 2, 'old'), ('2024-01-01T03:00:00Z', 3, 'new'), ('2024-01-01T03:00:00Z', 4, 'new')")
    e.execute("CREATE TABLE seen (id int, ts timestamp, PRIMARY KEY (id, ts)) RETENTION='2h'")  # no time comes first
    e.execute("INSERT INTO seen VALUES (1, '2024-01-01T00:00:00Z')")
    assert e.run_retention(datetime(2024, 1, 1, 4)) == {"logs": 2}
    assert sorted(rows(e, "SELECT id, v FROM logs")) == [(3, "new"), (4, "new")] and rows(e, "SELECT id FROM seen") == [(1,)]


def test_kv_revisions(engine):
    e = engine
    e.execute("CREATE TABLE k (k string PRIMARY KEY) ENGINE=KV")
    s = e.kv("k")
    one = s.apply([("put", "ab", "1"), ("put", "b", "2"), ("put", "bc", "3")])
    two = s.put("b", "20")
    assert s.get("b", one) == "2" and s.get("b") == "20" and s.get("x") is None
    assert [r["key"] for r in s.range("ab", "bc").collect()] == ["ab", "b"] and [r["key"] for r in s.prefix("b").collect()] == ["b", "bc"]
    assert [r["key"] for r in s.range(reverse=True, limit=1).collect()] == ["bc"] and s.count("b") == 2
    snap = s.snapshot()
    assert s.compare_and_swap("b", "20", "21") and not s.compare_and_swap("b", "20", "22") and s.compare_and_swap("new", None, "n")
    assert snap.get("b") == "20" and snap.get("new") is None
    assert s.delete("ab") == 1 and s.delete("ab") == 0
    with pytest.raises(RevisionRegress):
        s.apply([("put", "z", "1")], revision=two)
    dropped = s.compact(two)
    assert dropped == 1 and s.get("b", two) == "20" and s.get("b") == "21"
    with pytest.raises(AnalysisError):
        s.get("b", one)
    lease = s.grant(10, now=100)
    assert s.expired(now=105) == [] and s.expired(now=111) == [lease] and not s.revoke(lease)


def test_watch_and_changes_stream(engine):
    e = engine
    e.execute("CREATE TABLE k (k string PRIMARY KEY) ENGINE=KV")
    e.run_script("KV PUT k 'a1' 'x'; KV PUT k 'b1' 'y'; KV DELETE k 'a1'")
    query = e.watch("k", "a").writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r["key"], r["is_delete"]) for r in e.spark.table("watched").collect()} == {("a1", False), ("a1", True)}
    assert [[tuple(r) for r in f] for f in e.tail("KV SCAN k", interval=0, frames=2)] == [[("b1", "y")]] * 2


def test_bi_helpers(engine, tmp_path):
    e = engine
    e.execute("CREATE TABLE t (id int PRIMARY KEY, ts timestamp, msg string)")
    assert e.ingest("t", [{"id": 1, "ts": "2024-01-01T00:10:00Z", "msg": "boom"}, {"id": 2, "ts": datetime(2024, 1, 1, 2), "msg": "fine"}]) == 2
    found, histogram = e.log_explorer("t", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", "oo")
    assert [r["id"] for r in found.collect()] == [1] and [r["n"] for r in histogram.collect()] == [1]
    with pytest.raises(AnalysisError):
        e.ingest("t", [{"id": 1, "msg": ["a"]}])
    assert e.widget("SELECT COUNT(*) AS c FROM t")[0]["c"] == 2
    e.execute("DELETE FROM t WHERE id = 1")
    assert e.widget("SELECT COUNT(*) AS c FROM t")[0]["c"] == 2 and e.cache.hits == 1
    e.save_dashboard("d", "Name", {"w": [1]})
    assert e.dashboards()[0]["config"] == {"w": [1]} and e.delete_dashboard("d") == 1 and e.dashboards() == []
    e.export_csv("SELECT * FROM t", f"file://{tmp_path}/csv")
    assert e.spark.read.csv(f"file://{tmp_path}/csv", header=True).count() == 1
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")
    assert "quern_statement_seconds_count" in e.metrics.prometheus()
    (tmp_path / "s.sql").write_text("SELECT 1; SELECT 'a;b'")
    assert len(e.run_file(f"file://{tmp_path}/s.sql")) == 2


def test_admin_views(engine):
    e = engine
    e.run_script("CREATE TABLE t (id int PRIMARY KEY, name string); CREATE INDEX n ON t (name); INSERT INTO t VALUES (2, 'b'), (10, 'a')")
    assert e.sql("ADMIN SHARDS t").count() == 0
    assert e.execute("ADMIN SPLIT TABLE t AT 5").affected == 2
    assert [(r["n_rows"], r["start"], r["end"]) for r in e.sql("ADMIN SHARDS t").collect()] == [(1, "2", "2"), (1, "10", "10")]
    assert [(r["name"], r["key"], r["base_rows"], r["deltas"]) for r in e.sql("ADMIN TABLES").collect()] == [("t", "id", 2, 0)]
    assert [tuple(r) for r in e.rows("SELECT id FROM t WHERE name = 'a'")] == [(10,)]
    classes = {r["class"]: r["count"] for r in e.sql("ADMIN METRICS").collect()}
    assert classes["insert"] == 1 and classes["point"] == 1 and e.sql("ADMIN METRICS-JSON").count() >= len(classes)


def test_replayed_statements_change_nothing(engine):
    e = engine
    e.execute("CREATE TABLE t (id int PRIMARY KEY, v string)")
    statements = ["INSERT INTO t VALUES (1, 'a'), (2, 'b')", "UPDATE t SET v = 'c' WHERE id = 2", "DELETE FROM t WHERE id = 1"]
    for s in statements:
        e.execute(s)
    once = rows(e, "SELECT * FROM t")
    for s in statements:
        e.execute(s)
    assert rows(e, "SELECT * FROM t") == once == [(2, "c")]


def test_uncommitted_changes_are_not_seen(engine):
    e = engine
    e.run_script("CREATE TABLE t (id int PRIMARY KEY); INSERT INTO t VALUES (1)")
    t = e.catalog.table("t")
    # A crash after writing and before committing leaves a folder that the catalog doesn't list.
    e.storage.deltas(t).write.parquet(f"{e.storage.folder(t)}/delta/rev=99")
    assert rows(e, "SELECT COUNT(*) FROM t") == [(1,)]
    e.storage.vacuum(t)
    assert not e.catalog.files.exists(f"{e.storage.folder(t)}/delta/rev=99")


def test_many_changes_are_joined_by_shuffle(engine, monkeypatch):
    from quern.sources import tables

    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    e = engine
    e.execute("CREATE TABLE t (id int PRIMARY KEY, g int)")
    e.insert_frame("t", e.spark.range(1000).selectExpr("id", "id % 7 AS g"))
    e.execute("ADMIN COMPACT")
    e.execute("UPDATE t SET g = 100 WHERE id < 10")
    e.execute("DELETE FROM t WHERE id >= 990")
    e.execute("INSERT INTO t VALUES (5000, 1)")
    assert rows(e, "SELECT COUNT(*), COUNT_IF(g = 100), MAX(id) FROM t") == [(991, 10, 5000)]


def test_nulls_in_keys_and_not_null_columns(engine):
    e = engine
    e.execute("CREATE TABLE a (id int PRIMARY KEY, s string NOT NULL, f float)")
    e.execute("INSERT INTO a VALUES (1, 'x', 1.0)")
    for bad in ("INSERT INTO a VALUES (NULL, 'x', 1.0)", "INSERT INTO a VALUES (2, CAST(NULL AS string), 1.0)", "INSERT INTO a VALUES (3, NULL, 1.0)", "UPDATE a SET id = NULL", "UPDATE a SET s = NULL", "INSERT INTO a VALUES (4, 'y', 1.0), (CAST(NULL AS int), 'x', 1.0)"):
        with pytest.raises(AnalysisError):
            e.execute(bad)
    for bad in ([{"id": None, "s": "x"}], [{"id": 5, "s": None}]):
        with pytest.raises(AnalysisError):
            e.ingest("a", bad)
    with pytest.raises(AnalysisError):
        e.insert_frame("a", e.spark.createDataFrame([(None, "x")], "id long, s string"))
    e.execute("UPDATE a SET f = NULL")
    assert rows(e, "SELECT * FROM a") == [(1, "x", None)]


def opened(df):
    return len(df.inputFiles())


def test_reads_by_key_open_few_files(engine, monkeypatch):
    e = engine
    monkeypatch.setattr("quern.sources.tables.ROWS_A_FILE", 100)
    e.execute("CREATE TABLE p (id int PRIMARY KEY, g int)")
    e.insert_frame("p", e.spark.range(1000).selectExpr("id", "id % 7 AS g"))
    e.execute("ADMIN COMPACT")
    assert len(e.storage.files(e.managed("p"))) == 10
    for sql, files in (("SELECT * FROM p WHERE id = 42", 1), ("SELECT * FROM p WHERE 250 <= id AND id < 260 AND g = 3", 1), ("SELECT id FROM p ORDER BY id DESC LIMIT 10", 1), ("SELECT id FROM p ORDER BY id LIMIT 10", 1), ("SELECT * FROM p WHERE g = 1", 10), ("SELECT id FROM p WHERE id > 5000", 0), ("SELECT id FROM p WHERE id = 3 OR g = 1", 10)):
        assert opened(e.sql(sql)) <= files + (files < 10), sql
    assert rows(e, "SELECT id FROM p ORDER BY id DESC LIMIT 3") == [(999,), (998,), (997,)]
    assert rows(e, "SELECT id FROM p WHERE 250 <= id AND id < 253") == [(250,), (251,), (252,)]
    assert rows(e, "SELECT COUNT(*) FROM p WHERE id > 5000") == [(0,)]


def test_compaction_rewrites_only_what_changes_touch(engine, monkeypatch):
    e = engine
    monkeypatch.setattr("quern.sources.tables.ROWS_A_FILE", 100)
    e.execute("CREATE TABLE p (id int PRIMARY KEY, g int)")
    e.insert_frame("p", e.spark.range(1000).selectExpr("id * 2 AS id", "id % 7 AS g"))
    e.execute("ADMIN COMPACT")
    t = e.managed("p")
    before = {f.path for f in e.storage.files(t)}
    for i in range(10):
        e.execute(f"UPDATE p SET g = 100 WHERE id = {400 + 2 * i}" if i % 2 else f"INSERT INTO p VALUES ({401 + 2 * i}, 200)")
    e.execute("DELETE FROM p WHERE id = 440")
    assert not [d for d in t.deltas if d[0] <= t.base] and len(t.deltas) < 3
    after = {f.path for f in e.storage.files(t)}
    assert len(before & after) >= 8
    want = {2 * i: i % 7 for i in range(1000)}
    want |= {400 + 2 * i: 100 for i in range(1, 10, 2)} | {401 + 2 * i: 200 for i in range(0, 10, 2)}
    del want[440]
    assert dict(rows(e, "SELECT * FROM p")) == want
    assert rows(e, "SELECT * FROM p WHERE id >= 403 AND id <= 405") == [(r, want[r]) for r in (404, 405)]
    e.execute("ADMIN COMPACT")
    e.storage.vacuum(t)
    assert dict(rows(e, "SELECT * FROM p")) == want and sum(f.rows for f in e.storage.files(t)) == len(want)
    e.execute("DELETE FROM p")
    e.execute("ADMIN COMPACT")
    assert rows(e, "SELECT COUNT(*) FROM p") == [(0,)] and rows(e, "SELECT id FROM p ORDER BY id LIMIT 2") == []


def test_keys_of_all_kinds_prune(engine, monkeypatch):
    e = engine
    monkeypatch.setattr("quern.sources.tables.ROWS_A_FILE", 5)
    t0 = datetime(2024, 1, 1)
    made = {"timestamp": [t0 + timedelta(hours=h) for h in range(20)], "string": [f"k{h:02}" for h in range(20)], "float": [float(h) for h in range(19)] + [float("nan")]}
    asked = {"timestamp": "k >= '2024-01-01T07:00:00Z' AND k < '2024-01-01T09:00:00+00:00'", "string": "k >= 'k07' AND k < 'k09'", "float": "k >= 7 AND k < 9.0"}
    for kind, keys in made.items():
        e.execute(f"CREATE TABLE {kind}s (k {kind} PRIMARY KEY, n int)")
        spark_kind = {"float": "double"}.get(kind, kind)
        e.insert_frame(f"{kind}s", e.spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k {spark_kind}, n long"))
        e.execute("ADMIN COMPACT")
        got = e.sql(f"SELECT n FROM {kind}s WHERE {asked[kind]}")
        assert sorted(r[0] for r in got.collect()) == [7, 8] and opened(got) < 4, kind
        assert [r[0] for r in e.sql(f"SELECT n FROM {kind}s ORDER BY k DESC LIMIT 2").collect()] == [19, 18]


def test_latencies_are_those_of_rows(engine):
    engine.execute("CREATE TABLE t (id int PRIMARY KEY)")
    engine.slow_seconds = 0.0
    engine.rows("SELECT COUNT(*) FROM t WHERE id > 1")
    engine.sql("SELECT id FROM t GROUP BY id")
    assert "agg" in engine.metrics.count and "group" not in engine.metrics.count
    assert engine.slow[-1][2].startswith("SELECT COUNT")


def test_indexes_act_at_once(engine):
    e = engine
    e.execute("CREATE TABLE t (id int PRIMARY KEY, v string)")
    e.insert_frame("t", e.spark.range(50).selectExpr("id", "concat('v', id) AS v"))
    e.execute("ADMIN COMPACT")
    before = {f.path for f in e.storage.files(e.managed("t"))}
    e.execute("CREATE INDEX i ON t (v)")
    assert not before & {f.path for f in e.storage.files(e.managed("t"))}
    assert rows(e, "SELECT id FROM t WHERE v = 'v7'") == [(7,)]


def test_two_drivers_do_not_overwrite_each_other(spark, tmp_path):
    a = Engine(spark, f"file://{tmp_path}")
    a.execute("CREATE TABLE n (k string PRIMARY KEY) ENGINE=KV")
    a.kv("n").put("x", "1")
    b = Engine(spark, f"file://{tmp_path}")
    assert b.kv("n").compare_and_swap("x", "1", "2")
    with pytest.raises(AnalysisError):
        a.kv("n").compare_and_swap("x", "1", "3")  # it knows only the old value
    assert a.kv("n").get("x") == b.kv("n").get("x") == "2"
    assert not a.kv("n").compare_and_swap("x", "1", "3") and a.kv("n").compare_and_swap("x", "2", "3")
    with pytest.raises(AnalysisError):
        b.execute("CREATE TABLE t (id int PRIMARY KEY)")
    b.execute("CREATE TABLE t (id int PRIMARY KEY)")
    for i in range(25):
        b.kv("n").grant(1.0)
    c = Engine(spark, f"file://{tmp_path}")
    assert c.kv("n").get("x") == "3" and c.catalog.tables.keys() == b.catalog.tables.keys() and len(c.catalog.leases) == 25


def test_uncommitted_revisions_can_be_left_out(engine):
    from quern.streaming import tail

    e = engine
    e.execute("CREATE TABLE t (id int PRIMARY KEY)")
    e.execute("INSERT INTO t VALUES (1)")
    t = e.managed("t")
    rev = t.deltas[-1][0]
    batch = e.spark.createDataFrame([(1, rev), (2, rev + 5)], "id long, _rev long")
    assert [r["id"] for r in tail.committed(e.storage, t, batch).collect()] == [1]


def test_splits_stay(engine, monkeypatch):
    e = engine
    monkeypatch.setattr("quern.sources.tables.ROWS_A_FILE", 100)
    shards = lambda name: [(int(r["start"]), int(r["end"]), r["n_rows"]) for r in e.sql(f"ADMIN SHARDS {name}").collect()]
    e.execute("CREATE TABLE p (id int PRIMARY KEY, g int)")
    e.insert_frame("p", e.spark.range(1000).selectExpr("id * 2 AS id", "id % 7 AS g"))
    e.execute("ADMIN COMPACT")
    assert shards("p") == [(0, 1998, 1000)]
    for at in (1500, 500, 501, 5000):
        assert e.execute(f"ADMIN SPLIT TABLE p AT {at}").affected == 1000
    assert shards("p") == [(0, 498, 250), (500, 500, 1), (502, 1498, 499), (1500, 1998, 250)]  # the shard from 5000 on holds nothing yet
    assert [r["files"] > 1 for r in e.sql("ADMIN SHARDS p").collect()] == [True, False, True, True]
    e.run_script("INSERT INTO p VALUES (499, 1), (6000, 2); DELETE FROM p WHERE id = 0; UPDATE p SET id = 1501 WHERE id = 502; UPDATE p SET g = 9 WHERE id = 500; ADMIN COMPACT")
    after = [(2, 499, 250), (500, 500, 1), (504, 1498, 498), (1500, 1998, 251), (6000, 6000, 1)]
    assert shards("p") == after
    want = {2 * i: i % 7 for i in range(1000)} | {499: 1, 500: 9, 1501: 251 % 7, 6000: 2}
    del want[0], want[502]
    assert dict(rows(e, "SELECT * FROM p")) == want
    e.execute("CREATE INDEX by_g ON p (g)")
    again = Engine(e.spark, e.catalog.root)
    assert shards("p") == after and dict(rows(again, "SELECT * FROM p")) == want and again.managed("p").splits == [500, 501, 1500, 5000]
    for i in range(12):  # folds that rewrite only what changes touch
        e.execute(f"INSERT INTO p VALUES ({497 + 4 * (i % 2)}, {i}), (5001, {i})")
    e.execute("ADMIN COMPACT")
    assert shards("p") == [(2, 499, 251), (500, 500, 1), (501, 1498, 499), (1500, 1998, 251), (5001, 6000, 2)]
    assert dict(rows(e, "SELECT * FROM p")) == want | {497: 10, 501: 11, 5001: 11}
    e.execute("DELETE FROM p WHERE id >= 501 AND id < 1500")
    e.execute("ADMIN COMPACT")
    assert [r["shard"] for r in e.sql("ADMIN SHARDS p").collect()] == ["p-0", "p-1", "p-3", "p-4"]
    for bad in ("99999999999999999999", "x"):
        with pytest.raises(AnalysisError):
            e.execute(f"ADMIN SPLIT TABLE p AT {bad}")
    for kind, at, keys in (("timestamp", "'2024-01-01T02:00:00Z'", [datetime(2024, 1, 1, h) for h in range(4)]), ("string", "k2", [f"k{h}" for h in range(4)]), ("float", "2.0", [0.0, 1.0, 2.0, float("nan")])):
        e.execute(f"CREATE TABLE {kind}s (k {kind} PRIMARY KEY, n int)")
        e.execute(f"ADMIN SPLIT TABLE {kind}s AT {at}")  # before any row is there
        e.insert_frame(f"{kind}s", e.spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k {({'float': 'double'}).get(kind, kind)}, n long"))
        e.execute("ADMIN COMPACT")
        assert [r["n_rows"] for r in e.sql(f"ADMIN SHARDS {kind}s").collect()] == [2, 2], kind
        assert sorted(r[0] for r in rows(e, f"SELECT n FROM {kind}s")) == [0, 1, 2, 3]
