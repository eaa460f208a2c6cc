import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.errors import AnalysisError, ParseError
from quern.functions.durations import microseconds, seconds
from quern.plans import ast
from quern.plans.lexer import tokenize
from quern.plans.parser import parse, parse_script


def where(text):
    return parse(f"SELECT 1 FROM t WHERE {text}").where


def test_precedence():
    a, b, c = map(ast.Name, "abc")
    assert where("a OR b AND c") == ast.Binary("OR", a, ast.Binary("AND", b, c))
    assert where("a + b * c = 1") == ast.Binary("=", ast.Binary("+", a, ast.Binary("*", b, c)), ast.Literal(1))
    assert where("NOT a = 1") == ast.Unary("NOT", ast.Binary("=", a, ast.Literal(1)))
    assert where("a - b - c") == ast.Binary("-", ast.Binary("-", a, b), c)
    assert where("a NOT LIKE 'x%'") == ast.Unary("NOT", ast.Binary("LIKE", a, ast.Literal("x%")))
    assert where("-(a) < -2.5") == ast.Binary("<", ast.Unary("-", a), ast.Literal(-2.5))


@given(st.text())
def test_strings_round_trip(text):
    for q in "'\"":
        assert tokenize(q + text.replace(q, q * 2) + q)[0].text == text


def test_noise_words_are_optional():
    assert parse("INSERT t (1, 'a')") == parse("INSERT INTO t VALUES (1, 'a')")
    assert parse("UPDATE t a = 1") == parse("UPDATE t SET a = 1")
    assert parse("DELETE t WHERE a == 1") == parse("DELETE FROM t WHERE a = 1")
    assert parse("SELECT a FROM t ORDER a DESC LIMIT 3").order == (ast.Order(ast.Name("a"), True),)


def test_create_table():
    got = parse("CREATE TABLE IF NOT EXISTS T (a int, b TEXT NOT NULL, c timestamp DEFAULT 1, PRIMARY KEY (a, c)) ENGINE=CSTORE2 RETENTION='7d'")
    assert got.name == "t" and got.primary == ("a", "c") and got.engine == "CSTORE2" and got.retention == 7 * 86400 and got.if_not_exists
    assert [c.kind for c in got.columns] == ["int", "string", "timestamp"] and got.columns[1].not_null


def test_scripts_and_kv():
    assert len(parse_script("BEGIN; SELECT 1; COMMIT;")) == 3
    assert parse("KV SCAN t 'a' 'b'") == ast.Kv("SCAN", "t", ("a", "b"))
    assert parse("INSERT INTO t (a, b) VALUES (1, NULL), (2, TRUE)").columns == ("a", "b")


@pytest.mark.parametrize("sql", ["SELECT", "SELECT 'a", "SELECT a FROM t LIMIT x", "CREATE TABLE t (a blob)", "KV PUT t 'a'", "SELECT 1 2", "CREATE INDEX i ON t (a, b)", "SELECT a b FROM t", "FOO"])
def test_errors(sql):
    with pytest.raises(ParseError):
        parse(sql)


def test_durations():
    assert seconds("1h30m") == 5400 and seconds(900) == 900 and seconds("0.5h") == 1800 and seconds("2 days") == 172800 and microseconds("1w") == 604_800_000_000
    for bad in ("x", "5q", "", "-1", 0):
        with pytest.raises(AnalysisError):
            seconds(bad)
