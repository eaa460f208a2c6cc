"""Scalar expressions of the dialect as Spark columns; built-in expressions only."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import AnalysisError
from quern.functions.durations import microseconds
from quern.plans import ast

SPARK_TYPES = {"int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType(), "timestamp": T.TimestampType()}
#: Microseconds from 0001-01-01, where time buckets are aligned, to 1970-01-01.
ORIGIN_US = (datetime(1970, 1, 1) - datetime(1, 1, 1)) // timedelta(microseconds=1)
RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:[Tt ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?)?\s*([Zz]|[+-]\d\d:?\d\d)?")


@dataclass(frozen=True)
class Typed:
    """A column with its kind: int, float, string, bool, timestamp, null or other.

    ``naive`` timestamps have no time zone; they are read as UTC. ``value`` is set for literals.
    """

    col: Column
    kind: str
    naive: bool = False
    literal: bool = False
    value: object = None


def kind_of(t: T.DataType) -> tuple[str, bool]:
    if isinstance(t, T.BooleanType):
        return "bool", False
    if isinstance(t, T.IntegralType):
        return "int", False
    if isinstance(t, T.FractionalType):
        return "float", False
    if isinstance(t, T.StringType):
        return "string", False
    if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "timestamp", not isinstance(t, T.TimestampType)
    return ("null" if isinstance(t, T.NullType) else "other"), False


def literal(value: object) -> Typed:
    if value is None:
        return Typed(F.lit(None), "null", literal=True)
    kind = {bool: "bool", int: "int", float: "float", str: "string"}[type(value)]
    return Typed(F.lit(value).cast("long") if kind == "int" else F.lit(value), kind, literal=True, value=value)


def parse_timestamp(text: str) -> datetime:
    m = RFC3339.fullmatch(text.strip())
    if not m:
        raise AnalysisError(f"not a timestamp: {text!r}")
    y, mo, d, h, mi, s, frac, zone = m.groups()
    try:
        t = datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0), int((frac or "0").ljust(6, "0")[:6]))
    except ValueError as e:
        raise AnalysisError(f"not a timestamp: {text!r}") from e
    if zone and zone not in "Zz":
        digits = zone[1:].replace(":", "")
        offset = timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
        t += offset if zone[0] == "-" else -offset
    return t


def timestamp_literal(t: datetime, naive: bool) -> Column:
    text = t.isoformat(sep=" ")
    return F.expr(f"timestamp_ntz'{text}'") if naive else F.expr(f"timestamp'{text}Z'")


def as_timestamp(x: Typed, naive: bool = False) -> Column:
    """Any kind that has a meaning as a time: text is RFC 3339, whole numbers are seconds."""
    target = "timestamp_ntz" if naive else "timestamp"
    if x.kind == "timestamp":
        return x.col if x.naive == naive else _zone(x.col, naive)
    if x.kind == "string":
        return timestamp_literal(parse_timestamp(x.value), naive) if x.literal else _zone(x.col.cast("timestamp"), naive)
    if x.kind == "int":
        if x.literal:
            return timestamp_literal(datetime.fromtimestamp(x.value, UTC).replace(tzinfo=None), naive)
        return _zone(F.timestamp_seconds(x.col), naive)
    if x.kind == "null":
        return x.col.cast(target)
    raise AnalysisError(f"a {x.kind} is no timestamp")


def _zone(c: Column, naive: bool) -> Column:
    """Between times with a zone and without; the engine's sessions run in UTC."""
    return c.cast("timestamp_ntz" if naive else "timestamp")


def display(x: Typed) -> Column:
    """The text of a value: times in RFC 3339, everything else as Spark writes it."""
    if x.kind == "string":
        return x.col
    if x.kind == "timestamp":
        t = as_timestamp(x, naive=True)
        fraction = F.regexp_replace(F.date_format(t, ".SSSSSS"), r"\.?0+$", "")
        return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))
    return x.col.cast("string")


def truth(x: Typed) -> Column:
    if x.kind in ("bool", "null"):
        return x.col.cast("boolean")
    if x.kind == "int":
        return x.col != 0
    raise AnalysisError(f"a {x.kind} is no condition")


def compare(op: str, a: Typed, b: Typed) -> Typed:
    kinds = {a.kind, b.kind}
    if "null" in kinds:
        return Typed(F.lit(None).cast("boolean"), "bool")
    if "timestamp" in kinds and kinds <= {"timestamp", "string", "int"}:
        naive = next(x.naive for x in (a, b) if x.kind == "timestamp")
        left, right = as_timestamp(a, naive), as_timestamp(b, naive)
    elif a.kind == b.kind or kinds == {"int", "float"}:
        left, right = a.col, b.col
    else:
        left, right = display(a), display(b)
    out = {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}
    return Typed(out[op], "bool")


def like(a: Typed, pattern: Typed) -> Typed:
    """% and _ stand for letters and nothing escapes them."""
    if pattern.kind != "string":
        if pattern.kind == "null":
            return Typed(F.lit(None).cast("boolean"), "bool")
        raise AnalysisError("LIKE needs a string")
    text = display(a) if a.kind != "null" else a.col.cast("string")
    if pattern.literal:
        return Typed(text.like(str(pattern.value).replace("\\", "\\\\")), "bool")
    return Typed(F.like(text, F.replace(pattern.col, F.lit("\\"), F.lit("\\\\"))), "bool")


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    for x in (a, b):
        if x.kind not in ("int", "float", "null"):
            raise AnalysisError(f"{op} needs numbers, not a {x.kind}")
    kind = "float" if "float" in (a.kind, b.kind) else "int"
    x, y = (v.col.cast(SPARK_TYPES[kind]) if v.kind != kind else v.col for v in (a, b))
    if op == "/":
        if kind == "float":
            return Typed(F.try_divide(x, y) if "null" in (a.kind, b.kind) else x / y, kind)
        return Typed(F.call_function("div", x, y), kind)
    return Typed({"+": x + y, "-": x - y, "*": x * y}[op], kind)


def cast(x: Typed, kind: str) -> Typed:
    if x.kind == "null":
        return Typed(x.col.cast(SPARK_TYPES[kind]), kind)
    if x.kind == kind:
        return replace(x, literal=False, value=None)
    pair = (x.kind, kind)
    if kind == "string":
        return Typed(display(x), kind)
    if kind == "timestamp" and x.kind in ("string", "int"):
        return Typed(as_timestamp(x), kind)
    if pair in (("int", "float"), ("float", "int"), ("bool", "int"), ("bool", "float"), ("string", "int"), ("string", "float")):
        return Typed((F.trim(x.col) if x.kind == "string" else x.col).cast(SPARK_TYPES[kind]), kind)
    if pair == ("int", "bool"):
        return Typed(x.col != 0, kind)
    if pair == ("string", "bool"):
        t = F.lower(F.trim(x.col))
        wrong = F.raise_error(F.concat(F.lit("not a bool: "), x.col)).cast("boolean")
        return Typed(F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False).when(t.isNull(), None).otherwise(wrong), kind)
    raise AnalysisError(f"no cast from {x.kind} to {kind}")


def time_bucket(interval: Typed, t: Typed) -> Typed:
    """The start of the bucket that a time lies in; buckets are counted from 0001-01-01 in UTC."""
    if not interval.literal or interval.kind not in ("int", "float", "string"):
        raise AnalysisError("time_bucket needs a constant interval")
    width = microseconds(interval.value)
    us = F.unix_micros(as_timestamp(t))
    out = F.timestamp_micros(us - F.pmod(us + ORIGIN_US, F.lit(width)))
    naive = t.kind == "timestamp" and t.naive
    return Typed(_zone(out, True) if naive else out, "timestamp", naive)


def substring(s: Typed, start: Typed, length: Typed | None = None) -> Typed:
    """From a place counted from 1; places before the text are its begin, negative lengths nothing."""
    begin = F.greatest(start.col, F.lit(1)).cast("int")
    size = F.lit(2**31 - 1) if length is None else F.greatest(F.least(length.col, F.lit(2**31 - 1)), F.lit(0)).cast("int")
    return Typed(F.substring(display(s), begin, size), "string")


def _texts(f: Callable[[Column], Column], kind: str = "string") -> Callable[..., Typed]:
    return lambda s: Typed(f(display(s)) if s.kind != "null" else F.lit(None).cast(SPARK_TYPES[kind]), kind)


def _abs(x: Typed) -> Typed:
    if x.kind not in ("int", "float", "null"):
        raise AnalysisError(f"abs needs a number, not a {x.kind}")
    return Typed(F.abs(x.col.cast("double") if x.kind == "null" else x.col), "float" if x.kind == "null" else x.kind)


def _concat(*parts: Typed) -> Typed:
    return Typed(F.concat_ws("", *(display(p) for p in parts if p.kind != "null")), "string")


def _concat_ws(separator: Typed, *parts: Typed) -> Typed:
    if separator.kind != "string" or not separator.literal:
        raise AnalysisError("concat_ws needs a constant separator")
    return Typed(F.concat_ws(str(separator.value), *(display(p) for p in parts if p.kind != "null")), "string")


#: name: (implementation, fewest and most arguments)
FUNCTIONS: dict[str, tuple[Callable[..., Typed], int, int]] = {
    "abs": (_abs, 1, 1),
    "lower": (_texts(F.lower), 1, 1),
    "upper": (_texts(F.upper), 1, 1),
    "length": (_texts(lambda c: F.char_length(c).cast("long"), "int"), 1, 1),
    "len": (_texts(lambda c: F.char_length(c).cast("long"), "int"), 1, 1),
    "concat": (_concat, 1, 1000),
    "concat_ws": (_concat_ws, 1, 1000),
    "substr": (substring, 2, 3),
    "substring": (substring, 2, 3),
    "time_bucket": (time_bucket, 2, 2),
}


class Lowering:
    """Lowers expressions over the columns of one frame."""

    def __init__(self, columns: dict[str, Typed], now: datetime | None = None, known: dict[ast.Expr, Typed] | None = None) -> None:
        self.columns = columns
        self.now = now
        self.known = known or {}

    @classmethod
    def of(cls, schema: T.StructType, now: datetime | None = None) -> Lowering:
        columns = {}
        for f in schema.fields:
            kind, naive = kind_of(f.dataType)
            columns[f.name.lower()] = Typed(F.col(f"`{f.name}`"), kind, naive)
        return cls(columns, now)

    def __call__(self, e: ast.Expr) -> Typed:
        if e in self.known and not isinstance(e, ast.Literal):
            return self.known[e]
        match e:
            case ast.Literal(value):
                return literal(value)
            case ast.Name(name):
                if name not in self.columns:
                    raise AnalysisError(f"unknown column {name}")
                return self.columns[name]
            case ast.Unary("NOT", arg):
                return Typed(~truth(self(arg)), "bool")
            case ast.Unary("-", arg):
                x = self(arg)
                if x.kind not in ("int", "float", "null"):
                    raise AnalysisError(f"- needs a number, not a {x.kind}")
                return Typed(-x.col if x.kind != "null" else x.col, x.kind)
            case ast.Binary("AND", left, right):
                return Typed(truth(self(left)) & truth(self(right)), "bool")
            case ast.Binary("OR", left, right):
                return Typed(truth(self(left)) | truth(self(right)), "bool")
            case ast.Binary("LIKE", left, right):
                return like(self(left), self(right))
            case ast.Binary(op, left, right) if op in "+-*/":
                return arithmetic(op, self(left), self(right))
            case ast.Binary(op, left, right):
                return compare(op, self(left), self(right))
            case ast.Cast(arg, kind):
                return cast(self(arg), kind)
            case ast.Call(name, args):
                return self.call(name, args)
        raise AnalysisError(f"{e} has no meaning here")

    def call(self, name: str, args: tuple[ast.Expr, ...]) -> Typed:
        if name == "now" and not args:
            return Typed(timestamp_literal(self.now, False) if self.now else F.current_timestamp(), "timestamp")
        if name == "unixepoch" and not args:
            return Typed(F.unix_seconds(self(ast.Call("now", ())).col), "int")
        if name not in FUNCTIONS:
            raise AnalysisError(f"unknown function {name}")
        f, least, most = FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise AnalysisError(f"{name} takes {least} to {most} arguments, not {len(args)}")
        return f(*(self(a) for a in args))
