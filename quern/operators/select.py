"""SELECT as a DataFrame plan."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import AnalysisError
from quern.functions.dialect import Lowering, Typed, kind_of, truth
from quern.plans import ast

AGGREGATES = ("count", "sum", "min", "max", "avg", "count_if")


def children(e: ast.Expr) -> tuple[ast.Expr, ...]:
    match e:
        case ast.Unary(_, arg) | ast.Cast(arg, _):
            return (arg,)
        case ast.Binary(_, left, right):
            return left, right
        case ast.Call(_, args):
            return args
    return ()


def walk(e: ast.Expr) -> Iterator[ast.Expr]:
    yield e
    for c in children(e):
        yield from walk(c)


def is_aggregate(e: ast.Expr) -> bool:
    return isinstance(e, ast.Call) and e.name in AGGREGATES


def has_aggregate(e: ast.Expr | None) -> bool:
    return e is not None and any(is_aggregate(x) for x in walk(e))


def aggregate(call: ast.Call, lower: Lowering) -> tuple[Column, str, bool]:
    """The aggregate of a call, its kind, and whether its times are naive."""
    if len(call.args) != 1:
        raise AnalysisError(f"{call.name} takes one argument")
    arg = call.args[0]
    if has_aggregate(arg):
        raise AnalysisError("an aggregate within an aggregate")
    if call.name == "count":
        return (F.count(F.lit(1)) if isinstance(arg, ast.Star) else F.count(lower(arg).col)), "int", False
    x = lower(arg)
    if call.name == "count_if":
        return F.count_if(truth(x)), "int", False
    if call.name in ("min", "max"):
        return getattr(F, call.name)(x.col), x.kind, x.naive
    if x.kind not in ("int", "float", "null"):
        raise AnalysisError(f"{call.name} needs numbers, not a {x.kind}")
    if call.name == "avg":
        return F.avg(x.col.cast("double")), "float", False
    return F.sum(x.col.cast("long" if x.kind != "float" else "double")), "float" if x.kind == "float" else "int", False


def output_name(item: ast.Item, k: int) -> str:
    return item.alias or (item.expr.name if isinstance(item.expr, ast.Name) else f"col{k}")


def expand(items: tuple[ast.Item, ...], columns: list[str]) -> list[ast.Item]:
    out = []
    for item in items:
        out += [ast.Item(ast.Name(c)) for c in columns] if isinstance(item.expr, ast.Star) else [item]
    return out


def select(stmt: ast.Select, source: DataFrame, now: datetime | None = None) -> DataFrame:
    """The plan of a SELECT over its table (or over one row without columns)."""
    lower = Lowering.of(source.schema, now)
    items = expand(stmt.items, list(lower.columns))
    by_alias = {i.alias: i.expr for i in items if i.alias}

    def resolved(e: ast.Expr) -> ast.Expr:
        """What a key of GROUP BY or ORDER BY means: the n-th item, an item's alias, or itself."""
        if isinstance(e, ast.Literal) and type(e.value) is int:
            if not 1 <= e.value <= len(items):
                raise AnalysisError(f"there is no item {e.value}")
            return items[e.value - 1].expr
        if isinstance(e, ast.Name) and e.name in by_alias and e.name not in lower.columns:
            return by_alias[e.name]
        return e

    def named(e: ast.Expr) -> ast.Expr:
        """Aliases within a condition on groups."""
        match e:
            case ast.Name():
                return resolved(e)
            case ast.Unary(op, arg):
                return ast.Unary(op, named(arg))
            case ast.Binary(op, left, right):
                return ast.Binary(op, named(left), named(right))
            case ast.Cast(arg, kind):
                return ast.Cast(named(arg), kind)
            case ast.Call(name, args) if not is_aggregate(e):
                return ast.Call(name, tuple(map(named, args)))
        return e

    if has_aggregate(stmt.where):
        raise AnalysisError("an aggregate in WHERE")
    df = source.where(truth(lower(stmt.where))) if stmt.where else source
    order = [ast.Order(resolved(o.expr) if not isinstance(o.expr, ast.Name) or o.expr.name not in by_alias else by_alias[o.expr.name], o.descending) for o in stmt.order]
    having = named(stmt.having) if stmt.having else None
    if stmt.group or any(map(has_aggregate, [i.expr for i in items] + [o.expr for o in order] + [having])):
        df, lower = group(df, lower, [resolved(e) for e in stmt.group], [i.expr for i in items] + [o.expr for o in order] + ([having] if having else []))
        if having:
            df = df.where(truth(lower(having)))
    elif having:
        raise AnalysisError("HAVING without groups")
    return project(df, lower, items, order, stmt)


def group(df: DataFrame, lower: Lowering, keys: list[ast.Expr], used: list[ast.Expr]) -> tuple[DataFrame, Lowering]:
    """Groups by the keys; what the other expressions need is computed beside them."""
    known: dict[ast.Expr, Typed] = {}
    key_columns, columns = [], []
    for k, e in enumerate(keys):
        if has_aggregate(e):
            raise AnalysisError("an aggregate in GROUP BY")
        x = lower(e)
        key_columns.append(x.col.alias(f"_g{k}"))
        known[e] = Typed(F.col(f"_g{k}"), x.kind, x.naive)

    def need(e: ast.Expr) -> None:
        if e in known or isinstance(e, ast.Literal | ast.Star):
            return
        name = f"_a{len(columns)}"
        if is_aggregate(e):
            col, kind, naive = aggregate(e, lower)
        elif isinstance(e, ast.Name):
            x = lower(e)
            col, kind, naive = F.first(x.col), x.kind, x.naive
        else:
            for c in children(e):
                need(c)
            return
        columns.append(col.alias(name))
        known[e] = Typed(F.col(name), kind, naive)

    for e in used:
        need(e)
    if columns:
        out = df.groupBy(*key_columns).agg(*columns)
    else:
        out = df.select(*key_columns).distinct() if key_columns else df.limit(1)
    return out, Lowering({}, lower.now, known)


def project(df: DataFrame, lower: Lowering, items: list[ast.Item], order: list[ast.Order], stmt: ast.Select) -> DataFrame:
    outputs = [lower(i.expr).col for i in items]
    names = [output_name(i, k) for k, i in enumerate(items)]
    sort = [lower(o.expr).col for o in order]
    if stmt.distinct:
        # A distinct row is sorted by its first row's keys.
        inner = df.select(*(c.alias(f"_o{k}") for k, c in enumerate(outputs)), *(c.alias(f"_s{k}") for k, c in enumerate(sort)))
        rows = [F.col(f"_o{k}") for k in range(len(outputs))]
        if any(o.expr not in [i.expr for i in items] for o in order):
            ends = [(F.max if o.descending else F.min)(f"_s{k}").alias(f"_s{k}") for k, o in enumerate(order)]
            df = inner.groupBy(*rows).agg(*ends)
        else:
            df = inner.distinct()
        outputs, sort = rows, [F.col(f"_s{k}") for k in range(len(sort))]
    if sort:
        df = df.orderBy(*((c.desc_nulls_last() if o.descending else c.asc_nulls_first()) for c, o in zip(sort, order, strict=True)))
    if stmt.limit is not None:
        df = df.limit(stmt.limit)
    return df.select(*(c.alias(n) for c, n in zip(outputs, names, strict=True)))


def schema_kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType)[0] for f in df.schema.fields}
