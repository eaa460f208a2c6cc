"""CREATE, DROP, INSERT, UPDATE and DELETE on keyed tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import AnalysisError
from quern.functions.dialect import SPARK_TYPES, Lowering, Typed, cast, truth
from quern.operators.pruning import key_bounds
from quern.plans import ast
from quern.sources.catalog import Table
from quern.sources.tables import NOT_NULL, Storage

#: What an omitted column is; times are null.
ZERO = {"int": 0, "float": 0.0, "string": "", "bool": False, "timestamp": None}


def define(stmt: ast.CreateTable) -> Table:
    names = [c.name for c in stmt.columns]
    if len(set(names)) != len(names):
        raise AnalysisError("a column is named twice")
    wanted = set(stmt.primary) | {c.name for c in stmt.columns if c.primary} or set(names[:1])
    if missing := wanted - set(names):
        raise AnalysisError(f"no column {sorted(missing)[0]} for the primary key")
    return Table(stmt.name, [(c.name, c.kind) for c in stmt.columns], [n for n in names if n in wanted], [n for n in names if n in wanted or any(c.name == n and c.not_null for c in stmt.columns)], stmt.engine, stmt.retention)


def insert(storage: Storage, t: Table, stmt: ast.Insert, now: datetime | None = None) -> int:
    """Upsert literal rows; of rows with one key the last counts."""
    columns = list(stmt.columns) or [c for c, _ in t.columns]
    kinds = [t.kind(c) for c in columns]
    lower = Lowering({}, now)
    rows = []
    for k, row in enumerate(stmt.rows):
        if len(row) != len(columns):
            raise AnalysisError(f"{len(row)} values for {len(columns)} columns")
        values = [to_kind(lower(e), kind).cast(SPARK_TYPES[kind]) for e, kind in zip(row, kinds, strict=True)]
        rows.append(F.struct(*(v.alias(c) for v, c in zip(values, columns, strict=True)), F.lit(k).cast("long").alias("_seq")))
    df = storage.spark.range(1).select(F.inline(F.array(*rows)))
    return upsert(storage, t, df, F.col("_seq"))


def to_kind(x: Typed, kind: str):  # noqa: ANN201
    """A value as a column's kind; numbers take part in conditions, so they convert to bool and back."""
    return x.col if x.kind == kind and not x.naive else cast(x, kind).col


def checked(t: Table, name: str, value: Column) -> Column:
    """The value of a column, or an error where it is null and must not be."""
    if name not in t.not_null:
        return value
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"column {name} {NOT_NULL}")))


def upsert(storage: Storage, t: Table, df: DataFrame, seq=None) -> int:  # noqa: ANN001
    """Write whole rows; omitted columns get their zero values."""
    unknown = set(df.columns) - {c for c, _ in t.columns} - {"_seq"}
    if unknown:
        raise AnalysisError(f"table {t.name} has no column {sorted(unknown)[0]}")
    filled = df.select("*", *(F.lit(ZERO[k]).cast(SPARK_TYPES[k]).alias(c) for c, k in t.columns if c not in df.columns))
    filled = filled.withColumn("_place", seq if seq is not None else F.monotonically_increasing_id())
    filled = filled.select(*(checked(t, c, F.col(f"`{c}`").cast(SPARK_TYPES[k])).alias(c) for c, k in t.columns), "_place")
    return storage.append(t, filled, seq=F.col("_place"))


def update(storage: Storage, t: Table, stmt: ast.Update, now: datetime | None = None) -> int:
    """Set columns of the rows that match; expressions see the old row. A new key moves the row."""
    view = storage.view(t, bounds=key_bounds(stmt.where, t))
    lower = Lowering.of(view.schema, now)
    matched = view.where(truth(lower(stmt.where))) if stmt.where else view
    changes = {c: checked(t, c, to_kind(lower(e), t.kind(c)).cast(SPARK_TYPES[t.kind(c)])) for c, e in stmt.changes}
    if not set(changes) & set(t.key):
        rows = matched.select(*(F.col(k) for k in t.key), *(v.alias(c) for c, v in changes.items()))
        return storage.append(t, rows, sets=list(changes))
    # One revision: the old keys go, then the new rows come.
    old = matched.select(*(F.col(c) for c, _ in t.columns), F.lit("D").alias("_op"), F.lit(0).alias("_seq"))
    new = matched.select(*((changes[c] if c in changes else F.col(c)).alias(c) for c, _ in t.columns), F.lit("U").alias("_op"), F.lit(1).alias("_seq"))
    return storage.append_mixed(t, old.union(new)) // 2


def delete(storage: Storage, t: Table, where: ast.Expr | None, now: datetime | None = None) -> int:
    view = storage.view(t, bounds=key_bounds(where, t))
    matched = view.where(truth(Lowering.of(view.schema, now)(where))) if where else view
    return storage.append(t, matched.select(*t.key), op="D")
