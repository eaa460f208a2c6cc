"""Statements and expressions as immutable values."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    """An expression."""


@dataclass(frozen=True)
class Literal(Expr):
    value: int | float | str | bool | None


@dataclass(frozen=True)
class Name(Expr):
    name: str


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Cast(Expr):
    arg: Expr
    kind: str


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


class Statement:
    """A statement."""


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Select(Statement):
    items: tuple[Item, ...]
    table: str | None = None
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    distinct: bool = False


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str = "string"
    not_null: bool = False
    primary: bool = False
    default: Expr | None = None


@dataclass(frozen=True)
class CreateTable(Statement):
    name: str
    columns: tuple[ColumnDef, ...]
    primary: tuple[str, ...] = ()
    engine: str = "TABLE"
    retention: float | None = None
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropTable(Statement):
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class CreateIndex(Statement):
    name: str
    table: str
    column: str
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropIndex(Statement):
    name: str
    table: str | None = None
    if_exists: bool = False


@dataclass(frozen=True)
class CreateDatabase(Statement):
    name: str


@dataclass(frozen=True)
class Transaction(Statement):
    what: str


@dataclass(frozen=True)
class Insert(Statement):
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class Update(Statement):
    table: str
    changes: tuple[tuple[str, Expr], ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Delete(Statement):
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class Kv(Statement):
    what: str
    table: str
    args: tuple[str, ...] = ()


@dataclass(frozen=True)
class Admin(Statement):
    words: tuple[str, ...] = field(default=())
