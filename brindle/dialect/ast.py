"""Syntax tree of the SQL dialect. Nodes compare by value."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# -- expressions


@dataclass(frozen=True)
class Literal:
    value: Any  # None, bool, int, float, str


@dataclass(frozen=True)
class Column:
    table: str | None
    name: str


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Unary:  # NOT, -
    op: str
    arg: Any


@dataclass(frozen=True)
class Binary:  # + - * / = <> < <= > >= AND OR @@
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class IsTest:  # IS [NOT] NULL | JSON
    arg: Any
    what: str
    negated: bool


@dataclass(frozen=True)
class InList:
    arg: Any
    items: tuple
    negated: bool


@dataclass(frozen=True)
class Between:
    arg: Any
    low: Any
    high: Any
    negated: bool


@dataclass(frozen=True)
class Like:
    arg: Any
    pattern: Any
    negated: bool


@dataclass(frozen=True)
class Case:
    subject: Any
    whens: tuple
    otherwise: Any


@dataclass(frozen=True)
class Cast:
    arg: Any
    type: str


@dataclass(frozen=True)
class WindowSpec:
    partition: tuple = ()
    order: tuple = ()
    name: str | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    over: WindowSpec | None = None


@dataclass(frozen=True)
class Subquery:  # scalar
    query: Any


@dataclass(frozen=True)
class Exists:
    query: Any


@dataclass(frozen=True)
class InQuery:
    arg: Any
    query: Any
    negated: bool


# -- queries


@dataclass(frozen=True)
class OrderItem:
    expr: Any
    desc: bool = False


@dataclass(frozen=True)
class SelectItem:
    expr: Any
    alias: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    database: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class DerivedTable:
    query: Any
    alias: str


@dataclass(frozen=True)
class JsonTable:
    source: Any
    path: str
    columns: tuple  # (name, type, path)
    alias: str


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, cross
    source: Any
    on: Any = None
    using: tuple = ()


@dataclass(frozen=True)
class Select:
    items: tuple
    source: Any = None
    joins: tuple = ()
    where: Any = None
    group: tuple = ()
    having: Any = None
    windows: tuple = ()  # (name, WindowSpec)
    distinct: bool = False
    order: tuple = ()
    limit: int | None = None
    offset: int | None = None
    ctes: tuple = ()  # (name, query)
    recursive: bool = False


@dataclass(frozen=True)
class SetOp:
    op: str  # UNION, INTERSECT, EXCEPT
    all: bool
    left: Any
    right: Any
    order: tuple = ()
    limit: int | None = None
    offset: int | None = None
    ctes: tuple = ()
    recursive: bool = False


# -- other statements


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    not_null: bool = False
    unique: bool = False
    primary: bool = False
    default: Any = None
    has_default: bool = False


@dataclass(frozen=True)
class CreateTable:
    table: TableRef
    columns: tuple
    primary: tuple = ()


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: TableRef
    columns: tuple
    unique: bool = False
    method: str = "BTREE"
    tokenizer: str | None = None


@dataclass(frozen=True)
class Insert:
    table: TableRef
    columns: tuple
    rows: tuple = ()
    query: Any = None


@dataclass(frozen=True)
class Update:
    table: TableRef
    sets: tuple
    where: Any = None
    order: tuple = ()
    limit: int | None = None


@dataclass(frozen=True)
class Delete:
    table: TableRef
    where: Any = None
    order: tuple = ()
    limit: int | None = None


@dataclass(frozen=True)
class AlterTable:
    table: TableRef
    add: ColumnDef | None = None
    drop: str | None = None


@dataclass(frozen=True)
class Simple:
    """DROP TABLE, TRUNCATE, DROP INDEX, CREATE/DROP DATABASE, USE, SHOW DATABASES, SHOW TABLES."""

    action: str
    name: str = ""
    database: str | None = None


@dataclass(frozen=True)
class Explain:
    statement: Any


@dataclass
class Scope:
    """Names a query can see: sources by alias, and the scope around a correlated query."""

    sources: dict[str, dict[str, str]] = field(default_factory=dict)
    outer: Scope | None = None
