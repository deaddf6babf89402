"""Lowering: a query of the dialect becomes Spark SQL text, and Catalyst does all planning.

What the lowering adds is the dialect's meaning: comparisons with NULL are false (raw in positive
filter positions, so that they still push down and join; wrapped under NOT and in values), NULLS
LAST in both directions, integer division, set operations from left to right, first() for bare
columns of grouped queries, and the JSON and full-text functions.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..dialect import ast as A
from ..dialect.parser import AGGREGATES
from ..functions import json as J
from ..functions import scalar as S
from ..functions.search import rows_with, tokens_of

RANKS = ("ROW_NUMBER", "RANK", "DENSE_RANK")
MAX_DEPTH = 1000
COMPACT = 16  # steps of a recursion that are kept apart


class SQLError(ValueError):
    pass


class UnknownColumn(SQLError):
    pass


def widest(kinds: list[str]) -> str:
    """The type of a value that is one of several: FLOAT if any number of them is."""
    known = [k for k in kinds if k != "NULL"]
    return "FLOAT" if "FLOAT" in known and set(known) <= {"INT", "FLOAT"} else next(iter(known), "NULL")


@dataclass(frozen=True)
class Raw:
    """Text that is lowered already."""

    text: str
    kind: str


@dataclass
class Source:
    alias: str
    text: str
    columns: list[tuple[str, str]]  # (name, type)
    tokenizers: dict[str, str]
    hidden: set[str]
    postings: dict[str, tuple[str, str]] = field(default_factory=dict)  # (tokenizer, view) by column


@dataclass
class Scope:
    sources: list[Source]
    outer: Scope | None
    windows: dict[str, A.WindowSpec]
    grouped: set[str] | None = None
    ctes: dict[str, Any] | None = None
    filtering: bool = False  # inside WHERE, where a posting table may stand in


def tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def kind_of(field: T.StructField) -> str:
    if (field.metadata or {}).get("dialect_type"):
        return field.metadata["dialect_type"]
    t = field.dataType
    if isinstance(t, T.IntegralType):
        return "INT"
    if isinstance(t, T.FractionalType):
        return "FLOAT"
    return {T.StringType: "TEXT", T.BooleanType: "BOOL", T.VariantType: "JSONB", T.NullType: "NULL"}.get(type(t), "")


def mentions(node: Any, name: str) -> bool:
    """Whether a query refers to a table of this name."""
    if isinstance(node, A.TableRef):
        return node.database is None and node.name.lower() == name.lower()
    if isinstance(node, tuple):
        return any(mentions(x, name) for x in node)
    return any(mentions(getattr(node, f), name) for f in getattr(node, "__dataclass_fields__", ()))


def has_aggregate(node: Any) -> bool:
    if isinstance(node, A.Call):
        return node.name in AGGREGATES and node.over is None or any(has_aggregate(a) for a in node.args)
    if isinstance(node, (A.Subquery, A.Exists)):
        return False
    if isinstance(node, A.InQuery):
        return has_aggregate(node.arg)
    if isinstance(node, tuple):
        return any(has_aggregate(x) for x in node)
    return any(has_aggregate(getattr(node, f)) for f in getattr(node, "__dataclass_fields__", ()))


class Lowering:
    """Lowers one statement. ``tables`` resolves (database, name) to (view, {column: tokenizer}, posting tables)."""

    def __init__(self, spark, tables, checkpoints=lambda: None):
        self.spark, self.tables = spark, tables
        self.checkpoints = checkpoints  # the folder for steps of a recursion, if the session has none
        self.views: list[str] = []
        self.kinds: dict[int, list[str]] = {}  # types of the output columns, by id() of a lowered query
        self.held: list[Any] = []  # these queries, so that an id stays theirs

    def view(self, df: DataFrame) -> str:
        name = f"brindle_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        self.views.append(name)
        return name

    def close(self) -> None:
        for v in self.views:
            self.spark.catalog.dropTempView(v)

    def frame(self, query, ctes: dict[str, Any] | None = None) -> DataFrame:
        return self.spark.sql(self.query(query, ctes or {}, None))

    # -- queries -----------------------------------------------------------------------------

    def query(self, q, ctes: dict[str, Any], outer: Scope | None) -> str:
        ctes = dict(ctes)
        for name, body in q.ctes:
            ctes[name.lower()] = self.cte(name, body, ctes, q.recursive)
        return self.set_op(q, ctes, outer) if isinstance(q, A.SetOp) else self.select(q, ctes, outer)

    def cte(self, name: str, body, ctes: dict[str, Any], recursive: bool) -> str:
        if not recursive or not mentions(body, name):
            return self.view(self.frame(body, ctes))
        if not isinstance(body, A.SetOp) or body.op != "UNION":
            raise SQLError(f"recursive {name} must be a UNION")
        anchor = self.frame(body.left, ctes)
        wide = [f"CAST({tick(f.name)} AS BIGINT) AS {tick(f.name)}" if kind_of(f) == "INT" else tick(f.name) for f in anchor.schema]
        anchor = anchor.selectExpr(*wide)
        names = [f.name for f in anchor.schema]
        if body.all:
            start = self.view(anchor)
            self_name = f"brindle_{uuid.uuid4().hex}"
            scope = ctes | {name.lower(): (self_name, [(f.name, kind_of(f)) for f in anchor.schema])}
            step = self.query(body.right, scope, None)
            cols = ", ".join(map(tick, names))
            casts = ", ".join(f"CAST({tick(f'c{i}')} AS {f.dataType.simpleString()}) AS {tick(f.name)}" for i, f in enumerate(anchor.schema))
            inner = ", ".join(f"c{i}" for i in range(len(names)))
            text = f"WITH RECURSIVE {self_name}({cols}) AS (SELECT {cols} FROM {start} UNION ALL SELECT {casts} FROM ({step}) AS t({inner})) SELECT {cols} FROM {self_name}"
            return self.view(self.spark.sql(text))
        if self.spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            self.spark.sparkContext.setCheckpointDir(self.checkpoints())
        kept = delta = anchor.distinct().checkpoint()
        for round_ in range(MAX_DEPTH):
            step = self.frame(body.right, ctes | {name.lower(): self.view(delta)}).toDF(*names)
            step = step.select(*[step[c].cast(f.dataType).alias(c) for c, f in zip(names, anchor.schema, strict=True)])
            delta = step.subtract(kept).checkpoint()  # an anti-join with what is known
            if delta.isEmpty():
                return self.view(kept)
            kept = kept.unionAll(delta)
            if round_ % COMPACT == COMPACT - 1:
                kept = kept.checkpoint()  # one table again
        raise SQLError(f"recursive {name} exceeded maximum depth {MAX_DEPTH}")

    def set_op(self, q: A.SetOp, ctes: dict[str, Any], outer: Scope | None) -> str:
        left, right = self.query(q.left, ctes, outer), self.query(q.right, ctes, outer)
        a, b = self.kinds[id(q.left)], self.kinds[id(q.right)]
        if len(a) != len(b):
            raise SQLError(f"{q.op} of {len(a)} and {len(b)} columns")
        for x, y in zip(a, b, strict=True):
            k = {x, y} - {"NULL", ""}
            if len(k - {"JSON"} if "TEXT" in k else k) > 1:
                raise SQLError(f"{q.op} of {x} and {y}")
        self.kinds[id(q)] = [x if x not in ("NULL", "") else y for x, y in zip(a, b, strict=True)]
        self.held.append(q)
        text = f"({left}) {q.op}{' ALL' if q.all else ''} ({right})"
        order = []
        for o in q.order:
            if not isinstance(o.expr, A.Column):
                raise SQLError("ORDER BY of a set operation takes output columns")
            order.append(f"{tick(o.expr.name)} {'DESC' if o.desc else 'ASC'} NULLS LAST")
        return f"SELECT * FROM ({text})" + self.tail(order, q.limit, q.offset)

    @staticmethod
    def tail(order: list[str], limit: int | None, offset: int | None) -> str:
        out = f" ORDER BY {', '.join(order)}" if order else ""
        out += f" LIMIT {limit}" if limit is not None else ""
        return out + (f" OFFSET {offset}" if offset is not None else "")

    def source(self, s, ctes: dict[str, Any], outer: Scope | None) -> Source:
        tokenizers: dict[str, str] = {}
        postings: dict[str, tuple[str, str]] = {}
        if isinstance(s, A.TableRef):
            alias = s.alias or s.name
            found = ctes.get(s.name.lower()) if s.database is None else None
            if isinstance(found, tuple):
                return Source(alias, found[0], found[1], {}, set())
            if found is None:
                found, tokenizers, postings = self.tables(s.database, s.name)
        elif isinstance(s, A.JsonTable):
            e, k = self.value(s.source, Scope([], outer, {})), self.kind(s.source, Scope([], outer, {}))
            alias, found = s.alias, self.view(self.spark.sql(J.json_table(e, k, s.path, list(s.columns))))
        else:
            alias, found = s.alias, self.view(self.spark.sql(self.query(s.query, ctes, outer)))
        schema = self.spark.table(found).schema
        return Source(alias, found, [(f.name, kind_of(f)) for f in schema if f.name != "__rowid"], tokenizers, set(), postings)

    def select(self, q: A.Select, ctes: dict[str, Any], outer: Scope | None) -> str:
        scope = Scope([], outer, dict(q.windows), None, ctes)
        text = ""
        if q.source is not None:
            first = self.source(q.source, ctes, outer)
            scope.sources.append(first)
            text = f" FROM {first.text} AS {tick(first.alias)}"
        for j in q.joins:
            right = self.source(j.source, ctes, outer)
            if any(s.alias.lower() == right.alias.lower() for s in scope.sources):
                raise SQLError(f"table {right.alias} is there twice")
            previous = scope.sources[-1]
            scope.sources.append(right)
            on = j.on
            for c in j.using:
                pair = A.Binary("=", A.Column(previous.alias, c), A.Column(right.alias, c))
                on = pair if on is None or not j.using.index(c) else A.Binary("AND", on, pair)
                right.hidden.add(c.lower())
            condition = f" ON {self.truth(on, scope)}" if on is not None else ""
            text += f" {'INNER' if j.kind == 'inner' else j.kind.upper()} JOIN {right.text} AS {tick(right.alias)}{condition}"
        if q.where is not None:
            text += f" WHERE {self.truth(q.where, replace(scope, filtering=True))}"
        items: list[A.SelectItem] = []
        for item in q.items:
            if isinstance(item.expr, A.Star):
                if not scope.sources:
                    raise SQLError("* without a table")
                items += [A.SelectItem(A.Column(s.alias, c), c) for s in scope.sources for c, _ in s.columns if c.lower() not in s.hidden]
            else:
                items.append(item)
        grouped = bool(q.group) or has_aggregate(tuple(i.expr for i in items)) or q.having is not None
        groups = [self.value(self.by_alias(g, items) if self.is_alias(g, items, scope) else g, scope) for g in q.group]
        inner = replace_scope(scope, set(groups) if grouped else None)
        columns = [(self.value(i.expr, inner), i.alias or self.label(i.expr)) for i in items]
        if groups:
            text += f" GROUP BY {', '.join(groups)}"
        if q.having is not None:
            text += f" HAVING {self.truth(self.without_aliases(q.having, items, scope), inner)}"
        order = []
        for o in q.order:
            e = self.by_alias(o.expr, items) if self.is_alias(o.expr, items, scope) else o.expr
            order.append((self.value(e, inner), o.desc))
        self.kinds[id(q)] = [self.kind(i.expr, inner) for i in items]
        self.held.append(q)
        listed = ", ".join(f"{e} AS {tick(n)}" for e, n in columns)
        shown = {e for e, _ in columns}
        if q.distinct and any(e not in shown for e, _ in order):
            # the first of equal rows counts: order by the best hidden key of each
            keys = [f"k{i}" for i in range(len(order))]
            outs = [f"o{i}" for i in range(len(columns))]
            base = ", ".join([*(f"{e} AS {o}" for (e, _), o in zip(columns, outs, strict=True)), *(f"{e} AS {k}" for (e, _), k in zip(order, keys, strict=True))])
            best = [f"{'max' if d else 'min'}({k}) {'DESC' if d else 'ASC'} NULLS LAST" for (_, d), k in zip(order, keys, strict=True)]
            picked = ", ".join(f"{o} AS {tick(n)}" for o, (_, n) in zip(outs, columns, strict=True))
            return f"SELECT {picked} FROM (SELECT {base}{text}) GROUP BY {', '.join(outs)}" + self.tail(best, q.limit, q.offset)
        if q.distinct and order:
            outs = [f"o{i}" for i in range(len(columns))]
            base = ", ".join(f"{e} AS {o}" for (e, _), o in zip(columns, outs, strict=True))
            place = {e: o for (e, _), o in zip(columns, outs, strict=True)}
            picked = ", ".join(f"{o} AS {tick(n)}" for o, (_, n) in zip(outs, columns, strict=True))
            return f"SELECT {picked} FROM (SELECT DISTINCT {base}{text})" + self.tail([f"{place[e]} {'DESC' if d else 'ASC'} NULLS LAST" for e, d in order], q.limit, q.offset)
        keys = [f"{e} {'DESC' if d else 'ASC'} NULLS LAST" for e, d in order]
        return f"SELECT {'DISTINCT ' if q.distinct else ''}{listed}{text}" + self.tail(keys, q.limit, q.offset)

    # -- names -------------------------------------------------------------------------------

    def is_alias(self, e, items, scope: Scope) -> bool:
        if not isinstance(e, A.Column) or e.table is not None:
            return False
        known = any(c.lower() == e.name.lower() for s in scope.sources for c, _ in s.columns)
        return not known and any((i.alias or "").lower() == e.name.lower() for i in items)

    def by_alias(self, e, items):
        return next(i.expr for i in items if (i.alias or "").lower() == e.name.lower())

    def without_aliases(self, e, items, scope: Scope):
        if self.is_alias(e, items, scope):
            return self.by_alias(e, items)
        if isinstance(e, tuple):
            return tuple(self.without_aliases(x, items, scope) for x in e)
        if isinstance(e, (A.Subquery, A.Exists)) or not hasattr(e, "__dataclass_fields__"):
            return e
        return replace(e, **{f: self.without_aliases(getattr(e, f), items, scope) for f in e.__dataclass_fields__})

    def column(self, c: A.Column, scope: Scope) -> tuple[str, str, Source, bool]:
        """(text, type, source, whether it is from the innermost scope)."""
        at, own = scope, True
        while at is not None:
            found = [(s, n, k) for s in at.sources if c.table is None or s.alias.lower() == c.table.lower() for n, k in s.columns if n.lower() == c.name.lower()]
            if c.table is None and len(found) > 1:
                visible = [f for f in found if c.name.lower() not in f[0].hidden]
                if len(visible) != 1:
                    raise SQLError(f"column {c.name} is ambiguous")
                found = visible
            if found:
                s, n, k = found[0]
                return f"{tick(s.alias)}.{tick(n)}", k, s, own
            at, own = at.outer, False
        raise UnknownColumn(f"unknown column {(c.table + '.') if c.table else ''}{c.name}")

    def label(self, e) -> str:
        if isinstance(e, A.Column):
            return e.name
        if isinstance(e, A.Call):
            return f"{e.name}({', '.join('*' if isinstance(a, A.Star) else self.label(a) for a in e.args)})"
        if isinstance(e, A.Literal):
            return "NULL" if e.value is None else str(e.value)
        if isinstance(e, A.Binary):
            return f"{self.label(e.left)} {e.op} {self.label(e.right)}"
        if isinstance(e, A.Cast):
            return f"CAST({self.label(e.arg)} AS {e.type})"
        return "?"

    # -- types -------------------------------------------------------------------------------

    def kind(self, e, scope: Scope) -> str:
        if isinstance(e, Raw):
            return e.kind
        if isinstance(e, A.Literal):
            v = e.value
            return "NULL" if v is None else "BOOL" if isinstance(v, bool) else "INT" if isinstance(v, int) else "FLOAT" if isinstance(v, float) else "TEXT"
        if isinstance(e, A.Column):
            return self.column(e, scope)[1]
        if isinstance(e, A.Unary):
            return "BOOL" if e.op == "NOT" else self.kind(e.arg, scope)
        if isinstance(e, A.Binary):
            if e.op not in "+-*/":
                return "BOOL"
            k = {self.kind(e.left, scope), self.kind(e.right, scope)} - {"NULL"}
            return "INT" if k <= {"INT"} else "FLOAT"
        if isinstance(e, A.Cast):
            return e.type
        if isinstance(e, A.Case):
            return widest([self.kind(x, scope) for x in [*[t for _, t in e.whens], *([e.otherwise] if e.otherwise is not None else [])]])
        if isinstance(e, A.Call):
            if e.name in ("COUNT", *RANKS):
                return "INT"
            if e.name == "AVG":
                return "FLOAT"
            if e.name in S.SIGNATURES and S.SIGNATURES[e.name][2]:
                return S.SIGNATURES[e.name][2]
            if e.name in ("SUM", "MIN", "MAX") or e.name in S.SIGNATURES:
                kinds = [self.kind(a, scope) for a in e.args if not isinstance(a, A.Star)]
                return widest(kinds[:1] if e.name in ("NULLIF", "ROUND") else kinds)
            return ""
        if isinstance(e, A.Subquery):
            if id(e.query) not in self.kinds:
                self.query(e.query, scope.ctes or {}, scope)
            return self.kinds[id(e.query)][0]
        return "BOOL"

    # -- expressions -------------------------------------------------------------------------

    def truth(self, e, scope: Scope) -> str:
        """A condition in a positive position, where NULL counts as false anyway."""
        if isinstance(e, A.Binary) and e.op in ("AND", "OR"):
            return f"({self.truth(e.left, scope)} {e.op} {self.truth(e.right, scope)})"
        found = self.by_posting(e, scope) if scope.filtering else None
        return found or self.value(e, replace(scope, filtering=False), raw=True)

    def by_posting(self, e, scope: Scope) -> str | None:
        """The text of a search that a GIN index's posting table answers, alone or ahead of the search itself."""
        arg = e.left if isinstance(e, A.Binary) and e.op in ("@@", "=") else e.arg if isinstance(e, (A.Like, A.InList)) and not e.negated else None
        path = None
        if isinstance(arg, A.Call) and arg.name == "JSON_VALUE" and len(arg.args) == 2 and isinstance(arg.args[1], A.Literal):
            arg, path = arg.args[0], arg.args[1].value
        if not isinstance(arg, A.Column):
            return None
        _, _, s, own = self.column(arg, scope)
        tokenizer, view = s.postings.get(arg.name.lower(), (None, None))
        if view is None or not own or (path is not None) != (tokenizer == "jsonb_path_ops"):
            return None
        given = [e.pattern] if isinstance(e, A.Like) else e.items if isinstance(e, A.InList) else [e.right]
        if not given or not all(isinstance(x, A.Literal) and isinstance(x.value, str) for x in given):
            return None
        if any(not c.isascii() and c.lower() != c.upper() for x in given for c in x.value):
            return None  # case is Spark's business beyond ASCII
        exact = False
        if path is not None:
            if isinstance(e, A.Like) or not re.fullmatch(r"\$(\.[A-Za-z0-9_]+|\[[0-9]+\])+", path):
                return None
            ids, exact = f"SELECT id FROM {view} WHERE token IN ({', '.join(J.quote(f'{path}={x.value}') for x in given)})", True
        else:
            wanted = []
            for x in given:
                if isinstance(e, A.Like):  # what stands between wildcards is in every match
                    runs = [] if "\\" in x.value else re.split("[%_]", x.value)
                    found = sorted({t for r in runs for t in tokens_of(r, tokenizer)}) if tokenizer == "bigram" else []
                else:
                    found = tokens_of(x.value, tokenizer)
                if not found:
                    return None
                wanted.append(found)
            exact = isinstance(e, A.Binary) and e.op == "@@" and (tokenizer == "word" and wanted[0] == [given[0].value.lower()] or tokenizer == "bigram" and len(given[0].value.lower()) == 2)
            ids = " UNION ".join(rows_with(view, w) for w in wanted)
        test = f"{tick(s.alias)}.__rowid IN ({ids})"
        return f"({test})" if exact else f"({test} AND {self.value(e, replace(scope, filtering=False), raw=True)})"

    def value(self, e, scope: Scope, raw: bool = False) -> str:
        """The text of an expression; ``raw`` lets a comparison be NULL instead of false."""
        if scope.grouped is not None and not isinstance(e, (A.Literal, Raw)) and not (isinstance(e, A.Call) and e.name in AGGREGATES):
            plain = None if has_aggregate(e) else self.value(e, replace_scope(scope, None), raw)
            if plain in scope.grouped:
                return plain
            if isinstance(e, A.Column) and self.column(e, scope)[3]:
                return f"first({plain})"
        if isinstance(e, Raw):
            return e.text
        if isinstance(e, A.Literal):
            return self.literal(e.value)
        if isinstance(e, A.Column):
            return self.column(e, scope)[0]
        if isinstance(e, A.Unary):
            if e.op == "NOT":
                return f"(NOT coalesce({self.value(e.arg, scope)}, false))"
            return f"(- {self.value(e.arg, scope)})"
        if isinstance(e, A.Binary):
            return self.binary(e, scope, raw)
        if isinstance(e, A.IsTest):
            a = self.value(e.arg, scope)
            if e.what == "NULL":
                return f"({a} IS {'NOT ' if e.negated else ''}NULL)"
            k = self.kind(e.arg, scope)
            test = f"({a} IS NOT NULL)" if k == "JSONB" else J.valid(a) if k in ("TEXT", "JSON", "") else "false"
            return f"(NOT {test})" if e.negated else test
        if isinstance(e, A.InList):
            return self.in_list(e, scope, raw)
        if isinstance(e, A.Between):
            a = self.value(e.arg, scope)
            low, high = (self.compare(op, e.arg, x, scope) for op, x in ((">=", e.low), ("<=", e.high)))
            if e.negated:
                return f"({a} IS NOT NULL AND NOT (coalesce({low}, false) AND coalesce({high}, false)))"
            return f"({low} AND {high})" if raw else f"coalesce({low} AND {high}, false)"
        if isinstance(e, A.Like):
            a, p = self.value(e.arg, scope), self.pattern(e.pattern, scope)
            if e.negated:
                return f"({a} IS NOT NULL AND {p} IS NOT NULL AND NOT {a} LIKE {p})" if not raw else f"({a} NOT LIKE {p})"
            return f"({a} LIKE {p})" if raw else f"coalesce({a} LIKE {p}, false)"
        if isinstance(e, A.Case):
            whens = [(A.Binary("=", e.subject, w) if e.subject is not None else w, t) for w, t in e.whens]
            text = " ".join(f"WHEN {self.truth(w, scope)} THEN {self.value(t, scope)}" for w, t in whens if e.subject is not None or self.kind(w, scope) in ("BOOL", ""))
            other = f" ELSE {self.value(e.otherwise, scope)}" if e.otherwise is not None else ""
            return f"(CASE {text}{other} END)" if text else self.value(e.otherwise if e.otherwise is not None else A.Literal(None), scope)
        if isinstance(e, A.Cast):
            text = S.cast(self.value(e.arg, scope), self.kind(e.arg, scope), e.type)
            a = e.arg
            if e.type in ("INT", "FLOAT") and isinstance(a, A.Call) and a.name == "JSON_VALUE":
                return J.json_value_as(self.value(a.args[0], scope), self.kind(a.args[0], scope), a.args[1].value, e.type, text)
            return text
        if isinstance(e, A.Call):
            return self.call(e, scope)
        if isinstance(e, A.Subquery):
            return f"({self.query(e.query, scope.ctes or {}, scope)})"
        if isinstance(e, A.Exists):
            return f"EXISTS ({self.query(e.query, scope.ctes or {}, scope)})"
        if isinstance(e, A.InQuery):
            return self.in_query(e, scope)
        raise SQLError(f"cannot lower {type(e).__name__}")

    @staticmethod
    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, int):
            return str(v) if abs(v) < 1 << 31 else f"{v}L"
        return f"{v!r}D" if isinstance(v, float) else J.quote(v)

    def pattern(self, p, scope: Scope) -> str:
        if not (isinstance(p, A.Literal) and isinstance(p.value, str)):
            return self.value(p, scope)
        out, at = "", 0
        while at < len(p.value):  # a backslash keeps its meaning only where Spark allows one
            c = p.value[at]
            if c == "\\" and at + 1 < len(p.value):
                at += 1
                c = p.value[at]
                c = "\\" + c if c in "%_\\" else c
            elif c == "\\":
                c = "\\\\"
            out += c
            at += 1
        return J.quote(out)

    def compare(self, op: str, left, right, scope: Scope) -> str:
        a, b = self.kind(left, scope), self.kind(right, scope)
        if "BOOL" in (a, b):
            raise SQLError("truth values cannot be compared")
        groups = {("number" if k in ("INT", "FLOAT") else "text") for k in (a, b) if k not in ("NULL", "", "JSONB")}
        if len(groups) > 1:
            raise SQLError(f"cannot compare {a} with {b}")
        return f"({self.value(left, scope)} {op} {self.value(right, scope)})"

    def binary(self, e: A.Binary, scope: Scope, raw: bool) -> str:
        if e.op in ("AND", "OR"):
            return f"(coalesce({self.value(e.left, scope)}, false) {e.op} coalesce({self.value(e.right, scope)}, false))"
        if e.op == "@@":
            tokenizer = "word"
            if isinstance(e.left, A.Column):
                _, _, s, _ = self.column(e.left, scope)
                tokenizer = s.tokenizers.get(e.left.name.lower(), "word")
            if self.kind(e.left, scope) not in ("TEXT", "JSON", ""):
                raise SQLError("@@ takes text")
            return S.match(self.value(e.left, scope), self.value(e.right, scope), tokenizer)
        if e.op == "/":
            spread = self.by_branch(e, scope)
            if spread is not None:
                return self.value(spread, scope)
        if e.op in ("+", "-", "*", "/"):
            a, b = self.value(e.left, scope), self.value(e.right, scope)
            if self.kind(e, scope) == "INT":
                return f"(CAST({a} AS BIGINT) {'div' if e.op == '/' else e.op} {b})"
            return f"({a} {e.op} {b})"
        text = self.compare(e.op, e.left, e.right, scope)
        return text if raw else f"coalesce({text}, false)"

    def by_branch(self, e: A.Binary, scope: Scope):
        """A division one side of which is INT in some cases and FLOAT in others, as a CASE of divisions: each is of
        integers if both its sides are."""
        for side, other in (("left", "right"), ("right", "left")):
            x = getattr(e, side)
            if isinstance(x, A.Call) and x.name == "COALESCE":
                x = A.Case(None, tuple((A.IsTest(a, "NULL", True), a) for a in x.args[:-1]), x.args[-1])
            if isinstance(x, A.Case) and {"INT", "FLOAT"} <= {self.kind(b, scope) for b in [*[t for _, t in x.whens], *([x.otherwise] if x.otherwise is not None else [])]}:
                divided = lambda b: replace(e, **{side: b, other: getattr(e, other)})  # noqa: B023,E731
                return replace(x, whens=tuple((w, divided(t)) for w, t in x.whens), otherwise=None if x.otherwise is None else divided(x.otherwise))
        return None

    def in_list(self, e: A.InList, scope: Scope, raw: bool) -> str:
        a = self.value(e.arg, scope)
        items = [i for i in e.items if not (isinstance(i, A.Literal) and i.value is None)]
        for i in items:
            self.compare("=", e.arg, i, scope)
        found = f"({a} IN ({', '.join(self.value(i, scope) for i in items)}))" if items else "false"
        if e.negated:
            return f"({a} IS NOT NULL AND NOT coalesce({found}, false))"
        return found if raw else f"coalesce({found}, false)"

    def in_query(self, e: A.InQuery, scope: Scope) -> str:
        """[NOT] IN as [NOT] EXISTS with an equality: NULLs on either side never match."""
        q, a = e.query, self.value(e.arg, scope)
        arg = Raw(a, self.kind(e.arg, scope))
        if isinstance(q, A.Select) and not (q.group or q.distinct or q.limit is not None or q.offset is not None or q.ctes or has_aggregate(q.items) or q.having is not None) and len(q.items) == 1 and not isinstance(q.items[0].expr, A.Star):
            same = A.Binary("=", q.items[0].expr, arg)
            inner = replace(q, items=(A.SelectItem(A.Literal(1)),), where=same if q.where is None else A.Binary("AND", q.where, same), order=())
            text = f"EXISTS ({self.query(inner, scope.ctes or {}, scope)})"
        else:
            t = f"q_{uuid.uuid4().hex[:8]}"
            try:
                df = self.spark.sql(self.query(q, scope.ctes or {}, None))
                rows, name = self.view(df), df.columns[0]
            except UnknownColumn:  # it may be one of the outer query's
                rows, name = f"(SELECT * FROM ({self.query(q, scope.ctes or {}, scope)}) AS {t}_({t}_c))", f"{t}_c"
            text = f"EXISTS (SELECT 1 FROM {rows} AS {t} WHERE {t}.{tick(name)} = {a})"
        return f"({a} IS NOT NULL AND NOT {text})" if e.negated else text

    def call(self, e: A.Call, scope: Scope) -> str:
        name = e.name
        inside = replace_scope(scope, None) if name in AGGREGATES else scope
        if name in AGGREGATES or name in RANKS:
            args = ", ".join("*" if isinstance(a, A.Star) else self.value(a, inside) for a in e.args)
            if name == "AVG":
                args = f"CAST({args} AS DOUBLE)"
            text = f"{name.lower()}({'DISTINCT ' if e.distinct else ''}{args})"
            text = f"{text} OVER ({self.window(e.over, inside, name in RANKS)})" if e.over else text
            return f"CAST({text} AS BIGINT)" if name in RANKS else text
        if name in ("JSON_VALUE", "JSON_QUERY", "JSON_EXISTS"):
            if len(e.args) != 2 or not (isinstance(e.args[1], A.Literal) and isinstance(e.args[1].value, str)):
                raise SQLError(f"{name} takes a document and a literal path")
            lowered = {"JSON_VALUE": J.json_value, "JSON_QUERY": J.json_query, "JSON_EXISTS": J.json_exists}[name]
            return lowered(self.value(e.args[0], scope), self.kind(e.args[0], scope), e.args[1].value)
        args, kinds = [self.value(a, scope) for a in e.args], [self.kind(a, scope) for a in e.args]
        if name in S.SIGNATURES:
            least, most, _ = S.SIGNATURES[name]
            if not least <= len(args) <= most:
                raise SQLError(f"{name} takes {least} to {most} arguments")
            return S.call(name, args, kinds)
        text = f"{name.lower()}({'DISTINCT ' if e.distinct else ''}{', '.join(args)})"  # any other function of Spark
        return f"{text} OVER ({self.window(e.over, inside, True)})" if e.over else text

    def window(self, w: A.WindowSpec, scope: Scope, ordered: bool) -> str:
        if w.name is not None:
            if w.name not in scope.windows:
                raise SQLError(f"unknown window {w.name}")
            w = scope.windows[w.name]
        parts = []
        if w.partition:
            parts.append("PARTITION BY " + ", ".join(self.value(p, scope) for p in w.partition))
        if w.order:
            parts.append("ORDER BY " + ", ".join(f"{self.value(o.expr, scope)} {'DESC' if o.desc else 'ASC'} NULLS LAST" for o in w.order))
        elif ordered:
            parts.append("ORDER BY 1")
        return " ".join(parts)


def replace_scope(scope: Scope, grouped: set[str] | None) -> Scope:
    return Scope(scope.sources, scope.outer, scope.windows, grouped, scope.ctes, scope.filtering)
