"""Engine: statements of the dialect in, DataFrames out."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .catalog.catalog import ROWID, SPARK_TYPES, Catalog, Index, Table
from .dialect import ast as A
from .dialect.parser import parse
from .functions import scalar as S
from .plans.explain import COLUMNS, steps
from .plans.lower import Lowering, Scope, Source, SQLError, tick
from .sources.files import StatementLog

CHANGES = (A.Insert, A.Update, A.Delete, A.CreateTable, A.CreateIndex, A.AlterTable)


class Engine:
    """``sql(text)`` runs one statement. ``log`` appends every change that succeeded; ``replay()`` runs it again."""

    def __init__(self, spark: SparkSession, warehouse: str | None = None, log: str | None = None):
        self.spark = spark
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "1000")
        self.catalog = Catalog(spark, warehouse)
        self.log = StatementLog(log) if log else None

    @property
    def current_database(self) -> str:
        return self.catalog.current

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> Engine:
        self.catalog.register(name, df)
        return self

    def sql(self, text: str) -> DataFrame:
        statement = parse(text)
        out = self.run(statement)
        changed = isinstance(statement, CHANGES) or isinstance(statement, A.Simple) and not statement.action.startswith("show")
        if self.log and changed:
            self.log.append(text)
        return out

    def replay(self) -> int:
        found = self.log.statements() if self.log else []
        for text in found:
            self.run(parse(text))
        return len(found)

    def run(self, statement) -> DataFrame:
        if isinstance(statement, (A.Select, A.SetOp)):
            return self.lowered(lambda low: low.frame(statement))
        if isinstance(statement, A.Explain):
            rows, inner = steps(statement.statement, self.find), statement.statement
            plan = ""
            if isinstance(inner, (A.Select, A.SetOp)):
                plan = self.run(inner)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return self.spark.createDataFrame([(*r, plan if not i else "") for i, r in enumerate(rows)], COLUMNS)
        handler = {
            A.Insert: self.insert, A.Update: self.update, A.Delete: self.delete, A.CreateTable: self.create_table,
            A.CreateIndex: self.create_index, A.AlterTable: self.alter, A.Simple: self.simple,
        }[type(statement)]
        return handler(statement)

    def find(self, ref: A.TableRef) -> Table | None:
        return self.catalog.database(ref.database).get(ref.name.lower())

    def lowered(self, work):
        def resolve(database: str | None, name: str):
            t = self.catalog.table(database, name)
            return t.view, t.tokenizers(), t.postings()

        low = Lowering(self.spark, resolve, lambda: self.catalog.root)
        try:
            return work(low)
        finally:
            low.close()

    def message(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "message string")

    # -- definitions

    def create_table(self, s: A.CreateTable) -> DataFrame:
        primary = tuple(c.name for c in s.columns if c.primary)
        if len(primary) > 1 or primary and s.primary:
            raise SQLError("more than one primary key")
        primary = primary or s.primary
        columns = [replace(c, not_null=c.not_null or c.name.lower() in {p.lower() for p in primary}) for c in s.columns]
        table = Table(s.table.name, f"brindle_t_{uuid.uuid4().hex}", columns, True, [], primary)
        for p in primary:
            table.column(p)
        table.keys = ([primary] if primary else []) + [(c.name,) for c in columns if c.unique]
        for c in columns:
            if c.has_default:
                if c.not_null and c.default == A.Literal(None):
                    raise SQLError(f"column {c.name} is NOT NULL and defaults to NULL")
                self.lowered(lambda low, c=c: self.fit(low, c.default, c, Scope([], None, {})))
        self.catalog.create(s.table.database, table)
        return self.message("table created")

    def create_index(self, s: A.CreateIndex) -> DataFrame:
        t = self.catalog.table(s.table.database, s.table.name)
        if s.name in t.indexes:
            raise SQLError(f"index {s.name} is there already")
        tokenizer = s.tokenizer
        if t.columns:
            kinds = [t.column(c).type for c in s.columns]
        else:
            kinds = ["TEXT"] * len(s.columns)
        if s.method == "GIN":
            if len(s.columns) != 1 or kinds[0] not in ("TEXT", "JSONB"):
                raise SQLError("a GIN index takes one TEXT or JSONB column")
            tokenizer = tokenizer or ("word" if kinds[0] == "TEXT" else "jsonb_path_ops")
        if s.unique:
            t.keys.append(s.columns)
            try:
                self.catalog.check(t, self.catalog.rows(t))
            except SQLError:
                t.keys.pop()
                raise
        self.catalog.add_index(t, Index(s.name, s.columns, s.unique, s.method, tokenizer))
        return self.message("index created")

    def alter(self, s: A.AlterTable) -> DataFrame:
        t = self.managed(s.table)
        rows = self.catalog.rows(t)
        if s.add is not None:
            if s.add.primary:
                raise SQLError("a primary key cannot be added")
            if any(c.name.lower() == s.add.name.lower() for c in t.columns):
                raise SQLError(f"column {s.add.name} is there already")
            value = s.add.default if s.add.has_default else A.Literal(None)
            text = self.lowered(lambda low: self.fit(low, value, s.add, Scope([], None, {})))
            new = replace_table(t, [*t.columns, s.add], t.keys + ([(s.add.name,)] if s.add.unique else []))
            rows = rows.withColumn(s.add.name, F.expr(text))
        else:
            gone = t.column(s.drop)
            if gone.name.lower() in {p.lower() for p in t.primary}:
                raise SQLError("a primary key cannot be dropped")
            if len(t.columns) == 1:
                raise SQLError("the last column cannot be dropped")
            new = replace_table(t, [c for c in t.columns if c is not gone], [k for k in t.keys if gone.name.lower() not in {x.lower() for x in k}])
            new.indexes = {n: i for n, i in t.indexes.items() if gone.name.lower() not in {c.lower() for c in i.columns}}
        self.catalog.publish(new, rows, set())
        self.catalog.database(s.table.database)[t.name.lower()] = new
        return self.message("table altered")

    def simple(self, s: A.Simple) -> DataFrame:
        c = self.catalog
        if s.action == "show databases":
            return self.spark.createDataFrame([(n,) for n in sorted(c.databases)], "database string")
        if s.action == "show tables":
            return self.spark.createDataFrame([(t.name,) for _, t in sorted(c.database(None).items())], "table string")
        key = s.name.lower()
        if s.action == "use":
            c.database(s.name)
            c.current = key
            return self.message(f"switched to database {s.name}")
        if s.action == "create database":
            if key in c.databases:
                raise SQLError(f"database {s.name} is there already")
            c.databases[key] = {}
            return self.message("database created")
        if s.action == "drop database":
            c.database(s.name)
            if key in ("default", c.current):
                raise SQLError(f"database {s.name} is in use")
            del c.databases[key]
            return self.message("database dropped")
        if s.action == "drop index":
            for t in c.database(None).values():
                if s.name in t.indexes:
                    index = t.indexes.pop(s.name)
                    if index.unique:
                        t.keys.remove(index.columns)
                    return self.message("index dropped")
            raise SQLError(f"unknown index {s.name}")
        t = c.table(s.database, s.name)
        if s.action == "drop table":
            del c.database(s.database)[key]
            c.discard(t)
            return self.message("table dropped")
        c.publish(t, c.rows(t).limit(0))
        return self.message("table truncated")

    # -- changes

    def managed(self, ref: A.TableRef) -> Table:
        t = self.catalog.table(ref.database, ref.name)
        if not t.managed:
            raise SQLError(f"table {ref.name} is read-only")
        return t

    def fit(self, low: Lowering, e, c: A.ColumnDef, scope: Scope) -> str:
        """The text of a value for a column, or an error if its type does not fit."""
        return self.fitted(low.value(e, scope), low.kind(e, scope), c)

    @staticmethod
    def fitted(text: str, kind: str, c: A.ColumnDef) -> str:
        allowed = {"INT": ("INT",), "FLOAT": ("FLOAT", "INT"), "TEXT": ("TEXT", "JSON"), "JSON": ("TEXT", "JSON", "JSONB"), "JSONB": ("TEXT", "JSON", "JSONB")}[c.type]
        if kind not in (*allowed, "NULL", ""):
            raise SQLError(f"column {c.name} is {c.type}, not {kind}")
        if kind == "NULL":
            return f"CAST(NULL AS {SPARK_TYPES[c.type].simpleString()})"
        return S.cast(text, kind, c.type) if c.type in ("JSON", "JSONB") else f"CAST({text} AS {SPARK_TYPES[c.type].simpleString()})"

    def insert(self, s: A.Insert) -> DataFrame:
        t = self.managed(s.table)
        names = [t.column(n).name for n in s.columns] if s.columns else [c.name for c in t.columns]
        if len({n.lower() for n in names}) != len(names):
            raise SQLError("a column is there twice")

        def build(low: Lowering) -> DataFrame:
            nothing = Scope([], None, {})
            if s.query is not None:
                given = low.frame(s.query)
                if len(given.columns) != len(names):
                    raise SQLError(f"{len(names)} columns but {len(given.columns)} values")
                from .plans.lower import kind_of

                kinds = dict(zip(names, map(kind_of, given.schema), strict=True))
                given = given.toDF(*[f"v{i}" for i in range(len(names))])
                texts = {n: (f"v{i}", kinds[n]) for i, n in enumerate(names)}
                return given.selectExpr(*[f"{self.fitted(*texts[c.name], c) if c.name in texts else self.default(low, c)} AS {tick(c.name)}" for c in t.columns])
            rows = []
            for row in s.rows:
                if len(row) != len(names):
                    raise SQLError(f"{len(names)} columns but {len(row)} values")
                value = dict(zip(names, row, strict=True))
                rows.append("SELECT " + ", ".join(f"{self.fit(low, value[c.name], c, nothing) if c.name in value else self.default(low, c)} AS {tick(c.name)}" for c in t.columns))
            return self.spark.sql(" UNION ALL ".join(rows))

        new = self.lowered(build)
        old = self.catalog.rows(t)
        self.catalog.publish(t, old.unionByName(new.withColumn(ROWID, F.monotonically_increasing_id() + t.top + 1)), set(), t.top)
        n = self.catalog.rows(t).count() - old.count() if s.query is not None else len(s.rows)
        return self.message(f"{n} row{'s' * (n != 1)} inserted")

    def default(self, low: Lowering, c: A.ColumnDef) -> str:
        return self.fit(low, c.default if c.has_default else A.Literal(None), c, Scope([], None, {}))

    def chosen(self, low: Lowering, t: Table, s) -> tuple[Scope, str]:
        """(scope of the table's rows, text that is true for the rows a statement changes)."""
        source = Source(t.name, t.view, [(c.name, c.type) for c in t.columns], t.tokenizers(), set(), {})
        scope = Scope([source], None, {}, None, {})
        where = low.truth(s.where, scope) if s.where is not None else "true"
        if s.limit is None:
            return scope, f"coalesce({where}, false)"
        keys = [f"{low.value(o.expr, scope)} {'DESC' if o.desc else 'ASC'} NULLS LAST" for o in s.order]
        some = self.spark.sql(f"SELECT {ROWID} AS id FROM {t.view} AS {tick(t.name)} WHERE {where}" + low.tail([*keys, ROWID], s.limit, None))
        return scope, f"{ROWID} IN (SELECT id FROM {low.view(some)})"

    def update(self, s: A.Update) -> DataFrame:
        t = self.managed(s.table)

        changed = Observation()

        def build(low: Lowering) -> DataFrame:
            scope, match = self.chosen(low, t, s)
            sets = {t.column(n).name: self.fit(low, e, t.column(n), scope) for n, e in s.sets}
            marked = self.spark.sql(f"SELECT *, ({match}) AS __match FROM {t.view} AS {tick(t.name)}") if s.limit is None else self.mark(low, t, match)
            view = low.view(marked.observe(changed, F.count_if("__match").alias("n")))
            cols = [f"CASE WHEN __match THEN {sets[c.name]} ELSE {tick(c.name)} END AS {tick(c.name)}" if c.name in sets else tick(c.name) for c in t.columns]
            return self.spark.sql(f"SELECT {', '.join(cols)}, {ROWID} FROM {view} AS {tick(t.name)}")

        self.catalog.publish(t, self.lowered(build), {n.lower() for n, _ in s.sets})
        return self.message(f"{changed.get['n']} rows updated")

    def mark(self, low: Lowering, t: Table, match: str) -> DataFrame:
        ids = self.spark.sql(f"SELECT {ROWID} AS __id FROM {t.view} WHERE {match}")
        rows = self.catalog.rows(t)
        return rows.join(ids, rows[ROWID] == ids["__id"], "left").withColumn("__match", F.col("__id").isNotNull()).drop("__id")

    def delete(self, s: A.Delete) -> DataFrame:
        t = self.managed(s.table)

        changed = Observation()

        def build(low: Lowering) -> DataFrame:
            _, match = self.chosen(low, t, s)
            marked = self.spark.sql(f"SELECT *, ({match}) AS __match FROM {t.view} AS {tick(t.name)}") if s.limit is None else self.mark(low, t, match)
            return marked.observe(changed, F.count_if("__match").alias("n")).where("NOT __match").drop("__match")

        self.catalog.publish(t, self.lowered(build), set())
        return self.message(f"{changed.get['n']} rows deleted")


def replace_table(t: Table, columns: list, keys: list) -> Table:
    return Table(t.name, t.view, columns, True, keys, t.primary, dict(t.indexes), t.version, versions=t.versions, top=t.top)
