"""Databases and tables. A managed table is a row of Parquet versions; a statement that changes it
writes the next version, checks the constraints on it and only then points the table at it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dialect import ast as A
from ..plans.lower import SQLError
from .postings import build, read

SPARK_TYPES = {"INT": T.LongType(), "FLOAT": T.DoubleType(), "TEXT": T.StringType(), "JSON": T.StringType(), "JSONB": T.VariantType()}
ROWID = "__rowid"
KEPT_VERSIONS = 3  # of a table: results that were not read yet may stand on the last ones
MOST_PARTS = 8  # of a posting table: with more of them it is built anew


@dataclass
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool
    method: str
    tokenizer: str | None
    view: str | None = None  # the posting table of a GIN index
    parts: list[str] = field(default_factory=list)  # the folders of that: rows that came later have one of their own


@dataclass
class Table:
    name: str
    view: str
    columns: list[A.ColumnDef] = field(default_factory=list)
    managed: bool = False
    keys: list[tuple[str, ...]] = field(default_factory=list)  # unique column sets, primary first
    primary: tuple[str, ...] = ()
    indexes: dict[str, Index] = field(default_factory=dict)
    version: int = 0
    load: Callable[[], DataFrame] | None = None
    versions: list[list[str]] = field(default_factory=list)  # the folders of each that is still there, its own first, oldest first
    top: int = 0  # the largest row id ever given: ids that deleted rows leave in postings must not come again

    def column(self, name: str) -> A.ColumnDef:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise SQLError(f"unknown column {name} in {self.name}")

    def tokenizers(self) -> dict[str, str]:
        return {i.columns[0].lower(): i.tokenizer or "word" for i in self.indexes.values() if i.method == "GIN"}

    def postings(self) -> dict[str, tuple[str, str]]:
        """(tokenizer, view of the posting table) by column."""
        return {i.columns[0].lower(): (i.tokenizer or "word", i.view) for i in self.indexes.values() if i.view}

    def schema(self) -> T.StructType:
        fields = [T.StructField(c.name, SPARK_TYPES[c.type], True, {"dialect_type": c.type} if c.type == "JSON" else {}) for c in self.columns]
        return T.StructType([*fields, T.StructField(ROWID, T.LongType(), True)])


class Catalog:
    def __init__(self, spark: SparkSession, warehouse: str | None = None):
        self.spark = spark
        self._root = warehouse or spark.conf.get("spark.checkpoint.dir", None)
        self.databases: dict[str, dict[str, Table]] = {"default": {}}
        self.current = "default"

    @property
    def root(self) -> str:
        """The folder of managed tables, one that all machines share: only a local run may have one of its own."""
        if not self._root:
            if not self.spark.sparkContext.master.startswith("local["):
                raise SQLError("set spark.checkpoint.dir, or the engine's warehouse, to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="brindle-tables-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            self._root = "file://" + folder
        return self._root

    def discard(self, table: Table, keep: int = 0) -> None:
        """Remove a table's versions but the newest ``keep``; postings stay while one of these has them."""
        old = max(0, len(table.versions) - keep)
        kept = {path for version in table.versions[old:] for path in version}
        for path in dict.fromkeys(path for version in table.versions[:old] for path in version if path not in kept):
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path).getParent()  # of this alone
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        del table.versions[:old]

    def folder(self, table: Table, version: str) -> str:
        return f"{self.root.rstrip('/')}/brindle-{table.name}-{uuid.uuid4().hex}/{version}"

    def database(self, name: str | None) -> dict[str, Table]:
        key = (name or self.current).lower()
        if key not in self.databases:
            raise SQLError(f"unknown database {name}")
        return self.databases[key]

    def table(self, database: str | None, name: str) -> Table:
        found = self.database(database).get(name.lower())
        if found is None:
            raise SQLError(f"unknown table {name}")
        if found.load is not None:
            found.load().createOrReplaceTempView(found.view)
            found.load = None
        return found

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        """A read-only table over any DataFrame, or over what a function returns once the table is used."""
        table = Table(name, f"brindle_t_{uuid.uuid4().hex}")
        if callable(df):
            table.load = df
        else:
            df.createOrReplaceTempView(table.view)
        self.database(None)[name.lower()] = table

    def create(self, database: str | None, table: Table) -> None:
        tables = self.database(database)
        if table.name.lower() in tables:
            raise SQLError(f"table {table.name} is there already")
        seen: set[str] = set()
        for c in table.columns:
            if c.name.lower() in seen:
                raise SQLError(f"column {c.name} is there twice")
            seen.add(c.name.lower())
        self.publish(table, self.spark.createDataFrame([], table.schema()))
        tables[table.name.lower()] = table

    def rows(self, table: Table) -> DataFrame:
        return self.spark.table(table.view)

    def publish(self, table: Table, rows: DataFrame, changed: set[str] | None = None, since: int | None = None) -> None:
        """Write rows as the next version, check it, point the table at it. Postings of a column that is not among the
        ``changed`` ones (None: all are) stay; those of rows with ids above ``since`` (None: there are none) are added.
        Ids of rows that are gone find no row."""
        version = f"v{table.version + 1}"
        path = self.folder(table, version)
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema()]).write.parquet(path)
        df = self.spark.read.schema(table.schema()).parquet(path)
        df = df.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) if f.metadata else F.col(f"`{f.name}`") for f in table.schema()])
        try:
            self.check(table, df)
        except SQLError:
            self.discard(Table(table.name, table.view, versions=[[path]]))
            raise
        parts = {}
        for name, i in table.indexes.items():
            if i.method == "GIN":
                kept = changed is not None and i.columns[0].lower() not in changed and len(i.parts) + (since is not None) <= MOST_PARTS
                parts[name] = list(i.parts) if kept else []
                if not kept or since is not None:
                    parts[name].append(self.folder(table, f"{version}-{name}"))
                    build(df.where(F.col(ROWID) > since) if kept else df, i.columns[0], i.tokenizer or "word", ROWID, parts[name][-1])
        table.top = max(table.top, df.agg(F.max(ROWID).alias("m")).first()["m"] or 0)
        df.createOrReplaceTempView(table.view)
        for name, folders in parts.items():
            self.show(table.indexes[name], folders)
        table.version += 1
        table.versions.append([path, *(folder for folders in parts.values() for folder in folders)])
        self.discard(table, KEPT_VERSIONS)

    def show(self, index: Index, parts: list[str]) -> None:
        index.parts = parts
        index.view = index.view or f"brindle_p_{uuid.uuid4().hex}"
        read(self.spark, index.tokenizer or "word", parts).createOrReplaceTempView(index.view)

    def add_index(self, table: Table, index: Index) -> None:
        """Put an index on a table; a GIN index of a managed one gets its posting table."""
        if table.managed and index.method == "GIN":
            part = self.folder(table, f"v{table.version}-{index.name}")
            build(self.rows(table), index.columns[0], index.tokenizer or "word", ROWID, part)
            self.show(index, [part])
            table.versions[-1].append(part)
        table.indexes[index.name] = index

    def check(self, table: Table, df: DataFrame) -> None:
        for c in table.columns:
            if c.not_null and not df.where(F.col(f"`{c.name}`").isNull()).isEmpty():
                raise SQLError(f"column {c.name} is NOT NULL")
        for key in table.keys:
            cols = [F.col(f"`{k}`") for k in key]
            some = cols[0].isNotNull()
            for c in cols[1:]:
                some = some | c.isNotNull()
            if not df.where(some).groupBy(*cols).count().where("count > 1").isEmpty():
                raise SQLError(f"duplicate value for {', '.join(key)}")
