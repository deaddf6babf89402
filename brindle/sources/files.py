"""Parquet folders as tables, and the statement log."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from ..session import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register_folder(engine: Engine, folder: str, names: Iterable[str] = TABLES, fmt: str = "parquet", **options: str) -> Engine:
    """``folder/name.fmt`` as table ``name``; any format Spark reads."""
    for name in names:
        engine.register(name, lambda path=f"{folder}/{name}.{fmt}": engine.spark.read.format(fmt).options(**options).load(path))
    return engine


class StatementLog:
    """A file with one JSON string a line; an append is on disk when it returns."""

    def __init__(self, path: str):
        self.path = path

    def append(self, text: str) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(text) + "\n")
            f.flush()
            os.fsync(f.fileno())

    def statements(self) -> list[str]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            return [json.loads(line) for line in f if line.endswith("\n")]
