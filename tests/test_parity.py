"""Every statement of the catalogue against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from brindle.operators import catalogue
from brindle.sources.files import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def both(spark):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    return catalogue.engine_for(spark, FOLDER), c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_statement(spark, both, name):
    engine, c = both
    df = engine.sql(catalogue.STATEMENTS[name][0]) if name in catalogue.STATEMENTS else catalogue.run_script(spark, FOLDER, name)
    want = c.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
