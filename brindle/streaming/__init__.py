"""Queries of the dialect over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import Engine


def stream_query(spark: SparkSession, sql: str, **streams: DataFrame) -> DataFrame:
    """A SELECT over streaming DataFrames by table name: filters, projections, joins with static
    tables and aggregates lower to the same plans, so Structured Streaming runs them as they are."""
    engine = Engine(spark)
    for name, df in streams.items():
        engine.register(name, df)
    return engine.sql(sql)
