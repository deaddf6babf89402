"""A Spark-native SQL, JSON and full-text engine."""

from .session import Engine

__all__ = ["Engine"]
