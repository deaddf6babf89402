"""Scalar functions of the dialect, as Spark SQL text."""
