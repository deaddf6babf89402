"""python -m brindle.cli [folder]: a prompt over a folder of Parquet tables; rows are tab-separated."""

from __future__ import annotations

import sys
from decimal import Decimal

from pyspark.sql import SparkSession

from .session import Engine
from .sources.files import register_folder


def shown(v) -> str:
    """A value as the prompt prints it: floats in plain digits with a point, NULL as <nil>."""
    if v is None:
        return "<nil>"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if v != v or v in (float("inf"), float("-inf")):
            return "NaN.0" if v != v else ("+Inf.0" if v > 0 else "-Inf.0")
        text = format(Decimal(repr(v)), "f")
        text = text.rstrip("0").rstrip(".") if "." in text else text
        return text if "." in text else text + ".0"
    return str(v)


def show(df) -> str:
    """A statement's message, or a header, a rule, the rows and how many they are."""
    rows = df.collect()
    if df.columns == ["message"] and len(rows) == 1:
        return rows[0][0]
    head = "\t".join(df.columns)
    lines = [head, "-" * (len(head) + 8), *("\t".join(map(shown, row)) for row in rows), f"({len(rows)} rows)"]
    return "\n".join(lines)


def main(args: list[str]) -> None:
    engine = Engine(SparkSession.builder.getOrCreate())
    if args:
        register_folder(engine, args[0])
    held = ""
    for line in sys.stdin:
        held += line
        if held.rstrip().endswith(";"):
            try:
                print(show(engine.sql(held)))
            except Exception as e:  # the prompt goes on
                print(f"Error: {e}")
            held = ""


if __name__ == "__main__":
    main(sys.argv[1:])
