"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with the best of three runs each."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from brindle.operators.catalogue import STATEMENTS, engine_for

NAMES = (
    "filter_eq", "filter_between", "filter_like_contains", "agg_group", "agg_count_distinct", "sort_topk", "distinct_col", "join_inner", "join_chain4", "join_left_residual",
    "set_union", "win_running_sum", "sub_exists", "sub_corr_compare", "json_where_cast", "fts_word", "fts_bigram", "tpch_q1_like", "tpch_q3_like",
)


def timed(spark: SparkSession, sf: str) -> dict[str, float]:
    """Seconds of the best of three runs of each headline query."""
    engine = engine_for(spark, sf)
    took: dict[str, float] = {}
    for name in NAMES:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            engine.sql(STATEMENTS[name][0]).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(min(runs), 4)
    return took


def main() -> None:
    """The queries at $BENCH_SF_DIR, and for scaling at its neighbour of a tenth of the size, if there is one."""
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    size = os.path.basename(sf).removeprefix("sf")
    tenth = f"{os.path.dirname(sf)}/sf{float(size) / 10:g}" if size.replace(".", "", 1).isdigit() else ""
    small = timed(spark, tenth) if os.path.isdir(tenth) else {}
    took = timed(spark, sf)
    scaling = {name: round(took[name] / small[name], 2) for name in small}
    print(json.dumps({"metric": "headline queries, total of best runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf), "queries_at_a_tenth": small, "times_the_tenth": scaling}))


if __name__ == "__main__":
    main()
