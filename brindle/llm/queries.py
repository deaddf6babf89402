"""The training-data queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP2_SQL, op2_snapshot_collapse
from .gif import op4_gif_media
from .licenses import OP6_SQL, op6_minhash_licenses
from .mixing import op9_soft_mixing
from .quality import op8_crf_lines
from .sharding import op1_rendezvous_sharding
from .simhash import op5_vantage_simhash
from .suffix import op3_suffix_dedup
from .tokens import op7_tree_bpe, op10_ranked_varbyte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_rendezvous_sharding, op2_snapshot_collapse, op3_suffix_dedup, op4_gif_media, op5_vantage_simhash,
        op6_minhash_licenses, op7_tree_bpe, op8_crf_lines, op9_soft_mixing, op10_ranked_varbyte,
    )
}

SQL: dict[str, str] = {"op2_snapshot_collapse": OP2_SQL, "op6_minhash_licenses": OP6_SQL}
