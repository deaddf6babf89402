"""A training corpus from raw documents: STAGES in order, each over all rows its predecessor kept.

A stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of
``documents``. A runner writes each stage's rows as Parquet and reads them back for the next one.

Cases, for every stage: rows are judged one by one, whatever their ids; an empty table gives an empty
one; columns of any name come back as they were; long texts are whole. Null and empty texts fail the
quality rules; a stage that gets them nevertheless keeps them (the suffix stage as empty texts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.bpe import default_tokenizer_path
from brindle.llm.common import save
from brindle.llm.mixing import mixed
from brindle.llm.nearcopies import without_near_copies
from brindle.llm.quality import keep_quality, train_line_crf
from brindle.llm.suffix import without_repeats
from brindle.llm.tokens import token_digests


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or have too small a share of content lines go."""
    return keep_quality(docs, train_line_crf(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies, edited ones of a five-word Jaccard similarity of 0.8 or more included, the row with the
    smallest id stays. Rows are judged one by one: another text under the same id stays, of equal rows one does, and
    texts without words are copies of nothing."""
    return without_near_copies(spark, docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut from the text."""
    return without_repeats(spark, docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its rate says; rates make the domains' expected tokens meet the targets."""
    return mixed(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text."""
    return token_digests(docs, default_tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", mix_domains),
    ("BPE encoding and decoding", bpe_tokens),
]

#: None: line labels, links of fingerprints and BPE are beyond SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(spark, docs, f"stage-{i + 1}")
    return docs
