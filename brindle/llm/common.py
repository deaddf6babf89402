"""Shared pieces of the training-data operators: work folder, saved tables, text columns."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20  # of an Arrow batch
#: ASCII white space, as the contracts name it: \x20 and \x09-\x0D.
SPACE = b" \t\n\x0b\x0c\r"


def work_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or (local runs only) a folder of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", "file://" + shared)
        spark.sparkContext.setCheckpointDir("file://" + shared)
    bounded_batches(spark)
    return spark.conf.get("spark.checkpoint.dir")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES in this session, on both sides of the pipe to a Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def save(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    for key, value in ({"compression": "zstd"} | options).items():
        writer = writer.option(key, value)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables of save() that nothing reads any more: what was made from them is written, too."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def worker_threads() -> None:
    """Native libraries in a Python worker keep to one thread; Spark owns the cores."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")


def release_memory() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
