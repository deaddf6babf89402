"""Rendezvous sharding with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, forget, partitions, save

OVERHEAD = 16  # bytes that a stored row costs besides its text
SLOT_ROWS = 100_000  # rows aimed at in one numbering range
PIECE_ROWS = 10_000  # equal rows that are written out at one place


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """Weighted rendezvous score, smallest wins: -ln(u)/w with u in (0,1) from the pair's hash."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard.cast("int")), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def rendezvous(key: Column, weights: Sequence[float], grown_weight: float | None = None) -> tuple[Column, Column]:
    """(shard, shard once one more shard of grown_weight joins). The second is the first or the new shard."""
    if not weights or any(not w >= 0 or math.isinf(w) for w in weights) or not any(weights):
        raise ValueError("weights must be finite, not negative and not all zero")
    w = F.array(*[F.lit(float(x)) for x in weights])
    ids = F.array(*[F.lit(i) for i in range(len(weights))])
    best = F.array_min(F.transform(ids, lambda i: F.struct(_score(key, i, F.element_at(w, i + 1)).alias("score"), i.alias("id"))))
    new = float(weights[-1] if grown_weight is None else grown_weight)
    last = F.struct(_score(key, F.lit(len(weights)), F.lit(new)).alias("score"), F.lit(len(weights)).alias("id"))
    return best["id"], F.least(best, last)["id"]


def shard_table(spark: SparkSession, df: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float | None = None) -> DataFrame:
    """Shard, gapless slot within the shard and shard after growth, one output row for each input row.

    Law ``key``: the key and the weights alone decide; a row moves only into an added shard.
    Cases: a null key is a key like any other (all its rows share a shard); a null text has
    size 16 and the checksum of no bytes; equal rows get neighbouring slots in no set order;
    an empty table gives an empty table; other columns of df are ignored, whatever their names.

    Plan: rows shrink to (key, size, crc), equal ones are counted before the shuffle, so a key
    with a third of all rows is one counted row. Slots come from ranges of about SLOT_ROWS rows
    in a shard: a row_number inside the range plus the range's offset, so no shard is one task.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("doc_id"), (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    counted = save(spark, rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")), "shard-rows")
    total = counted.count()
    ranges = max(8, math.ceil(total / (len(weights) * SLOT_ROWS)))
    shard, grown = rendezvous(F.col("doc_id"), weights, grown_weight)
    placed = counted.withColumn("best", F.struct(shard.alias("shard"), grown.alias("grown_shard"))).select(
        "doc_id", "size", "text_crc32", "copies", F.col("best.shard").cast("int").alias("shard"), F.col("best.grown_shard").cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(ranges)).cast("int").alias("range"),
    )
    per_range = placed.groupBy("shard", "range").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "range").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    numbered = save(spark, first.join(offsets, ["shard", "range"]).select("doc_id", "size", "text_crc32", "copies", "shard", (F.col("offset") + F.col("inside")).alias("slot"), "grown_shard"), "shard-slots")
    forget(spark, counted)
    few = numbered.where(F.col("copies") <= PIECE_ROWS)
    many = numbered.where(F.col("copies") > PIECE_ROWS)
    if not many.isEmpty():  # pieces of them go to other tasks
        piece = many.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PIECE_ROWS))))
        piece = piece.withColumn("slot", F.col("slot") + F.col("piece") * PIECE_ROWS).withColumn("copies", F.least(F.lit(PIECE_ROWS).cast("long"), F.col("copies") - F.col("piece") * PIECE_ROWS))
        few = few.unionAll(piece.repartition(partitions(spark), "shard", "slot").select(few.columns))
    return (
        few.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col("copy")).alias("slot"), "grown_shard")
    )


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 shards of equal weight."""
    return shard_table(spark, documents(spark, sf_dir), [1.0] * 40)
