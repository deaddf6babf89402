"""Chat formatting: logged snapshots of growing conversations collapse to the longest ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, partitions, save

RANGE_TURNS = 200_000  # turns aimed at in one range of the prefix sums
PART_TURNS = 64  # turns rendered into one output row
SUMS = ["a1", "a2", "b1", "b2"]
PREFIX = ["n", *SUMS]


def ordered_turns(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The distinct turns in ranges of (conv_id, turn, role, text): ``chunk`` is the range, ``at`` ascends inside it.

    Ranges are of rows, not of turn numbers: a conversation that has all turns, or one whose turns all have one number
    or none, is many ranges.
    """
    rows = (
        turns.where(F.col("conv_id").isNotNull())
        .select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .distinct()
    )
    rows = save(spark, rows, "turns")
    ranges = max(partitions(spark), -(-rows.count() // RANGE_TURNS))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("at"))
    out = save(spark, placed.withColumn("chunk", F.shiftright("at", 33)), "ordered-turns")
    forget(spark, rows)
    return out


def turn_prefixes(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, the rolling hash PREFIX of the conversation up to each turn, whether it is the last), and per (conv_id,
    chunk) ``first`` and ``n_0``: turn ``at`` is number at - first + n_0 + 1 of its conversation.

    The hash of a prefix is the sum of its turns' hashes (two xxhash64, each in 32-bit halves), a turn's hash covering
    its number, role and text. Sums run inside the ranges and are then shifted by the ranges before, so a huge
    conversation is many tasks; no text goes along.
    """
    half = F.lit(0xFFFFFFFF).cast("long")
    hashed = rows.select("conv_id", "chunk", "at", F.xxhash64("turn", "role", "text").alias("a"), F.xxhash64("text", "role", "turn", F.lit(1)).alias("b")).select(
        "conv_id", "chunk", "at", F.col("a").bitwiseAND(half).alias("a1"), F.shiftrightunsigned("a", 32).alias("a2"), F.col("b").bitwiseAND(half).alias("b1"), F.shiftrightunsigned("b", 32).alias("b2"),
    )
    running = Window.partitionBy("conv_id", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = hashed.select("conv_id", "chunk", "at", F.count(F.lit(1)).over(running).alias("n"), *[F.sum(c).over(running).alias(c) for c in SUMS])
    chunks = hashed.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), *[F.sum(c).alias(c) for c in SUMS])
    order = Window.partitionBy("conv_id").orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    shift = chunks.select("conv_id", "chunk", "first", F.col("n").alias("size"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in PREFIX], F.lead("chunk").over(order).isNull().alias("conv_end"))
    shift = save(spark, shift, "turn-ranges")
    prefixes = local.join(shift, ["conv_id", "chunk"]).select("conv_id", *[(F.col(c) + F.col(f"{c}_0")).alias(c) for c in PREFIX], (F.col("conv_end") & (F.col("n") == F.col("size"))).alias("last"))
    return prefixes, shift


def collapse_conversations(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered: conv_id, part, n_turns, copies, rendered.

    A conversation that equals the first turns (number, role, text) of a longer one is dropped;
    of equal conversations the smallest conv_id stays and ``copies`` counts them. A turn renders
    as ``<|role|>\\ntext\\n<|end|>\\n``; row ``part`` holds turns 64*part+1 to 64*part+64, so that
    a row is bounded; concatenating parts in order gives the whole text.
    Cases: rows with a null conv_id belong to no conversation and go; a null turn sorts first;
    null role or text counts as empty; repeated rows count once; several rows with one turn
    number are ordered by role, then text; other columns are ignored; empty in, empty out.
    """
    rows = ordered_turns(spark, turns)
    prefixes, shift = turn_prefixes(spark, rows)
    prefixes = save(spark, prefixes, "turn-prefixes")
    classes = prefixes.where("last").groupBy(*PREFIX).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    proper = prefixes.where(~F.col("last")).select(*PREFIX).distinct()
    kept = classes.join(proper, PREFIX, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")
    placed = save(spark, shift.select("conv_id", "chunk", "first", "n_0").join(kept, "conv_id"), "kept-conversations")
    forget(spark, prefixes, shift)
    segment = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    return (
        rows.join(placed, ["conv_id", "chunk"])
        .withColumn("n", F.col("at") - F.col("first") + F.col("n_0") + 1)
        .select("conv_id", "n", "n_turns", "copies", F.floor((F.col("n") - 1) / PART_TURNS).alias("part"), segment.alias("segment"))
        .groupBy("conv_id", "part", "n_turns", "copies")
        .agg(F.array_sort(F.collect_list(F.struct("n", "segment"))).alias("s"))
        .select("conv_id", "part", "n_turns", "copies", F.concat_ws("", F.col("s.segment")).alias("rendered"))
    )


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_conversations(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP2_SQL = r"""
WITH turns AS (SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
               FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM turns),
whole AS (SELECT conv_id, count(*) AS n_turns, list({'turn': turn, 'role': role, 'text': text} ORDER BY n) AS l FROM numbered GROUP BY conv_id),
classes AS (SELECT l, n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM whole GROUP BY l, n_turns),
kept AS (SELECT * FROM classes c WHERE NOT EXISTS (
           SELECT 1 FROM whole w WHERE w.n_turns > c.n_turns AND w.l[1] = c.l[1] AND w.l[1:c.n_turns] = c.l))
SELECT k.conv_id, (n - 1) // 64 AS part, k.n_turns, k.copies,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY n) AS rendered
FROM kept k JOIN numbered t ON t.conv_id = k.conv_id GROUP BY ALL
"""
