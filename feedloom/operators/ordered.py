"""Scans over a total order without putting a hot key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.session import durable


def range_blocks(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Cut ``df`` into blocks of near equal size that follow the order of ``keys``.

    ``block`` numbers rise with the keys. A key value that holds a third of
    the rows spreads over many blocks as long as the last key is distinct.
    The blocks are made durable, so several scans of them agree.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(
        df.repartitionByRange(partitions, *keys).withColumn("block", F.spark_partition_id())
    )


def failure_runs(log: DataFrame, key: str = "feed_uid", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Number of failures since the last success, for every row of a log.

    ``log`` has ``ok`` (boolean). Each (key, block) piece is scanned on its
    own; one summary per piece carries the running count into later pieces.
    Adds ``failures`` (0 on a success).
    """
    blocks = range_blocks(log, key, *order)
    piece = Window.partitionBy(key, "block").orderBy(*order)
    successes = F.sum(F.col("ok").cast("long")).over(piece)
    scanned = blocks.withColumn("__run", successes)
    run = Window.partitionBy(key, "block", "__run").orderBy(*order)
    scanned = scanned.withColumn("__n", F.sum((~F.col("ok")).cast("long")).over(run))

    # Of each piece: whether it has a success, and its failures after the last.
    summary = blocks.groupBy(key, "block").agg(
        F.max(F.when(F.col("ok"), F.struct(*order))).alias("__last_ok"),
        F.count(F.lit(1)).alias("__rows"),
    )
    tails = (
        blocks.join(summary, [key, "block"])
        .where(~F.col("ok") & (F.col("__last_ok").isNull() | (F.struct(*order) > F.col("__last_ok"))))
        .groupBy(key, "block").agg(F.count(F.lit(1)).alias("__tail"))
    )
    # At most one row per key and block from here on.
    pieces = summary.join(tails, [key, "block"], "left").select(
        key, "block", F.col("__last_ok").isNotNull().alias("__has_ok"), F.coalesce("__tail", F.lit(0)).alias("__tail")
    )
    up_to = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("__era", F.sum(F.col("__has_ok").cast("long")).over(up_to))
    era = Window.partitionBy(key, "__era").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("__carry_out", F.sum("__tail").over(era))
    before = Window.partitionBy(key).orderBy("block")
    pieces = pieces.withColumn("__carry", F.coalesce(F.lag("__carry_out").over(before), F.lit(0)))
    return (
        scanned.join(pieces.select(key, "block", "__carry"), [key, "block"])
        .withColumn("failures", F.col("__n") + F.when(F.col("__run") == 0, F.col("__carry")).otherwise(0))
        .select(*log.columns, "failures")
    )


def number_rows(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Adds ``row_number`` (from 1) in the order of ``keys``, block by block."""
    blocks = range_blocks(df, *keys)
    # One row per block: how many rows lie before it.
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("block").orderBy(*keys))
    return (
        blocks.withColumn("__within", within)
        .join(sizes, "block")
        .select(*df.columns, (F.col("__before") + F.col("__within")).alias("row_number"))
    )
