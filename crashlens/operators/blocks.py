"""Ordered groups over many tasks: rows are dealt out by ranges of their order, and what a block needs of those before it is carried in.

A group of any size, or all rows as one, is so sorted by many tasks. Per block and group one row says what is carried on; a scan
over those, a row for each block, replaces the window over the group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlens.sources import shared


def dealt(rows: DataFrame, order: list, blocks: int | None = None) -> DataFrame:
    """Rows with _block and _at, which rise in that order (columns, or columns with a direction); as many blocks as the session has shuffle partitions, or as asked."""
    blocks = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return shared.stored(out, "dealt").withColumn("_block", F.shiftright("_at", 33))


def joined(rows: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the columns of edges of their block and group; null groups meet too."""
    here = ["_block", *by]
    right = edges.select(*(F.col(c).alias(f"_r_{c}") for c in here), *(c for c in edges.columns if c not in here))
    return rows.join(right, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in here)), "left").drop(*(f"_r_{c}" for c in here))


def nearest(rows: DataFrame, by: list[str], value: str, out: str, ahead: bool = False) -> DataFrame:
    """Adds the last value that isn't null before each row of its group, or with `ahead` the first one after it. rows: as dealt() gives them."""
    edge = F.when(F.col(value).isNotNull(), F.struct("_at", value))
    edges = rows.groupBy("_block", *by).agg((F.min(edge) if ahead else F.max(edge)).alias("_edge"))
    outer = Window.partitionBy(*by).orderBy(F.desc("_block") if ahead else F.col("_block")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("_block", *by, F.last("_edge", ignorenulls=True).over(outer)[value].alias("_carried"))
    inner = Window.partitionBy("_block", *by).orderBy(F.desc("_at") if ahead else F.col("_at")).rowsBetween(Window.unboundedPreceding, -1)
    return joined(rows.withColumn(out, F.last(value, ignorenulls=True).over(inner)), edges, by).withColumn(out, F.coalesce(out, "_carried")).drop("_carried")


def running(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of a column up to and with each row of its group. rows: as dealt() gives them."""
    edges = rows.groupBy("_block", *by).agg(F.sum(value).alias("_sum"))
    outer = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("_block", *by, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_block", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined(rows.withColumn(out, F.sum(value).over(inner)), edges, by).withColumn(out, F.col(out) + F.col("_base")).drop("_base")


def lowest(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Adds the least value up to and with each row of its group. rows: as dealt() gives them."""
    edges = rows.groupBy("_block", *by).agg(F.min(value).alias("_min"))
    outer = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("_block", *by, F.min("_min").over(outer).alias("_base"))
    inner = Window.partitionBy("_block", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined(rows.withColumn(out, F.min(value).over(inner)), edges, by).withColumn(out, F.least(out, "_base")).drop("_base")
