"""Lines of text files with their numbers, for files of any size.

Spark reads a file in blocks. The lines of each block are counted, a prefix scan over a file's blocks gives the number at which a
block begins, and a line's number is that plus its place in the block. Lines aren't shuffled while the table of blocks is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlens.sources import shared

#: Blocks up to which their table is broadcast, some 150 bytes each; beyond it lines are joined by block.
BROADCAST_BLOCKS = 500_000


def _read(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    """Lines with their file, block, and a number that rises by one within a block."""
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    rows = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_block_length").alias("_length"))
    return rows.withColumn("_id", F.monotonically_increasing_id())


def numbered(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """file, pos (from 1) and value of every line of the text files below a path.

    A compressed file is one block. Empty files have no lines. Files mustn't change meanwhile: a block that wasn't counted, or
    has other lines than were counted, raises an error.
    """
    counted = _read(spark, path, glob).groupBy("file", "_block", "_length").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    blocks = shared.stored(counted, "blocks")  # a row for each block
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    bases = F.broadcast(bases) if blocks.count() <= BROADCAST_BLOCKS else bases
    place = F.col("_id") - F.col("_first")
    moved = F.raise_error(F.concat(F.lit("lines were read in other blocks than counted: "), F.col("file"))).cast("long")
    pos = F.when((place >= 0) & (place < F.col("_n")), F.col("_base") + place + 1).otherwise(moved)
    return _read(spark, path, glob).join(bases, ["file", "_block", "_length"], "left").select("file", pos.alias("pos"), "value")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Columns of one CSV file as strings, by the names in its header, and row, a line's number from 1 below the header. A quoted value keeps to its line."""
    from pyspark.sql import types as T

    names = spark.read.csv(path, header=True).columns
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    lines = numbered(spark, path).where("pos > 1 and trim(value) <> ''")
    parsed = lines.select((F.col("pos") - 1).alias("row"), F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")).alias("c"))
    return parsed.select("row", *(F.col(f"c._{i}").alias(n) for i, n in enumerate(names)))
