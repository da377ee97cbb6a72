"""JSON arrays that are appended to, and read again whatever state they are in.

A file may hold several arrays in a row, records with commas but no brackets, or a record that was cut off. Its lines are numbered,
cut into quotes, escapes, braces and what is between, and sums over these, carried from block to block, tell what is inside a
string and how deep in braces. A file of any size is so read by many tasks; only one record has to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.operators import blocks, sequences
from crashlens.sources import numbered, shared

#: Java pattern of a file's tokens: an escape, a quote or brace, each with the text up to the next one; or the text before the first.
TOKEN = r'((?:\\[\s\S]|["{}\\])[^"{}\\]*|[^"{}\\]+)'


def append(rows: DataFrame, folder: str, batch: int, order: list) -> None:
    """Appends rows to an array as JSON records in that order (SNK-06): the part of a batch. A batch that is run again replaces its part.

    Files of a part are written by tasks that commit whole ones, so that a task that is tried again leaves no record twice.
    """
    text = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.concat(F.to_json(F.struct(*rows.columns)), F.lit(",")).alias("value"))
    text.write.mode("overwrite").text(f"{folder.rstrip('/')}/part={batch:09d}")


def repaired(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, record (from 1) and text of every whole JSON object on the outer level of the files below a path (SNK-06).

    Outer brackets, commas and anything else between records go. A record that isn't closed in its file, or that can't be read, is
    left out but keeps its number; a closing brace too many counts for nothing. Braces and quotes in strings are text.
    """
    lines = numbered.numbered(spark, path)
    tokens = lines.select("file", "pos", F.posexplode(F.regexp_extract_all(F.concat("value", F.lit("\n")), F.lit(TOKEN), 1)).alias("i", "token"))
    by, first = ["file"], F.left("token", F.lit(1))
    rows = blocks.dealt(tokens.withColumn("_quote", (first == '"').cast("int")), ["file", "pos", "i"])
    # each sum reads its rows twice, so they are written in between
    rows = blocks.running(rows, by, "_quote", "_quotes")
    step = F.when(F.col("_quotes") % 2 == 1, 0).when(first == "{", 1).when(first == "}", -1).otherwise(0)
    rows = shared.stored(blocks.running(shared.stored(rows.select(*by, "token", "_at", "_block", step.alias("_step")), "steps"), by, "_step", "_level"), "levels")
    rows = blocks.lowest(rows, by, "_level", "_low").withColumn("_level", F.col("_level") - F.least("_low", F.lit(0))).drop("_low")
    rows = shared.stored(rows.withColumn("_open", ((F.col("_step") == 1) & (F.col("_level") == 1)).cast("int")), "opened")
    rows = shared.stored(blocks.running(rows, by, "_open", "record").where("record > 0").select(*by, "record", "token", "_at", "_level"), "inside")
    # a record ends where the level first is 0 again; what follows up to the next one is between records
    ends = rows.where("_level = 0").groupBy("file", "record").agg(F.min("_at").alias("_end"))
    inside = rows.join(ends, ["file", "record"]).where("_at <= _end").groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("_at", F.when(F.col("_at") == F.col("_end"), "}").otherwise(F.col("token")).alias("token")))).alias("x"))
    whole = inside.select("file", "record", F.array_join(F.transform("x", lambda t: t["token"]), "").alias("text"))
    return whole.where(F.try_parse_json("text").isNotNull())


def located(records: DataFrame) -> DataFrame:
    """The first record of each kind, spelling and place, in order of file and record (SNK-06). records: as repaired() gives them.

    A field that is missing counts as empty, a number as 0. Files are in the order of their paths: parts by batch.
    """
    parsed = records.withColumn("_j", F.from_json("text", "kind string, spelling string, location struct<file: string, line: long, column: long>"))
    words = {"kind": F.col("_j.kind"), "spelling": F.col("_j.spelling"), "source": F.col("_j.location.file")}
    numbers = {"line": F.col("_j.location.line"), "column": F.col("_j.location.column")}
    keyed = parsed.select("file", "record", "text", *(F.coalesce(c, F.lit("")).alias(n) for n, c in words.items()), *(F.coalesce(c, F.lit(0)).alias(n) for n, c in numbers.items()))
    return sequences.first_wins(keyed, [*words, *numbers], ["file", "record"])
