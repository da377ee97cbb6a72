"""Blocks of lines: what diffs add, and continued assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Headers of unified diffs, source endings, and assignments of source lists.
NEW_FILE = r"^\+\+\+ b/(.+)$"
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
C_ENDINGS = r"(?i)\.(c|cc|cpp|cxx|h|hh|hpp|hxx)$"
SOURCES = r"^\s*[\w@.-]+_SOURCES\s*(?:\+?=|:=)"


def added_blocks(diffs: DataFrame, key: str, diff: str, endings: str | None = C_ENDINGS) -> DataFrame:
    """key, file, start, count: runs of added lines, by their first line's number in the new file (SCL-27).

    Lines before a file's first hunk count for nothing; each hunk header sets the line number. A diff is one group of windows.
    """
    lines = diffs.select(key, F.posexplode(F.split(F.col(diff), r"\r?\n")).alias("pos", "line"))
    first = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    sofar = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("new_file", first(NEW_FILE)).withColumn("hunk", F.when(F.col("new_file").isNull(), first(HUNK)).try_cast("long"))
    mark = F.col("new_file").isNotNull() | F.col("hunk").isNotNull()
    lines = lines.withColumns({"file": F.last("new_file", ignorenulls=True).over(sofar), "section": F.sum(mark.cast("int")).over(sofar), "mark": mark})
    section = Window.partitionBy(key, "section").orderBy("pos")
    # lines of the new file since the header
    kept = F.sum((~F.col("mark") & ~F.startswith("line", F.lit("-"))).cast("long")).over(section.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = lines.withColumns({"begin": F.first("hunk").over(section.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "kept": kept})
    plus = lines.where(~F.col("mark") & F.col("begin").isNotNull() & F.col("file").isNotNull() & F.startswith("line", F.lit("+")))
    plus = plus.withColumn("run", F.col("pos") - F.row_number().over(section))
    blocks = plus.groupBy(key, "file", "section", "run").agg(F.min(F.col("begin") + F.col("kept") - 1).alias("start"), F.count(F.lit(1)).alias("count"))
    blocks = blocks.select(key, "file", "start", "count")
    return blocks.where(F.col("file").rlike(endings)) if endings else blocks


def continued_blocks(lines: DataFrame, key: str, pattern: str = SOURCES) -> DataFrame:
    """key, start, end: places of assignments and the lines that a backslash continues them on (SCL-28). lines: key, pos, value.

    An assignment inside another one's continuation is part of it.
    """
    order = Window.partitionBy(key).orderBy("pos")
    more = F.endswith(F.rtrim(F.regexp_replace("value", r"\s+$", "")), F.lit("\\"))
    logical = lines.withColumn("more", more).withColumn("new", (~F.coalesce(F.lag("more").over(order), F.lit(False))).cast("int"))
    logical = logical.withColumn("statement", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    begin = F.min(F.when(F.col("value").rlike(pattern), F.col("pos")))
    return logical.groupBy(key, "statement").agg(begin.alias("start"), F.max("pos").alias("end")).where("start is not null").drop("statement")
