"""What is still to do: pending bugs, bugs by how they can be used, defaults for what isn't known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sanitizers whose bugs can be transplanted.
SANITIZERS = ("address", "undefined")


def pending(bugs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Bugs without a row in done (JOI-07). A null key is never done."""
    return bugs.join(done.select(*keys).distinct(), keys, "left_anti")


def with_default(rows: DataFrame, known: DataFrame, keys: list[str], column: str, default: str = "-") -> DataFrame:
    """Rows with a column of another frame, as text, and a default where that has no row or null (JOI-17, AGG-10). known has a row per key."""
    return rows.join(known.select(*keys, F.col(column).cast("string").alias(column)), keys, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def numeric_id(id_: Column) -> list[Column]:
    """Columns that order ids like OSV-2020-7 by their numbers, others behind them by name (WIN-09)."""
    part = lambda i: F.nullif(F.regexp_extract(id_, r"^OSV-(\d+)-(\d+)$", i), F.lit("")).try_cast("long").asc_nulls_last()
    return [part(1), part(2), id_.asc_nulls_last()]


def categorised(bugs: DataFrame, local: DataFrame) -> DataFrame:
    """bug_id, category: local, diff or testcase_only; bugs that can't be used are left out (DOM-07).

    bugs: bug_id, diff_bytes, testcase_bytes, impossible, fuzz_target, sanitizer; local: bug_id of those that need no transplant, which
    count whatever else they have. Others need a diff or a testcase that isn't empty, a fuzz target, one of SANITIZERS by the
    first word (none means address), and no mark of being impossible.
    """
    own = local.select("bug_id").distinct().withColumn("_local", F.lit(True))
    tool = F.split_part(F.coalesce("sanitizer", F.lit("address")), F.lit(" "), F.lit(1))
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    fit = ~F.coalesce("impossible", F.lit(False)) & (F.coalesce("fuzz_target", F.lit("")) != "") & tool.isin(*SANITIZERS)
    category = F.when(F.col("_local"), "local").when(fit & some("diff_bytes"), "diff").when(fit & some("testcase_bytes"), "testcase_only")
    return bugs.join(own, "bug_id", "left").select("bug_id", category.alias("category")).where("category is not null")
