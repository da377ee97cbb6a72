"""Bugs by location, fingerprint and crash state; crashes with known keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.functions import frames, text

LOCATION = ("crash_file", "crash_line", "crash_function")


def by_location(bugs: DataFrame, id_: str = "bug_id") -> tuple[DataFrame, DataFrame]:
    """Groups (crash_file, crash_line, crash_function, bugs, n) and, apart from them, the ids without any of the three (AGG-08).

    An empty file or function counts as none.
    """
    rows = bugs.select(id_, F.coalesce("crash_file", F.lit("")).alias("crash_file"), "crash_line", F.coalesce("crash_function", F.lit("")).alias("crash_function"))
    opaque = (F.col("crash_file") == "") & F.col("crash_line").isNull() & (F.col("crash_function") == "")
    groups = rows.where(~opaque).groupBy(*LOCATION).agg(F.array_sort(F.collect_list(id_)).alias("bugs")).withColumn("n", F.size("bugs"))
    return groups, rows.where(opaque).select(id_)


def by_fingerprint(bugs: DataFrame, depth: int = 3, with_line: bool = False, id_: str = "bug_id") -> DataFrame:
    """fingerprint, bugs, n of bugs (id, frames) whose top frames are the same; those without frames are in no group (AGG-08)."""
    rows = bugs.select(id_, frames.fingerprint(F.col("frames"), depth, with_line).alias("fingerprint")).where("size(fingerprint) > 0")
    return rows.groupBy("fingerprint").agg(F.array_sort(F.collect_list(id_)).alias("bugs")).withColumn("n", F.size("bugs"))


def largest_first(groups: DataFrame, *ties: str) -> DataFrame:
    """Groups by size, ties by the given columns (AGG-08)."""
    return groups.orderBy(F.desc("n"), *ties)


def state_index(bugs: DataFrame, id_: str = "bug_id") -> DataFrame:
    """state, the project's top three functions, and the bugs that have it (MAP-02). bugs: id, frames; no frames, no state."""
    rows = bugs.select(id_, frames.project_top3(F.col("frames")).alias("state")).where("size(state) > 0")
    return rows.groupBy("state").agg(F.array_sort(F.collect_set(id_)).alias("bugs"))


def with_state(crashes: DataFrame, index: DataFrame, state: str = "crash_state") -> DataFrame:
    """Crashes with the bugs of their crash state's top three functions; null where the index has none (MAP-02)."""
    return crashes.withColumn("state", text.state_top3(F.col(state))).join(index, "state", "left").drop("state")


def known(crashes: DataFrame, keys: DataFrame) -> DataFrame:
    """Crashes (fuzzer, crash_key) whose fuzzer and normal key are in keys (fuzzer, key) (JOI-06)."""
    return crashes.withColumn("key", text.normal_key(F.col("crash_key"))).join(keys, ["fuzzer", "key"], "left_semi").select(*crashes.columns)
