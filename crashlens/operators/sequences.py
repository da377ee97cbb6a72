"""Ordered rows: runs, prefixes, neighbours, samples, ranks, islands and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.operators import blocks as blocked


def collapse_runs(rows: DataFrame, by: list[str], order: list[str], value: str, blocks: int | None = None) -> DataFrame:
    """Rows whose value differs from the one before (WIN-02, SRC-25); positions stay.

    Without groups, and where `blocks` is given, ranges of the order are dealt to that many tasks.
    """
    if blocks or not by:
        dealt = blocked.dealt(rows.withColumn("_v", F.struct(value)), [*by, *order], blocks)
        dealt = blocked.nearest(dealt, by, "_v", "_b")
        return dealt.where(F.col("_b").isNull() | F.col(value).isNull() | ~F.col(f"_b.{value}").eqNullSafe(F.col(value))).drop("_v", "_b", "_at", "_block")
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.col(value)) | F.col("_b").isNull()).drop("_b")


def common_prefix(left: DataFrame, right: DataFrame, by: list[str], position: str, value: str, renames: DataFrame | None = None) -> DataFrame:
    """Positions before the first one at which two sequences differ (WIN-03): by the first word, `__revert_x` equals x, and two names
    of a pair in renames (old, new) equal each other. A position that only one side has ends the prefix."""
    word = lambda c: F.split_part(F.col(c), F.lit(" "), F.lit(1))
    both = left.select(*by, position, F.col(value).alias("a")).join(right.select(*by, position, F.col(value).alias("b")), [*by, position])
    same = word("a").eqNullSafe(word("b")) | (word("b") == F.concat(F.lit("__revert_"), word("a")))
    if renames is not None:
        pairs = renames.select(F.least("old", "new").alias("_x"), F.greatest("old", "new").alias("_y")).distinct().withColumn("_r", F.lit(True))
        both = both.withColumn("_x", F.least(word("a"), word("b"))).withColumn("_y", F.greatest(word("a"), word("b"))).join(pairs, ["_x", "_y"], "left")
        same = same | F.coalesce("_r", F.lit(False))
    off = (~F.coalesce(same, F.lit(False))).cast("int")
    both = both.withColumn("_off", off).drop("_x", "_y", "_r")
    off = F.col("_off")
    return both.withColumn("_m", F.sum(off).over(Window.partitionBy(*by).orderBy(position))).where("_m = 0").drop("_m", "_off")


def transplant_plan(rows: DataFrame, target: str, introduced: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """bug, state and source for a target commit (WIN-06): triggered there, needed from its best source, or unusable.

    rows: bug, commit, status, rank, row; statuses other than `0|0` and `0|1` count as triggered. introduced and edges as in graphs.best_sources().
    """
    from crashlens.operators import graphs

    there = rows.where(F.col("commit") == target).select("bug", F.coalesce(F.col("status").isin("1|1", "1|0", "0.5|1", "0.5|0"), F.lit(False)).alias("here"))
    best = graphs.best_sources(rows, edges, introduced).withColumnRenamed("commit", "source")
    state = F.when(F.col("here"), "triggered").when(F.col("source").isNotNull(), "needed").otherwise("unusable")
    return there.join(best, "bug", "left").select("bug", state.alias("state"), F.when(~F.col("here"), F.col("source")).alias("source"))


def neighbours(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Values before and after each row (JOI-20)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


def every_nth(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """Each n-th row of a group and its last one (FLT-08)."""
    w = Window.partitionBy(*by)
    return rows.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w)).where(f"(_i - 1) % {n} = 0 or _i = _n").drop("_i", "_n")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order (SNK-06, SNK-07, SET-04, WIN-06)."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_i = 1").drop("_i")


def top(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows of a total order, with their rank (WIN-05, WIN-07): one task sorts no more than k rows of each partition."""
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def trimmed_mean(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean without one least and one greatest value where there are more than two; null for none (AGG-14)."""
    n, total = F.count(value), F.sum(value)
    return rows.groupBy(*by).agg(F.when(n > 2, (total - F.min(value) - F.max(value)) / (n - 2)).otherwise(total / F.nullif(n, F.lit(0))).alias("trimmed_mean"))


def islands(rows: DataFrame, by: list[str], position: str, inside: str) -> DataFrame:
    """First and last positions of runs of rows that fulfil a condition (SCL-27, SCL-28)."""
    w = Window.partitionBy(*by).orderBy(position)
    kept = rows.withColumn("_n", F.row_number().over(w)).where(inside).withColumn("_g", F.col("_n") - F.row_number().over(w))
    return kept.groupBy(*by, "_g").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count(F.lit(1)).alias("n")).drop("_g")


def adjacency(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Targets of each source, sorted (GRF-02)."""
    return edges.groupBy(source).agg(F.array_sort(F.collect_set(target)).alias("targets"))


def closure(edges: DataFrame, source: str, target: str, most: int = 64) -> DataFrame:
    """All pairs that a path joins, every node with itself (GRF-01, FLT-06): doubling steps until no pair is new.

    Each step is checkpointed. Meant for a repository's commits, where callers bound the nodes.
    """
    one = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).distinct()
    nodes = one.select("a").unionByName(one.select(F.col("b").alias("a"))).distinct()
    reach, n = one.unionByName(nodes.select("a", F.col("a").alias("b"))).distinct(), -1
    for _ in range(most):
        left, right = reach.select("a", F.col("b").alias("m")), reach.select(F.col("a").alias("m"), "b")
        reach = left.join(right, "m").select("a", "b").distinct()
        if reach.sparkSession.sparkContext.getCheckpointDir() is not None:
            reach = reach.checkpoint()
        now = reach.count()
        if now == n:
            break
        n = now
    return reach


def live_commits(closure_: DataFrame, windows: DataFrame) -> DataFrame:
    """Commits at which a bug is live: after its introduction and not after its fix, in DAG order (FLT-06).

    closure_: a, b with b an ancestor of a or a itself; windows: bug, introduced, fixed.
    """
    since = windows.join(closure_, F.col("introduced") == F.col("b")).select("bug", F.col("a").alias("commit"))
    fixed = windows.join(closure_, F.col("fixed") == F.col("b")).select("bug", F.col("a").alias("commit"))
    return since.join(fixed, ["bug", "commit"], "left_anti").distinct()


def live_in_line(commits: DataFrame, windows: DataFrame, by: list[str], position: str, commit: str) -> DataFrame:
    """live_commits of whole linear histories: there an ancestor is an earlier position, so no closure is made.

    commits: by, position, commit; windows: by, bug, introduced, fixed, the positions of both (either can be null).
    """
    live = (F.col(position) >= F.col("introduced")) & (F.col("fixed").isNull() | (F.col(position) < F.col("fixed")))
    return commits.join(windows, by).where(live).select("bug", F.col(commit).alias("commit")).distinct()


def expand_names(names: DataFrame, renames: DataFrame, name: str = "name") -> DataFrame:
    """Names and all that a rename table adds to them (SET-05)."""
    more = names.join(renames, name).select(F.explode("new_names").alias(name))
    return names.select(name).unionByName(more).distinct()


def rename_table(pairs: DataFrame, order: str) -> DataFrame:
    """New names of each old one, in order, each once (MAP-01)."""
    rows = pairs.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(order, "new"))).alias("x"))
    return rows.select("name", F.array_distinct(F.transform("x", lambda x: x["new"])).alias("new_names"))
