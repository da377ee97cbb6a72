"""What reports sum up: by bug, by bug and fuzzer, over signatures, over trials with hits, over projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlens.functions import sanitizer
from crashlens.operators import blocks as blocked
from crashlens.operators import survival


def by_fuzzer(trials: DataFrame, censor: DataFrame) -> DataFrame:
    """fuzzer, n_trials, first_trial, last_trial, censor of an inventory's two frames (SRC-01, SRC-05, SRC-06). A row per fuzzer, whatever it has of trials."""
    rows = trials.groupBy("fuzzer").agg(F.countDistinct("trial").alias("n_trials"), F.min("trial").alias("first_trial"), F.max("trial").alias("last_trial"))
    return rows.crossJoin(F.broadcast(censor))  # one row


def per_bug(matrix: DataFrame, bugs: DataFrame, bug: str = "bug_id") -> DataFrame:
    """Every bug with n_trials, triggered and km_median over its rows of the matrix; 0, 0 and null for a bug that has none (AGG-03).

    matrix: bug, event, time as survival.dense() gives them; bugs: a row per bug, whose columns stay.
    """
    found = survival.km_median(matrix, [bug]).select(bug, F.col("n_pairs").alias("_n"), F.col("n_events").alias("_d"), F.col("km_median").alias("_m"))
    out = bugs.join(found, bug, "left").withColumns({"n_trials": F.coalesce("_n", F.lit(0)), "triggered": F.coalesce("_d", F.lit(0)), "km_median": F.col("_m")})
    return out.drop("_n", "_d", "_m")


def by_bug_and_fuzzer(matrix: DataFrame, bugs: DataFrame, bug: str = "bug_id") -> DataFrame:
    """fuzzer, stratum, bug, dispatch_value, trials, triggered for known bugs (AGG-04). Counted before bugs are met.

    matrix: fuzzer, bug, event; bugs: bug, stratum, dispatch_value, a row per bug.
    """
    counts = matrix.groupBy("fuzzer", bug).agg(F.count(F.lit(1)).alias("trials"), F.sum("event").alias("triggered"))
    return counts.join(bugs.select(bug, "stratum", "dispatch_value"), bug).select("fuzzer", "stratum", bug, "dispatch_value", "trials", "triggered")


def _any(column: str) -> Column:
    return F.coalesce(F.size(column) > 0, F.lit(False))


def headline(crashes: DataFrame) -> DataFrame:
    """One row: crashes as they come (a), by stack (b) and by key (c), and how many of each match a bug (AGG-06).

    crashes: count, fingerprint (array), key (normal), stack_bugs and state_bugs (arrays of the bugs that a stack or a state meets). An empty or
    missing fingerprint or key isn't counted as one. A stack matches if any crash with it meets a bug by its stack, a key if one does by its state.
    """
    stack, key = F.when(_any("fingerprint"), F.col("fingerprint")), F.nullif(F.col("key"), F.lit(""))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return crashes.agg(
        total("count").alias("a"), F.countDistinct(stack).alias("b"), F.countDistinct(key).alias("c"), total(F.when(_any("stack_bugs") | _any("state_bugs"), F.col("count"))).alias("a_matched"),
        F.countDistinct(F.when(_any("stack_bugs"), stack)).alias("b_matched"), F.countDistinct(F.when(_any("state_bugs"), key)).alias("c_matched"),
    )


def candidates(crashes: DataFrame) -> DataFrame:
    """key, occurrences and the sorted bugs that any of its crashes meets by stack or state (AGG-06). crashes: as for headline()."""
    rows = crashes.where((F.coalesce("key", F.lit("")) != "") & (_any("stack_bugs") | _any("state_bugs")))
    none = F.array().cast(crashes.schema["stack_bugs"].dataType)
    met = rows.select("key", F.explode(F.array_union(F.coalesce("stack_bugs", none), F.coalesce("state_bugs", none))).alias("bug")).distinct()
    return rows.groupBy("key").agg(F.sum("count").alias("occurrences")).join(met.groupBy("key").agg(F.array_sort(F.collect_list("bug")).alias("bugs")), "key")


def distinct_bugs(records: DataFrame) -> DataFrame:
    """project, fuzz_target, arch, bug_count: different ids of a project's target, by the architecture of the job (AGG-11). records: project, fuzz_target, job_type, bug."""
    return records.groupBy("project", "fuzz_target", sanitizer.architecture(F.col("job_type")).alias("arch")).agg(F.countDistinct("bug").alias("bug_count"))


def mean_over_hits(hits: DataFrame, by: str, trial: str, bug: str) -> DataFrame:
    """Mean number of bugs over the trials that have any, and their number (AGG-19); survival.zero_filled_means() is over all trials."""
    trials = hits.groupBy(by, trial).agg(F.countDistinct(bug).alias("n"))
    return trials.groupBy(by).agg(F.avg("n").alias("mean"), F.count(F.lit(1)).alias("trials_with_hits"))


def across(reports: DataFrame) -> DataFrame:
    """One row over the reports of all projects, as readers.markdown_report() gives them (AGG-16).

    projects, bugs, bugs_ff, bugs_ffl over reports with bugs, duplicates (the share of bugs that the loose key takes away, null without
    bugs); of those with crashes their number and sums, missing occurrences as 0.
    """
    own = reports.where("bugs is not null")
    crash = lambda c: F.coalesce(F.sum(F.when(F.col("crashes").isNotNull(), F.col(c))), F.lit(0)).alias(f"total_{c}")
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
    out = own.agg(F.count(F.lit(1)).alias("projects"), *(some(c) for c in ("bugs", "bugs_ff", "bugs_ffl")), F.count("crashes").alias("with_crashes"), *(crash(c) for c in ("crashes", "crashes_ff", "crashes_ffl", "crashes_matched", "occurrences")))
    return out.withColumn("duplicates", F.try_divide(F.col("total_bugs") - F.col("total_bugs_ff"), F.col("total_bugs")))


def ranked_bugs(rows: DataFrame, by: str = "fuzzer", bug: str = "bug_id") -> DataFrame:
    """Rows with the rank within their fuzzer: most triggered trials, most reached ones, least best_time with none at the end, bug (WIN-08). Bugs that nothing reached are left out."""
    order = Window.partitionBy(by).orderBy(F.desc("triggered"), F.desc("reached"), F.col("best_time").asc_nulls_last(), F.col(bug))
    return rows.where("triggered > 0 or reached > 0").withColumn("rank", F.row_number().over(order))


def newest_first(windows: DataFrame, inside: DataFrame, commits: DataFrame, blocks: int | None = None) -> DataFrame:
    """commit, time and rank of all commits in any bug's window, both ends too, newest first, each once (WIN-12).

    windows: bug, introduced, fixed; those without an end are left out. inside: bug, commit, as graphs.between() finds them. commits: commit, time, a row per
    commit; what isn't there is left out. Commits of the same time come in order of their names. Ranks are given out by ranges in many tasks.
    """
    whole = windows.where("introduced is not null and fixed is not null")
    ends = whole.select(F.explode(F.array("introduced", "fixed")).alias("commit"))
    met = ends.unionByName(inside.join(whole.select("bug").distinct(), "bug", "left_semi").select("commit")).distinct().join(commits.select("commit", "time"), "commit")
    dealt = blocked.dealt(met.withColumn("_one", F.lit(1)), [F.desc("time"), F.col("commit")], blocks)
    return blocked.running(dealt, [], "_one", "rank").select("commit", "time", "rank")
