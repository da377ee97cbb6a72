"""Experiments: crashes of trials, snapshot times, start times, corpus snapshots, live statistics, bug choices and log pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlens.functions import bits
from crashlens.operators import lookup


def crash_scan(crashes: DataFrame, trials: DataFrame, benchmark: str | None = None, keep_preempted: bool = False) -> DataFrame:
    """fuzzer, trial, time, stack of the crashes of a benchmark's trials (SRC-02); a missing stack is empty.

    crashes: trial_id, time, crash_stacktrace; trials: id, fuzzer, benchmark, preempted. Rows come in no order: what reads them
    takes the least (time, trial).
    """
    if benchmark is not None:
        trials = trials.where(F.col("benchmark") == benchmark)
    if not keep_preempted:
        trials = trials.where("preempted = 0")
    own = trials.select("fuzzer", F.col("id").alias("trial"))
    rows = crashes.select(F.col("trial_id").alias("trial"), "time", F.coalesce("crash_stacktrace", F.lit("")).alias("stack"))
    return rows.join(own, "trial").select("fuzzer", "trial", "time", "stack")


def snapshot_times(snapshots: DataFrame) -> DataFrame:
    """trial and its sorted snapshot times (SRC-03). snapshots: trial_id, time; null times don't count."""
    return snapshots.groupBy(F.col("trial_id").alias("trial")).agg(F.array_sort(F.collect_list("time")).alias("times"))


def epoch_seconds(text: Column) -> Column:
    """Seconds since 1970 of an ISO time, as UTC where it names no zone; null if it can't be read (SRC-04)."""
    zoned = text.rlike(r"(?i)(z|[+-]\d\d(:?\d\d)?)$") & text.rlike(r"\d[T ]\d")
    return F.unix_micros(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")) / 1e6


def experiment_start(experiments: DataFrame) -> DataFrame:
    """One row: start, the epoch seconds of the experiment's time_created, or null (SRC-04). Of several rows the least text counts."""
    return experiments.agg(F.min("time_created").alias("t")).select(epoch_seconds(F.col("t")).alias("start"))


def live_statistics(experiments: DataFrame, trials: DataFrame, snapshots: DataFrame, crashes: DataFrame) -> DataFrame:
    """One row of what a watcher prints (AGG-15): time_created, time_ended, total_trials, ended_trials, latest_snapshot, crash_rows."""
    parts = [
        experiments.agg(F.min(F.struct("time_created", "time_ended")).alias("e")).select("e.time_created", "e.time_ended"),
        trials.agg(F.count(F.lit(1)).alias("total_trials"), F.count("time_ended").alias("ended_trials")),
        snapshots.agg(F.max("time").alias("latest_snapshot")),
        crashes.agg(F.count(F.lit(1)).alias("crash_rows")),
    ]
    out = parts[0]
    for part in parts[1:]:  # one row each
        out = out.crossJoin(F.broadcast(part))
    return out


def crashes_by_fuzzer(crashes: DataFrame, trials: DataFrame) -> DataFrame:
    """fuzzer and n of the crashes of its trials (AGG-15). Counted by trial before the join."""
    counts = crashes.groupBy(F.col("trial_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(trials.select("id", "fuzzer"), "id").groupBy("fuzzer").agg(F.sum("n").alias("n"))


def top_states(crashes: DataFrame, k: int = 5) -> DataFrame:
    """The k commonest crash states, ties to the least name (AGG-15)."""
    return crashes.groupBy("crash_state").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("crash_state")).limit(k)


def corpus_snapshots(inputs: DataFrame, bugs: DataFrame, n_bytes: int) -> DataFrame:
    """fuzzer, trial, bug_id and the earliest time at which a corpus holds an input that switches the bug on (SRC-18).

    inputs: fuzzer, trial, time, head (an input's first bytes); bugs: bug_id and dispatch_mask, a bit set of any width, or
    dispatch_value up to 2^62; no bit for those always on.
    Shorter inputs switch nothing on. Inputs of a trial are taken together by head before bugs are met.
    """
    heads = inputs.where(F.octet_length("head") >= n_bytes).groupBy("fuzzer", "trial", F.substring("head", 1, n_bytes).alias("head")).agg(F.min("time").alias("time"))
    bit = heads.select("fuzzer", "trial", "time", F.explode(bits.set_bits(F.hex("head"))).alias("bit"))
    held = bits.places(F.col("dispatch_mask")) if "dispatch_mask" in bugs.columns else F.expr("filter(sequence(0, 62), i -> getbit(dispatch_value, i) = 1)")
    bugs = bugs.select("bug_id", held.alias("_bits"))
    gated = bugs.select("bug_id", F.explode("_bits").alias("bit"))
    always = heads.crossJoin(F.broadcast(bugs.where("size(_bits) = 0").select("bug_id")))  # bugs are a dimension of one project
    hits = bit.join(gated, "bit").select("fuzzer", "trial", "bug_id", "time").unionByName(always.select("fuzzer", "trial", "bug_id", "time"))
    return hits.groupBy("fuzzer", "trial", "bug_id").agg(F.min("time").alias("first_time"))


def selectable(bugs: DataFrame, wanted: DataFrame, fuzz_target: str, sanitizer: str | None = None) -> DataFrame:
    """Wanted bugs that are known, not of a 32-bit job and of a fuzz target, optionally of a sanitizer by its first word (FLT-02).

    bugs: bug_id, job_type, fuzz_target, sanitizer; wanted: bug_id.
    """
    fit = bugs.where(~F.col("job_type").contains("i386") & (F.col("fuzz_target") == fuzz_target))
    if sanitizer is not None:
        fit = fit.where(F.split_part("sanitizer", F.lit(" "), F.lit(1)) == sanitizer)
    return wanted.join(fit, "bug_id", "left_semi")


def log_pairs(bugs: DataFrame, original: DataFrame, post: DataFrame, keys: list[str]) -> DataFrame:
    """Every bug with its log before and after, note missing_log where either is missing (JOI-18). original and post: keys, log."""
    both = bugs.join(original.withColumnRenamed("log", "before"), keys, "left").join(post.withColumnRenamed("log", "after"), keys, "left")
    return both.withColumn("note", F.when(F.col("before").isNull() | F.col("after").isNull(), "missing_log"))


def blockers(functions: DataFrame, files: DataFrame, applied: DataFrame) -> DataFrame:
    """Applied patches that touch functions of a crash path; only if there is none, those that touch the same files (JOI-16).

    functions: func; files: file; applied: bug_id, functions, files (arrays). Gives bug_id, kind, items (sorted).
    """

    def touching(side: DataFrame, column: str, array: str) -> DataFrame:
        met = applied.select("bug_id", F.explode(F.array_distinct(array)).alias(column)).join(side.distinct(), column)
        return met.groupBy("bug_id").agg(F.lit(array).alias("kind"), F.array_sort(F.collect_set(column)).alias("items"))

    return lookup.with_fallback(touching(functions, "func", "functions"), touching(files, "file", "files"))
