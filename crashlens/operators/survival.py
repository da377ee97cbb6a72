"""First events, dense right-censored matrices, Kaplan-Meier medians and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that count as the end of a trial where there are no snapshots.
DEFAULT_CENSOR = 86400


def inventory(trials: DataFrame, snapshots: DataFrame, benchmark: str | None = None, keep_preempted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Trials (fuzzer, trial) and one row with the censor time (SRC-01, SRC-05, SRC-06). Filters are parameters: the reports differ in them."""
    if benchmark is not None:
        trials = trials.where(F.col("benchmark") == benchmark)
    if not keep_preempted:
        trials = trials.where("preempted = 0")
    censor = snapshots.agg(F.coalesce(F.nullif(F.max("time"), F.lit(0)), F.lit(DEFAULT_CENSOR)).cast("long").alias("censor"))
    return trials.select("fuzzer", F.col("id").alias("trial")), censor


def first_events(events: DataFrame, keys: list[str], time: str = "time", out: str = "first_time") -> DataFrame:
    """Least time per key (AGG-01)."""
    return events.groupBy(*keys).agg(F.min(time).alias(out))


def merge_events(reached: DataFrame, triggered: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge; a trigger counts as reached from its time on where nothing was reached before (JOI-04)."""
    both = reached.withColumnRenamed("first_time", "r").join(triggered.withColumnRenamed("first_time", "time_first_triggered"), keys, "full")
    return both.withColumn("time_first_reached", F.coalesce("r", "time_first_triggered")).select(*keys, "time_first_reached", "time_first_triggered")


def dense(trials: DataFrame, targets: DataFrame, events: DataFrame, censor: DataFrame, keys: list[str], time: str = "first_time") -> DataFrame:
    """Every trial with every target: event 0/1, and its time or the censor time (JOI-03). A time of 0 is an event at 0.

    targets and censor are dimensions of a few rows; Spark broadcasts them if their size allows.
    """
    grid = trials.crossJoin(targets).crossJoin(censor)
    return grid.join(events, keys, "left").withColumn("event", F.col(time).isNotNull().cast("int")).withColumn("time", F.coalesce(F.col(time), F.col("censor")))


def km_median(frame: DataFrame, by: list[str], time: str = "time", event: str = "event") -> DataFrame:
    """n, events and the Kaplan-Meier median: the first time at which survival is 0.5 or less, null if never (DOM-02).

    Events and subjects are counted per time before the curve is folded, so a group costs a row per distinct time.
    Survival within 1e-12 of 0.5 counts as 0.5.
    """
    steps = frame.groupBy(*by, time).agg(F.sum(event).alias("d"), F.count(F.lit(1)).alias("n"))
    rows = steps.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), "d", "n"))).alias("s"), F.sum("n").alias("n_pairs"), F.sum("d").alias("n_events"))
    fold = """aggregate(s, struct(cast(n_pairs as double) as risk, 1.0D as alive, cast(null as bigint) as median),
        (a, x) -> struct(a.risk - x.n as risk, a.alive * (1 - x.d / a.risk) as alive,
                         coalesce(a.median, if(x.d > 0 and a.alive * (1 - x.d / a.risk) <= 0.5 + 1e-12, cast(x.t as bigint), null)) as median), a -> a.median)"""
    return rows.select(*by, "n_pairs", F.col("n_events").cast("long").alias("n_events"), F.expr(fold).alias("km_median"))


def km_curve(frame: DataFrame, by: list[str], time: str = "time", event: str = "event") -> DataFrame:
    """Survival after each distinct time, in window form (WIN-01)."""
    steps = frame.groupBy(*by, F.col(time).alias("t")).agg(F.sum(event).alias("d"), F.count(F.lit(1)).alias("n"))
    sofar = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    risk = steps.withColumn("risk", F.sum("n").over(Window.partitionBy(*by)) - F.sum("n").over(sofar) + F.col("n"))
    return risk.withColumn("alive", F.product(1 - F.col("d") / F.col("risk")).over(sofar))


def survival_wide(matrix: DataFrame) -> DataFrame:
    """Reached and triggered events with right-censored times, in seconds and hours (DOM-03)."""
    out = matrix
    for kind in ("reached", "triggered"):
        at = F.col(f"time_first_{kind}")
        out = out.withColumn(f"{kind}_event", at.isNotNull().cast("int")).withColumn(f"{kind}_seconds", F.coalesce(at, F.col("censor")).cast("long"))
    return out


def survival_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """One row per event kind (DOM-03)."""
    kinds = F.expr("stack(2, 'reached', reached_event, reached_seconds, 'triggered', triggered_event, triggered_seconds) as (event_type, event_observed, time_seconds)")
    return wide.select(*keys, kinds)


def zero_filled_means(matrix: DataFrame, by: str, trial: str, target: str) -> DataFrame:
    """Over all trials: mean and most targets hit, earliest hit, and targets hit in every trial (AGG-10)."""
    trials = matrix.groupBy(by, trial).agg(F.sum("event").alias("hits"), F.min(F.when(F.col("event") == 1, F.col("time"))).alias("first"))
    one = trials.groupBy(by).agg(F.count(F.lit(1)).alias("n_trials"), F.sum("hits").alias("total_hits"), F.max("hits").alias("max_hits"), F.min("first").alias("earliest"))
    always = matrix.groupBy(by, target).agg(F.min("event").alias("all")).groupBy(by).agg(F.sum("all").alias("hit_in_all"))
    return one.join(always, by)


def missing(matrix: DataFrame, by: str, target: str) -> DataFrame:
    """Targets that no trial hit, as a sorted list (AGG-10, SET-03)."""
    hit = matrix.groupBy(by, target).agg(F.max("event").alias("hit"))
    return hit.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit") == 0, F.col(target)))), ",").alias("missing"))


def time_is_relative(latest: Column) -> Column:
    """Times up to 1e9 are seconds since the start; none at all are epochs (SCL-16)."""
    return F.coalesce(latest < 1_000_000_000, F.lit(False))
