"""As-of lookups, intervals, overlaps and positional joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlens.operators import blocks as blocked
from crashlens.sources import shared


def _merged(probes: DataFrame, times: DataFrame, at: str, by: list[str], value: str) -> DataFrame:
    """Probes and lookup rows in one frame: a window replaces the range join."""
    left = probes.withColumn("_t", F.col(at)).withColumn("_v", F.lit(None).cast(times.schema[value].dataType)).withColumn("_probe", F.lit(True))
    right = times.select(*by, F.col(at).alias("_t"), F.col(value).alias("_v")).withColumn("_probe", F.lit(False))
    return left.unionByName(right, allowMissingColumns=True)


def asof(probes: DataFrame, times: DataFrame, at: str, by: list[str], value: str, out: str, blocks: int | None = None) -> DataFrame:
    """The value after a probe's time, else the latest up to it; null only where a group has none (JOI-10).

    One sort by group and time in either direction, with frames that only grow: linear in a group's rows. Without groups, and
    where `blocks` is given, ranges of times are dealt to that many tasks, so that no group is sorted in one.
    """
    rows = _merged(probes, times, at, by, value)
    if blocks or not by:
        rows = blocked.dealt(rows, [*by, "_t", "_probe", "_v"], blocks)
        # a value at a probe's own time stands before it
        rows = blocked.nearest(blocked.nearest(rows, by, "_v", "_before"), by, "_v", "_after", ahead=True)
        return rows.where("_probe").withColumn(out, F.coalesce("_after", "_before")).drop("_t", "_v", "_probe", "_before", "_after", "_at", "_block")
    group = Window.partitionBy(*by)
    before = F.last("_v", ignorenulls=True).over(group.orderBy("_t", "_probe", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.last("_v", ignorenulls=True).over(group.orderBy(F.desc("_t"), F.desc("_probe"), F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(out, F.coalesce(after, before)).where("_probe").drop("_t", "_v", "_probe")


def latest_before(rows: DataFrame, by: list[str], at: str, value: str, cutoff: str) -> DataFrame:
    """Per group the value of the latest row before a cutoff, else of the first one; ties to the least value (JOI-11)."""
    early = F.col(at) < F.lit(cutoff).cast("timestamp_ntz")
    best = F.max(F.when(early, F.struct(F.col(at).alias("t"), (-F.col(value)).alias("v"))))
    return rows.groupBy(*by).agg(F.coalesce(-best["v"], F.min(F.struct(at, value))[value]).alias(value))


def first_after(rows: DataFrame, by: list[str], at: str, value: str, start: str, days: int) -> DataFrame:
    """Per group the first row later than an offset from its start (JOI-12): real times are compared."""
    late = F.col(at) > F.col(start) + F.make_dt_interval(F.lit(days))
    return rows.groupBy(*by).agg(F.min(F.when(late, F.struct(at, value)))[value].alias(value))


def live(intervals: DataFrame, start: str, end: str, a: str, b: str) -> DataFrame:
    """Closed overlap of [start, end] with [a, b] (FLT-03)."""
    return intervals.where(F.col(start).cast("timestamp_ntz").isNotNull() & (F.col(start) <= F.lit(b).cast("timestamp_ntz")) & (F.col(end) >= F.lit(a).cast("timestamp_ntz")))


def busiest(intervals: DataFrame, start: str, end: str, by: list[str], blocks: int | None = None) -> DataFrame:
    """Per group the first stretch with most intervals at once (WIN-04). An end comes before a start at the same time.

    Events at a time are counted first, so a group's window has a row per distinct time and kind. Without groups, and where
    `blocks` is given, ranges of times are dealt to that many tasks.
    """
    ups = intervals.groupBy(*by, F.col(start).alias("t")).agg(F.count(F.lit(1)).alias("d")).withColumn("k", F.lit(1))
    downs = intervals.groupBy(*by, F.col(end).alias("t")).agg((-F.count(F.lit(1))).alias("d")).withColumn("k", F.lit(0))
    order = Window.partitionBy(*by).orderBy("t", "k")
    if blocks or not by:
        rows = blocked.dealt(ups.unionByName(downs), [*by, "t", "k"], blocks)
        level = blocked.nearest(blocked.running(rows, by, "d", "level"), by, "t", "until", ahead=True)
    else:
        level = ups.unionByName(downs).withColumn("level", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("until", F.lead("t").over(order))
    best = level.groupBy(*by).agg(F.max(F.struct("level", F.expr("-unix_micros(cast(t as timestamp))").alias("early"), "t", "until")).alias("m"))
    return best.select(*by, F.col("m.level").alias("level"), F.col("m.t").alias("start"), F.col("m.until").alias("end"))


def positional(left: DataFrame, right: DataFrame, by: str, order_left: list[str], order_right: list[str], fallback: str, time: str) -> DataFrame:
    """The i-th rows of either side of a group belong together, if the sides are equally long; else the left's own time (JOI-09)."""
    number = lambda df, o: df.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(*o))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    a, b = number(left, order_left), number(right.select(by, *order_right), order_right).select(by, "i", F.col("n").alias("m"), F.col(time).alias("_t"))
    return a.join(b, [by, "i"], "left").withColumn("time", F.when(F.col("n") == F.col("m"), F.col("_t")).otherwise(F.col(fallback))).drop("_t", "m")


def with_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The primary rows; the secondary ones only if there are no primary ones at all (JOI-16)."""
    flag = primary.agg((F.count(F.lit(1)) == 0).alias("_none"))
    return primary.unionByName(secondary.crossJoin(F.broadcast(flag)).where("_none").drop("_none"))


def affix_pairs(left: DataFrame, right: DataFrame, a: str, b: str, ends: bool = False) -> DataFrame:
    """Distinct (a, b) of which either is a prefix of the other, or with `ends` a suffix; nulls meet nothing (JOI-02, JOI-15).

    An index by length: each text gives a key for every length that the other side has and that isn't over its own, so both
    directions are equi-joins. Lengths are a bounded dimension, of ids and paths; their distinct values go through the driver.
    """
    longer, shorter = _affixes(left, right, a, b, ends)
    return longer.unionByName(shorter)


def _affixes(left: DataFrame, right: DataFrame, a: str, b: str, ends: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b) of which b is a prefix of a, and those of which a is one of a longer b.

    Spark takes rows that are exploded for no larger than their source, so they are merged and never broadcast.
    """
    x, y = left.select(a).where(F.col(a).isNotNull()).distinct(), right.select(b).where(F.col(b).isNotNull()).distinct()
    cut = F.right if ends else F.left

    def index(df: DataFrame, own: str, other: DataFrame, name: str, upto: Column) -> DataFrame:
        lengths = sorted(other.agg(F.collect_set(F.char_length(name))).first()[0])
        some = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= upto)
        return df.select(own, F.explode(F.transform(some, lambda n: cut(F.col(own), n))).alias(name))

    longer = index(x, a, y, b, F.char_length(a)).hint("merge").join(y, b)
    shorter = index(y, b, x, a, F.char_length(b) - 1).hint("merge").join(x, a)
    return longer.select(a, b), shorter.select(a, b)


#: Pairs of rows that a task makes of one short id at most, about; beyond it the id's rows are dealt to several tasks.
PAIRS = 4_000_000


def prefixes(left: DataFrame, right: DataFrame, a: str, b: str, pairs: int = PAIRS) -> DataFrame:
    """Rows of both sides whose ids a and b are such that either is a prefix of the other, of any lengths (JOI-15).

    Rows with the longer id find their prefixes first, some per row; all pairs are made in the last join, by the shorter id. There
    the longer rows of an id with many pairs are dealt to parts, each of which has all its shorter rows. Nothing is broadcast.
    """
    columns = [a, *(c for c in left.columns if c != a), *(c for c in right.columns if c != a)]

    def paired(long: DataFrame, short: DataFrame, met: DataFrame, own: str, other: str) -> DataFrame:
        found = shared.stored(long.hint("merge").join(met, own).withColumn("_at", F.monotonically_increasing_id()), "prefixes")
        counts = found.groupBy(other).agg(F.count(F.lit(1)).alias("_n")).hint("merge").join(short.groupBy(other).agg(F.count(F.lit(1)).alias("_m")), other)
        hot = counts.where(F.col("_n") * F.col("_m") > pairs).select(other, F.ceil(F.col("_n") * F.col("_m") / pairs).cast("int").alias("_parts"))
        hot = shared.stored(hot, "hot")
        n = F.coalesce("_parts", F.lit(1))
        one = found.join(hot, other, "left").withColumn("_part", F.pmod("_at", n).cast("int")).drop("_parts")
        all_ = short.join(hot, other, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
        return one.hint("merge").join(all_, [other, "_part"]).select(*columns)

    longer, shorter = _affixes(left, right, a, b)
    return paired(left, right, longer, a, b).unionByName(paired(right, left, shorter, b, a))


def first_projects(files: DataFrame, projects: DataFrame) -> DataFrame:
    """file, project: the first project of the table whose name a file's name begins with, whatever the case, `_` and `-` (JOI-19).

    files: file; projects: project, row (the place in the table). Files without one have no row.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[_-]", "")
    a, b = files.select("file").distinct().withColumn("_f", plain("file")), projects.withColumn("_p", plain("project"))
    met = a.join(affix_pairs(a, b, "_f", "_p").where("startswith(_f, _p)"), "_f").join(b, "_p")
    return met.groupBy("file").agg(F.min(F.struct("row", "project"))["project"].alias("project"))


def containing(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) of which either holds the other anywhere; nulls and empty ids meet nothing (SRC-13).

    A q-gram index: q is the least length of all ids. An id is looked for by that of its grams that fewest longer ids hold, then verified.
    Ids are numbered and stored, so that the index has a number and a gram's hash for each gram; grams of the same hash only give more to
    verify. Spark takes the grams for no larger than the ids, so they are merged and never broadcast.
    """
    x, y = (shared.stored(df.select(F.col(c).alias("id")).where("id <> ''").distinct().withColumn("n", F.monotonically_increasing_id()), "ids") for df, c in ((left, a), (right, b)))
    least = x.unionByName(y).agg(F.min(F.char_length("id"))).first()[0] or 1
    grams = lambda df: df.select("n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("id") - least + 1), lambda i: F.xxhash64(F.substr("id", i, F.lit(least)))))).alias("gram"))

    def held(short: DataFrame, long: DataFrame, one: str, other: str) -> DataFrame:
        index = grams(long)
        rare = grams(short).hint("merge").join(index.groupBy("gram").agg(F.count(F.lit(1)).alias("many")), "gram").groupBy("n").agg(F.min(F.struct("many", "gram"))["gram"].alias("gram"))
        met = rare.hint("merge").join(index.withColumnRenamed("n", "m"), "gram").drop("gram")
        met = met.hint("merge").join(short.withColumnRenamed("id", one), "n").hint("merge").join(long.select(F.col("n").alias("m"), F.col("id").alias(other)), "m")
        return met.where(F.contains(F.col(other), F.col(one))).select(a, b)

    return held(x, y, a, b).unionByName(held(y, x, b, a).where(F.col(a) != F.col(b)))
