"""Counts, histograms, cross-tabs and wide-to-long matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlens.functions import bits


def ratio_by(rows: DataFrame, by: list[str], hit: str) -> DataFrame:
    """n, hits and their unrounded share (AGG-02, AGG-16)."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).cast("long").alias("hits")).withColumn("share", F.try_divide(F.col("hits"), F.col("n")))


def strata(rows: DataFrame, fuzzers: DataFrame, hit: str) -> DataFrame:
    """fuzzer, stratum, n, hits and share, to four places, with zeros and no share for a fuzzer's empty strata (AGG-02).

    rows: fuzzer, stratum and a column of 0 and 1; fuzzers: one row each, in `fuzzer`.
    """
    grid = fuzzers.select("fuzzer").distinct().select("fuzzer", F.explode(F.array(F.lit("gated"), F.lit("always"))).alias("stratum"))
    out = grid.join(ratio_by(rows, ["fuzzer", "stratum"], hit), ["fuzzer", "stratum"], "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "hits": F.coalesce("hits", F.lit(0)), "share": F.round("share", 4)})


def usage_cost(rows: DataFrame, prices: DataFrame, default: tuple[float, float, float], by: list[str]) -> DataFrame:
    """Sums of input_tokens, cached_input_tokens, output_tokens, and their cost (AGG-13). Cached tokens are among the input ones.

    rows: by, model and the tokens; prices: model, input, cached, output per million, a row per model; other models cost the default.
    """
    kinds = ("input_tokens", "cached_input_tokens", "output_tokens")
    sums = rows.groupBy(*dict.fromkeys([*by, "model"])).agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds)).join(prices, "model", "left")
    price = lambda c, i: F.coalesce(c, F.lit(default[i]))
    cost = ((F.col(kinds[0]) - F.col(kinds[1])) * price("input", 0) + F.col(kinds[1]) * price("cached", 1) + F.col(kinds[2]) * price("output", 2)) / 1_000_000
    return sums.withColumn("cost", cost).groupBy(*by).agg(*(F.sum(k).alias(k) for k in (*kinds, "cost")))


def precedence(gated: Column, always: Column) -> Column:
    """gated before always before unmatched (AGG-05)."""
    return F.when(gated, "gated").when(always, "always").otherwise("unmatched")


def dense_histogram(rows: DataFrame, by: str, bit: str) -> DataFrame:
    """Counts of each bit from 0 to the greatest, zeros included; nothing without any bit (AGG-05)."""
    counts = rows.where(F.col(bit).isNotNull()).groupBy(by, bit).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max(bit).alias("top")).where("top is not null")
    grid = rows.select(by).distinct().crossJoin(F.broadcast(top)).select(by, F.explode(F.sequence(F.lit(0), F.col("top"))).alias(bit))
    return grid.join(counts, [by, bit], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def with_total(rows: DataFrame, by: str, kind: str, total: str = "__overall__") -> DataFrame:
    """Counts by group and kind with a total group, in one pass (AGG-12)."""
    out = rows.cube(by, kind).agg(F.count(F.lit(1)).alias("n"), F.grouping(by).alias("g"), F.grouping(kind).alias("h")).where("h = 0")
    return out.select(F.when(F.col("g") == 1, total).otherwise(F.col(by)).alias(by), kind, "n")


def breakdown(rows: DataFrame, sets: list[str], value: str) -> DataFrame:
    """Counts and sums by each of several columns, by grouping sets in one pass (AGG-09)."""
    parts = [F.when(F.grouping(c) == 0, c) for c in sets]
    names = [F.when(F.grouping(c) == 0, F.col(c).cast("string")) for c in sets]
    grouped = rows.groupingSets([[F.col(c)] for c in sets], *sets).agg(F.coalesce(*parts).alias("dimension"), F.coalesce(*names).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select("dimension", "name", "n", "total")


def to_long(matrix: DataFrame, ids: list[str], name: str = "bug", cell: str = "status") -> DataFrame:
    """A wide matrix with a column per bug as rows (SRC-12); the column `poc count` isn't a bug."""
    values = [c for c in matrix.columns if c not in ids and c != "poc count"]
    return matrix.unpivot(ids, values, name, cell)


def status_counts(long: DataFrame, by: list[str]) -> DataFrame:
    """Sure, weak and ranked cells of each row (SRC-12, AGG-17)."""
    rank = bits.status_rank(F.col("status"))
    return long.groupBy(*by).agg(F.count_if(rank == 2).alias("strong"), F.count_if(F.col("status") == "0.5|1").alias("weak"), F.max(rank).alias("best"))


def first_by_key(rows: DataFrame, keys: list[str], order: list[str], carry: list[str], distinct: str) -> DataFrame:
    """Occurrences, distinct values, least order and the first row's attributes (AGG-05)."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct(distinct).alias("seen"), F.min(F.struct(*order, *carry)).alias("r"))
    return out.select(*keys, "occurrences", "seen", *(F.col(f"r.{c}").alias(c) for c in (*order, *carry)))
