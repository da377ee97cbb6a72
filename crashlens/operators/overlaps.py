"""Overlaps of sets: pairs of keys that share values, how many others a key overlaps, which applied ones it meets.

A value that few keys hold makes its pairs. One of more than `hot` keys makes none: keys with the same hot values are a class,
classes meet instead of keys, and bitmaps of the keys that hold a hot value tell how many keys a class meets. A hot value so costs
its bitmap and not the square of its keys. Rows with a null in the project, key or value share nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlens.operators import blocks as blocked
from crashlens.sources import shared

#: Keys up to which a value makes pairs: at most half as many pairs as that for each item.
HOT = 256


def _sets(items: DataFrame, key: str, value: str, by: list[str]) -> DataFrame:
    """Distinct items without a null."""
    return shared.stored(items.select(*by, key, value).dropna().distinct(), "sets")


def _split(one: DataFrame, key: str, value: str, by: list[str], hot: int) -> tuple[DataFrame, DataFrame]:
    """Items of _sets() of values that aren't hot, and each key's hot values, sorted, as _mask; keys without one have no row."""
    often = one.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select(*by, value)
    masks = one.join(often, [*by, value], "left_semi").groupBy(*by, key).agg(F.array_sort(F.collect_set(value)).alias("_mask"))
    return one.join(often, [*by, value], "left_anti"), shared.stored(masks, "masks")


def _light_pairs(light: DataFrame, key: str, value: str, by: list[str]) -> DataFrame:
    a, b = light.withColumnRenamed(key, "a"), light.withColumnRenamed(key, "b")
    return a.join(b, [*by, value]).where("a < b").groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("shared"))


def _classes(masks: DataFrame, by: list[str]) -> DataFrame:
    """Each class of keys with the same hot values, a row per value."""
    return masks.select(*by, "_mask").distinct().select(*by, "_mask", F.explode("_mask").alias("_v"))


def pair_overlaps(items: DataFrame, key: str, value: str, by: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """Pairs of keys with how many values they share (JOI-13), within a project where `by` names one.

    All pairs are listed, so there are as many rows as pairs. Those of hot values are made once a pair of classes and not once a value.
    """
    by = list(by)
    light, masks = _split(_sets(items, key, value, by), key, value, by, hot)
    held = _classes(masks, by)
    a, b = held.withColumnRenamed("_mask", "_a"), held.withColumnRenamed("_mask", "_b")
    met = a.join(b, [*by, "_v"]).where("_a <= _b").groupBy(*by, "_a", "_b").agg(F.count(F.lit(1)).alias("shared"))
    side = lambda c: masks.select(*by, F.col(key).alias(c), F.col("_mask").alias(f"_{c}"))
    listed = met.join(side("a"), [*by, "_a"]).join(side("b"), [*by, "_b"]).where("_a < _b or a < b")
    listed = listed.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared")
    return _light_pairs(light, key, value, by).unionByName(listed).groupBy(*by, "a", "b").agg(F.sum("shared").alias("shared"))


def degrees(items: DataFrame, key: str, value: str, by: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """How many others each key shares a value with; keys that share none have no row. No pair of a hot value is made.

    Keys are numbered. A hot value has a bitmap for each 32,768 numbers; a class takes them together by or and counts. The other
    values' keys come as a list for each class, so a key is sent lists, of `hot` keys at most a value, and no pair of keys is a row.
    """
    return _degrees(_sets(items, key, value, list(by)), key, value, list(by), hot)


def _degrees(one: DataFrame, key: str, value: str, by: list[str], hot: int) -> DataFrame:
    """degrees() of items of _sets()."""
    light, masks = _split(one, key, value, by, hot)
    at = F.col("_at")
    numbered = blocked.dealt(masks, [*by, key]).select(*by, F.explode("_mask").alias("_v"), F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_place"))
    bitmaps = numbered.groupBy(*by, "_v", "_bucket").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    met = _classes(masks, by).join(bitmaps, [*by, "_v"]).groupBy(*by, "_mask", "_bucket").agg(F.bitmap_count(F.bitmap_or_agg("_bits")).alias("_n"))
    met = masks.join(met.groupBy(*by, "_mask").agg((F.sum("_n") - 1).alias("degree")), [*by, "_mask"]).select(*by, key, "degree")
    # keys that share a hot value too are in the bitmaps, so a class takes the holders of its other values only from classes that share none
    held = light.join(masks, [*by, key], "left")
    holders = held.groupBy(*by, value, F.col("_mask").alias("_theirs")).agg(F.collect_list(key).alias("_keys"))
    others = held.join(holders, [*by, value]).where(~F.coalesce(F.arrays_overlap("_mask", "_theirs"), F.lit(False))).select(*by, key, "_keys")
    others = others.where(F.size("_keys") > F.array_contains("_keys", F.col(key)).cast("int"))
    rest = others.groupBy(*by, key).agg(F.array_distinct(F.flatten(F.collect_list("_keys"))).alias("_keys"))
    rest = rest.select(*by, key, (F.size("_keys") - F.array_contains("_keys", F.col(key)).cast("int")).cast("long").alias("degree"))
    return met.unionByName(rest).groupBy(*by, key).agg(F.sum("degree").alias("degree")).where("degree > 0")


def merge_order(items: DataFrame, key: str, value: str, by: tuple[str, ...] = (), blocks: int | None = None, hot: int = HOT) -> DataFrame:
    """A project's keys in the order of merging (WIN-11): by how many others they overlap, then by size, then by key; rank from 1.

    Sizes and degrees come from the same distinct items, which are made once. by: the project. Without one, and where `blocks` is given, keys are ranked by ranges of the order in that many tasks.
    """
    by = list(by)
    one = _sets(items, key, value, by)
    nulls = items.select(*by, key, value).where(reduce(Column.__or__, (F.col(c).isNull() for c in (*by, key, value)))).distinct()
    sizes = one.unionByName(nulls).groupBy(*by, key).agg(F.count(value).alias("n"))
    out = sizes.join(_degrees(one, key, value, by, hot), [*by, key], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if blocks or not by:
        rows = blocked.dealt(out.withColumn("_one", F.lit(1)), [*by, "degree", "n", key], blocks)
        return blocked.running(rows, by, "_one", "rank").drop("_one", "_at", "_block")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("degree", "n", key)))


def overlapping(items: DataFrame, applied: DataFrame, key: str, value: str, hot: int = HOT) -> DataFrame:
    """Keys that share a value with applied ones, themselves apart, and those, sorted (JOI-14). items: key, value; applied: key.

    A hot value's applied keys are listed once for each class.
    """
    light, masks = _split(_sets(items, key, value, []), key, value, [], hot)
    chosen = applied.select(key).distinct()
    held = light.join(chosen, key, "left_semi").groupBy(value).agg(F.collect_set(key).alias("_with"))
    few = light.join(held, value).select(key, F.explode("_with").alias("_w")).groupBy(key).agg(F.collect_set("_w").alias("_few"))
    theirs = masks.join(chosen, key, "left_semi").groupBy("_mask").agg(F.collect_list(key).alias("_with"))
    theirs = theirs.select(F.col("_mask").alias("_theirs"), "_with", F.explode("_mask").alias("_v"))
    pairs = _classes(masks, []).join(theirs, "_v").dropDuplicates(["_mask", "_theirs"])
    many = masks.join(pairs.groupBy("_mask").agg(F.flatten(F.collect_list("_with")).alias("_many")), "_mask").select(key, "_many")
    none = F.array().cast(few.schema["_few"].dataType)
    both = few.join(many, key, "full").withColumn("applied", F.array_union(F.coalesce("_few", none), F.coalesce("_many", none)))
    both = both.select(key, F.array_sort(F.array_remove("applied", F.col(key))).alias("applied"))
    return both.where(F.size("applied") > 0)
