"""Crash to bug matching: path and line candidates, sanitizer and stack scores, fingerprint joins, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlens.functions import frames as fr
from crashlens.functions import sanitizer as sn
from crashlens.operators import lookup
from crashlens.sources import shared


def same_path(a: Column, b: Column) -> Column:
    """Equal, or one ends with the other; separators don't matter (JOI-02)."""
    return F.endswith(a, b) | F.endswith(b, a)


def candidates(crashes: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Targets with a frame on their line, in their file and function (JOI-02).

    Distinct files meet first, by the suffix index of affix_pairs(); frames then join the targets' places on file and line.
    crashes: key, frames; targets: bug_id, crash_file, crash_line, crash_function (null or empty: any).
    """
    lines = crashes.select(key, F.explode("frames").alias("f")).select(key, "f.*").where("file is not null and line is not null")
    usable = targets.where("crash_file <> '' and crash_line is not null").select("bug_id", "crash_file", F.col("crash_line").alias("line"), F.nullif("crash_function", F.lit("")).alias("crash_function"))
    places = lookup.affix_pairs(lines, usable, "file", "crash_file", ends=True).join(usable, "crash_file").drop("crash_file")
    return lines.join(places, ["file", "line"]).where("crash_function is null or func = crash_function").select(key, "bug_id").distinct()


def match(crashes: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Bugs of each crash (DOM-01): a lone candidate as it is; of several, those with the best sanitizer score, unless it is
    negative, and of those the ones with the best stack score; ties stay.

    crashes: key, frames, signature; targets also reference_frames and reference_signature (nullable structs). Either side is read,
    and its logs parsed, once; crashes with equal frames and signature are matched together, in one aggregate, and told apart at the end.
    """
    kind = F.sha2(F.to_json(F.struct("frames", "signature")), 256)
    crashes = shared.stored(crashes.select(key, "frames", "signature", kind.alias("_kind")), "crashes")
    targets = shared.stored(targets.select("bug_id", "crash_file", "crash_line", "crash_function", "reference_frames", "reference_signature"), "targets")
    kinds = shared.stored(crashes.groupBy("_kind").agg(F.first("frames").alias("frames"), F.first("signature").alias("signature")), "kinds")
    met = candidates(kinds, targets, "_kind").join(kinds, "_kind").join(targets, "bug_id")
    own = lambda r: (r["line"] == F.col("crash_line")) & same_path(r["file"], F.col("crash_file")) & (F.coalesce("crash_function", F.lit("")).isin("") | (r["func"] == F.col("crash_function")))
    seen = lambda r: F.exists("frames", lambda x: (x["line"] == r["line"]) & (x["func"] == r["func"]) & same_path(x["file"], r["file"]))
    refs = F.coalesce(F.col("reference_frames"), F.array().cast("array<struct<func:string,file:string,line:int>>"))
    known = reduce(lambda a, b: a | b, (F.col("signature")[f].isNotNull() for f in sn.FIELDS))
    stack = F.size(F.filter(refs, lambda r: ~F.coalesce(own(r), F.lit(False)) & F.coalesce(seen(r), F.lit(False))))
    score = F.when(known, F.coalesce(sn.score(F.col("signature"), F.col("reference_signature")), F.lit(0)))
    listed = met.groupBy("_kind").agg(F.collect_list(F.struct("bug_id", score.alias("score"), stack.alias("stack"))).alias("all"))
    best = listed.withColumn("_best", F.array_max(F.transform("all", lambda x: x["score"])))
    best = best.withColumn("fit", F.filter("all", lambda x: F.col("_best").isNull() | ((F.col("_best") >= 0) & (x["score"] == F.col("_best")))))
    best = best.withColumn("fit", F.expr("if(size(all) = 1, all, filter(fit, x -> x.stack = array_max(transform(fit, y -> y.stack))))"))
    return crashes.select(key, "_kind").join(best.select("_kind", F.explode("fit.bug_id").alias("bug_id")), "_kind").select(key, "bug_id")


def fingerprint_matches(left: DataFrame, right: DataFrame, key: str, print_: str, bug: str) -> DataFrame:
    """Bugs with the same non-empty fingerprint, sorted (JOI-05)."""
    some = lambda df: df.where(F.size(print_) > 0)
    return some(left).join(some(right).select(print_, bug), print_).groupBy(key).agg(F.array_sort(F.collect_set(bug)).alias("bugs"))


def with_verdicts(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Adds verdict, shared_functions and shared_files for two logs: exact, partial, rejected or no_data (DOM-04)."""
    return verdicts(pairs.withColumns({"_a": fr.clean_frames(F.col(before)), "_b": fr.clean_frames(F.col(after)), "_ca": sn.crash_class(F.col(before))[0], "_cb": sn.crash_class(F.col(after))[0]}))


def parsed(logs: DataFrame, log: str, side: str) -> DataFrame:
    """A log's clean frames and class in place of its text, as verdicts() takes them for side `a` or `b`: parse before a join, once per log."""
    return logs.withColumns({f"_{side}": fr.clean_frames(F.col(log)), f"_c{side}": sn.crash_class(F.col(log))[0]}).drop(log)


def verdicts(out: DataFrame) -> DataFrame:
    """with_verdicts of pairs that hold parsed() columns of either side."""
    names = lambda x: F.array_distinct(F.transform(x, lambda f: f["func"]))
    files = lambda x: F.array_distinct(F.transform(x, lambda f: F.element_at(F.split(f["file"], "/"), -1)))
    out = out.withColumn("_f", F.array_intersect(names(F.col("_a")), names(F.col("_b")))).withColumn("_p", F.array_intersect(files(F.col("_a")), files(F.col("_b"))))
    top = lambda x: F.get(F.col(x), F.lit(0))["func"]
    same_top = F.coalesce((top("_a") == top("_b")) & (top("_a") != ""), F.lit(False))
    same_print = (F.size("_a") > 0) & (fr.fingerprint(F.col("_a")) == fr.fingerprint(F.col("_b")))
    same_class = F.col("_ca") == F.col("_cb")
    verdict = (
        F.when(F.col("_ca").isNull() | F.col("_cb").isNull(), "no_data")
        .when(same_class & same_top & same_print, "exact")
        .when(same_top, "partial")
        .when(same_class & ((F.size("_f") > 0) | (F.size("_p") > 0)), "partial")
        .when(F.size(F.array_remove("_f", fr.ENTRY_POINT)) >= 2, "partial")
        .otherwise("rejected")
    )
    return out.withColumn("verdict", verdict).withColumn("shared_functions", F.size("_f")).withColumn("shared_files", F.size("_p")).drop("_a", "_b", "_ca", "_cb", "_f", "_p")


def loose_match(before: Column, after: Column) -> Column:
    """Any shared function or file; a reference without either accepts all (SET-02)."""
    f, g = fr.crash_functions(before), fr.crash_files(before)
    return F.arrays_overlap(f, fr.crash_functions(after)) | F.arrays_overlap(g, fr.crash_files(after)) | ((F.size(f) == 0) & (F.size(g) == 0))


def strict_match(verdict: Column, loose: Column) -> Column:
    """exact or partial; without data the loose rule (DOM-05)."""
    return F.when(verdict == "no_data", loose).otherwise(verdict.isin("exact", "partial"))


def clusters(crashes: DataFrame, print_: str, kind: str, fuzzer: str, occurrences: str, state: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """By fingerprint: signatures, occurrences, fuzzers and the crash type that most signatures have, ties to the least name (AGG-07).

    state: also example, the first 120 characters of the first one in order that isn't empty, or an empty text.
    """
    kinds = crashes.groupBy(print_, kind).agg(F.count(F.lit(1)).alias("o")).groupBy(print_).agg(F.min(F.struct((-F.col("o")).alias("o"), kind)).alias("m"))
    sums = [F.count(F.lit(1)).alias("n_signatures"), F.sum(occurrences).alias("occurrences"), F.countDistinct(fuzzer).alias("n_fuzzers")]
    if state is not None:
        first = F.min(F.when(F.col(state) != "", F.struct(*order, F.substring(state, 1, 120).alias("_example"))))
        sums.append(F.coalesce(first["_example"], F.lit("")).alias("example"))
    all_ = crashes.groupBy(print_).agg(*sums)
    own = [F.col(c) for c in all_.columns if c != print_]
    return all_.join(kinds, all_[print_].eqNullSafe(kinds[print_])).select(all_[print_], *own, F.col(f"m.{kind}").alias("common_type"))


def representatives(crashes: DataFrame, keys: list[str], order: list[str], carry: str) -> DataFrame:
    """Counts per key with the value of the row that comes first (SRC-07)."""
    return crashes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order, carry)).alias("r")).select(*keys, "n", F.col(f"r.{carry}").alias(carry))
