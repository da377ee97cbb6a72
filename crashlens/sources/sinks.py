"""Writers and the frames that they write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.functions import bits, text
from crashlens.operators import blocks as blocked
from crashlens.operators import sequences


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns with a header, missing values blank (SNK-01)."""
    have = set(rows.columns)
    rows.select(*((F.col(c) if c in have else F.lit(None).cast("string").alias(c)) for c in columns)).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def bug_report(bugs: DataFrame, events: DataFrame) -> DataFrame:
    """One JSON row per bug with its sorted events (SNK-02). events: fuzzer, trial, bug_id, time_first_reached, time_first_triggered."""
    listed = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("fuzzer", "trial", F.col(c).alias("time")))))
    grouped = events.groupBy("bug_id").agg(listed("time_first_reached").alias("reached_by"), listed("time_first_triggered").alias("triggered_by"))
    full = bugs.join(grouped, "bug_id", "left")
    empty = F.array().cast("array<struct<fuzzer: string, trial: string, time: bigint>>")
    return full.withColumn("reached_by", F.coalesce("reached_by", empty)).withColumn("triggered_by", F.coalesce("triggered_by", empty)).select("bug_id", F.to_json(F.struct(*(F.col(c) for c in [*bugs.columns, "reached_by", "triggered_by"]))).alias("report"))


def bug_summary(bugs: DataFrame, events: DataFrame) -> DataFrame:
    """One row: total_bugs, bugs_with_crash_line, bugs_reached, bugs_triggered (SNK-02). bugs: bug_id, crash_line; events as in bug_report()."""
    seen = events.groupBy("bug_id").agg(F.count("time_first_reached").alias("r"), F.count("time_first_triggered").alias("t"))
    return bugs.join(seen, "bug_id", "left").agg(F.count(F.lit(1)).alias("total_bugs"), F.count("crash_line").alias("bugs_with_crash_line"), F.count_if(F.col("r") > 0).alias("bugs_reached"), F.count_if(F.col("t") > 0).alias("bugs_triggered"))


def bug_lines(bugs: DataFrame, events: DataFrame) -> DataFrame:
    """bug_id and its line of the readable report, in fixed columns (SNK-02): id, location cut to its last 50 characters, reached, triggered."""
    seen = events.groupBy("bug_id").agg(F.count("time_first_reached").alias("r"), F.count("time_first_triggered").alias("t"))
    place = F.when(F.coalesce("crash_line", F.lit(0)) != 0, F.concat_ws(":", "crash_file", F.col("crash_line").cast("string"))).otherwise("(no crash line)")
    yes = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, "yes").otherwise("no")
    wide = lambda c, n: F.when(F.char_length(c) < n, F.rpad(c, F.lit(n), F.lit(" "))).otherwise(c)
    line = F.concat_ws(" ", wide(F.col("bug_id"), 20), wide(text.right_cut(place, 50), 50), F.lpad(yes("r"), 8, " "), F.lpad(yes("t"), 10, " "))
    return bugs.join(seen, "bug_id", "left").select("bug_id", line.alias("line"))


def progress(results: DataFrame, ongoing: list[str]) -> DataFrame:
    """One row of a batch's progress (SNK-08): completed, skipped, ongoing, succeeded, failed, and the results as JSON by bug id. results: bug_id, status and more."""
    skipped = F.col("status") == "skipped"
    return results.agg(
        F.count_if(~skipped).alias("completed"), F.count_if(skipped).alias("skipped"), F.array(*(F.lit(x) for x in ongoing)).cast("array<string>").alias("ongoing"),
        F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status").isin("failed", "error")).alias("failed"),
        F.transform(F.array_sort(F.collect_list(F.struct("bug_id", F.to_json(F.struct(*results.columns)).alias("j")))), lambda x: x["j"]).alias("results"),
    )


def refreshed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old rows in which new ones replace the given columns where there are any (SNK-10)."""
    fresh = new.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_new"))
    out = old.join(fresh, key, "left")
    return out.select(*(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns))


def allow_list(functions: DataFrame) -> DataFrame:
    """Sorted distinct `fun:` lines and `src:*` at the end (SNK-05)."""
    rows = functions.select(F.concat(F.lit("fun:"), F.col("func")).alias("value"), F.lit(0).alias("o")).distinct()
    return rows.unionByName(functions.sparkSession.range(1).select(F.lit("src:*").alias("value"), F.lit(1).alias("o"))).orderBy("o", "value").select("value")


def upsert(earlier: DataFrame, folders: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """This run before the folders before earlier entries (SNK-07, DOM-08).

    A bug that its folder, or without one its earlier entry, says is impossible stays so. Rows of this run that were skipped or have no status
    change nothing. All three: key, status and any more columns, a row per key; of several the one with the least status counts.
    """
    rows = earlier.withColumn("_p", F.lit(2)).unionByName(folders.withColumn("_p", F.lit(1)), True)
    rows = rows.unionByName(current.where("status <> 'skipped'").withColumn("_p", F.lit(0)), True)
    known = F.min(F.when(F.col("_p") > 0, F.struct("_p", "status"))).over(Window.partitionBy(key))["status"]
    ranked = rows.withColumn("_p", F.when((F.col("_p") == 0) & (known == "impossible"), 3).otherwise(F.col("_p")))
    return sequences.first_wins(ranked, [key], ["_p", "status"]).drop("_p")


# Files that a bug's folder may hold, and reasons that are given for what it lacks.
IMPOSSIBLE = "bug_transplant.impossible"
CRASH = "transplant_crash.txt"
DIFFS = ("bug_transplant.diff", "git_diff.diff")
TESTCASE = "testcase-"
DONE = ("success", "impossible")


def folder_result(files: DataFrame, key: str) -> DataFrame:
    """key, status and reason of a bug from the files that its folder has (DOM-08). files: key, name and, if there is any, text (only that of IMPOSSIBLE is read), a row with null for a folder without any.

    A mark of being impossible comes before a crash, which is success; all else failed, for want of a crash or of anything at all.
    """
    has = lambda c: F.max(F.coalesce(c, F.lit(False)))
    name = F.col("name")
    written = F.regexp_replace("text", r"^\s+|\s+$", "") if "text" in files.columns else F.lit(None).cast("string")
    found = files.groupBy(key).agg(
        has(name == IMPOSSIBLE).alias("i"), has(name == CRASH).alias("c"), has(name.isin(*DIFFS)).alias("d"), has(name.startswith(TESTCASE)).alias("t"),
        F.min(F.when(name == IMPOSSIBLE, written)).alias("why"),
    )
    held = F.concat_ws(" and ", F.when(F.col("d"), "diff"), F.when(F.col("t"), "testcase"))
    reason = F.when(F.col("i"), F.col("why")).when(F.col("c"), F.lit(None)).when(held == "", "no artifacts").otherwise(F.concat(held, F.lit(" but no verified crash")))
    return found.select(key, F.when(F.col("i"), "impossible").when(F.col("c"), "success").otherwise("failed").alias("status"), reason.alias("reason"))


def resumed(folders: DataFrame, earlier: DataFrame, key: str) -> DataFrame:
    """Results of bugs that a resumed batch skips (DOM-08): an earlier one that was done as it was, another with the folder's status, and its reason if
    it has one, without an exit code or error once the folder says it is done; the folder's alone without an earlier one.

    folders: as folder_result() gives them; earlier: key, status, reason, exit_code, error_message, a row per key.
    """
    old = earlier.select(key, F.struct("status", "reason", "exit_code", "error_message").alias("_old"))
    done = lambda c: F.coalesce(c.isin(*DONE), F.lit(False))
    kept, now = done(F.col("_old.status")), done(F.col("status"))
    return folders.join(old, key, "left").select(
        key, F.when(kept, F.col("_old.status")).otherwise(F.col("status")).alias("status"), F.when(kept, F.col("_old.reason")).otherwise(F.coalesce("reason", "_old.reason")).alias("reason"),
        F.when(kept | ~now, F.col("_old.exit_code")).when(F.col("_old").isNotNull(), 0).alias("exit_code"), F.when(kept | ~now, F.col("_old.error_message")).alias("error_message"),
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: attempted, succeeded and failed bugs of a batch; impossible ones failed too, skipped ones weren't attempted (SNK-07)."""
    status = F.coalesce("status", F.lit(""))
    return results.agg(F.count_if(status != "skipped").alias("attempted"), F.count_if(status == "success").alias("succeeded"), F.count_if(status.isin("failed", "error", "impossible")).alias("failed"))


def metadata(results: DataFrame, lines: DataFrame, bug: str = "bug_id") -> DataFrame:
    """One row with the map of bugs: results left-joined with crash lines (SNK-09)."""
    joined = results.join(lines, bug, "left")
    value = F.struct(*(F.col(c) for c in joined.columns if c != bug))
    return joined.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(bug), value)))).alias("bugs"), F.count(F.lit(1)).alias("total_bugs"))


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """How many rows differ in any column, nulls compared too (SNK-10)."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return old.alias("o").join(new.alias("n"), key).agg(F.count_if(~same).alias("changed"))


def dispatch_bits(bugs: DataFrame, order: list, gated: str, by: tuple[str, ...] = (), blocks: int | None = None) -> DataFrame:
    """bit, dispatch_mask, its width mask_bytes, and dispatch_value for each bug (WIN-10). by: the project, if there are several.

    dispatch_mask is the bit as bytes, least first, as many as a project's bits need; without a gate the bit is null and the mask
    empty of bits. Masks of n bugs are n * n / 8 bytes: who needs only their width takes mask_bytes, and they aren't made. dispatch_value is the mask as a number, for the first 63 bits; null for a bit beyond. Without a project, and where
    `blocks` is given, bugs are numbered by ranges of the order in that many tasks; order must then tell all bugs apart.
    """
    out = bugs.withColumn("_gated", F.coalesce(F.expr(gated), F.lit(False)))
    if blocks or not by:
        rows = blocked.dealt(out.withColumn("_one", F.col("_gated").cast("int")), [*by, *order], blocks)
        out = blocked.running(rows, list(by), "_one", "_n").withColumn("bit", F.when(F.col("_gated"), (F.col("_n") - 1).cast("int")))
        counts = rows.groupBy("_block", *by).agg(F.sum("_one").alias("_here")).select("_block", *by, F.sum("_here").over(Window.partitionBy(*by)).alias("_bits"))
        out = blocked.joined(out, counts, list(by)).drop("_at", "_block", "_one", "_n")
        # masks are far wider than the rows they are made of
        out = out.repartition(blocks or int(bugs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    else:
        out = out.withColumn("bit", F.when(F.col("_gated"), F.row_number().over(Window.partitionBy(*by, "_gated").orderBy(*order)) - 1))
        out = out.withColumn("_bits", F.count("bit").over(Window.partitionBy(*by)))
    out = out.withColumn("dispatch_value", F.when(~F.col("_gated"), F.lit(0).cast("long")).when(F.col("bit") <= 62, F.expr("shiftleft(1L, bit)")))
    out = out.withColumn("mask_bytes", bits.byte_width(F.col("_bits")).cast("int"))
    return out.withColumn("dispatch_mask", bits.mask(F.col("bit"), F.col("mask_bytes"))).drop("_gated", "_bits")


def dispatch_state(numbered: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """next_bit and dispatch_bytes, one at least, of numbered bugs (WIN-10)."""
    return numbered.groupBy(*by).agg(F.count("bit").alias("next_bit")).withColumn("dispatch_bytes", bits.byte_width(F.col("next_bit")))


def document(title: str, sections: list[tuple[str, DataFrame | str]], limit: int = 1000) -> str:
    """A Markdown report of headings with tables or plain text (SNK-04). A table without rows says so; one over the limit raises an error."""
    out = [f"# {title}\n"]
    for heading, body in sections:
        table = body if isinstance(body, str) else markdown(body, limit)
        empty = not isinstance(body, str) and table.count("\n") == 2
        out.append(f"## {heading}\n\n{'Nothing.' if empty else table.rstrip()}\n")
    return "\n".join(out)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A small frame as a Markdown table (SNK-03, SNK-04). More rows than the limit raise an error: a report isn't cut in silence."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows; raise the limit or summarise first")
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in found)
