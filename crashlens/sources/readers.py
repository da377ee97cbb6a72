"""Readers: JSON, CSV, logs, traces, coverage, diffs and archives as frames with explicit schemas."""

from __future__ import annotations

import io
import tarfile
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashlens.functions import frames, sanitizer, text
from crashlens.sources import numbered

BUG = "struct<dispatch_value: bigint, triggered: boolean, crash_file: string, crash_line: int, crash_function: string>"
METADATA = f"project string, target_commit string, dispatch_bytes bigint, total_bugs bigint, bugs map<string, {BUG}>"
EVENT = "array<struct<fuzzer: string, trial: string, time: bigint>>"
REPORT = f"bugs map<string, struct<crash_file: string, crash_line: int, crash_function: string, dispatch_value: bigint, reached_by: {EVENT}, triggered_by: {EVENT}>>"
USAGE = "type string, payload struct<id: string>, item struct<type: string, text: string>, usage struct<input_tokens: bigint, cached_input_tokens: bigint, output_tokens: bigint>"
#: Fixed value: the line grammar of raw traces.
TRACE = r"offset: ([0-9a-f]+) called by: ([0-9a-f]+)"


def blank_to_null(column: str) -> Column:
    """'' and 'None' are missing values in CSV files (SRC-10)."""
    return F.nullif(F.nullif(F.col(column), F.lit("")), F.lit("None"))


def bug_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per bug, with its location text (SRC-08, SRC-09)."""
    rows = spark.read.schema(METADATA).json(path, multiLine=True).select("project", F.explode("bugs").alias("bug_id", "b")).select("project", "bug_id", "b.*")
    return rows.withColumn("location", text.location(F.col("crash_file"), F.col("crash_line")))


def with_references(bugs: DataFrame, logs: DataFrame) -> DataFrame:
    """Bugs with the frames and signature of their reference logs, null where there is none (SRC-08). logs: as reference_logs() gives them."""
    return bugs.join(logs.select("bug_id", F.col("frames").alias("reference_frames"), F.col("signature").alias("reference_signature")), "bug_id", "left")


def bug_report(spark: SparkSession, path: str) -> DataFrame:
    """fuzzer, trial, bug_id, time_first_reached, time_first_triggered from a nested report (SRC-11)."""
    bugs = spark.read.schema(REPORT).json(path, multiLine=True).select(F.explode("bugs").alias("bug_id", "b"))
    part = lambda k: bugs.select("bug_id", F.explode(f"b.{k}").alias("e"), F.lit(k).alias("kind"))
    events = part("reached_by").unionByName(part("triggered_by"))
    first = lambda k: F.min(F.when(F.col("kind") == k, F.col("e.time")))
    return events.groupBy("e.fuzzer", "e.trial", "bug_id").agg(first("reached_by").alias("time_first_reached"), first("triggered_by").alias("time_first_triggered"))


def csv(spark: SparkSession, path: str, columns: list[str], numbers: tuple[str, ...] = ()) -> DataFrame:
    """Columns of a CSV file by the names in its header; blank is null, as is a column that the file lacks; numbers are cast (SRC-10, SRC-14)."""
    rows = spark.read.csv(path, header=True)
    have = {x.strip().lstrip("\ufeff"): x for x in rows.columns}
    rows = rows.select(*((F.col(f"`{have[c]}`") if c in have else F.lit(None).cast("string")).alias(c) for c in columns))
    return rows.select(*((blank_to_null(c).try_cast("long") if c in numbers else blank_to_null(c)).alias(c) for c in columns))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """A commit by bug matrix as rows: commit, row, bug, status (SRC-12). row is the line's number below the header, whatever the file's size."""
    from crashlens.operators import rollups

    wide = numbered.csv_rows(spark, path).withColumnRenamed("commit id", "commit").select("commit", "row", "*")
    wide = wide.select("commit", "row", *(F.col(f"`{c}`") for c in wide.columns[2:] if c not in ("commit", "row")))
    return rollups.to_long(wide, ["commit", "row"])


def unmatched_keys(rows: DataFrame) -> DataFrame:
    """Distinct fuzzers and normalized keys (SRC-15)."""
    return rows.select("fuzzer", text.normal_key(F.col("crash_key")).alias("key")).distinct()


def builds(spark: SparkSession, path: str) -> DataFrame:
    """line, and the columns of a builds CSV file (SRC-13)."""
    return numbered.csv_rows(spark, path).withColumnRenamed("row", "line")


def build_commits(builds: DataFrame, wanted: DataFrame) -> DataFrame:
    """target, commit, oss_fuzz_commit, matched: for each row of wanted, repeated ones too, the first build of its project whose commit
    holds the wanted one or is held by it, else the project's last row with matched = false (SRC-13); none for an unknown project.

    builds: line, target, commit_id, oss_fuzz_commit; wanted: target, commit. Ids meet by lookup.containing(). Commits and builds
    are as many as the tables' rows, so they are merged; only each project's last row is small.
    """
    from crashlens.operators import lookup

    wanted = wanted.select("target", "commit")
    met = wanted.distinct().hint("merge").join(lookup.containing(wanted, builds, "commit", "commit_id"), "commit")
    met = met.hint("merge").join(builds.select("target", "commit_id", "line", "oss_fuzz_commit"), ["target", "commit_id"])
    first = met.groupBy("target", "commit").agg(F.min(F.struct("line", "oss_fuzz_commit"))["oss_fuzz_commit"].alias("_hit"), F.lit(True).alias("_matched"))
    last = builds.groupBy("target").agg(F.max(F.struct("line", "oss_fuzz_commit"))["oss_fuzz_commit"].alias("_last"))
    out = wanted.join(last, "target").hint("merge").join(first, ["target", "commit"], "left")
    return out.select("target", "commit", F.when(F.col("_matched"), F.col("_hit")).otherwise(F.col("_last")).alias("oss_fuzz_commit"), F.coalesce("_matched", F.lit(False)).alias("matched"))


def build_commit(builds: DataFrame, project: str, commit: str) -> DataFrame:
    """build_commits() of one commit: oss_fuzz_commit and matched (SRC-13)."""
    wanted = builds.sparkSession.createDataFrame([(project, commit)], "target string, commit string")
    return build_commits(builds, wanted).select("oss_fuzz_commit", "matched")


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """archive, file, file_pos (the file's place in the archive), line, count: the greatest count of segment starts that were hit (SRC-16);
    gzip is read as it is."""
    rows = spark.read.schema("data array<struct<files: array<struct<filename: string, segments: array<array<string>>>>>>").json(path)
    segments = rows.select(F.input_file_name().alias("archive"), F.posexplode(F.col("data")[0]["files"]).alias("file_pos", "f")).select("archive", "file_pos", F.col("f.filename").alias("file"), F.explode("f.segments").alias("s"))
    hit = (F.get("s", F.lit(3)).isin("true", "1")) & (F.get("s", F.lit(2)).try_cast("long") > 0)
    return segments.where(hit).groupBy("archive", "file", "file_pos", F.get("s", F.lit(0)).try_cast("int").alias("line")).agg(F.max(F.get("s", F.lit(2)).try_cast("long")).alias("count"))


def first_covered(lines: DataFrame, bugs: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest snapshot in which a bug's line is covered; of the files an archive has for a bug only the first one counts (JOI-08).

    lines: keys, archive, file, file_pos, line, time, as coverage() gives them with its archives' keys and times; bugs: bug_id,
    crash_file, crash_line. Either path may be a suffix of the other: distinct file names meet by the index of affix_pairs().
    """
    from crashlens.operators import lookup

    names = lookup.affix_pairs(lines, bugs, "file", "crash_file", ends=True).join(bugs.select("bug_id", "crash_file"), "crash_file").select("file", "bug_id")
    files = lines.select(*keys, "archive", "file", "file_pos", "time").distinct().join(names, "file")
    chosen = files.groupBy(*keys, "archive", "time", "bug_id").agg(F.min(F.struct("file_pos", "file")).alias("x")).select(*keys, "archive", "time", "bug_id", F.col("x.file").alias("file"))
    hit = chosen.join(bugs.select("bug_id", "crash_line"), "bug_id").join(lines.select(*keys, "archive", "file", F.col("line").alias("crash_line")), [*keys, "archive", "file", "crash_line"], "left_semi")
    return hit.groupBy(*keys, "bug_id").agg(F.min("time").alias("first_time"))


def reference_logs(spark: SparkSession, path: str, own: str | None = None) -> DataFrame:
    """Whole crash logs by bug id: frames (those below `own`, if there are any), signature, fingerprints, error class (SRC-20..22)."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("bug_id"), F.col("value").alias("log"))
    all_ = frames.strict_frames(F.col("log"))
    kept = F.filter(all_, lambda x: x["file"].contains(own)) if own else all_
    loose = frames.loose_frames(F.col("log"))
    return rows.select(
        "bug_id", F.when(F.size(kept) > 0, kept).otherwise(all_).alias("frames"), sanitizer.signature(F.col("log")).alias("signature"), frames.fingerprint(loose).alias("loose"),
        frames.fingerprint(loose, 3, True).alias("strict"), sanitizer.error_class(F.col("log")).alias("error_class"),
    )


def raw_trace(lines: DataFrame) -> DataFrame:
    """offset and caller from lines (pos, value, and file where there are several) of raw traces, beside what lines have (SRC-23, SRC-42)."""
    return lines.where(F.col("value").rlike(TRACE)).select(*(c for c in lines.columns if c != "value"), F.regexp_extract("value", TRACE, 1).alias("offset"), F.regexp_extract("value", TRACE, 2).alias("caller"))


def trace_offsets(calls: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct offsets of a raw trace (SRC-23), each with the place where it first stands. calls: as raw_trace() gives them; by: the file, where there are several."""
    return calls.groupBy(*by, "offset").agg(F.min("pos").alias("pos"))


def trace_callees(calls: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """caller and the offsets that it called, in order, repeats too (SRC-23)."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "offset")))
    return calls.groupBy(*by, "caller").agg(F.transform(listed, lambda x: x["offset"]).alias("callees"))


def entered(lines: DataFrame) -> DataFrame:
    """func and location from lines (pos, value, and file where there are several) of symbolised traces, beside what lines have (SRC-24, SRC-25)."""
    form = r"^Entering function: (.*?) Location: (.*)$"
    return lines.where(F.col("value").rlike(form)).select(*(c for c in lines.columns if c != "value"), F.regexp_extract("value", form, 1).alias("func"), F.regexp_extract("value", form, 2).alias("location"))


def call_graph(lines: DataFrame, trace: str) -> DataFrame:
    """caller and callee from the section before the first entered function (SRC-26, GRF-02). lines: trace, pos, value."""
    w = Window.partitionBy(trace).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    caller = F.nullif(F.regexp_extract("value", r"^Caller:\s+\('([^']+)'", 1), F.lit(""))
    callee = F.nullif(F.regexp_extract("value", r"^\s+->\s+Callee:\s+\('([^']+)'", 1), F.lit(""))
    rows = lines.withColumn("over", F.max(F.startswith("value", F.lit("Entering function")).cast("int")).over(w)).withColumn("caller", F.last(caller, ignorenulls=True).over(w)).withColumn("callee", callee)
    return rows.where("over = 0 and caller is not null and callee is not null").select(trace, "caller", "callee").distinct()


def agent_log(lines: DataFrame, key: str) -> DataFrame:
    """Tokens, first session id and messages of JSON lines (key, pos, value); malformed lines are skipped (SRC-27, SRC-28)."""
    rows = lines.withColumn("j", F.from_json("value", USAGE, {"mode": "PERMISSIVE"}))
    use = lambda f: F.coalesce(F.sum(f"j.usage.{f}"), F.lit(0)).alias(f)
    session = F.min(F.when(F.col("j.type") == "session_meta", F.struct("pos", F.col("j.payload.id").alias("id"))))
    return rows.groupBy(key).agg(use("input_tokens"), use("cached_input_tokens"), use("output_tokens"), session["id"].alias("session"), F.count_if(F.col("j.item.type") == "agent_message").alias("messages"))


def project_list(lines: DataFrame) -> DataFrame:
    """Trimmed lines without blanks and comments (SRC-32)."""
    return lines.select(F.trim("value").alias("project")).where("project <> '' and not startswith(project, '#')")


#: Names under which bug lists hold a field.
PROJECT_KEYS = ("Project", "project", "project_name")
TARGET_KEYS = ("Fuzz Target", "Fuzz target", "fuzz_target", "fuzz target", "FuzzTarget")
DETAIL_KEYS = ("Detailed Report", "detailed report", "detailed_report", "detailedReport", "detail", "url")
JOB_KEYS = ("Job Type", "job_type", "JobType")
UNKNOWN_TARGET = "<unknown>"


def keyed_bugs(files: DataFrame) -> DataFrame:
    """project, target, job_type, id of JSON objects by bug id (SRC-33). files: value, a whole file each. Entries without a project go."""
    entries = files.select(F.explode(F.from_json("value", "map<string, string>")).alias("id", "entry"))
    pick = lambda keys, at="$": F.coalesce(*(F.nullif(F.trim(F.get_json_object("entry", f"{at}['{k}']")), F.lit("")) for k in keys))
    both = lambda keys: F.coalesce(pick(keys, "$['reproduce']"), pick(keys, "$['Reproduce']"), pick(keys))
    rows = entries.where(F.startswith(F.ltrim("entry"), F.lit("{"))).select(both(PROJECT_KEYS).alias("project"), F.coalesce(both(TARGET_KEYS), F.lit(UNKNOWN_TARGET)).alias("target"), F.coalesce(both(JOB_KEYS), F.lit("")).alias("job_type"), F.trim("id").alias("id"))
    return rows.where("project is not null and id <> ''")


def listed_bugs(files: DataFrame) -> DataFrame:
    """The same of lists of records, bare or below `results` or `items`; the id is the report's address, else a running number (SRC-33)."""
    arrays = F.coalesce(*(F.from_json(x, "array<string>") for x in (F.get_json_object("value", "$.results"), F.get_json_object("value", "$.items"), F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.col("value")))))
    rows = files.select(F.posexplode(arrays).alias("i", "entry"))
    pick = lambda keys: F.coalesce(*(F.nullif(F.trim(F.get_json_object("entry", f"$['{k}']")), F.lit("")) for k in keys))
    id_ = F.coalesce(pick(DETAIL_KEYS), text.first_url(F.col("entry")), F.concat(F.lit("__NO_DETAILED_REPORT__#"), (F.col("i") + 1).cast("string")))
    return rows.select(pick(PROJECT_KEYS).alias("project"), F.coalesce(pick(TARGET_KEYS), F.lit(UNKNOWN_TARGET)).alias("target"), F.coalesce(pick(JOB_KEYS), F.lit("")).alias("job_type"), id_.alias("id")).where("project is not null")


def bug_list(keyed: DataFrame, listed: DataFrame) -> DataFrame:
    """The id-keyed form; the list form only if the first has no rows (SRC-33)."""
    from crashlens.operators import lookup

    return lookup.with_fallback(keyed, listed)


def commit_range(edges: DataFrame, commits: DataFrame, start: str, end: str) -> DataFrame:
    """Commits between two, on paths that join them, both included; if the first is no ancestor of the last, those at times strictly
    between theirs (SRC-34). edges: child, parent; commits: commit, ts. Paths come from the chains of graphs.history()."""
    from crashlens.operators import graphs, lookup

    ends = edges.sparkSession.createDataFrame([(0, start, end)], "key int, first string, last string")
    path = graphs.between(graphs.history(edges), ends).select("commit")
    times = commits.where(F.col("commit").isin(start, end)).agg(F.min("ts").alias("x"), F.max("ts").alias("y"))
    window = commits.join(F.broadcast(times), F.expr("ts > x and ts < y")).select("commit")
    return lookup.with_fallback(path, window)


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """file, directory, arguments; the last entry of a file counts (SRC-36)."""
    rows = spark.read.schema("directory string, file string, command string, arguments array<string>").json(path, multiLine=True).withColumn("i", F.monotonically_increasing_id())
    full = F.when(F.startswith("file", F.lit("/")), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))
    rows = rows.select(full.alias("file"), "directory", F.coalesce("arguments", F.split(F.trim("command"), r"\s+")).alias("arguments"), "i")
    return rows.groupBy("file").agg(F.max(F.struct("i", "directory", "arguments")).alias("x")).select("file", "x.directory", "x.arguments")


MEMBERS = T.StructType([T.StructField("path", T.StringType()), T.StructField("member", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.LongType()), T.StructField("head", T.BinaryType())])


def _unpacker(head: int):
    """Members of whole archives (path, content), with their first bytes."""

    def unpack(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                own = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                        for m in archive:
                            if m.isfile():
                                own.append((name, m.name, m.size, int(m.mtime), archive.extractfile(m).read(head)))
                except (tarfile.TarError, EOFError, OSError, zlib.error):
                    continue
                rows += own
            yield pd.DataFrame(rows, columns=[f.name for f in MEMBERS])

    return unpack


def archive_members(spark: SparkSession, path: str, head: int = 64) -> DataFrame:
    """Files in tar.gz archives with their first bytes (SRC-17, SRC-19). An archive that is corrupt or cut off has no members at all; an archive is read in one task."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_unpacker(head), MEMBERS)


def corpus_inputs(spark: SparkSession, root: str, n_bytes: int) -> DataFrame:
    """fuzzer, trial, time, head of the inputs in corpora below root (SRC-18): members of `.../<fuzzer>/trial-<n>/corpus/*.tar.gz` at the
    archive's time, and files of `corpus/<time>/`, at their own time where the folder's name is no number."""
    place = r"([^/]+)/trial-(\d+)/corpus/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").rlike(place))
    own = [F.regexp_extract("path", place, 1).alias("fuzzer"), F.regexp_extract("path", place, 2).alias("trial")]
    packed = files.where("path like '%.tar.gz'")
    members = packed.select("path", "content").mapInPandas(_unpacker(n_bytes), MEMBERS).select("path", "head").join(packed.select("path", "modificationTime"), "path")
    members = members.select(*own, F.unix_seconds("modificationTime").alias("time"), "head")
    plain = files.where("path not like '%.tar.gz'").where(F.col("path").rlike(place + r"[^/]+/[^/]+$"))
    folder = F.regexp_extract("path", place + r"([^/]+)/", 3).try_cast("long")
    return members.unionByName(plain.select(*own, F.coalesce(folder, F.unix_seconds("modificationTime")).alias("time"), F.substring("content", 1, n_bytes).alias("head")))


def benchmark_dirs(files: DataFrame) -> DataFrame:
    """Names of folders with `_transplant_` in them that hold a bug_metadata.json (SRC-43). files: path."""
    return files.select(F.regexp_extract("path", r"([^/]*_transplant_[^/]*)/bug_metadata\.json$", 1).alias("benchmark")).where("benchmark <> ''").distinct()


def archive_census(members: DataFrame) -> DataFrame:
    """Archives, members, and non-empty crash members by fuzzer (SRC-19). members: fuzzer, path, member, size."""
    crash = F.element_at(F.split("member", "/"), -1).startswith("crash-") & (F.col("size") > 0)
    return members.groupBy("fuzzer").agg(F.countDistinct("path").alias("archives"), F.count(F.lit(1)).alias("members"), F.count_if(crash).alias("crashes"))


def member_prefixes(members: DataFrame) -> DataFrame:
    """prefix, of a member's file name up to its first hyphen, and n (SRC-19). members: member."""
    return members.groupBy(F.split_part(F.element_at(F.split("member", "/"), -1), F.lit("-"), F.lit(1)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def member_samples(members: DataFrame, k: int = 8) -> DataFrame:
    """The first k members by archive and name (SRC-19): a report's examples."""
    return members.select("path", "member", "size").orderBy("path", "member").limit(k)


#: The headings, table rules and sentence of a duplication report.
LEVEL_1 = r"(?s)## Level 1.*?\| raw OSV ids \|.*?\n\| ---: \|.*?\n\| (\d+) \| (\d+) \| (\d+) \|"
CRASHES = r"(?s)## Crashes.*?unique FuzzBench `crash_key`s.*?\n\| ---: \|.*?\n\| (\d+) \| (\d+) \| (\d+) \| (\d+) \|"
OCCURRENCES = r"\*\*([\d,]+) total (?:unmatched )?crash occurrences\*\*"
SHARED = r"(?s)Bugs that share a top-3 `\(function, file\)` fingerprint\n\n\| top-3.*?\n\| --- \|.*?\n\| `([^`]+)` \| ([^|]+?) \| (\d+) \|"


def markdown_report(spark: SparkSession, path: str) -> DataFrame:
    """A duplication report's counts (SRC-38): bugs by id and by two keys, crashes by the same and those that match a bug, occurrences,
    and the first group of bugs that share a fingerprint. A missing section gives nulls; without the first one all are null."""
    part = lambda p, g: F.nullif(F.regexp_extract("value", p, g), F.lit(""))
    whole = F.col("value").rlike(LEVEL_1)
    number = lambda p, g: F.when(whole, F.replace(part(p, g), F.lit(","), F.lit("")).try_cast("long"))
    names = [("bugs", LEVEL_1, 1), ("bugs_ff", LEVEL_1, 2), ("bugs_ffl", LEVEL_1, 3), ("crashes", CRASHES, 1), ("crashes_ff", CRASHES, 2), ("crashes_ffl", CRASHES, 3), ("crashes_matched", CRASHES, 4), ("occurrences", OCCURRENCES, 1)]
    example = F.when(whole & F.col("value").rlike(SHARED), F.struct(F.trim(part(SHARED, 1)).alias("chain"), F.trim(part(SHARED, 2)).alias("ids"), number(SHARED, 3).alias("n")))
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), *(number(p, g).alias(n) for n, p, g in names), example.alias("example"))


def fuzzer_dirs(files: DataFrame, benchmark: str) -> DataFrame:
    """fuzzer and trial of a benchmark's files (path) below `experiment-folders`: nested `benchmark/fuzzer/trial-n` if there is any, else
    flat `benchmark-fuzzer/trial-n`, names with hyphens whole (SRC-39)."""
    below = F.split_part(F.concat(F.lit("/"), F.regexp_replace("path", "^/+", "")), F.lit("/experiment-folders/"), F.lit(2))
    parts = files.withColumn("_p", F.split(below, "/")).where(F.size("_p") > 2)
    top = F.get("_p", F.lit(0))
    nested = (top == benchmark) & F.get("_p", F.lit(2)).rlike(r"^trial-\d+$")
    flat = F.startswith(top, F.lit(f"{benchmark}-")) & (F.char_length(top) > len(benchmark) + 1) & F.get("_p", F.lit(1)).rlike(r"^trial-\d+$")
    rows = parts.withColumn("_layout", F.when(nested, 0).when(flat, 1)).where("_layout is not null")
    best = rows.agg(F.min("_layout").alias("_least"))
    fuzzer = F.when(F.col("_layout") == 0, F.get("_p", F.lit(1))).otherwise(F.substr(top, F.lit(len(benchmark) + 2)))
    trial = F.split_part(F.when(F.col("_layout") == 0, F.get("_p", F.lit(2))).otherwise(F.get("_p", F.lit(1))), F.lit("-"), F.lit(2))
    return rows.join(F.broadcast(best), F.expr("_layout = _least")).select(F.lit(benchmark).alias("benchmark"), fuzzer.alias("fuzzer"), trial.alias("trial"), "path")


def only_prefix(names: DataFrame, default: str) -> DataFrame:
    """The one prefix before the last dash that all names have, else the default (SRC-41)."""
    prefix = F.nullif(F.regexp_extract("name", r"^(.*)-[^-]*$", 1), F.lit(""))
    return names.agg(F.when(F.countDistinct(prefix) == 1, F.max(prefix)).otherwise(default).alias("benchmark"))


def saved_ids(spark: SparkSession, path: str) -> DataFrame:
    """project and id from saved batch answers (SRC-30)."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("project", "ids")).select("project", F.explode("ids").alias("id"))
