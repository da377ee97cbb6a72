"""Experiments, groups, patches, report blocks and their files on small inputs."""

import gzip
import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from crashlens.functions import text
from crashlens.operators import graphs, grouping, matching, patches, sequences, trials
from crashlens.sources import readers, sinks
from crashlens.streaming import watch


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_csv_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("trial,fuzzer,time\n1,a,5\n2,b,None\n")
    got = readers.csv(spark, str(tmp_path / "t.csv"), ["fuzzer", "trial", "time", "more"], ("trial", "time"))
    assert [tuple(r) for r in got.collect()] == [("a", 1, 5, None), ("b", 2, None, None)]


def test_cut_archives_have_no_members(spark, tmp_path):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for i in range(50):
            info = tarfile.TarInfo(f"crash-{i}")
            info.size = 2000
            t.addfile(info, io.BytesIO(os.urandom(2000)))
    (tmp_path / "cut.tar.gz").write_bytes(gzip.compress(raw.getvalue())[:60_000])
    assert readers.archive_members(spark, str(tmp_path / "*.tar.gz")).count() == 0


def test_empty_function_matches_any(spark):
    crashes = frame(spark, [(1, [("f", "/src/p/lib/a.c", 5)]), (2, [("g", "a.c", 5)])], "event_id int, frames array<struct<func:string,file:string,line:int>>")
    targets = frame(spark, [("x", "lib/a.c", 5, ""), ("y", "lib/a.c", 5, None), ("z", "lib/a.c", 5, "g"), ("s", "a.c", 5, "f"), ("t", "/x/src/p/lib/a.c", 5, "f")], "bug_id string, crash_file string, crash_line int, crash_function string")
    got = {tuple(r) for r in matching.candidates(crashes, targets, "event_id").collect()}
    assert got == {(1, "x"), (1, "y"), (1, "s"), (1, "t"), (2, "x"), (2, "y"), (2, "z")}


def test_streams_stop_at_the_first_hit(spark, tmp_path):
    for i in range(30):
        spark.range(i, i + 1).write.mode("append").parquet(str(tmp_path / "s"))
    rows = watch.stream(spark, str(tmp_path / "s"), "*.parquet", "id bigint", 1)
    seen = []
    counted = rows.select("id", F.lit(1).alias("one"))
    assert len(watch.until_match(counted, "id >= 0", 60, ["id"])) == 1
    assert watch.until_match(counted, "id > 99", 60, ["id"]) == seen
    with pytest.raises(Exception, match="(?i)nothing"):
        watch.until_match(counted, "nothing > 0", 60, ["id"])


def test_crash_scan_and_times(spark):
    crashes = frame(spark, [(1, 5, None), (2, 6, "x"), (3, 7, "y")], "trial_id int, time int, crash_stacktrace string")
    own = frame(spark, [(1, "f", "b", 0), (2, "f", "b", 1), (3, "g", "c", 0)], "id int, fuzzer string, benchmark string, preempted int")
    assert [tuple(r) for r in trials.crash_scan(crashes, own, "b").collect()] == [("f", 1, 5, "")]
    assert trials.crash_scan(crashes, own, keep_preempted=True).count() == 3
    times = frame(spark, [(1, 9), (1, 3), (2, None)], "trial_id int, time int")
    assert {r.trial: r.times for r in trials.snapshot_times(times).collect()} == {1: [3, 9], 2: []}


def test_experiment_start(spark):
    rows = ["2024-01-02T03:04:05", "2024-01-02 03:04:05.5", "2024-01-02T03:04:05+01:00", "2024-01-02T03:04:05Z", "soon", None]
    got = [r[0] for r in frame(spark, [(i, x) for i, x in enumerate(rows)], "i int, t string").orderBy("i").select(trials.epoch_seconds(F.col("t"))).collect()]
    assert got == [1704164645.0, 1704164645.5, 1704161045.0, 1704164645.0, None, None]
    assert trials.experiment_start(frame(spark, [], "time_created string")).first().start is None


def test_corpus(spark, tmp_path):
    base = tmp_path / "b" / "afl" / "trial-7" / "corpus"
    (base / "900").mkdir(parents=True)
    (base / "900" / "in").write_bytes(b"\x01\x00rest")
    (base / "900" / "short").write_bytes(b"\x04")
    with tarfile.open(base / "z.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("q")
        info.size = 2
        t.addfile(info, io.BytesIO(b"\x01\x02"))
    os.utime(base / "z.tar.gz", (500, 500))
    inputs = readers.corpus_inputs(spark, str(tmp_path), 2)
    assert sorted((r.fuzzer, r.trial, r.time, bytes(r.head)) for r in inputs.collect()) == [("afl", "7", 500, b"\x01\x02"), ("afl", "7", 900, b"\x01\x00"), ("afl", "7", 900, b"\x04")]
    bugs = frame(spark, [("one", 1), ("nine", 512), ("two", 4), ("always", 0)], "bug_id string, dispatch_value long")
    got = {(r.bug_id, r.first_time) for r in trials.corpus_snapshots(inputs, bugs, 2).collect()}
    assert got == {("one", 500), ("nine", 500), ("always", 500)}


def test_selectable_and_log_pairs(spark):
    bugs = frame(spark, [("a", "asan_i386_x", "t", "address (ASAN)"), ("b", "asan_x", "t", "address (ASAN)"), ("c", "asan_x", "u", "address"), ("d", "asan_x", "t", "memory")], "bug_id string, job_type string, fuzz_target string, sanitizer string")
    wanted = frame(spark, [("a",), ("b",), ("c",), ("d",), ("e",)], "bug_id string")
    assert sorted(r.bug_id for r in trials.selectable(bugs, wanted, "t").collect()) == ["b", "d"]
    assert [r.bug_id for r in trials.selectable(bugs, wanted, "t", "address").collect()] == ["b"]
    logs = frame(spark, [("a", "x")], "bug_id string, log string")
    both = {r.bug_id: r.note for r in trials.log_pairs(wanted, logs, logs.unionByName(frame(spark, [("b", "y")], "bug_id string, log string")), ["bug_id"]).collect()}
    assert both == {"a": None, "b": "missing_log", "c": "missing_log", "d": "missing_log", "e": "missing_log"}


def test_blockers(spark):
    applied = frame(spark, [("a", ["f", "g"], ["x.c"]), ("b", ["h"], ["x.c", "y.c"])], "bug_id string, functions array<string>, files array<string>")
    one = lambda c, *x: frame(spark, [(v,) for v in x], f"{c} string")
    assert [tuple(r) for r in trials.blockers(one("func", "g", "f"), one("file", "x.c"), applied).collect()] == [("a", "functions", ["f", "g"])]
    assert sorted(tuple(r) for r in trials.blockers(one("func", "z"), one("file", "x.c"), applied).collect()) == [("a", "files", ["x.c"]), ("b", "files", ["x.c"])]


def test_groups(spark):
    bugs = frame(spark, [("b", "x.c", 1, "f"), ("a", "x.c", 1, "f"), ("c", "", None, ""), ("d", None, None, None), ("e", "", 4, None)], "bug_id string, crash_file string, crash_line int, crash_function string")
    groups, opaque = grouping.by_location(bugs)
    assert [r.bugs for r in grouping.largest_first(groups, "crash_file", "crash_line").collect()] == [["a", "b"], ["e"]]
    assert sorted(r.bug_id for r in opaque.collect()) == ["c", "d"]
    kind = "array<struct<func:string,file:string,line:int>>"
    stacks = frame(spark, [("a", [("f", "x.c", 1), ("g", "x.c", 2)]), ("b", [("f", "x.c", 9), ("g", "x.c", 2)]), ("c", [])], f"bug_id string, frames {kind}")
    assert [r.bugs for r in grouping.by_fingerprint(stacks).collect()] == [["a", "b"]] and grouping.by_fingerprint(stacks, 3, True).count() == 2
    index = grouping.state_index(stacks)
    crashes = frame(spark, [(1, "f\n g"), (2, "f")], "i int, crash_state string")
    assert {r.i: r.bugs for r in grouping.with_state(crashes, index).collect()} == {1: ["a", "b"], 2: None}
    keyed = frame(spark, [(1, "f", "a\nb"), (2, "g", "a\nb")], "i int, fuzzer string, crash_key string")
    keys = readers.unmatched_keys(frame(spark, [("f", "a\nb"), ("f", "a\nb")], "fuzzer string, crash_key string"))
    assert keys.count() == 1 and [r.i for r in grouping.known(keyed, keys).collect()] == [1]


def test_added_blocks(spark):
    diff = "\n".join(["+++ ignored", "+++ b/a.c", "+no hunk yet", "@@ -1,2 +10,4 @@", " x", "+a", "+b", "-c", "+d", "\\ No newline", "+e", "@@ -9 +40 @@", "+f", "--- a/b.txt", "+++ b/b.txt", "@@ -1 +1 @@", "+t", "+++ b/c.h", "@@ -0,0 +1 @@", "+h"])
    diffs = frame(spark, [("d", diff), ("e", None), ("f", "")], "key string, diff string")
    got = sorted(tuple(r) for r in patches.added_blocks(diffs, "key", "diff").collect())
    assert got == [("d", "a.c", 11, 2), ("d", "a.c", 13, 1), ("d", "a.c", 15, 1), ("d", "a.c", 40, 1), ("d", "c.h", 1, 1)]
    assert patches.added_blocks(diffs, "key", "diff", None).count() == 6


def test_continued_blocks(spark):
    lines = ["a = b \\", "x_SOURCES = 1 \\", "  2 \\ ", "y_SOURCES = 3", "z_SOURCES += 4", "w_SOURCES := \\"]
    got = patches.continued_blocks(frame(spark, [("m", i, v) for i, v in enumerate(lines)], "key string, pos int, value string"), "key")
    assert sorted(tuple(r) for r in got.collect()) == [("m", 1, 3), ("m", 4, 4), ("m", 5, 5)]


def test_report_block(spark):
    def parse(block):
        r = frame(spark, [(block,)], "b string").select(text.report_block(F.col("b")).alias("r")).first().r
        return dict(r.fields), r.crash_state, r.extra

    assert parse("Detailed Report: u\n\nnote\nA: 1\nA: 2\nCrash State:\n f1 \n  f2\nB: 3\n f3\n\nC: 4\nx") == ({"Detailed Report": "u", "A": "2", "B": "3"}, ["f1", "f2", "f3"], "note")
    assert parse("A: 1\n\nB: 2\nfree") == ({"A": "1", "B": "2"}, None, "free")
    assert parse("Crash State:\n\nA: 1") == ({}, None, None) and parse("") == ({}, None, None) and parse(None) == ({}, None, None)
    urls = frame(spark, [("see https://a.b/c?d=1 now",), ("none",)], "t string").select(text.first_url(F.col("t")).alias("u"))
    assert [r.u for r in urls.collect()] == ["https://a.b/c?d=1", None]


def test_renamed_prefix_and_sources(spark):
    make = lambda xs: frame(spark, [("s", i, v) for i, v in enumerate(xs)], "g string, pos int, v string")
    a, b = make(["f x", "g", "old", "h", "k"]), make(["f y", "__revert_g", "new", "z", "k"])
    pairs = frame(spark, [("new", "old")], "old string, new string")
    assert sequences.common_prefix(a, b, ["g"], "pos", "v").count() == 2
    assert sequences.common_prefix(a, b, ["g"], "pos", "v", pairs).count() == 3
    rows = frame(spark, [("x", "aaa1", "1|1", 2, 1), ("x", "bbb2", "1|0", 2, 2), ("x", "ttt3", "0|0", 0, 3), ("y", "ttt3", "0.5|0", 0, 3), ("z", "aaa1", "0|1", 0, 1), ("z", "ttt3", "0|0", 0, 3), ("w", "bbb2", "0.5|1", 1, 2), ("w", "ttt3", None, 0, 3)], "bug string, commit string, status string, rank int, row int")
    line = frame(spark, [("bbb2", "aaa1"), ("ttt3", "bbb2")], "child string, parent string")
    assert {r.bug: r.commit for r in graphs.best_sources(rows).collect()} == {"x": "aaa1", "w": "bbb2"}
    assert {r.bug: r.commit for r in graphs.best_sources(rows, line).collect()} == {"x": "bbb2", "w": "bbb2"}
    known = frame(spark, [("x", "aaa"), ("w", "")], "bug string, introduced string")
    got = {r.bug: (r.state, r.source) for r in sequences.transplant_plan(rows, "ttt3", known, line).collect()}
    assert got == {"x": ("needed", "aaa1"), "y": ("triggered", None), "z": ("unusable", None), "w": ("needed", "bbb2")}


def test_bug_lists(spark, tmp_path):
    keyed = {"OSV-1": {"reproduce": {"project": " p ", "fuzz_target": "t", "job_type": "j"}}, "OSV-2": {"Project": "q"}, "OSV-3": {"x": 1}, "OSV-4": "text"}
    listed = {"results": [{"Project": "p", "Fuzz Target": "t", "url": "https://x/1"}, {"project": "q", "note": "at https://x/2 "}, {"project": "r"}, {"x": 1}]}
    one = lambda v: frame(spark, [(json.dumps(v),)], "value string")
    assert sorted(tuple(r) for r in readers.keyed_bugs(one(keyed)).collect()) == [("p", "t", "j", "OSV-1"), ("q", "<unknown>", "", "OSV-2")]
    want = [("p", "t", "", "https://x/1"), ("q", "<unknown>", "", "https://x/2"), ("r", "<unknown>", "", "__NO_DETAILED_REPORT__#3")]
    for form in (listed, listed["results"], {"items": listed["results"]}):
        assert sorted(tuple(r) for r in readers.listed_bugs(one(form)).collect()) == want
    assert readers.bug_list(readers.keyed_bugs(one(keyed)), readers.listed_bugs(one(keyed))).count() == 2
    assert readers.bug_list(readers.keyed_bugs(one(listed)), readers.listed_bugs(one(listed))).count() == 3


def test_folders_and_markdown(spark, tmp_path):
    paths = frame(spark, [("/r/p_transplant_x/bug_metadata.json",), ("/r/p_transplant_y/other.json",), ("/r/z/bug_metadata.json",)], "path string")
    assert [r.benchmark for r in readers.benchmark_dirs(paths).collect()] == ["p_transplant_x"]
    report = """# Duplication
## Level 1 — duplication inside the merge bug set
| raw OSV ids | (function, file) | (function, file, line) |
| ---: | ---: | ---: |
| 21 | 14 | 17 |
### Bugs that share a top-3 `(function, file)` fingerprint

| top-3 chain | ids | n |
| --- | --- | ---: |
| `f > g > h` | OSV-1, OSV-2 | 2 |
## Crashes
| unique FuzzBench `crash_key`s | a | b | c |
| ---: | ---: | ---: | ---: |
| 300 | 40 | 50 | 6 |
These represent **4,316 total crash occurrences** in 3 trials.
"""
    texts = {"a": report, "b": report.replace("**4,316 total crash", "**12 total unmatched crash").split("### Bugs")[0] + "**12 total unmatched crash occurrences**", "c": "## Crashes\n**5 total crash occurrences**"}
    for name, value in texts.items():
        (tmp_path / f"{name}.md").write_text(value)
    got = {r.path[-4]: tuple(r)[1:] for r in readers.markdown_report(spark, str(tmp_path / "*.md")).collect()}
    assert got["a"] == (21, 14, 17, 300, 40, 50, 6, 4316, ("f > g > h", "OSV-1, OSV-2", 2))
    assert got["b"] == (21, 14, 17, None, None, None, None, 12, None) and got["c"] == (None,) * 9
    rows = frame(spark, [("/src/p/a.c:1",), ("/x/a.c",)], "p string").select(text.relative_location(F.col("p"), "/src/p/").alias("p"))
    assert [r.p for r in rows.collect()] == ["a.c:1", "/x/a.c"]
    assert sinks.markdown(frame(spark, [(1, None)], "a int, b int")) == "| a | b |\n|---|---|\n| 1 |  |\n"
    with pytest.raises(ValueError, match="limit"):
        sinks.markdown(spark.range(5), 4)


def test_report_sinks(spark):
    bugs = frame(spark, [("b1", "dir/" + "x" * 60 + ".c", 7), ("b2", None, None)], "bug_id string, crash_file string, crash_line int")
    events = frame(spark, [("f", "1", "b1", 4, None), ("f", "2", "b1", None, 9), ("f", "3", "b1", None, None)], "fuzzer string, trial string, bug_id string, time_first_reached long, time_first_triggered long")
    assert tuple(sinks.bug_summary(bugs, events).first()) == (2, 1, 1, 1)
    lines = {r.bug_id: r.line for r in sinks.bug_lines(bugs, events).collect()}
    assert lines["b1"] == f"{'b1':<20} {'...' + ('x' * 60 + '.c:7')[-47:]:<50} {'yes':>8} {'yes':>10}"
    assert lines["b2"] == f"{'b2':<20} {'(no crash line)':<50} {'no':>8} {'no':>10}"
    results = frame(spark, [("b", "success"), ("a", "skipped"), ("c", "error")], "bug_id string, status string")
    row = sinks.progress(results, ["d"]).first()
    assert (row.completed, row.skipped, row.ongoing, row.succeeded, row.failed) == (2, 1, ["d"], 1, 1) and [json.loads(x)["bug_id"] for x in row.results] == ["a", "b", "c"]
    new = frame(spark, [("b2", "n.c", 3)], "bug_id string, crash_file string, crash_line int")
    assert {tuple(r) for r in sinks.refreshed(bugs, new, "bug_id", ["crash_file", "crash_line"]).where("bug_id = 'b2'").collect()} == {("b2", "n.c", 3)}
    assert sinks.changed(bugs, new, "bug_id", ["crash_file", "crash_line"]).first().changed == 1
