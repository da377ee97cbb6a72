"""Summaries, folder results, upserts, escapes and redirects on micro fixtures."""

import html

from pyspark.sql import functions as F

from crashlens.functions import frames, text
from crashlens.operators import matching, summaries
from crashlens.sources import sinks


def rows(frame, *columns):
    return {tuple(r[c] for c in columns) for r in frame.collect()}


def test_per_bug_keeps_bugs_without_trials(spark):
    matrix = spark.createDataFrame([("f", "a", 1, 0), ("f", "a", 0, 9), ("g", "a", 1, 5), ("g", "x", 1, 5)], "fuzzer string, bug_id string, event int, time long")
    bugs = spark.createDataFrame([("a", "gated", 4), ("b", "always", 0)], "bug_id string, stratum string, dispatch_value long")
    assert rows(summaries.per_bug(matrix, bugs), "bug_id", "n_trials", "triggered", "km_median") == {("a", 3, 2, 5), ("b", 0, 0, None)}
    assert rows(summaries.by_bug_and_fuzzer(matrix, bugs), "fuzzer", "stratum", "bug_id", "dispatch_value", "trials", "triggered") == {("f", "gated", "a", 4, 2, 1), ("g", "gated", "a", 4, 1, 1)}
    assert summaries.per_bug(matrix.limit(0), bugs).count() == 2


def test_headline(spark):
    schema = "count long, fingerprint array<string>, key string, stack_bugs array<int>, state_bugs array<int>"
    crashes = spark.createDataFrame([(3, ["p"], "k", [1], None), (2, ["p"], "l", [], [2, 1]), (1, [], "", None, [7]), (4, None, None, [], []), (5, ["q"], "k", [], [2])], schema)
    assert tuple(summaries.headline(crashes).first()) == (15, 2, 2, 11, 1, 2)
    assert tuple(summaries.headline(crashes.limit(0)).first()) == (0,) * 6
    assert {r.key: (r.occurrences, r.bugs) for r in summaries.candidates(crashes).collect()} == {"k": (8, [1, 2]), "l": (2, [1, 2])}


def test_projects_and_ranks(spark):
    schema = "bugs long, bugs_ff long, bugs_ffl long, crashes long, crashes_ff long, crashes_ffl long, crashes_matched long, occurrences long"
    reports = spark.createDataFrame([(10, 6, 8, 100, 9, 20, 2, None), (10, 9, 9, None, None, None, None, 5), (None,) * 8], schema)
    got = summaries.across(reports).first().asDict()
    assert got == {"projects": 2, "total_bugs": 20, "total_bugs_ff": 15, "total_bugs_ffl": 17, "with_crashes": 1, "total_crashes": 100, "total_crashes_ff": 9, "total_crashes_ffl": 20, "total_crashes_matched": 2, "total_occurrences": 0, "duplicates": 0.25}
    assert summaries.across(reports.limit(0)).first().duplicates is None
    bugs = spark.createDataFrame([("f", "a", 1, 1, None), ("f", "b", 1, 1, 0), ("f", "c", 2, 2, 9), ("f", "d", 0, 0, None), ("f", "e", 0, 3, None)], "fuzzer string, bug_id string, triggered int, reached int, best_time long")
    assert {r.bug_id: r["rank"] for r in summaries.ranked_bugs(bugs).collect()} == {"c": 1, "b": 2, "a": 3, "e": 4}
    hits = spark.createDataFrame([("f", 1, "a"), ("f", 1, "a"), ("f", 1, "b"), ("f", 2, "a")], "fuzzer string, trial int, bug string")
    assert rows(summaries.mean_over_hits(hits, "fuzzer", "trial", "bug"), "fuzzer", "mean", "trials_with_hits") == {("f", 1.5, 2)}
    records = spark.createDataFrame([("p", "t", "asan_i386_x", "1"), ("p", "t", "asan_x", "1"), ("p", "t", None, "2"), ("p", "t", "asan_x", "1")], "project string, fuzz_target string, job_type string, bug string")
    assert rows(summaries.distinct_bugs(records), "arch", "bug_count") == {("i386", 1), ("x86_64", 2)}


def test_newest_first(spark):
    windows = spark.createDataFrame([("x", "c1", "c3"), ("y", "c3", None), ("z", "c2", "gone")], "bug string, introduced string, fixed string")
    inside = spark.createDataFrame([("x", "c2"), ("x", "c3"), ("y", "c9")], "bug string, commit string")
    commits = spark.createDataFrame([("c1", 5), ("c2", 5), ("c3", 7), ("c9", 1)], "commit string, time int")
    for blocks in (1, 3):
        assert {r.commit: r["rank"] for r in summaries.newest_first(windows, inside, commits, blocks).collect()} == {"c3": 1, "c1": 2, "c2": 3}


def test_cluster_examples(spark):
    crashes = spark.createDataFrame([(["p"], "b", "f", 9, "", 1), (["p"], "a", "f", 1, "s" * 130, 3), (["p"], "a", "g", 1, "later", 4), (None, "c", "f", 3, None, 2)], "print array<string>, kind string, fuzzer string, n long, state string, i int")
    got = {tuple(r.print or ()): (r.occurrences, r.common_type, r.example) for r in matching.clusters(crashes, "print", "kind", "fuzzer", "n", "state", ("i",)).collect()}
    assert got == {("p",): (11, "a", "s" * 120), (): (3, "c", "")}


def test_folder_results(spark):
    files = [
        ("i", "bug_transplant.impossible", " no way \n"), ("i", "transplant_crash.txt", None), ("s", "transplant_crash.txt", None), ("s", "git_diff.diff", None), ("dt", "bug_transplant.diff", None),
        ("dt", "testcase-1", None), ("d", "git_diff.diff", None), ("t", "testcase-x", None), ("n", "a testcase-x", None), ("0", None, None),
    ]
    found = sinks.folder_result(spark.createDataFrame(files, "bug string, name string, text string"), "bug")
    want = {
        ("i", "impossible", "no way"), ("s", "success", None), ("dt", "failed", "diff and testcase but no verified crash"), ("d", "failed", "diff but no verified crash"),
        ("t", "failed", "testcase but no verified crash"), ("n", "failed", "no artifacts"), ("0", "failed", "no artifacts"),
    }
    assert rows(found, "bug", "status", "reason") == want
    earlier = spark.createDataFrame([("i", "error", "r", 2, "e"), ("s", "failed", "r", 2, "e"), ("d", "success", "r", 0, None), ("t", None, "r", 3, "e")], "bug string, status string, reason string, exit_code int, error_message string")
    got = {r.bug: tuple(r)[1:] for r in sinks.resumed(found, earlier, "bug").collect()}
    assert got["i"] == ("impossible", "no way", 0, None) and got["s"] == ("success", "r", 0, None) and got["d"] == ("success", "r", 0, None)
    assert got["t"] == ("failed", "testcase but no verified crash", 3, "e") and got["n"] == ("failed", "no artifacts", None, None)


def test_upsert(spark):
    state = lambda *x: spark.createDataFrame(list(x), "bug string, status string")
    earlier = state(("a", "impossible"), ("b", "impossible"), ("c", "success"), ("d", "failed"))
    folders = state(("a", "failed"), ("e", "impossible"), ("d", "success"))
    current = state(("a", "success"), ("b", "success"), ("c", "skipped"), ("d", None), ("e", "success"), ("f", "error"), ("g", "impossible"))
    out = sinks.upsert(earlier, folders, current, "bug")
    assert rows(out, "bug", "status") == {("a", "success"), ("b", "impossible"), ("c", "success"), ("d", "success"), ("e", "impossible"), ("f", "error"), ("g", "impossible")}
    assert tuple(sinks.batch_summary(out).first()) == (7, 3, 4)


def test_escapes_and_redirects(spark):
    texts = ["a &amp;lt; b &#38;#60; &lt;&#x3e;&quot;&apos;", "&#128512;&#x1F600; &#0; &#55296; &#99999999999;", "", "none & &; &unknown; &#;", "&amp;" * 3 + "end", None]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(text.unescaped(F.col("t")).alias("t")).collect()]
    assert got[0] == html.unescape(texts[0]) and got[1] == "\U0001f600\U0001f600 &#0; &#55296; &#99999999999;" and got[2:] == ["", texts[3], "&&&end", None]
    page = r'x href="https://www.google.com/url?q=https%3A%2F%2Foss-fuzz.com%2Ftestcase%3Fkey%3D5+1&amp;sa=D" HTTP://WWW.GOOGLE.COM/url?q=https%3a%2f%2foss-fuzz.com%2Fbad%zz https://www.google.com/url?q=https%3A%2F%2Fother.com%2F'
    one = spark.createDataFrame([(page,)], "t string").select(text.issue_html(F.col("t")).alias("t")).first().t
    assert one == 'x href="https://oss-fuzz.com/testcase?key=5+1&sa=D" https://oss-fuzz.com/bad%zz https://www.google.com/url?q=https%3A%2F%2Fother.com%2F'


def test_days_and_sets(spark):
    days = spark.sql("select timestamp_ntz'2024-02-28 23:59:59' a, timestamp_ntz'2024-02-29 00:00:00' b, timestamp_ntz'2024-02-28 00:00:00' c")
    got = days.select(text.is_later_day(F.col("a"), F.col("b")), text.is_later_day(F.col("c"), F.col("a")), text.next_midnight(F.col("a")).cast("string"), text.months_later(F.col("c"), 1).cast("string")).first()
    assert tuple(got) == (True, False, "2024-02-29", "2024-03-29 00:00:00")
    stack = spark.createDataFrame([([("g", "x", 1), ("f", "x", 2), ("g", "y", None)], ["f", "h", "f"]), (None, ["f"])], "f array<struct<func: string, file: string, line: int>>, o array<string>")
    got = stack.select(frames.function_set(F.col("f")).alias("s"), frames.shared_count(frames.function_set(F.col("f")), F.col("o")).alias("n")).collect()
    assert [(r.s, r.n) for r in got] == [(["f", "g"], 1), ([], 0)]
