"""Readers and writers on small files."""

import gzip
import io
import json
import tarfile

from pyspark.sql import functions as F

from crashlens.sources import readers, sinks


def test_bug_metadata_and_report(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"project": "p", "bugs": {"OSV-1": {"dispatch_value": 1, "triggered": True, "crash_file": "a.c", "crash_line": 3}, "OSV-2": {}}}))
    assert {r.bug_id: r.location for r in readers.bug_metadata(spark, str(tmp_path / "m.json")).collect()} == {"OSV-1": "a.c:3", "OSV-2": "-"}
    (tmp_path / "r.json").write_text(json.dumps({"bugs": {"b": {"reached_by": [{"fuzzer": "f", "trial": "1", "time": 5}, {"fuzzer": "f", "trial": "1", "time": 3}], "triggered_by": [{"fuzzer": "f", "trial": "1", "time": 7}]}}}))
    assert [tuple(r) for r in readers.bug_report(spark, str(tmp_path / "r.json")).collect()] == [("f", "1", "b", 3, 7)]


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("fuzzer,trial,time\na,1,None\nb,2,\nc,3,0\n")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "t.csv"), ["fuzzer", "trial", "time"], ("time",)).collect()] == [("a", "1", None), ("b", "2", None), ("c", "3", 0)]
    (tmp_path / "m.csv").write_text("commit id,OSV-1,OSV-2,poc count\nc1,1|1,,2\n")
    assert sorted((r.commit, r.bug, r.status) for r in readers.matrix(spark, str(tmp_path / "m.csv")).collect()) == [("c1", "OSV-1", "1|1"), ("c1", "OSV-2", None)]


def test_build_commit(spark):
    builds = spark.createDataFrame([(1, "p", "abc123", "o1"), (2, "p", "def", "o2"), (3, "q", "abc", "o3")], "line int, target string, commit_id string, oss_fuzz_commit string")
    assert tuple(readers.build_commit(builds, "p", "abc").first()) == ("o1", True)
    assert tuple(readers.build_commit(builds, "p", "zzz").first()) == ("o2", False)


def test_coverage(spark, tmp_path):
    data = {"data": [{"files": [{"filename": "/src/a.c", "segments": [[1, 1, 5, True, True, False], [1, 9, 7, True, False, False], [2, 1, 0, True, True, False], [3, 1, 4, False, False, False]]}]}]}
    with gzip.open(tmp_path / "c.json.gz", "wt") as f:
        f.write(json.dumps(data))
    assert [(r.file, r.line, r["count"]) for r in readers.coverage(spark, str(tmp_path / "c.json.gz")).collect()] == [("/src/a.c", 1, 7)]


def test_first_covered(spark):
    lines = spark.createDataFrame([(1, "z1", "/src/xa.c", 0, 5, 10), (1, "z1", "/src/a.c", 1, 9, 10), (1, "z2", "/src/a.c", 0, 9, 20)], "trial int, archive string, file string, file_pos int, line int, time int")
    bugs = spark.createDataFrame([("b", "a.c", 9)], "bug_id string, crash_file string, crash_line int")
    assert [tuple(r) for r in readers.first_covered(lines, bugs, ["trial"]).collect()] == [(1, "b", 20)]


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, data in (("x/crash-1", b"\x03\x00abc"), ("x/crash-2", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "bad.tar.gz").write_bytes(b"no archive")
    members = readers.archive_members(spark, str(tmp_path / "*.tar.gz"), 2).withColumn("fuzzer", F.lit("f"))
    assert sorted((r.member, r.size, bytes(r.head)) for r in members.collect()) == [("x/crash-1", 5, b"\x03\x00"), ("x/crash-2", 0, b"")]
    assert tuple(readers.archive_census(members).first()) == ("f", 1, 2, 1)


def test_traces(spark):
    lines = spark.createDataFrame([("t", i, v) for i, v in enumerate(["Caller:  ('a', 1)", "  -> Callee: ('b', 2)", "  -> Callee: ('c', 2)", "Entering function: f Location: a.c:1:2", "  -> Callee: ('d', 2)", "offset: 1f called by: 2e"])], "trace string, pos int, value string")
    assert sorted((r.caller, r.callee) for r in readers.call_graph(lines, "trace").collect()) == [("a", "b"), ("a", "c")]
    assert [(r.func, r.location) for r in readers.entered(lines).collect()] == [("f", "a.c:1:2")]
    assert [(r.offset, r.caller) for r in readers.raw_trace(lines).collect()] == [("1f", "2e")]


def test_agent_log(spark):
    rows = [("k", 0, '{"type":"session_meta","payload":{"id":"s1"}}'), ("k", 1, "not json"), ("k", 2, '{"usage":{"input_tokens":5,"output_tokens":2}}'), ("k", 3, '{"item":{"type":"agent_message","text":"x"}}')]
    r = readers.agent_log(spark.createDataFrame(rows, "key string, pos int, value string"), "key").first()
    assert (r.input_tokens, r.cached_input_tokens, r.output_tokens, r.session, r.messages) == (5, 0, 2, "s1", 1)


def test_small_readers(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "OSV-1.txt").write_text("    #0 0x1 in f /src/p/a.c:1:2\n    #1 0x1 in g /src/q/b.c:2:2\n")
    r = readers.reference_logs(spark, str(tmp_path / "log"), "/src/q/").first()
    assert r.bug_id == "OSV-1" and [x.func for x in r.frames] == ["g"]
    (tmp_path / "cc.json").write_text(json.dumps([{"directory": "/d", "file": "a.c", "command": "cc -c a.c"}, {"directory": "/d", "file": "a.c", "arguments": ["cc"]}]))
    assert [tuple(r) for r in readers.compile_commands(spark, str(tmp_path / "cc.json")).collect()] == [("/d/a.c", "/d", ["cc"])]
    assert [r.project for r in readers.project_list(spark.createDataFrame([(" a ",), ("#x",), ("",)], "value string")).collect()] == ["a"]
    assert readers.only_prefix(spark.createDataFrame([("b-1",), ("b-2",)], "name string"), "d").first().benchmark == "b"
    assert readers.only_prefix(spark.createDataFrame([("b-1",), ("c-2",)], "name string"), "d").first().benchmark == "d"
    (tmp_path / "ids.json").write_text('{"p": ["i1", "i2"], "q": []}')
    assert sorted(map(tuple, readers.saved_ids(spark, str(tmp_path / "ids.json")).collect())) == [("p", "i1"), ("p", "i2")]


def test_experiment_folders(spark):
    dirs = lambda paths, b: sorted(tuple(r)[1:3] for r in readers.fuzzer_dirs(spark.createDataFrame([(p,) for p in paths], "path string"), b).collect())
    flat = ["/x/experiment-folders/bench-x-afl-plus/trial-3/c", "/x/experiment-folders/bench-x-lib/trial-12/c/d", "/x/experiment-folders/bench-xy/trial-1/c", "/x/experiment-folders/bench-x-/trial-1/c"]
    assert dirs(flat, "bench-x") == [("afl-plus", "3"), ("lib", "12")]
    assert dirs([*flat, "/x/experiment-folders/bench-x/afl/trial-7/c", "/trial-9/x/bench-x/afl/trial-2/c"], "bench-x") == [("afl", "7")]
    assert dirs(flat, "none") == []


def test_commit_range(spark):
    edges = spark.createDataFrame([("c2", "c1"), ("c3", "c2"), ("y", "c1")], "child string, parent string")
    commits = spark.createDataFrame([("c1", 1), ("c2", 2), ("c3", 3), ("y", 2)], "commit string, ts int")
    assert sorted(r.commit for r in readers.commit_range(edges, commits, "c1", "c3").collect()) == ["c1", "c2", "c3"]
    assert sorted(r.commit for r in readers.commit_range(edges, commits, "c2", "y").collect()) == []  # times strictly between
    late = commits.unionByName(spark.createDataFrame([("z", 9)], "commit string, ts int"))
    assert sorted(r.commit for r in readers.commit_range(edges, late, "y", "z").collect()) == ["c3"]


def test_sinks(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("a", None)], "x string, y int").coalesce(1), str(tmp_path / "o"), ["x", "y", "z"])
    assert "".join(p.read_text() for p in (tmp_path / "o").glob("*.csv")) == "x,y,z\na,,\n"
    bugs = spark.createDataFrame([("b1", "a.c"), ("b2", None)], "bug_id string, crash_file string")
    events = spark.createDataFrame([("f", "1", "b1", 3, None)], "fuzzer string, trial string, bug_id string, time_first_reached long, time_first_triggered long")
    reports = {r.bug_id: json.loads(r.report) for r in sinks.bug_report(bugs, events).collect()}
    assert reports["b1"]["reached_by"] == [{"fuzzer": "f", "trial": "1", "time": 3}] and reports["b2"]["triggered_by"] == []
    assert [r.value for r in sinks.allow_list(spark.createDataFrame([("g",), ("f",), ("g",)], "func string")).collect()] == ["fun:f", "fun:g", "src:*"]
    state = lambda *rows: spark.createDataFrame(list(rows), "bug string, status string")
    out = {r.bug: r.status for r in sinks.upsert(state(("a", "failed"), ("b", "impossible"), ("c", "x")), state(("a", "success")), state(("b", "success"), ("d", "failed")), "bug").collect()}
    assert out == {"a": "success", "b": "impossible", "c": "x", "d": "failed"}
    assert sinks.folder_result(spark.createDataFrame([("a", "bug.diff"), ("a", "x"), ("b", None)], "bug string, name string"), "bug").count() == 2
    bits = {r.b: (r.bit, r.dispatch_value) for r in sinks.dispatch_bits(spark.createDataFrame([("x", True), ("y", False), ("z", True)], "b string, g boolean"), ["b"], "g").collect()}
    assert bits == {"x": (0, 1), "y": (None, 0), "z": (1, 2)}
    assert sinks.changed(bugs, bugs, "bug_id", ["crash_file"]).first().changed == 0
    assert sinks.metadata(bugs, spark.createDataFrame([("b1", 3)], "bug_id string, crash_line int")).first().total_bugs == 2
    assert sinks.markdown(bugs.orderBy("bug_id")).splitlines()[2] == "| b1 | a.c |"
