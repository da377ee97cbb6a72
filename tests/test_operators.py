"""Micro fixtures of the operators."""

from pyspark.sql import functions as F

from crashlens.operators import lookup, matching, rollups, sequences, survival


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def median(spark, times, events):
    return survival.km_median(frame(spark, list(zip(["g"] * len(times), times, events, strict=True)), "g string, time long, event int"), ["g"]).collect()


def test_km_median(spark):
    assert median(spark, [1, 2, 3, 4], [1, 1, 0, 0])[0].km_median == 2
    assert median(spark, list(range(1, 25)), [1] * 12 + [0] * 12)[0].km_median == 12
    assert median(spark, [5, 5, 5], [0, 0, 0])[0].km_median is None
    assert median(spark, [1, 1, 2], [1, 0, 1])[0].km_median == 2
    assert median(spark, [0, 9], [1, 0])[0].km_median == 0
    assert median(spark, [], []) == []


def test_dense_keeps_time_zero(spark):
    trials, bugs = frame(spark, [("a", "1"), ("a", "2")], "fuzzer string, trial string"), frame(spark, [("b",)], "bug string")
    events, censor = frame(spark, [("a", "1", "b", 0)], "fuzzer string, trial string, bug string, first_time long"), frame(spark, [(100,)], "censor long")
    rows = {r.trial: (r.event, r.time) for r in survival.dense(trials, bugs, events, censor, ["fuzzer", "trial", "bug"]).collect()}
    assert rows == {"1": (1, 0), "2": (0, 100)}


def test_inventory(spark):
    trials = frame(spark, [(1, "a", "x", 0), (2, "a", "x", 1), (3, "b", "y", 0)], "id long, fuzzer string, benchmark string, preempted int")
    none = frame(spark, [], "trial_id long, time long")
    some, censor = survival.inventory(trials, none, "x")
    assert [tuple(r) for r in some.collect()] == [("a", 1)] and censor.first().censor == 86400
    assert survival.inventory(trials, none, None, True)[0].count() == 3


def test_paths(spark):
    rows = frame(spark, [("/src/p/a.c", "a.c"), ("a.c", "/src/p/a.c"), ("xa.c", "a.c"), ("b.c", "a.c")], "a string, b string")
    assert [r.x for r in rows.select(matching.same_path(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, True, False]


def test_match_scores(spark):
    f = "array<struct<func:string,file:string,line:int>>"
    s = "struct<sanitizer:string,error_type:string,access_type:string,access_size:int,region_offset:int,region_relation:string,region_size:int>"
    sig = lambda e: ("A", e, None, None, None, None, None)
    stack = [("f", "/src/p/a.c", 1), ("g", "/src/p/b.c", 2)]
    crashes = frame(spark, [(1, stack, sig("x")), (2, stack, sig("z")), (3, [("h", "/src/p/h.c", 9)], sig("x")), (4, [], None)], f"id long, frames {f}, signature {s}")
    bugs = frame(spark, [("b1", "a.c", 1, "f", stack, sig("x")), ("b2", "a.c", 1, None, [("g", "b.c", 3)], sig("x")), ("b3", "a.c", 1, "f", stack, sig("y")), ("b4", "h.c", 9, None, None, None), ("b5", None, 1, None, None, None)],
                 f"bug_id string, crash_file string, crash_line int, crash_function string, reference_frames {f}, reference_signature {s}")
    assert sorted(map(tuple, matching.match(crashes, bugs, "id").collect())) == [(1, "b1"), (3, "b4")]


def test_verdicts(spark):
    log = lambda kind, *f: f"==1==ERROR: AddressSanitizer: {kind} on address 0x1\nREAD of size 1\n" + "\n".join(f"    #{i} 0x1 in {x} /src/p/{x}.c:{i}:1" for i, x in enumerate(f)) + f"\nSUMMARY: AddressSanitizer: {kind} x"
    pairs = [(1, log("SEGV", "a", "b"), log("SEGV", "a", "b")), (2, log("SEGV", "a", "b"), log("UAF", "a", "c")), (3, log("SEGV", "a", "b", "c"), log("UAF", "d", "b", "c")), (4, log("SEGV", "a"), log("UAF", "b")), (5, log("SEGV", "a"), "nothing"), (6, None, "")]
    rows = {r.i: r.verdict for r in matching.with_verdicts(frame(spark, pairs, "i int, a string, b string"), "a", "b").collect()}
    assert rows == {1: "exact", 2: "partial", 3: "partial", 4: "rejected", 5: "no_data", 6: "no_data"}


def test_clusters_break_ties(spark):
    rows = frame(spark, [(["p"], "b", "f1", 1), (["p"], "a", "f2", 1), (None, "c", "f1", 3)], "print array<string>, kind string, fuzzer string, n long")
    out = {tuple(r.print or ()): (r.n_signatures, r.occurrences, r.n_fuzzers, r.common_type) for r in matching.clusters(rows, "print", "kind", "fuzzer", "n").collect()}
    assert out == {("p",): (2, 2, 2, "a"), (): (1, 3, 1, "c")}


def test_busiest(spark):
    ts = lambda d: f"2020-01-{d:02d}"
    rows = spark.createDataFrame([("x", ts(1), ts(2)), ("x", ts(5), ts(6)), ("y", ts(1), ts(5)), ("y", ts(5), ts(9))], "g string, a string, b string").select("g", F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b"))
    out = {r.g: (r.level, r.start.day, r.end.day) for r in lookup.busiest(rows, "a", "b", ["g"]).collect()}
    assert out == {"x": (1, 1, 2), "y": (1, 1, 5)}


def test_asof(spark):
    images = frame(spark, [("g", 10, "i1"), ("g", 20, "i2")], "g string, t int, image string")
    probes = frame(spark, [("g", 1), ("g", 10), ("g", 25), ("h", 1)], "g string, t int")
    out = {(r.g, r.t): r.found for r in lookup.asof(probes, images, "t", ["g"], "image", "found").collect()}
    assert out == {("g", 1): "i1", ("g", 10): "i2", ("g", 25): "i2", ("h", 1): None}


def test_fallback(spark):
    none, some = frame(spark, [], "x int"), frame(spark, [(1,)], "x int")
    assert lookup.with_fallback(none, some).count() == 1 and lookup.with_fallback(some, some).count() == 1


def test_sequences(spark):
    rows = frame(spark, [("s", i, v) for i, v in enumerate("aabba", 1)], "g string, pos int, v string")
    assert sorted(r.pos for r in sequences.collapse_runs(rows, ["g"], ["pos"], "v").collect()) == [1, 3, 5]
    a, b = ([("s", i, v) for i, v in enumerate(x)] for x in (["f", "g", "h"], ["f", "__revert_g", "k"]))
    assert sequences.common_prefix(frame(spark, a, "g string, pos int, v string"), frame(spark, b, "g string, pos int, v string"), ["g"], "pos", "v").count() == 2
    means = {r.g: r.trimmed_mean for r in sequences.trimmed_mean(frame(spark, [("a", 1.0), ("a", 5.0), ("a", 9.0), ("b", 1.0), ("b", 9.0), ("c", None)], "g string, v double"), ["g"], "v").collect()}
    assert means == {"a": 5.0, "b": 5.0, "c": None}
    assert sorted(r.pos for r in sequences.every_nth(rows, ["g"], ["pos"], 3).collect()) == [1, 4, 5]


def test_closure_and_live(spark):
    edges = frame(spark, [("c2", "c1"), ("c3", "c2"), ("c4", "c3"), ("x", "c1")], "child string, parent string")
    reach = sequences.closure(edges, "child", "parent")
    assert reach.where("a = 'c4'").count() == 4
    live = sequences.live_commits(reach, frame(spark, [("b", "c2", "c4")], "bug string, introduced string, fixed string"))
    assert sorted(r.commit for r in live.collect()) == ["c2", "c3"]


def test_rollups(spark):
    rows = frame(spark, [("a", 0), ("a", 2), ("b", None)], "g string, bit int")
    assert sorted(map(tuple, rollups.dense_histogram(rows, "g", "bit").collect())) == [("a", 0, 1), ("a", 1, 0), ("a", 2, 1), ("b", 0, 0), ("b", 1, 0), ("b", 2, 0)]
    assert rollups.dense_histogram(rows.where("bit is null"), "g", "bit").count() == 0
    matrix = frame(spark, [("c1", "1|1", None, "3"), ("c2", "0.5|1", "1|0", "1")], "commit string, b1 string, b2 string, `poc count` string")
    long = rollups.to_long(matrix, ["commit"])
    assert {r.commit: (r.strong, r.weak) for r in rollups.status_counts(long, ["commit"]).collect()} == {"c1": (1, 0), "c2": (1, 1)}


def test_live_in_line_covers_whole_histories(spark):
    """Against closures; users beyond 20 and events beyond the 12th count."""
    commits = [(u, i, 100 * u + i) for u in (1, 25, 1400) for i in range(1, 16)] + [(30, i, 3000 + i) for i in range(1, 6)]
    spans = [(1, "a", 3, 14), (25, "b", 3, 9), (25, "c", 13, None), (1400, "d", 9, 3), (30, "e", 3, None), (30, "f", None, 2)]
    rows = frame(spark, commits, "user_id long, i int, event_id long")
    edges = sequences.neighbours(rows, ["user_id"], ["i"], "event_id").where("next is not null")
    at = {(u, i): e for u, i, e in commits}
    ids = [(b, at.get((u, x)), at.get((u, y))) for u, b, x, y in spans]
    want = sequences.live_commits(sequences.closure(edges, "next", "event_id"), frame(spark, ids, "bug string, introduced long, fixed long"))
    got = sequences.live_in_line(rows, frame(spark, spans, "user_id long, bug string, introduced int, fixed int"), ["user_id"], "i", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.bug for r in got.collect()} == {"a", "b", "c", "e"}
