"""Numbered lines, commit graphs, bit sets, and joins by prefix, suffix and content, against plain versions."""

import gzip
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from crashlens.functions import bits
from crashlens.operators import graphs, lookup, matching
from crashlens.plans import catalogue
from crashlens.sources import numbered, readers, sinks


@pytest.fixture
def tiny_blocks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    spark.conf.set("spark.sql.files.openCostInBytes", "16b")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_numbered(spark, tmp_path, tiny_blocks, monkeypatch, broadcast):
    monkeypatch.setattr(numbered, "BROADCAST_BLOCKS", broadcast)
    rng = random.Random(1)
    files = {f"d{i % 2}/f{i}.log": ["x" * rng.choice((0, 1, 9, 70, 300)) + str(k) for k in range(rng.choice((1, 40, 90)))] for i in range(4)} | {"d0/empty.log": []}
    for name, lines in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    with gzip.open(tmp_path / "d0/z.log.gz", "wt") as f:
        f.write("\n".join(["", "a", "b"] * 50))
    files["d0/z.log.gz"] = ["", "a", "b"] * 50
    rows = numbered.numbered(spark, str(tmp_path))
    assert rows.select("file").distinct().count() == 5
    got = {(r.file.split(str(tmp_path) + "/")[1], r.pos): r.value for r in rows.collect()}
    assert got == {(name, i): x for name, lines in files.items() for i, x in enumerate(lines, 1)}
    assert numbered.numbered(spark, str(tmp_path), "*.gz").count() == 150


def test_tables_by_line(spark, tmp_path, tiny_blocks):
    (tmp_path / "m.csv").write_text("commit id,OSV-1,poc count\n" + "".join(f"c{i},{i}|{i % 2},7\n" for i in range(60)))
    assert sorted((r.row, r.commit, r.status) for r in readers.matrix(spark, str(tmp_path / "m.csv")).where("bug = 'OSV-1'").collect()) == [(i + 1, f"c{i}", f"{i}|{i % 2}") for i in range(60)]
    (tmp_path / "b.csv").write_text("target,commit_id,oss_fuzz_commit\n" + "".join(f"p{i % 2},{i:012x},o{i}\n" for i in range(50)))
    wanted = spark.createDataFrame([("p1", "000000000007ff"), ("p0", "00006"), ("p0", "none"), ("q", "1")], "target string, commit string")
    got = {(r.target, r.commit): (r.oss_fuzz_commit, r.matched) for r in readers.build_commits(readers.builds(spark, str(tmp_path / "b.csv")), wanted).collect()}
    assert got == {("p1", "000000000007ff"): ("o7", True), ("p0", "00006"): ("o6", True), ("p0", "none"): ("o48", False)}


def test_traces_from_files(spark, tmp_path, tiny_blocks):
    for name in ("a", "b"):
        (tmp_path / f"{name}.trace").write_text("noise\n" * 9 + "offset: 1f called by: 2e\noffset: 3a called by: 2e\n" * 20 + "offset: 1f called by: 4\n")
    calls = readers.raw_trace(numbered.numbered(spark, str(tmp_path)))
    assert sorted((r.offset, r.pos) for r in readers.trace_offsets(calls, ("file",)).collect()) == [("1f", 10), ("1f", 10), ("3a", 11), ("3a", 11)]
    assert {r.caller: r.callees for r in readers.trace_callees(calls.where("file like '%a.trace'")).collect()} == {"2e": ["1f", "3a"] * 20, "4": ["1f"]}


def test_coverage_to_first_covered(spark, tmp_path):
    segments = lambda *lines: [[x, 1, 5, True, True, False] for x in lines]
    for time, files in ((10, [("x/src/a.c", segments(1)), ("/src/a.c", segments(7))]), (20, [("/src/b.c", segments(3)), ("/src/a.c", segments(7))])):
        with gzip.open(tmp_path / f"{time}.json.gz", "wt") as f:
            f.write(json.dumps({"data": [{"files": [{"filename": n, "segments": s} for n, s in files]}]}))
    lines = readers.coverage(spark, str(tmp_path)).withColumn("time", F.regexp_extract("archive", r"(\d+)\.json", 1).cast("long")).withColumn("trial", F.lit(1))
    bugs = spark.createDataFrame([("a", "src/a.c", 7), ("b", "deep/src/b.c", 3), ("c", "b.c", 3), ("d", "src/c.c", 3)], "bug_id string, crash_file string, crash_line int")
    found = readers.first_covered(lines, bugs, ["trial"])
    assert sorted((r.bug_id, r.first_time) for r in found.collect()) == [("a", 20), ("b", 20), ("c", 20)]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def brute(edges):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    nodes = {x for e in edges for x in e}
    seen = {}

    def ancestors(n):
        if n not in seen:
            seen[n] = {n}.union(*(ancestors(p) for p in up.get(n, ())))
        return seen[n]

    return {n: ancestors(n) for n in nodes}


def dag(seed, n):
    """Lines, branches and merges; parents come before their children."""
    rng = random.Random(seed)
    edges = set()
    for c in range(1, n):
        edges.add((c, c - 1 if rng.random() < 0.7 else rng.randrange(c)))
        if rng.random() < 0.15:
            edges.add((c, rng.randrange(c)))
    names = list(range(n))
    rng.shuffle(names)
    return [(names[c], names[p]) for c, p in edges]


def test_history(spark, seed=1):
    edges = dag(seed, 40)
    up = brute(edges)
    graph = graphs.history(spark.createDataFrame(edges + edges[:3] + [(None, 1)], "child long, parent long"))
    rng = random.Random(seed)
    windows = [(b, rng.randrange(40), rng.choice([None, rng.randrange(40)])) for b in range(8)] + [(99, None, 3), (98, 1000, None)]
    live = graphs.live(graph, spark.createDataFrame(windows, "bug long, introduced long, fixed long"))
    assert sorted(map(tuple, live.collect())) == sorted((b, c) for b, i, f in windows for c in up if i in up[c] and f not in up[c])
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(7, 7), (1000, 3)]
    got = graphs.ancestry(graph, spark.createDataFrame(pairs, "a long, b long"), graphs.levels(graph))
    assert sorted(map(tuple, got.collect())) == sorted({(a, b, a in up.get(b, ())) for a, b in pairs})
    ranges = [(i, *pairs[i]) for i in range(12)]
    ways = graphs.between(graph, spark.createDataFrame(ranges, "key long, first long, last long"))
    assert sorted(map(tuple, ways.collect())) == sorted((k, c) for k, a, b in ranges for c in up[b] if a in up[c])

    def level(n):
        return max((level(p) + 1 for c, p in edges if c == n), default=0)

    placed = graph.nodes.join(graphs.levels(graph), "chain").select("node", (F.col("level") + F.col("place")).alias("level"))
    assert {r.node: r.level for r in placed.collect()} == {n: level(n) for n in up}


def test_history_of_lines_and_rings(spark):
    line = graphs.history(spark.createDataFrame([(i + 1, i) for i in range(100)], "child long, parent long"))
    assert line.nodes.select("chain").distinct().count() == 1 and line.links.count() == 0 and line.nodes.agg(F.max("place")).first()[0] == 100
    with pytest.raises(ValueError, match="cycle"):
        graphs.history(spark.createDataFrame([(2, 1), (3, 2), (1, 3)], "child long, parent long"))
    with pytest.raises(ValueError, match="cycle"):
        graphs.levels(graphs.history(spark.createDataFrame([(2, 1), (1, 2), (3, 2), (2, 0)], "child long, parent long")))
    nothing = graphs.history(spark.createDataFrame([], "child long, parent long"))
    assert graphs.live(nothing, spark.createDataFrame([(1, 2, 3)], "bug long, introduced long, fixed long")).count() == 0


def test_best_source_goes_by_ancestry(spark):
    """d is on a longer line than b, but no descendant of it: the earlier row stays; e descends from b."""
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "c"), ("f", "d"), ("e", "b")], "child string, parent string")
    rows = [("x", "b", 2, 1), ("x", "f", 2, 2), ("y", "b", 1, 1), ("y", "f", 1, 2), ("y", "e", 1, 3), ("z", "a", 1, 1), ("z", "d", 2, 2), ("z", "c", 2, 3), ("z", "f", 2, 4), ("w", "a", 0, 1), ("v", "zz", 1, 1), ("v", "a", 1, 2)]
    frame = spark.createDataFrame(rows, "bug string, commit string, rank int, row int")
    assert {r.bug: r.commit for r in graphs.best_sources(frame, edges).collect()} == {"x": "b", "y": "e", "z": "f", "v": "zz"}
    introduced = spark.createDataFrame([("y", "fff"), ("z", "a"), ("x", "")], "bug string, introduced string")
    assert {r.bug: r.commit for r in graphs.best_sources(frame, edges, introduced).collect()} == {"x": "b", "y": "f", "z": "f", "v": "zz"}


def test_masks_of_a_thousand_bugs(spark):
    out = sinks.dispatch_bits(spark.range(1100).withColumn("gated", F.col("id") % 11 != 0), ["id"], "gated")
    rows = {r.id: r for r in out.withColumns({"places": bits.places(F.col("dispatch_mask")), "lone": bits.lone_bit(F.col("dispatch_mask"))}).collect()}
    assert all(len(r.dispatch_mask) == 125 for r in rows.values()) and sorted(r.bit for r in rows.values() if r.bit is not None) == list(range(1000))
    assert all(int.from_bytes(r.dispatch_mask, "little") == (0 if r.bit is None else 1 << r.bit) and r.places == ([] if r.bit is None else [r.bit]) and r.lone == r.bit for r in rows.values())
    sets = [([3, 70, 999], [3, 8]), ([], [999]), ([0], [0])]
    df = spark.createDataFrame(sets, "a array<int>, b array<int>").select("a", "b", bits.mask_of(F.col("a"), F.lit(125)).alias("x"), bits.mask_of(F.col("b"), F.greatest(F.lit(2), F.lit(125) * (F.array_max("b") > 15).cast("int"))).alias("y"))
    for r in df.select("a", "b", bits.places(bits.mask_or(F.col("x"), F.col("y"))).alias("o"), bits.places(bits.mask_and(F.col("x"), F.col("y"))).alias("n"), bits.has_bit(F.col("x"), F.lit(70)).alias("h"), bits.has_bit(F.col("y"), F.lit(5000)).alias("no")).collect():
        assert r.o == sorted({*r.a, *r.b}) and r.n == sorted({*r.a} & {*r.b}) and r.h == (70 in r.a) and r.no is False


def test_affixes(spark):
    rng = random.Random(5)
    ids = lambda n: ["".join(rng.choice("ab") for _ in range(rng.choice((0, 1, 2, 5, 40)))) for _ in range(n)]
    a, b = ids(60), ids(60)
    frames = [spark.createDataFrame([(x,) for x in [*v, None]], f"{c} string") for v, c in ((a, "a"), (b, "b"))]
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(lookup.affix_pairs(*frames, "a", "b")) == sorted({(x, y) for x in a for y in b if x.startswith(y) or y.startswith(x)})
    pairs = lookup.affix_pairs(*frames, "a", "b", ends=True)
    assert got(pairs) == sorted({(x, y) for x in a for y in b if x.endswith(y) or y.endswith(x)})
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert got(lookup.containing(*frames, "a", "b")) == sorted({(x, y) for x in a for y in b if x and y and (x in y or y in x)})
    files = spark.createDataFrame([("Lib-X_y.c",), ("other.c",)], "file string")
    projects = spark.createDataFrame([("lib-xy", 2), ("LIB_", 3), ("libx", 1), ("z", 0)], "project string, row int")
    assert got(lookup.first_projects(files, projects)) == [("Lib-X_y.c", "libx")]


def test_match_reads_each_side_once(spark):
    """Logs that parse alike are matched together; short and long paths meet in either direction."""
    frame = "array<struct<func: string, file: string, line: int>>"
    sign = "struct<sanitizer: string, error_type: string, access_type: string, access_size: int, region_offset: int, region_relation: string, region_size: int>"
    one = ("address", "heap", "READ", 4, None, None, None)
    crashes = spark.createDataFrame([(i, [("f", "/src/p/a.c", 3), ("g", "b.c", 4)], one if i < 5 else None) for i in range(6)] + [(9, [], one), (10, None, one)], f"id int, frames {frame}, signature {sign}")
    targets = spark.createDataFrame([("x", "a.c", 3, "f", None, one), ("y", "dir/b.c", 4, "", [("f", "/src/p/a.c", 3)], one), ("z", "c.c", 3, "f", None, one), ("n", None, 3, "f", None, one)], f"bug_id string, crash_file string, crash_line int, crash_function string, reference_frames {frame}, reference_signature {sign}")
    assert sorted(map(tuple, matching.candidates(crashes, targets, "id").collect())) == sorted((i, b) for i in range(6) for b in "xy")
    assert sorted(map(tuple, matching.match(crashes, targets, "id").collect())) == [(i, "y") for i in range(6)]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_blocks_carry_over(spark, by):
    """A hundred blocks give what windows over whole groups give, nulls and ties too."""
    from crashlens.operators import sequences

    rng = random.Random(4)
    rows = [(rng.choice([0, 1, None]), rng.choice([*range(40), None]), rng.choice(["a", "b", None]), i) for i in range(150)]
    frame = spark.createDataFrame(rows, "g int, t int, v string, id int").withColumn("all", F.lit(1))
    some = lambda df: sorted(map(repr, (tuple(r) for r in df.drop("all").collect())))
    plain = by or ["all"]
    assert some(sequences.collapse_runs(frame, by, ["t", "id"], "v", 100)) == some(sequences.collapse_runs(frame, plain, ["t", "id"], "v"))
    probes, times = frame.where("id % 3 > 0 and t is not null"), frame.where("id % 3 = 0 and t is not null")
    assert some(lookup.asof(probes, times, "t", by, "id", "found", 100)) == some(lookup.asof(probes, times, "t", plain, "id", "found"))
    spans = frame.where("t is not null").select("g", "all", F.timestamp_seconds("t").alias("a"), F.timestamp_seconds(F.col("t") + F.col("id") % 7).alias("b"))
    assert some(lookup.busiest(spans, "a", "b", by, 100)) == some(lookup.busiest(spans, "a", "b", plain))


def test_watcher_goes_on(spark, tmp_path, monkeypatch):
    """Files that were counted aren't counted again after a restart; a batch that is run again changes nothing."""
    from crashlens.streaming import watch

    monkeypatch.setattr(watch, "MERGE_EVERY", 2)
    files, store = f"{tmp_path}/in", f"file://{tmp_path}/store"
    make = lambda ids: spark.createDataFrame([(i, i % 3, "ab"[i % 2]) for i in ids], "event_id long, user_id long, event_type string").selectExpr("event_id", "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(event_id) as ts", "user_id", "event_type", "0D as value", "concat('{\"k\": ', event_id % 4, '}') as props")
    for n, ids in enumerate((range(10), range(10, 13), range(13, 30))):
        make(ids).coalesce(1).write.mode("append").parquet(files)
        watch.keep(watch.stream(spark, files, "*.parquet", files=1), store, f"{tmp_path}/checkpoint").awaitTermination()
        found = watch.state(spark, store)
        seen = range(ids[-1] + 1)
        assert watch.totals(found).first().rows == len(seen)
        assert {r.event_type: (r.n, r.users) for r in watch.by_type(found).collect()} == {x: (len([i for i in seen if "ab"[i % 2] == x]), len({i % 3 for i in seen if "ab"[i % 2] == x})) for x in "ab"}
    want = sorted(map(tuple, found.collect()))
    watch.partial(make(range(13, 30))).write.mode("overwrite").parquet(f"{store}/batch=2")  # as a batch that is run again
    found = watch.state(spark, store)
    assert sorted(map(tuple, found.collect())) == want and watch._finished(spark, store, "base") == [1]
    assert [tuple(r) for r in watch.top_states(found, 2).collect()] == [("a|0", 8), ("b|1", 8)]
    assert watch.state(spark, f"file://{tmp_path}/none").count() == 0


def test_build_commits_as_its_sql(spark, tmp_path):
    # the piece of 390915's id is in 350325's too; 262676 and 779498 look for the same commit that there isn't
    keys = {350325: "2-HIGH", 390915: "2-HIGH", 390920: "2-HIGH", 262676: "3-MEDIUM", 779498: "3-MEDIUM"}
    orders = spark.createDataFrame([(k, "F", p) for k, p in keys.items()], "o_orderkey bigint, o_orderstatus string, o_orderpriority string")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    found = con.execute(catalogue.ORACLES["build_commits"])
    names = [x[0] for x in found.description]
    theirs = sorted(found.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in catalogue.QUERIES["build_commits"](spark, str(tmp_path)).collect()) == theirs
    assert len(theirs) == 5 and ("2-HIGH", "b3cdc81a", "oss390915", True) in theirs


def test_build_commits_first_build_and_each_row(spark):
    builds = spark.createDataFrame([(1, "p", "ab12ff", "x"), (2, "p", "12ff99", "y"), (3, "p", "77", "z"), (1, "q", "12ff", "w")], "line int, target string, commit_id string, oss_fuzz_commit string")
    wanted = spark.createDataFrame([("p", "12ff"), ("p", "12ff"), ("p", "none"), ("p", "none"), ("q", "0012ff")], "target string, commit string")
    out = sorted(map(tuple, readers.build_commits(builds, wanted).collect()))
    assert out == [("p", "12ff", "x", True)] * 2 + [("p", "none", "z", False)] * 2 + [("q", "0012ff", "w", True)]
