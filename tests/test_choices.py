"""Pending bugs, categories, orders of merging, costs, dense strata and report documents."""

import random

import pytest
from pyspark.sql import functions as F

from crashlens.functions import text
from crashlens.operators import choices, overlaps, rollups
from crashlens.sources import readers, sinks


def test_pending_and_defaults(spark):
    bugs = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "bug string, trial int")
    done = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), ("b", 2)], "bug string, trial int")
    assert {r.bug for r in choices.pending(bugs, done, ["bug", "trial"]).collect()} == {"b", None}
    places = spark.createDataFrame([("a", 7), ("b", None)], "bug string, line int")
    assert {r.bug: r.line for r in choices.with_default(bugs, places, ["bug"], "line").collect()} == {"a": "7", "b": "-", None: "-"}


def test_numeric_ids(spark):
    ids = ["OSV-2020-10", "x", "OSV-2020-9", "OSV-2019-100", None, "OSV-2020-9b"]
    got = spark.createDataFrame([(i,) for i in ids], "id string").orderBy(*choices.numeric_id(F.col("id"))).collect()
    assert [r.id for r in got] == ["OSV-2019-100", "OSV-2020-9", "OSV-2020-10", "OSV-2020-9b", "x", None]


def test_categories(spark):
    rows = [
        ("local", 5, 5, True, None, None), ("diff", 5, 5, False, "f", "address (ASAN)"), ("case", 0, 5, None, "f", None), ("none", None, 0, False, "f", "address"),
        ("mark", 5, 5, True, "f", "address"), ("memory", 5, 5, False, "f", "memory (MSAN)"), ("target", 5, 5, False, "", "address"), ("ubsan", 1, None, False, "f", "undefined (UBSAN)"),
    ]
    bugs = spark.createDataFrame(rows, "bug_id string, diff_bytes int, testcase_bytes int, impossible boolean, fuzz_target string, sanitizer string")
    got = {tuple(r) for r in choices.categorised(bugs, spark.createDataFrame([("local",), ("local",)], "bug_id string")).collect()}
    assert got == {("local", "local"), ("diff", "diff"), ("case", "testcase_only"), ("ubsan", "diff")}


def test_merge_order_and_overlaps(spark):
    rows = [("p", "a", "x"), ("p", "b", "x"), ("p", "b", "y"), ("p", "c", "z"), ("p", "c", "w"), ("p", "d", None), ("q", "e", "x"), ("p", "b", "y")]
    items = spark.createDataFrame(rows, "project string, bug string, file string")
    got = {(r.project, r.bug): (r.degree, r.n, r["rank"]) for r in overlaps.merge_order(items, "bug", "file", ("project",)).collect()}
    assert got == {("p", "d"): (0, 0, 1), ("p", "c"): (0, 2, 2), ("p", "a"): (1, 1, 3), ("p", "b"): (1, 2, 4), ("q", "e"): (0, 1, 1)}
    applied = spark.createDataFrame([("a",), ("e",), ("gone",)], "bug string")
    assert {r.bug: r.applied for r in overlaps.overlapping(items, applied, "bug", "file").collect()} == {"b": ["a", "e"], "a": ["e"], "e": ["a"]}


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_overlaps_of_hot_values(spark, hot):
    rng = random.Random(7)
    sets = {k: {"all"} | {f"v{rng.randrange(40)}" for _ in range(rng.randrange(3))} | ({"half"} if k % 2 else set()) for k in range(60)}
    sets |= {90 + k: {f"w{k // 2}"} for k in range(6)} | {99: {"alone"}}
    rows = [(k, v) for k, s in sets.items() for v in s] * 2
    items = spark.createDataFrame([*rows, (None, "all"), (5, None)], "k long, v string")
    pairs = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert {(r.a, r.b): r.shared for r in overlaps.pair_overlaps(items, "k", "v", hot=hot).collect()} == pairs
    degree = {k: sum(k in p for p in pairs) for k in sets}
    assert {r.k: r.degree for r in overlaps.degrees(items, "k", "v", hot=hot).collect()} == {k: n for k, n in degree.items() if n}
    want = [k for _, _, k in sorted((degree[k], len(sets[k]), k) for k in sets)]
    known = items.where("k is not null")
    assert [r.k for r in overlaps.merge_order(known, "k", "v", hot=hot).orderBy("rank").collect()] == want
    assert [r.k for r in overlaps.merge_order(known.withColumn("p", F.lit(1)), "k", "v", ("p",), hot=hot).orderBy("rank").collect()] == want
    applied = {0, 1, 7, 90, 95}
    got = overlaps.overlapping(items, spark.createDataFrame([(k,) for k in applied], "k long"), "k", "v", hot=hot)
    meets = {k: sorted(x for x in applied if x != k and sets[k] & sets[x]) for k in sets}
    assert {r.k: r.applied for r in got.collect()} == {k: x for k, x in meets.items() if x}


def test_a_value_in_all_keys_makes_no_pairs(spark):
    items = spark.range(20_000).select(F.col("id").alias("k"), F.explode(F.array(F.lit("all"), F.concat(F.lit("own"), F.col("id").cast("string")))).alias("v"))
    found = overlaps.degrees(items, "k", "v").agg(F.count("k").alias("n"), F.min("degree").alias("a"), F.max("degree").alias("b")).first()
    assert tuple(found) == (20_000, 19_999, 19_999)


def test_bits_over_blocks(spark):
    bugs = spark.range(500).select(F.col("id").alias("bug"), (F.col("id") % 3).alias("p"), (F.col("id") % 5 > 0).alias("gate"))
    for by in ((), ("p",)):
        many = sinks.dispatch_bits(bugs, ["bug"], "gate", by, blocks=9).orderBy("bug").collect()
        one = sinks.dispatch_bits(bugs.withColumn("_", F.lit(0)), ["bug"], "gate", by or ("_",)).drop("_").orderBy("bug").collect()
        assert [r.asDict() for r in many] == [r.asDict() for r in one]


def test_costs(spark):
    rows = spark.createDataFrame([("k", "m", 100, 40, 10), ("k", "other", 10, None, 1), ("k", None, 10, 0, 0), ("l", "m", None, None, None)], "key string, model string, input_tokens int, cached_input_tokens int, output_tokens int")
    prices = spark.createDataFrame([("m", 1.0, 0.5, 4.0)], "model string, input double, cached double, output double")
    got = {r.key: (r.input_tokens, r.cached_input_tokens, r.output_tokens, pytest.approx(r.cost * 1e6)) for r in rollups.usage_cost(rows, prices, (2.0, 1.0, 8.0), ["key"]).collect()}
    assert got == {"k": (120, 40, 11, 60 + 20 + 40 + 20 + 8 + 20), "l": (0, 0, 0, 0)}


def test_empty_strata(spark):
    rows = spark.createDataFrame([("f", "gated", 1), ("f", "gated", 0), ("f", "gated", 0)], "fuzzer string, stratum string, hit int")
    got = {(r.fuzzer, r.stratum): (r.n, r.hits, r.share) for r in rollups.strata(rows, spark.createDataFrame([("f",), ("g",)], "fuzzer string"), "hit").collect()}
    assert got == {("f", "gated"): (3, 1, 0.3333), ("f", "always"): (0, 0, None), ("g", "gated"): (0, 0, None), ("g", "always"): (0, 0, None)}


def test_traces_and_archives(spark):
    lines = spark.createDataFrame([(0, "offset: 1f called by: 2e"), (1, "noise"), (2, "offset: 3a called by: 2e"), (3, "offset: 1f called by: 2e"), (4, "offset: 1f called by: 4")], "pos int, value string")
    calls = readers.raw_trace(lines)
    assert {r.offset: r.pos for r in readers.trace_offsets(calls).collect()} == {"1f": 0, "3a": 2}
    assert {r.caller: r.callees for r in readers.trace_callees(calls).collect()} == {"2e": ["1f", "3a", "1f"], "4": ["1f"]}
    members = spark.createDataFrame([("b", "x/crash-1", 3), ("a", "x/crash-2", 0), ("a", "leak-1", 1), ("a", "plain", 1)], "path string, member string, size long")
    assert {r.prefix: r.n for r in readers.member_prefixes(members).collect()} == {"crash": 2, "leak": 1, "plain": 1}
    assert [(r.path, r.member) for r in readers.member_samples(members, 2).collect()] == [("a", "leak-1"), ("a", "plain")]


def test_dispatch_state_and_documents(spark):
    bugs = spark.createDataFrame([("p", i, i != 3) for i in range(10)] + [("q", 1, False)], "project string, bug int, gated boolean")
    numbered = sinks.dispatch_bits(bugs, ["bug"], "gated", ("project",))
    assert {r.project: (r.next_bit, r.dispatch_bytes) for r in sinks.dispatch_state(numbered, ("project",)).collect()} == {"p": (9, 2), "q": (0, 1)}
    got = sinks.document("Report", [("Text", "some"), ("None", bugs.where("false")), ("Rows", bugs.where("project = 'q'"))])
    assert got == "# Report\n\n## Text\n\nsome\n\n## None\n\nNothing.\n\n## Rows\n\n| project | bug | gated |\n|---|---|---|\n| q | 1 | False |\n"
    with pytest.raises(ValueError, match="more than 2"):
        sinks.document("x", [("y", bugs)], limit=2)


def test_json_pick(spark):
    df = spark.createDataFrame([('{"a": null, "b": "x"}',), ("{}",), ("bad",), (None,)], "j string")
    assert [r.v for r in df.select(text.json_pick("j", ["$.a", "$.b"], "-").alias("v")).collect()] == ["x", "-", "-", "-"]
