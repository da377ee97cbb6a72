"""Work that must not grow with the square of a row's size, and joins that must not be broadcast."""

import random
import time

from pyspark.sql import functions as F

from crashlens.functions import bits, text
from crashlens.operators import lookup, overlaps
from crashlens.plans import catalogue
from crashlens.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def took(df):
    df.limit(1).count()
    start = time.time()
    rows = df.collect()
    return rows, time.time() - start


def test_grams_are_not_broadcast(spark):
    builds = spark.createDataFrame([(1, "p", "abcdef12", "x"), (2, "p", "99", "y")], "line int, target string, commit_id string, oss_fuzz_commit string")
    wanted = spark.createDataFrame([("p", "bcde"), ("p", "none")], "target string, commit string")
    assert "BroadcastHashJoin" not in plan(lookup.containing(wanted, builds, "commit", "commit_id"))
    out = readers.build_commits(builds, wanted)
    assert {tuple(r) for r in out.collect()} == {("p", "bcde", "x", True), ("p", "none", "y", False)}
    assert plan(out).count("BroadcastHashJoin") <= 1  # each project's last row


def test_prefixes_are_not_broadcast(spark):
    rng = random.Random(3)
    ids = lambda n: ["".join(rng.choice("ab") for _ in range(rng.choice((1, 2, 3, 9)))) for _ in range(n)]
    x, y = ids(80), ids(90)
    left, right = spark.createDataFrame(list(enumerate(x)), "i int, a string"), spark.createDataFrame(list(enumerate(y)), "j int, b string")
    wanted = sorted((i, j) for i, p in enumerate(x) for j, q in enumerate(y) if p.startswith(q) or q.startswith(p))
    for pairs in (lookup.PAIRS, 50):
        out = lookup.prefixes(left, right, "a", "b", pairs)
        assert sorted((r.i, r.j) for r in out.collect()) == wanted and out.columns == ["a", "i", "j", "b"]
        assert plan(lookup.affix_pairs(left, right, "a", "b")).count("BroadcastHashJoin") == 0


def test_report_block_computes_lines_once(spark):
    body = "\n".join(f"Key{i}: {i}\nfree {i}" for i in range(60)) + "\nCrash State:\n" + "\n".join(f" f{i}" for i in range(60))
    df = spark.range(400, numPartitions=1).select(text.report_block(F.concat(F.lit(body), F.lit("\n\nend "), "id")).alias("r"))
    rows, seconds = took(df)
    assert all(len(r.r.fields) == 60 and r.r.crash_state == [f"f{i}" for i in range(60)] and r.r.extra.count("\n") == 59 for r in rows)
    assert seconds < 30


def test_wide_masks(spark):
    width = 20000
    df = spark.createDataFrame([(b,) for b in (0, 7, 70, 8 * width - 1, None)], "bit int").select("bit", bits.mask(F.col("bit"), F.lit(width)).alias("m"))
    rows, seconds = took(df.select("bit", bits.lone_bit(F.col("m")).alias("lone"), bits.places(F.col("m")).alias("places")))
    assert all(r.lone == r.bit and r.places == ([] if r.bit is None else [r.bit]) for r in rows) and len(rows) == 5
    assert seconds < 30
    both = spark.createDataFrame([(bytes([3]),), (b"",), (bytes([0, 128]),), (None,)], "m binary").select(bits.lone_bit(F.col("m")).alias("x"))
    assert [r.x for r in both.collect()] == [None, None, 15, None]


def test_wide_mask_sets(spark):
    width, rng = 12000, random.Random(1)
    a, b = (sorted(rng.sample(range(8 * width), 30000)) for _ in range(2))
    df = spark.createDataFrame([([*a, a[0]], b)], "a array<int>, b array<int>").select(bits.mask_of(F.col("a"), F.lit(width)).alias("a"), bits.mask_of(F.col("b"), F.lit(width + 3)).alias("b"))
    rows, seconds = took(df.select("a", "b", bits.mask_or(F.col("a"), F.col("b")).alias("o"), bits.mask_and(F.col("a"), F.col("b")).alias("n")))
    number = lambda v: sum(1 << p for p in v)
    r = rows[0]
    assert int.from_bytes(r.a, "little") == number(a) and len(r.a) == width and int.from_bytes(r.b, "little") == number(b) and len(r.o) == len(r.n) == width + 3
    assert int.from_bytes(r.o, "little") == number({*a, *b}) and int.from_bytes(r.n, "little") == number({*a} & {*b})
    assert seconds < 60
    few = spark.createDataFrame([([],), ([9, 1, 0],)], "a array<int>").select(bits.mask_of(F.col("a"), F.lit(3)).alias("m"))
    assert [bytes(r.m) for r in few.collect()] == [b"\0\0\0", bytes([3, 2, 0])]


def test_width_makes_no_masks(spark):
    out = catalogue.QUERIES["dispatch_bits_whole_table"](spark, SF)
    assert "unhex" not in plan(out)
    rows = sinks.dispatch_bits(spark.range(20), ["id"], "id < 17").collect()
    assert all(r.mask_bytes == len(r.dispatch_mask) == 3 for r in rows)


def test_degrees_make_no_pairs(spark):
    rng = random.Random(2)
    items = [(k, v) for k in range(300) for v in {rng.choice(("hot", "warm")) if k % 3 else "", f"v{rng.randrange(60)}", f"v{rng.randrange(60)}"} if v]
    frame = spark.createDataFrame(items, "k int, v string")
    sets = {}
    for k, v in items:
        sets.setdefault(k, set()).add(v)
    wanted = {k: n for k in sets if (n := sum(1 for o in sets if o != k and sets[o] & sets[k]))}
    for hot in (5, 50, 1000):
        out = overlaps.degrees(frame, "k", "v", hot=hot)
        assert {r.k: r.degree for r in out.collect()} == wanted
        assert "shared" not in plan(out)


def test_inventory_has_all_trials(spark):
    users = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    assert sum(r.n for r in catalogue.QUERIES["trial_inventory"](spark, SF).collect()) == users


def test_merge_order_makes_its_sets_once(spark, monkeypatch):
    made = []
    stored = overlaps.shared.stored
    monkeypatch.setattr(overlaps.shared, "stored", lambda df, name: made.append(name) or stored(df, name))
    items = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", None), ("c", None), (None, 4), ("d", 5)], "k string, v int")
    out = overlaps.merge_order(items, "k", "v")
    assert {r.k: (r.n, r.degree) for r in out.collect()} == {"a": (1, 1), "b": (1, 1), "c": (0, 0), "d": (1, 0), None: (1, 0)}
    assert sorted(r["rank"] for r in out.collect()) == [1, 2, 3, 4, 5] and made.count("sets") == 1
    # the sizes' key, and the distinct rows with a null, are all that the table itself is still shuffled for
    assert overlaps._sets(items, "k", "v", []).count() == 3
