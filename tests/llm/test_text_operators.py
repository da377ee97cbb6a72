"""Operators 1, 2, 4 and 6 against their plain versions."""

import itertools

import brute
import pytest

from crashlens.llm import decontamination, jaccard, lines, substrings


def test_decontamination(spark, docs, corpus):
    rows = [*corpus(1, 40), (900, "x one TWO three y one two"), (901, "a " * 20), (902, "É one, two!three"), (903, " ".join(map(str, range(40))))]
    bench = [(10, "one two three"), (11, "a " * 14), (12, None), (13, ""), (14, "One, two!"), (15, " ".join(map(str, range(3, 22)))), (16, " ".join(map(str, range(3, 22)))), (17, corpus(1, 40)[20][1]), (18, "zz")]
    items = spark.createDataFrame(bench, "item_id long, text string").withColumnRenamed("text", "text")
    want = brute.decontamination(rows, bench)
    got = {r[0]: tuple(r)[1:] for r in decontamination.decontaminate(docs(rows), items).collect()}
    assert got == want
    assert decontamination.decontaminate(docs([]), items).count() == 0
    none = decontamination.decontaminate(docs(rows), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(rows) and not any(r.n_hit or r.contaminated for r in none)


@pytest.mark.parametrize(("window", "gram"), [(13, 6), (5, 1), (4, 4), (9, 3), (12, 7)])
def test_fingerprints_cover_windows(spark, window, gram):
    """Each window keeps its least gram; equal runs of words have equal fingerprints wherever they stand."""
    import random

    rng = random.Random(window)
    run = [f"x{i}" for i in range(window)]
    for n in (0, window - 1, window, window + 1, 60):
        a = [rng.choice("abc") for _ in range(n)]
        b = [*a, *run, "z", "y"]
        frame = spark.createDataFrame([(0, a), (1, b), (2, ["q", *run])], "i int, w array<string>")
        got = {r.i: r.f for r in frame.selectExpr("i", f"{decontamination.fingerprints('w', 'size(w)', window, gram)} as f").collect()}
        places = sorted(x & 2**31 - 1 for x in got[0])
        assert (not places) == (n < window) and all(any(k <= p <= k + window - gram for p in places) for k in range(n - window + 1))
        assert {x >> 31 for x in got[1]} & {x >> 31 for x in got[2]}


def test_decontamination_of_repeated_ids(spark, docs):
    """Each row has its own result; an item on two rows counts once."""
    bench = spark.createDataFrame([(7, "one two three"), (7, "two three four"), (8, "ONE two three")], "item_id long, text string")
    rows = [(1, "one two three four"), (1, "nine ten two six"), (2, "one two three"), (2, "one two three")]
    got = sorted(tuple(r) for r in decontamination.decontaminate(docs(rows), bench).collect())
    sha = brute.sha
    assert got == [(1, 4, 0, 0, sha(""), False), (1, 4, 4, 2, sha("7,8"), True), (2, 3, 3, 2, sha("7,8"), True), (2, 3, 3, 2, sha("7,8"), True)]


def test_decontamination_shuffled(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    rows = corpus(2, 25)
    bench = [(i, t) for i, t in rows[10:14]]
    got = {r[0]: tuple(r)[1:] for r in decontamination.decontaminate(docs(rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == brute.decontamination(rows, bench)


@pytest.mark.parametrize(("rare", "hot", "bits"), [(32, 1 << 20, 48), (1, 1 << 20, 48), (32, 20, 48), (32, 1 << 20, 32)])
def test_jaccard(docs, corpus, monkeypatch, rare, hot, bits):
    monkeypatch.setattr(jaccard, "RARE", rare)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "TOKEN_BITS", bits)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0 if hot == 20 else 1000)
    rows = corpus(3, 90, 120)
    got = {r[0]: tuple(r)[1:] for r in jaccard.jaccard_components(docs([*rows, (None, "x")])).collect()}
    assert got == brute.jaccard(rows)


@pytest.mark.parametrize("rare", [32, 1])
def test_jaccard_links(docs, corpus, monkeypatch, rare):
    monkeypatch.setattr(jaccard, "RARE", rare)
    rows = [x for x in corpus(13, 60, 120)]
    first, want = {}, set()
    for i, t in rows:
        first.setdefault(brute.shingles(t), i)
    some = [(s, i) for s, i in first.items() if s]
    for s, i in some:
        want |= {(i, j) for t, j in some if i < j and 100 * len(s & t) >= 80 * len(s | t)}
    assert {tuple(r) for r in jaccard.jaccard_links(docs(rows)).collect()} == want


def test_jaccard_of_repeated_ids(docs, corpus):
    """Different texts of one doc_id lead to it; links of either count."""
    base = [t for _, t in corpus(17, 40) if t and len(set(t.split())) > 30][0].split()
    near = " ".join([*base[:-1], "other"])
    rows = [(5, " ".join(base)), (5, "zz " + " ".join(f"q{i}" for i in range(60))), (9, near), (7, "aa " + " ".join(f"q{i}" for i in range(60))), (8, "alone " * 9)]
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs(rows)).collect()}
    assert got == {(5, 5), (9, 5), (7, 5), (8, 8)}


def joined_rows(plan, of):
    """Rows made by a plan's joins that name a column, after it ran."""
    if "AdaptiveSparkPlan" in plan.nodeName():
        return joined_rows(plan.executedPlan(), of)
    if "QueryStage" in plan.nodeName():
        return joined_rows(plan.plan(), of)
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() and of in plan.simpleString(100) else 0
    return own + sum(joined_rows(plan.children().apply(i), of) for i in range(plan.children().size()))


@pytest.mark.parametrize("rare", [32, 1])
def test_jaccard_meets_components_as_wholes(docs, monkeypatch, rare):
    """Documents just too far from a group meet it once a shared token, not once a token and member."""
    monkeypatch.setattr(jaccard, "RARE", rare)
    verified, seen = jaccard._verified, []

    def spied(pairs, held, percent):
        rows = pairs.collect()
        seen.append((len(rows), joined_rows(pairs._jdf.queryExecution().executedPlan(), "_component")))
        return verified(pairs, held, percent)

    monkeypatch.setattr(jaccard, "_verified", spied)
    base = [f"x{i}" for i in range(300)]
    rows = [(i, " ".join(f"y{i}" if k == 7 * i + 3 else x for k, x in enumerate(base))) for i in range(40)]
    spots = {10 * e + 4: ij for e, ij in enumerate(itertools.combinations(range(8), 2))}  # two of the others change each
    rows += [(50 + i, " ".join(f"z{k}" if i in spots.get(k, ()) else x for k, x in enumerate(base))) for i in range(8)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(rows)).collect()}
    assert got == brute.jaccard(rows) and len({c for _, c in got.values()}) == 9
    pairs, made = seen[-1]
    assert pairs > 100 and made < 10 * pairs


def test_jaccard_edges(docs):
    assert jaccard.jaccard_components(docs([])).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, None), (4, "")]
    assert sorted(map(tuple, jaccard.jaccard_components(docs(rows)).collect())) == [(3, 0, 3), (4, 0, 4), (5, 2, 5), (5, 2, 5)]


@pytest.mark.parametrize("counters", [1 << 17, 1])
def test_lines(docs, corpus, monkeypatch, counters):
    monkeypatch.setattr(lines, "COUNTERS", counters)
    rows = [*corpus(4, 60), (700, "\n\nx\n"), (701, "X\nx\n x "), (702, "a\tb\rc\x0bd\x0ce f\nF e  d c b a"), (703, "long " * 30_000 + "\n" + "w1\n" * 3000)]
    out = lines.dedup_lines(docs([*rows, (None, "w1\nw1")])).collect()
    got = {r.doc_id: (r.n_lines, r.n_removed, brute.sha(r.text or "")) for r in out if r.doc_id is not None}
    assert got == brute.lines(rows)
    assert [r.text for r in out if r.doc_id is None] == ["w1\nw1"]
    assert lines.dedup_lines(docs([])).count() == 0


def test_lines_of_repeated_ids(docs):
    """Only a row's own lines go; wholly equal rows stay alike."""
    out = lines.dedup_lines(docs([(1, "a b c d e\nx y z w v"), (1, "p q r s t\na b c d e"), (2, "same here\nsame here"), (2, "same here\nsame here")])).collect()
    kept = [x for r in out for x in r.text.split("\n")]
    assert sorted(kept) == sorted(["a b c d e", "x y z w v", "p q r s t", "same here", "same here"])


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_lines_thresholds(docs, corpus, percent):
    rows = corpus(14, 50)
    got = {r.doc_id: (r.n_lines, r.n_removed, brute.sha(r.text or "")) for r in lines.dedup_lines(docs(rows), percent).collect()}
    assert got == brute.lines(rows, percent)


@pytest.mark.parametrize("percent", [80, 100])
def test_lines_of_the_same_words(docs, percent):
    """Other orders, blanks, cases and repeats of a line's words, short or long, are that line."""
    rows = [(1, "a b c d e f\none two\nq r s t"), (2, "F  e d\tc b a a\ntwo ONE one\nq r s t u v"), (3, "f e d c b a \ntwo\nt q r s"), (4, "one two \n a b c d e f")]
    got = {r.doc_id: (r.n_lines, r.n_removed, brute.sha(r.text or "")) for r in lines.dedup_lines(docs(rows), percent).collect()}
    assert got == brute.lines(rows, percent) and got[4][1] == 2


def test_lines_long_and_short_of_a_second_parity(docs):
    import random

    rng, rows = random.Random(8), []
    for i in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((50, 70, 72, 80, 130)))]
        near = [f"x{rng.randrange(400)}" if rng.random() < rng.choice((0, 0.1, 0.2)) else w for w in base]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, "\t".join(near[: rng.randrange(48, len(near) + 1)]))]
    got = {r.doc_id: (r.n_lines, r.n_removed, brute.sha(r.text or "")) for r in lines.dedup_lines(docs(rows)).collect()}
    assert got == brute.lines(rows)


def test_lines_are_split_once(spark, docs):
    """Texts are read for their lines, for the words of pairs and for what is left: not again for counts, nor for the later pairs."""
    words = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join([*words[:i], f"n{i}", *words[i + 1 :]])) for i in range(10)]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    source = docs(rows)
    got = {r.doc_id: (r.n_lines, r.n_removed, brute.sha(r.text or "")) for r in lines.dedup_lines(source.mapInArrow(count, source.schema)).collect()}
    assert got == brute.lines(rows) and read.value <= 3 * len(rows)


def test_lines_are_kept_for_pairs(spark, docs):
    """Texts are read for their lines and for what is left: the words of pairs come from the lines."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(i, " ".join(f"w{j}" for j in range(20) if j != i)) for i in range(10)]
    source = docs(rows)
    got = {r.doc_id: (r.n_lines, r.n_removed, brute.sha(r.text or "")) for r in lines.dedup_lines(source.mapInArrow(count, source.schema)).collect()}
    assert got == brute.lines(rows) and read.value <= 2 * len(rows)


def test_lines_near_to_a_first_one_that_no_pair_has(spark, docs):
    """Two lines match; both look near to the first of their words' lists, too late in it for a pair with it."""
    words = [f"v{i}" for i in range(4000)]
    low = [r.h for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(w) & 63 as h").collect()]
    h = words[:20]
    # words that change no parity
    others = lambda i: [w for w, x in zip(words[20:], low[20:], strict=True) if x == low[i] and low.index(x) == i]
    rare, often = next((i for i in range(20) if len(others(i)) > 1)), [i for i in range(20) if others(i)][1:3]
    h = [h[i] for i in (rare, *often)] + [w for i, w in enumerate(h) if i not in (rare, *often)]
    y, x = ([others(rare)[k], *(others(i)[0] for i in often), *h[3:]] for k in (0, 1))
    rows = [(0, " ".join(h)), (1, " ".join(y)), (2, " ".join(x)), (3, "\n".join([*h[5:] * 20, *y[1:3] * 60]))]
    got = {r.doc_id: (r.n_lines, r.n_removed, brute.sha(r.text or "")) for r in lines.dedup_lines(docs(rows)).collect()}
    assert got == brute.lines(rows) and [got[i][1] for i in range(3)] == [0, 0, 1]


def test_lines_of_one_group(docs):
    """Many near copies of one line, some near to the first, some only to each other."""
    import random

    rng, base = random.Random(9), [f"b{i}" for i in range(30)]
    rows = []
    for i in range(150):
        x = list(base)
        for _ in range(rng.choice((1, 3, 4, 6))):
            x[rng.randrange(30)] = f"v{rng.randrange(12)}"
        rows.append((i, " ".join(x)))
    got = {r.doc_id: (r.n_lines, r.n_removed, brute.sha(r.text or "")) for r in lines.dedup_lines(docs(rows)).collect()}
    assert got == brute.lines(rows)


@pytest.mark.parametrize(("window", "gram", "shard"), [(50, 20, 4096), (12, 4, 4096), (12, 4, 5)])
def test_repeats(docs, corpus, monkeypatch, window, gram, shard):
    monkeypatch.setattr(substrings, "SHARD", shard)
    rows = corpus(5, 70, 110)
    got = {r[0]: tuple(r)[1:4] for r in substrings.remove_repeats(docs([*rows, (None, "x")]), window, gram).collect()}
    assert got == brute.repeats(rows, window)


def test_matching_statistics():
    """Longest matches from each word on, and the least owner of full ones, against all substrings."""
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(60):
        depth, n = int(rng.integers(2, 9)), int(rng.integers(1, 12))
        rows = [rng.integers(1, int(rng.integers(3, 7)), rng.integers(depth, 2 * depth)) for _ in range(n)]
        owners, some = rng.integers(0, 5, n), rng.random(n) < 0.7
        some[0] = True
        index = substrings.FMIndex([r for r, i in zip(rows, some, strict=True) if i], owners[some], depth)
        held: dict[tuple, int] = {}
        for r, o in ((r, o) for r, o, i in zip(rows, owners.tolist(), some, strict=True) if i):
            for a in range(len(r)):
                for b in range(a, len(r) + 1):
                    held[tuple(r[a:b])] = min(held.get(tuple(r[a:b]), 9), o)
        words, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
        begin = np.cumsum(sizes) - sizes
        match, low, high = index.statistics(words, begin, begin + sizes)
        for r, x in zip(rows, begin.tolist(), strict=True):
            for p in range(len(r)):
                want = max(m for m in range(min(depth, len(r) - p) + 1) if tuple(r[p : p + m]) in held)
                assert match[x + p] == want or (match[x + p] == 0 and want < depth)
                if want == depth:
                    assert index.minima(low[[x + p]].astype(int), high[[x + p]].astype(int))[0] == held[tuple(r[p : p + depth])]


def test_repeats_empty(docs):
    assert substrings.remove_repeats(docs([])).count() == 0
