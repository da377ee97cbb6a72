"""Operators 11, 12 and 13 and their queries against plain versions."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import ITEM_WORD, LOW

from crashlens.llm import bins, importance, lexical, queries
from crashlens.llm.tokens import Encoder, crc32, public

ODD = [None, "", " \n", "Été é 漢字 x", "a-b_c`d\x7fe", "A b A b A", "9 Z[z]", "it's 3.5"]


def drawn(docs, bench, orders, buckets, percent, seed=2024, least=20):
    words = lambda t: ITEM_WORD.findall((t or "").translate(LOW))
    grams = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(grams(words(x)))
    for _, x in bench:
        t.update(grams(words(x)))
    big_s, big_t, out = sum(s.values()), sum(t.values()), []
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    for i, x in docs:
        w = words(x)
        f = grams(w)
        weight, score = (sum(gain[b] for b in f) // len(f) if f else 0), None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, len(w), len(f), weight, score, None])
    fit = sorted((r for r in out if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=repr)


def scores(docs, bench, k):
    words = lambda t: ITEM_WORD.findall((t or "").translate(LOW))
    texts = [(i, Counter(w)) for i, x in docs if (w := words(x))]
    n, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df, out = Counter(w for _, c in texts for w in c), []
    for item, x in bench:
        q, found = Counter(words(x)), []
        for i, c in texts:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, times in q.items() if c[w])
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture
def bench(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string").withColumns({c: importance.F.lit("x") for c in ("q", "rank", "score", "_x")})


@pytest.mark.parametrize("orders, percent", [(1, 10), (3, 50)])
def test_importance(docs, bench, corpus, monkeypatch, orders, percent):
    monkeypatch.setattr(importance, "BLOCK", 500)
    rows = [*corpus(5, 60), *((300 + i, x) for i, x in enumerate(ODD)), (70, "w1 w2 " * 40), (70, "w1 w2 " * 40), (None, "w3 " * 30), (900, "long " * 30_000)]
    items = [(1, "w1 w2 w3 w4"), (2, None), (3, "w5 Été w6 w5")]
    out = importance.resample(docs(rows), bench(items), orders, 500, percent)
    assert sorted(map(tuple, out.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr) == drawn(rows, items, orders, 500, percent)


def test_importance_of_nothing(docs, bench):
    assert importance.resample(docs([]), bench([(1, "a")])).count() == 0
    assert [r["rank"] for r in importance.resample(docs([(1, "a " * 30), (2, "b")]), bench([]), percent=100).orderBy("doc_id").collect()] == [1, None]


def test_words_with_one_hash(monkeypatch):
    monkeypatch.setattr(importance.scan, "hashes", lambda data, starts, ends, lower: (ends - starts).astype(np.uint64))
    data = np.frombuffer(b"ab cd ab e cd", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 11]), np.array([2, 5, 8, 10, 13])
    assert importance.word_ids(data, starts, ends)[0].tolist() == [0, 1, 0, 2, 1]
    vocabulary = lexical.Vocabulary([b"cd", b"xy", b"ab"])
    where, codes = vocabulary.find(data, starts, ends)
    assert sorted((w, vocabulary.terms[c]) for w, c in zip(where.tolist(), codes.tolist(), strict=True)) == [(0, b"ab"), (1, b"cd"), (2, b"ab"), (4, b"cd")]


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_suffixes(depth):
    rng = np.random.default_rng(depth)
    sizes = rng.integers(0, 12, 20)
    ids = rng.integers(0, 3, int(sizes.sum()))
    ends = np.repeat(np.cumsum(sizes), sizes)
    order, common = importance.suffixes(ids, ends - np.arange(len(ids)), depth)
    heads = [tuple(ids[i : min(i + depth, ends[i])]) for i in order]
    assert heads == sorted(heads) and sorted(order.tolist()) == list(range(len(ids)))
    assert common[1:].tolist() == [next((j for j, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y))) for x, y in zip(heads, heads[1:], strict=False)]


@pytest.mark.parametrize("seed", range(4))
def test_first_fit(seed):
    rng = np.random.default_rng(seed)
    capacity, lengths = int(rng.integers(8, 300)), rng.integers(1, 2000, int(rng.integers(0, 500)))
    lengths = np.minimum(lengths, capacity)
    found, room, place = bins.first_fit_decreasing(lengths, capacity), [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):  # the plain rule
        at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        room[at:] = room[at:] or [capacity]
        room[at] -= lengths[i]
        place.setdefault(at, []).append(i)
    assert found == [place[b] for b in range(len(room))]
    for slack in (0, 5):
        out, seen = bins.level(found, lengths, capacity, slack), {}
        for part in out:
            n = sum(b - a for _, a, b in part)
            assert capacity - slack <= n <= capacity or n & (n - 1) == 0
            for i, a, b in part:
                seen.setdefault(i, []).append((a, b))
        for i, n in enumerate(lengths.tolist()):
            spans = sorted(seen[i])
            assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def packed_right(rows, out, capacity):
    coder, own, places = Encoder(public("word_bpe_49k.json")), {}, {}
    want = Counter()
    for i, t in rows:
        ids = np.array([*coder.library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i, ids.tobytes()] += 1
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        own.setdefault(r.doc_id, []).append(r)
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end += length
        assert end == capacity or end < capacity and end & (end - 1) == 0
    return want, own


def test_packing_in_groups(docs, corpus):
    rows = [*corpus(6, 60), *((300 + i, x) for i, x in enumerate(ODD)), (901, "word " * 700), (None, "no id")]
    out = bins.pack_groups(docs(rows), 128, group=16).collect()
    want, own = packed_right(rows, out, 128)
    for (i, ids), _ in want.items():
        parts = sorted(own[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in parts) == ids and all(r.doc_tokens * 4 == len(ids) and r.length * 4 == len(r.ids) for r in parts)
        assert [r.start for r in parts] == [sum(x.length for x in parts[:k]) for k in range(len(parts))]
    assert bins.pack_groups(docs([])).count() == 0
    same = bins.pack_groups(docs([(5, "a b c")] * 40), 16, group=8)
    assert same.groupBy("start").count().count() >= 1 and sum(r.length for r in same.collect()) == 160


@pytest.mark.parametrize("shard, sample, words", [(1 << 16, 1 << 13, 1 << 20), (7, 4, 20), (20, 1, 1 << 20)])
def test_search(docs, bench, corpus, monkeypatch, shard, sample, words):
    for name, value in (("SHARD", shard), ("SAMPLE", sample), ("QUERY_WORDS", words), ("LEFT", 1)):
        monkeypatch.setattr(lexical, name, value)
    rows = [*corpus(7, 70), *((300 + i, x) for i, x in enumerate(ODD)), (70, "w1 w2"), (70, "w1 w2"), (None, "w1 w2 w3"), (900, "w7 " * 30_000)]
    items = [(1, "w1 w2 w3 w4 w1"), (2, None), (3, "Été 漢字 w6"), (3, "w9"), (None, "W10 w11"), (5, "unknown"), (6, ""), *((10 + i, x) for i, x in corpus(8, 14))]
    out = lexical.search_documents(docs(rows), bench(items), 4)
    assert sorted(map(tuple, out.collect()), key=repr) == scores(rows, items, 4)
    assert lexical.search_documents(docs([]), bench(items)).count() == 0 and lexical.search_documents(docs(rows), bench([])).count() == 0


def test_search_stops_early(monkeypatch):
    """Rare terms settle the query: the frequent term's postings stay unread, and scores are complete all the same."""
    rng = np.random.default_rng(3)
    n, sizes = 4000, []
    codes, tfs = [], []
    for i in range(n):
        own = [0] + ([1] if i % 500 == 0 else []) + ([2] if i % 400 == 0 else [])
        sizes.append(len(own))
        codes += own
        tfs += rng.integers(1, 5, len(own)).tolist()
    shard = lexical.Shard(np.arange(n), rng.integers(5, 50, n), np.array(sizes), np.array(codes), np.array(tfs), n, n * 20, 3)
    query = lexical.Query(np.array([0, 1, 2]), np.array([1, 9000, 8000]))
    exact = shard.complete(np.arange(n), query)
    want = sorted(zip((-exact).tolist(), range(n), strict=True))[:5]
    asked = []
    complete = shard.complete
    monkeypatch.setattr(shard, "complete", lambda docs, q: asked.append(len(docs)) or complete(docs, q))
    assert shard.search(query, 5, 0) == [(-s, i) for s, i in want] and asked and asked[0] <= 40
    assert shard.search(query, 5, int(exact.max()) + 1) == []


def test_queries_run(spark, tmp_path, docs, corpus):
    rows, items = [*corpus(9, 60), (None, "w1 " * 25), (7, "again " * 25)], [(1, "w1 w2 w3"), (2, None), (4, "w8 w9 w8")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {n: queries.QUERIES[n](spark, str(tmp_path)).collect() for n in ("op11_importance_resampling", "op12_packing", "op13_ranked_search")}
    assert sorted(map(tuple, got["op11_importance_resampling"]), key=repr) == sorted((x[:1] + x[2:] for x in drawn(rows, items, 1, 10_000, 10)), key=repr)
    want, own = packed_right(rows, got["op12_packing"], 2048)
    for (i, ids), n in want.items():
        if n == 1 and len(own[i]) == 1:
            assert own[i][0].ids_crc32 == crc32(np.frombuffer(ids, "<u4")) and own[i][0].doc_tokens * 4 == len(ids)
    assert sorted(map(tuple, got["op13_ranked_search"]), key=repr) == scores(rows, items, 10)
