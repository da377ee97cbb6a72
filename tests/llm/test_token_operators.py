"""Operators 5, 8 and 9: the library's ids, exact round trips and packing bounds."""

import random

import numpy as np
import pytest

from crashlens.llm import packing, scratch, token_counts, token_files
from crashlens.llm.tokens import Encoder, crc32, public
from crashlens.llm.wavelet import WaveletMatrix

ODD = ["", "  ", "a  b\n\nc \t x'll don't  ", "Été ß 12 3¾ İx 漢字 é", "<|endoftext|> hi", " \n x\r\n", "a\x00b", "123abc!!! ?  ", None, "é x", "tab\tafter", "🎉 ok"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_library_s(name, corpus):
    coder = Encoder(public(name))
    for group in (ODD, [t for _, t in corpus(1, 30)], [(x or "") + (y or "") for x in ODD for y in ODD]):
        ids, offsets = coder.encode(group)
        for i, text in enumerate(group):
            assert coder.library.encode(text or "", add_special_tokens=False).ids == ids[offsets[i] : offsets[i + 1]].tolist()


def test_cache_is_bounded(monkeypatch):
    from crashlens.llm import tokens

    monkeypatch.setattr(tokens, "CACHE", 5)
    coder = Encoder(public("word_bpe_49k.json"))
    for text in ("a b c d", "e f g h i j k", "a z"):
        assert coder.encode([text])[0].tolist() == coder.library.encode(text, add_special_tokens=False).ids


def test_memory_of_an_encoder_is_bounded():
    import tracemalloc

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(350)) for _ in range(1500)]
    coder = Encoder(public("word_bpe_49k.json"))
    tracemalloc.start()
    try:
        ids, offsets = coder.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 70e6
    for i in (0, 777, 1499):
        assert coder.library.encode(texts[i], add_special_tokens=False).ids == ids[offsets[i] : offsets[i + 1]].tolist()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_wavelet_matrix(n):
    v = np.random.default_rng(n).integers(0, 50, n)
    w = WaveletMatrix.from_bytes(WaveletMatrix.build(v, 16).to_bytes())
    assert w.decode().tolist() == v.tolist() and w.access(np.arange(n)).tolist() == v.tolist()
    for x in (0, 7, 49, 60000):
        assert w.count(x) == (v == x).sum() and w.select(x).tolist() == np.flatnonzero(v == x).tolist()
        assert w.rank(np.full(n + 1, x), np.arange(n + 1)).tolist() == np.concatenate(([0], np.cumsum(v == x))).tolist()


def test_token_files(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD", 100)
    rows = [(i + 3, t) for i, t in corpus(2, 40)] + [(200 + i, t) for i, t in enumerate(ODD)]
    random.Random(1).shuffle(rows)
    path = public("byte_bpe_50k.json")
    manifest = token_files.write(docs([*rows, (None, "x")]), path, 2, scratch.folder(spark, "t"), 3)
    got, coder, start = sorted(map(tuple, token_files.read(manifest, 2).collect())), Encoder(path), 0
    for (doc, text), row in zip(sorted(rows, key=lambda r: r[0]), got, strict=True):
        ids = np.array([*coder.library.encode(text or "", add_special_tokens=False).ids, 2])
        assert row == (doc, start, len(ids), crc32(ids))
        start += len(ids)
    assert token_files.read(token_files.write(docs([]), path, 2, scratch.folder(spark, "t"), 3), 2).count() == 0


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_token_counts(spark, docs, corpus, monkeypatch, block):
    monkeypatch.setattr(token_counts, "FILE", 300)
    rows = [*corpus(3, 25), *((500 + i, t) for i, t in enumerate(ODD))]
    path = public("word_bpe_49k.json")
    files = token_counts.write_flat(docs(rows), path, 49407, scratch.folder(spark, "f"))
    counts = token_counts.count_tokens(files.select("path", "n_bytes"), 49407, block=block)
    coder, have = Encoder(path, True), {}
    for r in files.collect():
        have |= {(r.path, i): d for i, d in enumerate(r.doc_ids)}
    got = {have[r.path, r.ordinal]: r.n_tokens for r in counts.collect()}
    assert got == {i: len(coder.library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_open_end_of_a_flat_file(spark):
    out = scratch.folder(spark, "f")
    token_files.put(f"{out}/a.bin", np.array([5, 5, 9, 9, 5, 5, 5], "<u2").tobytes())
    token_files.put(f"{out}/b.bin", b"")
    files = spark.createDataFrame([(f"{out}/a.bin", 14), (f"{out}/b.bin", 0)], "path string, n_bytes long")
    assert sorted((r.ordinal, r.n_tokens) for r in token_counts.count_tokens(files, 9, block=4).collect()) == [(0, 2), (1, 0), (2, 3)]


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 80))
    counts = np.bincount(rng.integers(1, capacity + 1, rng.integers(0, 400)), minlength=capacity + 1)
    patterns = packing.plan(counts, capacity)
    used = np.zeros(capacity + 1, int)
    for pattern, times in patterns:
        assert sum(pattern) <= capacity
        for x in pattern:
            used[x] += times
    assert (used == counts).all()
    bins, total = sum(n for _, n in patterns), int((np.arange(capacity + 1) * counts).sum())
    assert bins <= -(-total // capacity) * 1.3 + 2


def test_exact_complements_come_first():
    counts = np.zeros(11, int)
    counts[[10, 7, 3, 5, 2]] = [2, 3, 3, 2, 1]
    assert sum(n for _, n in packing.plan(counts, 10)) == 7
    counts[:] = 0
    counts[[6, 2]] = [4, 8]
    assert packing.plan(counts, 10) == [((6, 2, 2), 4)]


def test_packing(docs, corpus):
    rows = [*corpus(4, 60), (901, "word " * 300), (902, "word " * 300)]
    out = packing.pack_documents(docs(rows), 128).collect()
    coder, places = Encoder(public("word_bpe_49k.json")), {}
    for i, t in rows:
        ids = np.array([*coder.library.encode(t or "", add_special_tokens=False).ids, 1])
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, a, min(128, len(ids) - a), crc32(ids[a : a + 128])) for k, a in enumerate(range(0, len(ids), 128))]
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 128
    assert len(places) <= -(-sum(r.length for r in out) // 128) + 3
    assert packing.pack_documents(docs([])).count() == 0


def test_plan_tries_every_exact_fill():
    """One hot length and scarce partners: more than 64 tries for a length find fills that were left to best fit."""
    import numpy as np

    from crashlens.llm import packing

    rng = np.random.default_rng(7)
    counts = np.zeros(1025, np.int64)
    k, most = int(rng.choice([60, 150, 300, 500])), int(rng.choice([250, 330, 500]))
    counts[rng.integers(1, most, k)] = 1
    counts[int(rng.integers(200, 500))] = int(rng.choice([100, 300]))
    patterns, used = packing.plan(counts, 1024), np.zeros(1025, np.int64)
    for pattern, times in patterns:
        assert sum(pattern) <= 1024
        for length in pattern:
            used[length] += times
    assert (used == counts).all() and sum(t for _, t in patterns) <= 161 and sum(t for p, t in patterns if sum(p) == 1024) >= 112


def test_ranges_grow_with_the_table(spark, docs, corpus, monkeypatch):
    from crashlens.llm import scratch

    table = scratch.stored(docs(corpus(3, 40)).select("doc_id", "text"), "documents")
    assert scratch.ranges(table) == scratch.partitions(spark)
    monkeypatch.setattr(scratch, "RANGE", 100)
    assert scratch.ranges(table) > scratch.partitions(spark)
