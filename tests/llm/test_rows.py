"""Rows without an id, with a repeated one or wholly equal; shared hashes; large capacities; and all queries over a small folder."""

import random

import brute
import corpus_pipeline as pipeline
import numpy as np
import pytest

from crashlens.llm import jaccard, lines, packing, queries, scratch, token_counts
from crashlens.llm.tokens import Encoder, crc32, public

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def known(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def words(seed, n=40):
    rng = random.Random(seed)
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def test_near_copies_by_row(spark):
    base, other = words(1), words(2)
    near = " ".join([*base[:-1], "changed"])
    rows = [(3, " ".join(base)), (5, near), (5, " ".join(other)), (None, None), (None, " ".join(words(3))), (None, near + " x"), (7, " ".join(words(4))), (7, " ".join(words(4))), (8, ""), (8, ""), (9, " ".join(words(5))), (9, " ".join([*words(5)[:-1], "z"]))]
    out = [(r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, known(spark, rows), "").collect()]
    want = [(3, rows[0][1]), (5, rows[2][1]), (None, None), (None, rows[4][1]), (7, rows[6][1]), (8, ""), (8, "")]
    nine = [x for x in out if x[0] == 9]
    assert sorted((x for x in out if x[0] != 9), key=repr) == sorted(want, key=repr) and len(nine) == 1 and nine[0] in rows


def test_contamination_by_row(spark, tmp_path):
    item = " ".join(words(6, 20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"a {item} b"), (1, "clean text here"), (None, f"c {item}"), (None, "clean as well"), (2, "clean"), (3, None), (4, f"d {item}"), (4, f"d {item}")]
    out = pipeline.decontaminate(spark, known(spark, rows), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted([rows[1], rows[3], rows[4], rows[5]], key=repr)
    assert out[0].__fields__ == list(pipeline.COLUMNS)


def test_lines_by_row(spark):
    long = "one two three four five six"
    rows = [(2, "same here\nsame here"), (2, "same here\nsame here"), (None, f"{long}\nmine alone"), (1, long), (None, None), (3, "\n"), (4, "same here")]
    out = [(r.doc_id, r.text, r.n_chars) for r in pipeline.dedup_lines(spark, known(spark, rows), "").collect()]
    assert sorted(out, key=repr) == sorted([(2, "same here", 9), (2, "same here", 9), (None, "mine alone", 10), (1, long, len(long)), (None, None, None), (3, "\n", 1)], key=repr)
    twice = lines.dedup_lines(known(spark, rows[:2]).withColumnsRenamed({"lang": "_gone", "source": "__gone"}))
    assert [(r.n_lines, r.n_removed, r._gone) for r in twice.collect()] == [(2, 1, "en")] * 2


def test_language_by_row(spark):
    rows = [(i, "das ist ein Haus und der Baum " * 3) for i in range(4)] + [(None, "noch ein Haus und Baum"), (1, "und der"), (5, None), (6, "123")]
    out = pipeline.identify_language(spark, known(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text, r.lang) for r in out), key=repr) == sorted(((i, t, "en") for i, t in rows[:6]), key=repr)
    assert pipeline.identify_language(spark, known(spark, rows).withColumn("lang", pipeline.F.lit(None).cast("string")), "").count() == 0


def test_sets_that_share_a_hash(docs, corpus, monkeypatch):
    prints = jaccard._prints

    def short(tokens, edges, salt):
        return prints(tokens, edges, salt) & (15 if salt == 1 else -1)

    def nodes(tokens, edges, twice):
        out = short(tokens, edges, 1)
        shared = np.isin(out, twice)
        out[shared] = short(tokens, edges, 2)[shared]
        return out

    monkeypatch.setattr(jaccard, "_prints", short)  # both, as workers import the module anew
    monkeypatch.setattr(jaccard, "_nodes", nodes)
    rows = corpus(12, 60)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(rows)).collect()}
    assert out == brute.jaccard(rows)


@pytest.mark.parametrize("seed", range(4))
def test_pairs_without_an_index(monkeypatch, seed):
    """Found when asked for, they give the same patterns as the index."""
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(20, 400))
    counts = np.bincount(rng.integers(1, capacity + 1, 500), minlength=capacity + 1)
    want = packing.plan(counts, capacity)
    monkeypatch.setattr(packing, "LENGTHS", 0)
    assert packing.plan(counts, capacity) == want


def test_capacity_beyond_two_bytes(docs):
    counts = np.zeros(131_073, np.int64)
    counts[[66_000, 65_072, 131_072, 100_000, 31_072]] = 1
    assert sorted(sum(p) for p, n in packing.plan(counts, 131_072) for _ in range(n)) == [131_072] * 3
    out = packing.pack_documents(docs([(1, "word " * 70_000), (2, "word " * 50_000), (None, "x"), (1, "y")]), 131_072).collect()
    assert len({r.sequence_id for r in out}) == 1 and max(r.length for r in out) == 70_001


def test_ids_that_do_not_fit(docs):
    with pytest.raises(ValueError, match="doesn't fit"):
        token_counts.write_flat(docs([(1, "a")]), public("word_bpe_49k.json"), 70_000, "unused")
    with pytest.raises(Exception, match="doesn't fit"):
        token_counts.write_flat(docs([(1, "some words")]), public("word_bpe_49k.json"), 200, "unused", 1).count()


def test_pipeline_rows(spark, tmp_path, corpus):
    """Each row's fate over all stages, with rows that repeat an id, have none, or are wholly equal."""
    item = " ".join(words(8, 20))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base = " ".join(words(9, 60))
    rows = [(1, base), (2, base + " more"), (2, " ".join(words(10, 50))), (None, " ".join(words(11, 50))), (3, f"x {item}"), (3, " ".join(words(13, 50))), (3, " ".join(words(13, 50))), (4, None), (5, "12"), (6, " ".join(words(14, 50)) + "\n" + base)]
    known(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in out), key=repr) == sorted([1, 2, None, 3, 6], key=repr)
    coder = Encoder(public("word_bpe_49k.json"))
    ids = {i: np.array([*coder.library.encode(t, add_special_tokens=False).ids, 1]) for i, t in ((1, base), (2, rows[2][1]), (None, rows[3][1]), (3, rows[5][1]), (6, rows[9][1].split("\n")[0]))}
    assert {r.doc_id: (r.piece, r.start, r.length, r.ids_crc32) for r in out} == {i: (0, 0, len(x), crc32(x)) for i, x in ids.items()}
    assert brute.packed(out, 4096)[0] == 1
    known(spark, []).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_queries_over_a_folder(spark, tmp_path, corpus):
    """Every registered query on nulls, repeats, blanks and a long text, against the plain versions."""
    rows = [*corpus(20, 40), (300, "w1 w2 " * 4000), (301, "Été\n\nß 漢字 w1")]
    items = [(1, " ".join(rows[-3][1].split()[:20]) if rows[-3][1] else "w1 w2"), (2, None), (3, "w1 w2 w1 w2 w1")]
    turns = [(1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", "<|im_start|>assistant ok"), (2, 1, "user", None), (None, 1, "user", "x")]
    vectors = [(i, [float(i % 7), -0.5, 1 / (i + 1)]) for i in range(120)] + [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 1.0, 2.0])]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", 1) for i, t in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(turns[:3], "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    run = lambda name: queries.QUERIES[name](spark, path).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in run("op1_decontamination")} == brute.decontamination(rows, items)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run("op2_ngram_jaccard")} == brute.jaccard(rows)
    import zlib

    found = run("op3_language_id")
    assert {r.doc_id: r.held_out for r in found} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in rows}
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in found) and {r.doc_id for r in found if r.lang_pred == "und"} == {i for i, t in rows if not any(c.isalpha() for c in t or "")}
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in run("op4_line_dedup")} == brute.lines(rows)
    count = Encoder(public("word_bpe_49k.json"), True).library
    assert {r.doc_id: r.n_tokens for r in run("op5_token_counts")} == {i: len(count.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run("op6_substring_dedup")} == brute.repeats(rows, 50)
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in run("op7_chat_formatting")}
    said = "<|im_end|><|im_start|>assistant ok"
    assert out == brute.chat([*turns[:3], (-1, 1, "user", said), (-1, 2, "assistant", said)])
    pieces, ids = run("op8_best_fit_packing"), Encoder(public("word_bpe_49k.json"))
    _, own = brute.packed(pieces, 4096)
    for i, t in rows:
        x = np.array([*ids.library.encode(t or "", add_special_tokens=False).ids, 1])
        assert sorted(own[i]) == [(k, a, min(4096, len(x) - a)) for k, a in enumerate(range(0, len(x), 4096))]
        assert {r.piece: r.ids_crc32 for r in pieces if r.doc_id == i} == {k: crc32(x[a : a + 4096]) for k, a in enumerate(range(0, len(x), 4096))}
    start, whole = 0, {r.doc_id: tuple(r)[1:] for r in run("op9_token_output")}
    byte = Encoder(public("byte_bpe_50k.json")).library
    for i, t in sorted(rows):
        x = np.array([*byte.encode(t or "", add_special_tokens=False).ids, 2])
        assert whole[i] == (start, len(x), crc32(x))
        start += len(x)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in run("op10_exact_top_k")) == brute.top_k(vectors)
