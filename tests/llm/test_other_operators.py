"""Operators 3, 7 and 10, components, and the pipeline."""

import random
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from crashlens.llm import chat, components, language, topk


def longest_parse(text, train):
    phrases, i = 0, 0
    while i < len(text):
        n = 1
        while i + n <= len(text) and text[i : i + n] in train:
            n += 1
        i += max(1, n - 1)
        phrases += 1
    return phrases


@pytest.mark.parametrize("seed", range(4))
def test_automaton_finds_longest_matches(seed):
    rng = random.Random(seed)
    train = "".join(rng.choice("abc ") for _ in range(200))
    text = "".join(rng.choice("abcd ") for _ in range(150))
    model = language.Model({"x": [train], "y": ["zzz"]})
    got = model.phrases([text, "", train])
    assert got[0, 0] == longest_parse(text, train) and got[1].tolist() == [0, 0] and got[2, 0] == 1


def test_languages(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "er", "on", "th"], "de": ["der", "ung", "sch", "ei", "ü"]}
    rows = [(i, " ".join("".join(rng.choices(parts[x], k=3)) for _ in range(30)), x) for i in range(60) for x in (rng.choice(["en", "de"]),)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 - 3", "en"), (103, "the theing", None), (None, "der sch", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    out = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    assert all(out[i].lang_pred == x for i, _, x in rows[:60]) and out[103].lang_pred == "en"
    assert [out[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in out.values())
    none = docs.where("false")
    assert language.identify(none, language.fit(none)).count() == 0
    assert language.identify(docs, language.fit(none)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_languages_with_long_texts_only(spark):
    rows = [(i, "12 \n" * 2000 + "".join(random.Random(i).choices(["der ", "ung ", "sch "], k=2000)), "de") for i in range(8)]
    rows += [(10 + i, "".join(random.Random(i).choices(["the ", "ing ", "on "], k=50)), "en") for i in range(8)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"] and model.predict(["der schung sch", "the oning on"])[0] == ["de", "en"]


def test_every_character_has_its_class(monkeypatch):
    """Two languages told apart by rare characters only, with more characters than 96; tables and keys give the same."""
    rng = random.Random(4)
    words = [["".join(chr(c + rng.randrange(200)) for _ in range(4)) for _ in range(100)] for c in (0x4E00, 0x5000)]
    text = lambda own, n: "".join(rng.choice(own) for _ in range(n))
    samples = {x: ["e" * 4000 + text(own, 1000)] for x, own in zip("xy", words, strict=True)}
    docs = [text(own, 50) for own in words for _ in range(20)]
    dense = language.Model(samples)
    assert dense.predict(docs)[0] == ["x"] * 20 + ["y"] * 20
    monkeypatch.setattr(language, "DENSE", 0)
    keyed = language.Model(samples)
    assert all(a.table is None for a in keyed.automata) and (keyed.phrases(docs) == dense.phrases(docs)).all()
    assert keyed.phrases(docs[-1:])[0, 1] == longest_parse(docs[-1], samples["y"][0])


def test_chat_round_trip(spark):
    rows = [(1, 0, "us\ner\\n", "a\\b<|c\\|d<\\|e\n<"), (1, 1, "assistant", "\\"), (1, 2, "assistant", "<|im_end|>\n"), (2, 0, None, None), (3, 0, "assistant", ""), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"),
            (4, None, "user\\", "é🎉\\n\\\\n"), (4, 2, "assistant", "🎉<|<|"), (5, 0, "<|r\\n\n\\\\n|", "z"), (-1, 0, "user", chat.HOSTILE), (-1, 1, "assistant", chat.HOSTILE)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1)).withColumn("v", F.lit(1))
    out = chat.digest(chat.render(chat.canonical(chat.conversations(frame)))).collect()
    assert {r[0]: tuple(r)[1:5] for r in out} == brute.chat(rows)
    assert chat.digest(chat.render(chat.canonical(chat.conversations(frame.where("false"))))).count() == 0


def test_layouts(spark):
    records = {
        '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":null}]}': ("messages", ["user:hi", "assistant:"]),
        '{"conversations":[{"value":"a","from":"human"},{"from":"gpt","value":"b"}]}': ("conversations", ["user:a", "assistant:b"]),
        '{"instruction":"do","input":"x","output":"y"}': ("instruction", ["user:do\n\nx", "assistant:y"]),
        '{"system":"s","instruction":"do","output":"y"}': ("instruction with system", ["system:s", "user:do", "assistant:y"]),
        '{"prompt":"p","response":"r"}': ("prompt and response", ["user:p", "assistant:r"]),
        '{"prompt":"p","completion":"r"}': ("prompt and completion", ["user:p", "assistant:r"]),
        '{"question":"q","answer":3}': ("question and answer", ["user:q", "assistant:3"]),
        '{"other":1}': (None, None), "not json": (None, None), None: (None, None),
    }
    for r in chat.canonical(spark.createDataFrame([(x,) for x in records], "record string")).collect():
        assert (r.layout, None if r.turns is None else [f"{t.role}:{t.text}" for t in r.turns]) == records[r.record]


def test_long_conversations_stay(spark):
    """A turn beyond the JSON reader's 20,000,000 characters; as a JSON record it is an error, not null."""
    n = chat.JSON_CHARS + 100
    frame = spark.range(2).selectExpr("7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"if(id = 0, repeat('x', {n}), 'ok') as text")
    got = chat.digest(chat.render(chat.canonical(chat.conversations(frame)))).collect()
    assert {r[0]: tuple(r)[1:5] for r in got} == brute.chat([(7, 0, "user", "x" * n), (7, 1, "assistant", "ok")])
    record = spark.range(1).select(F.expr(f"""'{{"prompt":"' || repeat('x', {n}) || '","response":"r"}}'""").alias("record"))
    with pytest.raises(Exception, match="(?i)parse|malformed|json"):
        chat.canonical(record).select("layout").collect()


def test_typed_layouts(spark):
    row = spark.sql("select named_struct('conversations', array(named_struct('value', 'a', 'from', 'human'), named_struct('value', 'b', 'from', 'gpt'))) as record")
    got = chat.canonical(row).first()
    assert (got.layout, [tuple(t) for t in got.turns]) == ("conversations", [("user", "a"), ("assistant", "b")])
    other = chat.canonical(spark.sql("select named_struct('other', 1) as record")).first()
    assert other.layout is None and other.turns is None


def test_empty_lists_and_clashing_columns(spark):
    got = chat.canonical(spark.createDataFrame([('{"turns":[]}',), ('{"messages":[]}',), ('{"turns":[{"role":"user","text":"x"}]}',)], "record string").withColumns({c: F.lit(1) for c in ("v", "f", "part")}))
    assert [(r.layout, [tuple(t) for t in r.turns], r.v, r.f) for r in got.collect()] == [("turns", [], 1, 1), ("messages", [], 1, 1), ("turns", [("user", "x")], 1, 1)]
    out = chat.render(got).collect()
    assert out[0].formatted == "" and out[0].loss == [] and out[0].part == 1


def test_places_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    turns = [(1, i, ("user", "assistant")[i % 2], "é" * i + "<|") for i in range(20)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rendered = chat.render(chat.canonical(chat.conversations(frame)))
    assert {r[0]: tuple(r)[1:5] for r in chat.digest(rendered).collect()} == brute.chat(turns)
    row = rendered.first()
    assert [row.formatted[x.start : x.start + x.length] for x in row.loss] == ["é" * i + "<\\|" for i in range(1, 20, 2)]


def test_numerals_are_no_letters():
    model = language.Model({"x": ["abc abc"]})
    assert model.predict(["½ ² Ⅷ 12 _", "ª", None, "", "a"])[0] == ["und", "x", "und", "und", "x"]


def test_language_blocks_ties_and_sizes():
    """Parsing starts anew at each block; ties go to the first name; a longer labelled text costs more bits a phrase."""
    rng = random.Random(7)
    train, text = "".join(rng.choice("abc ") for _ in range(300)), "".join(rng.choice("abcd ") for _ in range(2 * language.BLOCK + 77))
    model = language.Model({"x": [train], "y": [train]})
    want = sum(longest_parse(text[i : i + language.BLOCK], train) for i in range(0, len(text), language.BLOCK))
    assert model.phrases([text]).tolist() == [[want, want]] and model.predict([text, text]) == (["x", "x"], [0.0, 0.0])
    small, large = language.Model({"a": ["qq"], "b": ["q" * 5000 + "z"]}).automata
    assert small.bits < large.bits


def test_chat_is_native(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digest(chat.render(chat.canonical(chat.conversations(frame))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 4)
    monkeypatch.setattr(topk, "LEAST", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-3, 4, (300, 3)) / 256)]
    odd = [(500, None), (501, [1.0, None, 2.0]), (502, [float("nan"), 1.0, 1.0]), (503, [float("inf")] * 3), (550, []), (600, [1.0, 2.0]), (601, [1.0, -2.0]), (650, [1.0] * 4), (None, [1.0] * 3)]
    frame = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").withColumn("v", F.lit(0)).withColumn("shard", F.lit(0))
    v = topk.integers(frame)
    assert sorted(map(tuple, topk.top_k(v, v.where("vec_id % 50 = 0")).collect())) == brute.top_k([*rows, *odd])
    none = topk.integers(frame.where("false"))
    assert topk.top_k(none, none).count() == 0


def test_top_k_of_hot_regions(spark, monkeypatch):
    """Many equal vectors, many parts of a region, more dimensions, repeated rows."""
    monkeypatch.setattr(topk, "SHARD", 50)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 130)).astype(np.float32))]
    rows = [(i, rows[7][1]) if i % 3 == 0 else (i, v) for i, v in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.integers(frame)
    assert sorted(map(tuple, topk.top_k(v, v.where("vec_id % 50 = 0")).collect())) == brute.top_k(rows)
    twice = topk.integers(frame.unionByName(frame.where("vec_id = 399")))
    got = [tuple(r) for r in topk.top_k(twice, twice.where("vec_id = 0"), 400).collect()]
    assert len(got) == 400 and sum(r[2] == 399 for r in got) == 2


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k_keeps_all_finite_vectors(spark, monkeypatch, kind):
    """Components from 2^20 up to the greatest floats, whose scores pass 63 bits, of both signs."""
    monkeypatch.setattr(topk, "LEAF", 4)
    monkeypatch.setattr(topk, "LEAST", 3)
    rng = np.random.default_rng(2)
    most = float(np.float32(3e38)) if kind == "float" else 1.7e308
    sizes = [1.5, 2.0**20, 2.0**21 + 0.25, 2.0**31, 2.0**40, 1e30, most]
    rows = [(i, [float(np.float32(x)) if kind == "float" else float(x) for x in rng.choice(sizes, 3) * rng.choice([-1, 1], 3)]) for i in range(120)]
    rows += [(200 + i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-9, 9, (60, 3)) / 256)]
    rows += [(300, [-most, -most, -most]), (350, [2.0**20, 0.0, 0.0])]
    v = topk.integers(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"))
    brute_rows = [(i, [Fraction(x) for x in e]) for i, e in rows] if kind == "double" else rows
    monkeypatch.setattr(brute, "float", lambda x: x, raising=False)
    monkeypatch.setattr("math.isfinite", lambda x: True)
    want = [(q, r, c, s if -(2**63) <= s < 2**63 else None) for q, r, c, s in brute.top_k(brute_rows)]
    monkeypatch.undo()
    got = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 50 = 0")).collect()))
    assert got == want and {r[0] for r in got} == {0, 50, 100, 200, 250, 300, 350} and any(r[3] is None for r in got)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 3)]
    root = {x: x for p in links for x in p if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path, corpus):
    """Each stage against plain versions on its own input."""
    import corpus_pipeline

    rows = [(i, t) for i, t in corpus(6, 40)] + [(700, " ".join(f"b{i}" for i in range(40)))]
    bench = [(1, " ".join(f"b{i}" for i in range(5, 30)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in out.collect()] if k else rows
        stage(spark, out, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, out.collect()
        if name != "best_fit_packing":
            assert out.columns == docs.columns
    before, after = seen["language_id"]
    assert {r.doc_id for r in after} == {i for i, t in before if any(c.isalpha() for c in t or "")}
    before, after = seen["line_dedup"]
    want, texts = brute.lines(before), dict(before)
    left = {i: "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in brute.gone_lines(before)[i]) for i in texts}
    assert {r.doc_id: r.text for r in after} == {i: left[i] for i in texts if want[i][1] == 0 or left[i].strip(" \t\n\r\x0b\x0c")}
    before, after = seen["ngram_jaccard"]
    assert {r.doc_id for r in after} == {i for i, (_, c) in brute.jaccard(before).items() if c == i}
    before, after = seen["decontamination"]
    assert {r.doc_id for r in after} == {i for i, x in brute.decontamination(before, bench).items() if not x[4]} and 700 not in {r.doc_id for r in after}
    before, after = seen["best_fit_packing"]
    assert {r.doc_id for r in after} == {i for i, _ in before}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after)
    brute.packed(after, 4096)
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
