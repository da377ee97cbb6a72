"""JSON arrays in any state, against a reader that goes through them character by character."""

import json
import random

import pytest
from pyspark.sql import functions as F

from crashlens.sources import fragments


def outer_records(text):
    out, level, start, quoted, skip = [], 0, None, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c == "{":
            level += 1
            start = i if level == 1 else start
        elif not quoted and c == "}" and level:
            level -= 1
            if level == 0:
                out.append(text[start : i + 1])
    return out


def readable(text):
    try:
        return json.loads(text) is not None
    except ValueError:
        return False


CASES = {
    "two": '[{"a": 1}, {"a": 2}][{"a": 3}]',
    "commas": '{"a": 1},\n{"a": {"b": [1, {"c": 2}]}},\n',
    "cut": '[{"a": 1}, {"a": "x',
    "strings": r'[{"a": "}{][\"\\"}, {"b": "\\\\"}, {"c{": "]"}]',
    "stray": '}} , {"a": 1}} {"b": {}} ] }',
    "pretty": json.dumps([{"k": [1, 2], "s": {"t": None}}, {"k": "é"}], indent=2) + ",\n[]",
    "broken": '{a b} {"a": 1} {}',
    "none": "[1, 2, []]",
    "empty": "",
}


@pytest.mark.parametrize("split", [None, "400"])
def test_repaired(spark, tmp_path, split):
    rng = random.Random(3)
    many = "".join(rng.choice(['{"a": "', '"}', "}", "{", '"', "\\\\", '\\"', "x", ",\n", "[", '{"n": 1}']) for _ in range(3000))
    cases = {**CASES, "many": many}
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        found = fragments.repaired(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {(r.file.rsplit("/", 1)[1].removesuffix(".json"), r.record): r.text for r in found}
    want = {(n, i): t for n, text in cases.items() for i, t in enumerate(outer_records(text), 1) if readable(t)}
    assert {k: v for k, v in got.items() if k[0] != "many"} == {k: v for k, v in want.items() if k[0] != "many"}
    assert sorted(v for k, v in got.items() if k[0] == "many") == sorted(v for k, v in want.items() if k[0] == "many")


def test_append_again_and_first_wins(spark, tmp_path):
    folder = str(tmp_path / "array")

    def rows(*xs):
        return spark.createDataFrame([(k, s, (f, n, 1), e) for k, s, f, n, e in xs], "kind string, spelling string, location struct<file: string, line: long, column: long>, extra int")

    first = rows(("F", "a{", "x.c", 1, 1), ("F", 'q"\\', "x.c", 2, 2), ("F", "a{", "x.c", 1, 3))
    second = rows(("F", "a{", "x.c", 1, 4), ("G", "a{", "x.c", 1, 5), ("F", None, None, None, 6), ("F", "", "", 0, 7))
    fragments.append(first, folder, 1, ["extra"])
    fragments.append(second, folder, 2, ["extra"])
    fragments.append(second, folder, 2, ["extra"])  # a batch that is run again
    records = fragments.repaired(spark, folder)
    assert records.count() == 7
    kept = fragments.located(records).select(F.get_json_object("text", "$.extra").cast("int").alias("e")).collect()
    assert sorted(r.e for r in kept) == [1, 2, 5, 6]
