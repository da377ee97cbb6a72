"""Micro fixtures of the column builders: nulls, empty texts, ties and traps."""

from pyspark.sql import functions as F

from crashlens.functions import bits, frames, sanitizer, text

LOG = """==1==ERROR: AddressSanitizer: heap-buffer-overflow on address 0x60
WRITE of size 8
    #0 0x1 in __asan_memcpy /src/llvm-project/compiler-rt/lib/asan/asan_interceptors.cpp:22:3
    #1 0x2 in parse_osv_2020_1(char const*, int) /src/proj/lib/a.c:10:5
    #2 0x3 in read_all /src/proj/lib/b.c:20
    #3 0x4 in LLVMFuzzerTestOneInput /src/proj/fuzz/h.c:3:1
    #4 0x5 in main /src/proj/main.c
0x60 is located 4 bytes to the right of 16-byte region
SUMMARY: AddressSanitizer: heap-buffer-overflow /src/proj/lib/a.c:10:5 in parse
"""


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string"] * len(values), strict=True))) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_frames(spark):
    x = one(spark, frames.strict_frames(F.col("t")), t=LOG)
    assert [(f.func, f.line) for f in x] == [("__asan_memcpy", 22), ("parse_osv_2020_1(char const*, int)", 10), ("read_all", 20), ("LLVMFuzzerTestOneInput", 3)]
    loose = one(spark, frames.loose_frames(F.col("t")), t=LOG)
    assert loose[-1].file == "main.c" and loose[-1].line is None and loose[1].file == "lib/a.c"
    clean = one(spark, frames.clean_frames(F.col("t")), t=LOG)
    assert [f.func for f in clean] == ["parse(char const*, int)", "read_all", "LLVMFuzzerTestOneInput"]
    assert one(spark, frames.first_project_frame(F.col("t")), t=LOG).file == "/src/proj/lib/b.c"
    assert one(spark, frames.first_project_frame(F.col("t")), t="SUMMARY: AddressSanitizer: SEGV /a/b.c:7:1 in f").line == 7
    for build in (frames.strict_frames, frames.loose_frames, frames.clean_frames, frames.function_stack, frames.crash_files):
        assert one(spark, build(F.col("t")), t=None) == [] and one(spark, build(F.col("t")), t="") == []


def test_stacks(spark):
    assert one(spark, frames.function_stack(F.col("t")), t=LOG) == ["__asan_memcpy", "parse_osv_2020_1", "read_all", "LLVMFuzzerTestOneInput"]
    assert one(spark, frames.fallback_stack(F.col("t")), t="#0 0x1 (bin+0x2)\n#1 0x3 (bin+0x4)") == ["bin+0x2", "bin+0x4"]
    assert one(spark, frames.clean_name(F.lit("__revert_0aF_foo(int)+0x1"))) == "foo"
    assert one(spark, frames.clean_name(F.lit("__interceptor_H5D__io.part.0"))) == "H5D__io"
    run = lambda stack, patterns: one(spark, frames.contains_run(F.expr(stack), F.expr(patterns)))
    assert run("array('a','b','c','d')", "array(array('b','x'), array('c'))")
    assert not run("array('a','b')", "cast(array() as array<array<string>>)")
    assert not run("array('b')", "array(array('b'), array('c'))")
    assert not run("cast(array() as array<string>)", "array(array('b'))")


def test_sanitizer(spark):
    s = one(spark, sanitizer.signature(F.col("t")), t=LOG)
    assert tuple(s) == ("AddressSanitizer", "heap-buffer-overflow", "WRITE", 8, 4, "right", 16)
    assert tuple(one(spark, sanitizer.signature(F.col("t")), t=None)) == (None,) * 7
    kind, way = sanitizer.crash_class(F.col("t"))
    assert (one(spark, kind, t=LOG), one(spark, way, t=LOG)) == ("heap-buffer-overflow", "WRITE")
    assert one(spark, sanitizer.error_class(F.col("t")), t="") == "?"
    for name, kind in (("heap-use-after-free", "Heap-use-after-free READ 8"), ("stack-buffer", "Stack-buffer-overflow WRITE"), ("other", ""), ("other", None)):
        assert one(spark, sanitizer.crash_type(F.col("t")), t=kind) == name
    assert one(spark, sanitizer.architecture(F.lit("libfuzzer_asan_i386_p"))) == "i386"
    fields = "named_struct('sanitizer', {0}, 'error_type', {1}, 'access_type', {2}, 'access_size', {3}, 'region_offset', cast(null as int), 'region_relation', cast(null as string), 'region_size', cast(null as int))"
    score = lambda a, b: one(spark, sanitizer.score(F.expr(fields.format(*a)), F.expr(fields.format(*b))))
    assert score(("'A'", "'x'", "'READ'", "1"), ("'A'", "'x'", "'READ'", "cast(null as int)")) == 3
    assert score(("'A'", "'x'", "'READ'", "1"), ("'A'", "'x'", "'WRITE'", "cast(null as int)")) == -1
    assert score(("'A'", "'x'", "'READ'", "1"), ("cast(null as string)", "cast(null as string)", "cast(null as string)", "cast(null as int)")) == 0


def test_text(spark):
    assert one(spark, text.normal_key(F.lit("T:\na\nb\n"))) == one(spark, text.normal_key(F.lit("T:|a|b|"))) == "T: a b"
    u = one(spark, text.usage(F.lit("Tokens: 12,345 input, 6,789 cached input, 4,567 output\nCost: $0.1234")))
    assert tuple(u) == (12345, 6789, 4567, 0.1234)
    assert tuple(one(spark, text.usage(F.lit("cached input, 4,567 output")))) == (0, 0, 0, 0.0)
    assert tuple(one(spark, text.usage(F.lit(None).cast("string")))) == (0, 0, 0, 0.0)
    assert one(spark, text.location(F.lit(None).cast("string"), F.lit(3))) == "-"
    assert one(spark, text.right_cut(F.lit("x" * 60))) == "..." + "x" * 47
    assert one(spark, text.html_text(F.lit('a<br/>b <a href="u">c</a>&amp;<i>d</i>'))) == "a\nb c&d"
    assert one(spark, text.unescaped(F.lit(r"a\u003db"))) == "a=b"
    assert one(spark, text.key_values(F.lit("A: 1\nB: 2\nA: 3\nx"))) == {"A": "3", "B": "2"}
    assert one(spark, text.tail(F.lit("a\nb\nc"), 2)) == "b\nc" and one(spark, text.tail(F.lit(None).cast("string"))) == ""
    assert one(spark, text.state_top3(F.lit("a\n b |\nc\nd"))) == ["a", "b", "c"]


def test_bits(spark):
    for value, kind, bit in ((0, "always", None), (8, "gated", 3), (6, "gated", None)):
        assert (one(spark, bits.stratum(F.lit(value))), one(spark, bits.bit_index(F.lit(value)))) == (kind, bit)
    assert one(spark, bits.little_endian(F.lit("0101"))) == 257
    assert one(spark, bits.set_bits(F.lit("0101"))) == [0, 8] and one(spark, bits.set_bits(F.lit(""))) == []
    assert [one(spark, bits.byte_width(F.lit(n))) for n in (0, 1, 8, 9)] == [1, 1, 1, 2]
    assert [one(spark, bits.status_rank(F.lit(s).cast("string"))) for s in ("1|0", "0.5|1", "0.5|0", None)] == [2, 1, 0, 0]
