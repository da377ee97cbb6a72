"""Stack frames in crash logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line formats of sanitizer logs.
STRICT_FRAME = r"(?m)^\s*#\d+\s+0x[0-9a-fA-F]+\s+in\s+(.+?)\s+(/src/[^:\n]+):(\d+)(?::\d+)?"
LOOSE_FRAME = r"(?m)^\s*#\d+\s+0x[0-9a-fA-F]+\s+in\s+(.+?)\s+(/src/[^:\n]+)(?::(\d+))?"
ANY_FRAME = r"(?m)#\d+\s+\S+\s+in\s+(.+?)\s+(/\S+?):(\d+)(?::\d+)?\s*$"
PLAIN_FRAME = r"#\d+\s+\S+\s+in\s+(\S+)\s+(/\S+?):(\d+)"
SUMMARY_FRAME = r"SUMMARY:\s+\w+Sanitizer:\s+\S+\s+(/\S+?):(\d+)(?::\d+)?\s+in\s+(\S+)"
SOURCE_FUNCTION = r"#\d+\s+\S+ in (\S+)\s+/src/"
SOURCE_FILE = r"/src/\S+/([\w._-]+\.\w+):\d+"
SYMBOL = r"(?i)#\d+\s+0x[0-9a-f]+\s+in\s+([^\s]+)"
NO_SYMBOL = r"(?i)#\d+\s+0x[0-9a-f]+\s+\(([^)]+\+0x[0-9a-f]+)\)"
ENTRY_POINT = "LLVMFuzzerTestOneInput"
INFRA_FUNCTION = r"^(__asan_|__msan_|__tsan_|__sanitizer|__interceptor_|__ubsan_|fuzzer::|asan_thread_start|_start$|start_thread$|__clone$|__libc_|raise$|abort$|__assert_fail$|__GI___|sigsetjmp)"
INFRA_PATH = r"^(/src/llvm-project/|/lib/x86_64-linux-gnu/|/usr/lib/)"
DISPATCH_SUFFIX = r"(_osv_\d+_\d+|_original)(?=$|\W)"
RUNTIME_PATH = r"/compiler-rt/|/llvm-project/|/lib/fuzzer/|/lib/asan/|/lib/msan/|/lib/ubsan/|/lib/tsan/|/lib/lsan/|/lib/dfsan/"
INTERCEPTOR_PATH = r"compiler-rt/lib/(asan|tsan|msan|ubsan|hwasan)/"
DISPATCH_FRAME = r"__bug_dispatch|bug_dispatch_link"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), group)


def _frames(text: Column, pattern: str) -> Column:
    """Each frame is found once, then taken apart on its own; no group of a frame has a line break."""
    parts = F.transform(_all(text, pattern, 0), lambda x: F.split(F.regexp_replace(x, pattern, "$1\n$2\n$3"), "\n"))
    return F.transform(parts, lambda x: F.struct(F.trim(x[0]).alias("func"), F.trim(x[1]).alias("file"), F.nullif(x[2], F.lit("")).try_cast("int").alias("line")))


def below_project(path: Column) -> Column:
    """A source path without its /src/<project>/."""
    return F.when(path.startswith("/src/"), F.array_join(F.slice(F.split(path, "/"), 4, 1 << 20), "/")).otherwise(path)


def strict_frames(text: Column) -> Column:
    """Frames below /src/ with a line (SCL-01)."""
    return _frames(text, STRICT_FRAME)


def loose_frames(text: Column) -> Column:
    """Frames below /src/, line optional, files relative to the project (SCL-02)."""
    return F.transform(_frames(text, LOOSE_FRAME), lambda x: F.struct(x["func"].alias("func"), below_project(x["file"]).alias("file"), x["line"].alias("line")))


def is_infra(func: Column, path: Column) -> Column:
    """Sanitizer, fuzzer or libc code (FLT-04)."""
    return func.rlike(INFRA_FUNCTION) | path.rlike(INFRA_PATH)


def clean_frames(text: Column) -> Column:
    """Project frames of any absolute path with a line; dispatch suffixes are stripped (SCL-03)."""
    kept = F.filter(_frames(text, ANY_FRAME), lambda x: ~is_infra(x["func"], x["file"]))
    return F.transform(kept, lambda x: F.struct(F.regexp_replace(x["func"], DISPATCH_SUFFIX, "").alias("func"), below_project(x["file"]).alias("file"), x["line"].alias("line")))


def first_project_frame(text: Column) -> Column:
    """file, line, func of the first frame outside runtimes, else of the summary line (WIN-13)."""
    own = F.filter(_frames(text, PLAIN_FRAME), lambda x: ~x["file"].rlike(RUNTIME_PATH))
    part = lambda g: F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), SUMMARY_FRAME, g), F.lit(""))
    summary = F.struct(part(3).alias("func"), part(1).alias("file"), part(2).try_cast("int").alias("line"))
    return F.when(F.size(own) > 0, F.get(own, F.lit(0))).otherwise(summary)


def crash_functions(text: Column) -> Column:
    """Functions of frames below /src/ (SCL-05)."""
    return _all(text, SOURCE_FUNCTION)


def crash_files(text: Column) -> Column:
    """Distinct base names of source files (SCL-05)."""
    return F.array_distinct(_all(text, SOURCE_FILE))


def clean_name(name: Column) -> Column:
    """A function without arguments, offset, revert or interceptor prefix and part suffix (SCL-08)."""
    cut = F.trim(F.regexp_extract(name, r"^[^(+]*", 0))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, r"^__revert_[A-Fa-f0-9]+_", ""), r"^__interceptor_", ""), r"\.part\.\d+$", "")


def function_stack(text: Column) -> Column:
    """Cleaned functions in order, down to the fuzz entry point (SCL-04)."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    entry = F.array_position(F.transform(lines, lambda x: x.contains(f"in {ENTRY_POINT}")), True)
    upto = F.when(entry > 0, F.slice(lines, F.lit(1), entry.cast("int"))).otherwise(lines)
    return F.transform(F.filter(upto, lambda x: x.rlike(SYMBOL)), lambda x: clean_name(F.regexp_extract(x, SYMBOL, 1)))


def fallback_stack(text: Column) -> Column:
    """function_stack, or binary offsets where no frame has a symbol (SCL-04)."""
    named = function_stack(text)
    return F.when(F.size(named) > 0, named).otherwise(_all(text, NO_SYMBOL))


def fingerprint(frames: Column, depth: int | None = 3, with_line: bool = False) -> Column:
    """The first frames as a key: functions and files, lines on request (ARR-02, ARR-03)."""
    some = frames if depth is None else F.slice(frames, 1, depth)
    return some if with_line else F.transform(some, lambda x: F.struct(x["func"].alias("func"), x["file"].alias("file")))


def project_top3(frames: Column) -> Column:
    """First three functions, interceptors skipped (ARR-01)."""
    return F.slice(F.transform(F.filter(frames, lambda x: ~x["file"].rlike(INTERCEPTOR_PATH)), lambda x: x["func"]), 1, 3)


def rename(stack: Column, names: Column) -> Column:
    """Each cleaned function, or the first name that a map<string, array<string>> gives for it (ARR-05)."""
    return F.transform(stack, lambda x: F.coalesce(F.get(F.try_element_at(names, clean_name(x)), F.lit(0)), clean_name(x)))


def contains_run(stack: Column, patterns: Column) -> Column:
    """Whether consecutive functions fall into an array of sets of allowed names; never for empty or longer patterns (ARR-04)."""
    n, m = F.size(stack), F.size(patterns)
    starts = F.when((m > 0) & (n >= m), F.sequence(F.lit(0), n - m)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda s: F.forall(F.sequence(F.lit(0), m - 1), lambda i: F.array_contains(F.get(patterns, i), F.get(stack, s + i))))


def is_dispatch(frame: Column) -> Column:
    """FLT-05."""
    return F.coalesce(frame, F.lit("")).rlike(DISPATCH_FRAME)


def joined(frames: Column) -> Column:
    """Frames or pairs as one text, for keys and output."""
    return F.array_join(F.transform(frames, lambda x: F.concat_ws("@", x["func"], x["file"])), "|")


def function_set(frames: Column) -> Column:
    """Different functions of frames, sorted (AGG-18)."""
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(frames, F.array().cast("array<struct<func: string, file: string, line: int>>")), lambda x: x["func"])))


def shared_count(a: Column, b: Column) -> Column:
    """How many different values two arrays have in common; a missing array has none (AGG-18)."""
    return F.when(a.isNull() | b.isNull(), 0).otherwise(F.size(F.array_intersect(a, b))).cast("long")
