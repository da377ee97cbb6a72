"""Frames, fingerprints, matching and verdicts over crash logs made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from crashlens.functions import frames as fr
from crashlens.functions import sanitizer as sn
from crashlens.functions import text
from crashlens.operators import matching
from crashlens.plans.base import LG, Query, logs, table, timed_logs
from crashlens.sources import shared

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


#: The grammar of sanitizer logs, as in functions/frames.py, for DuckDB.
STRICT = r"(?m)^\s*#\d+\s+0x[0-9a-fA-F]+\s+in\s+(.+?)\s+(/src/[^:\n]+):(\d+)(?::\d+)?"
LOOSE = r"(?m)^\s*#\d+\s+0x[0-9a-fA-F]+\s+in\s+(.+?)\s+(/src/[^:\n]+)(?::(\d+))?"
ANY = r"(?m)#\d+\s+\S+\s+in\s+(.+?)\s+(/\S+?):(\d+)(?::\d+)?\s*$"
INFRA = "^(__asan_|__msan_|__tsan_|__sanitizer|__interceptor_|__ubsan_|fuzzer::|asan_thread_start|_start$|start_thread$|__clone$|__libc_|raise$|abort$|__assert_fail$|__GI___|sigsetjmp)"


def _parsed(pattern: str, n: str = "f") -> str:
    """DuckDB: lists of functions, files and lines."""
    return ", ".join(f"regexp_extract_all(log, '{pattern}', {g}) AS {n}{g}" for g in (1, 2, 3))


SHORT = "array_to_string(list_slice(string_split({0}, '/'), 4, 99), '/')"
CLEAN = LG + f""", q AS (SELECT *, {_parsed(ANY)} FROM lg),
c AS (SELECT * EXCLUDE (f1, f2, f3), list_filter(list_transform(range(1, len(f1) + 1), lambda i: CASE WHEN regexp_matches(f1[i], '{INFRA}') OR regexp_matches(f2[i], '^(/src/llvm-project/|/lib/x86_64-linux-gnu/|/usr/lib/)') THEN NULL
      ELSE regexp_replace(f1[i], '(_osv_\\d+_\\d+|_original)($|\\W)', '\\2') || '@' || {SHORT.format("f2[i]")} END), lambda x: x IS NOT NULL) AS fr FROM q)"""
KIND = r"coalesce(nullif(regexp_extract(log, '(?s)ERROR:\s*\w+Sanitizer:\s*([\w-]+)\s+on address.*?\n(READ|WRITE)\s+of\s+size', 1), ''), nullif(regexp_extract(log, 'SUMMARY:\s*\w+Sanitizer:\s*([\w-]+)', 1), ''))"

add(
    "frame_extract",
    lambda s, d: logs(s, d).select("event_id", F.posexplode(fr.strict_frames(F.col("log"))).alias("pos", "f")).select("event_id", "pos", "f.func", "f.file", "f.line"),
    f"WITH {LG}, q AS (SELECT event_id, {_parsed(STRICT)} FROM lg), e AS (SELECT *, unnest(range(1, len(f1) + 1)) AS i FROM q) SELECT event_id, CAST(i - 1 AS INTEGER) AS pos, f1[i] AS func, f2[i] AS file, CAST(f3[i] AS INTEGER) AS line FROM e",
)
add(
    "frame_top3_fp",
    lambda s, d: logs(s, d).select("event_id", fr.joined(fr.fingerprint(fr.loose_frames(F.col("log")))).alias("top3"), F.array_join(fr.project_top3(fr.loose_frames(F.col("log"))), "|").alias("state")),
    f"""WITH {LG}, q AS (SELECT event_id, {_parsed(LOOSE)} FROM lg), r AS (SELECT event_id, list_transform(range(1, len(f1) + 1), lambda i: f1[i] || '@' || {SHORT.format("f2[i]")}) AS x FROM q)
    SELECT event_id, array_to_string(x[1:3], '|') AS top3, array_to_string(list_transform(list_filter(x, lambda y: NOT regexp_matches(y, 'compiler-rt/lib/(asan|tsan|msan|ubsan|hwasan)/')), lambda y: string_split(y, '@')[1])[1:3], '|') AS state FROM r""",
)


def _clustered(with_line):
    def run(s, d):
        rows = logs(s, d).withColumn("f", fr.loose_frames(F.col("log"))).withColumn("print", fr.fingerprint(F.col("f"), 3, with_line)).withColumn("one", F.lit(1)).withColumn("fuzzer", F.col("user_id") % 4)
        out = matching.clusters(rows, "print", "event_type", "fuzzer", "one")
        key = F.array_join(F.transform("print", lambda x: F.concat_ws("@", x["func"], x["file"], *([F.coalesce(x["line"].cast("string"), F.lit("-"))] if with_line else []))), "|")
        return out.select(key.alias("print"), "n_signatures", "occurrences", "n_fuzzers", "common_type")

    return run


def _cluster_sql(with_line):
    line = " || '@' || coalesce(nullif(f3[i], ''), '-')" if with_line else ""
    return f"""WITH {LG}, q AS (SELECT *, {_parsed(LOOSE)} FROM lg), r AS (SELECT event_type, user_id % 4 AS fuzzer, array_to_string(list_transform(range(1, len(f1) + 1), lambda i: f1[i] || '@' || {SHORT.format("f2[i]")}{line})[1:3], '|') AS print FROM q),
    m AS (SELECT print, event_type, count(*) AS n FROM r GROUP BY ALL), n AS (SELECT print, arg_min(event_type, (-n, event_type)) AS common_type FROM m GROUP BY 1)
    SELECT print, count(*) AS n_signatures, count(*) AS occurrences, count(DISTINCT fuzzer) AS n_fuzzers, any_value(common_type) AS common_type FROM r JOIN n USING (print) GROUP BY 1"""


add("fp_cluster_loose", _clustered(False), _cluster_sql(False))
add("fp_cluster_strict", _clustered(True), _cluster_sql(True))


def _sides(s, d):
    """All logs, parsed once, as crashes; and as targets, one per first project frame with the least event_id of its logs."""
    crashes = shared.stored(logs(s, d).select("event_id", fr.strict_frames(F.col("log")).alias("frames"), sn.signature(F.col("log")).alias("signature")), "parsed")
    rows = crashes.withColumn("x", F.get(F.filter("frames", lambda x: ~x["file"].rlike("llvm-project")), F.lit(0))).where("x is not null")
    first = rows.groupBy("x").agg(F.min("event_id").alias("event_id")).join(crashes, "event_id")
    return crashes, first.select(F.col("event_id").alias("bug_id"), text.right_cut(F.col("x.file"), 99).alias("crash_file"), F.col("x.line").alias("crash_line"), F.expr("if(event_id % 3 = 0, null, x.func)").alias("crash_function"), F.col("frames").alias("reference_frames"), F.col("signature").alias("reference_signature"))


WHOLE = f"""WITH {LG}, q AS (SELECT *, {_parsed(STRICT)} FROM lg), r AS (SELECT event_id, event_type, k, list_transform(range(1, len(f1) + 1), lambda i: {{'func': f1[i], 'file': f2[i], 'line': f3[i]}}) AS f FROM q),
l AS (SELECT *, list_filter(f, lambda x: NOT contains(x.file, 'llvm-project'))[1] AS x FROM r), m AS (SELECT min(event_id) AS bug_id FROM l WHERE x IS NOT NULL GROUP BY x),
b AS (SELECT bug_id, event_type, k, f, x FROM m JOIN l ON event_id = bug_id),
c AS (SELECT a.event_id, b.bug_id, a.event_type AS aty, a.k AS ak, a.f AS af, b.event_type AS bt, b.k AS bk, b.f AS bf, b.x FROM r a JOIN b
      ON len(list_filter(a.f, lambda y: y.line = b.x.line AND (suffix(y.file, b.x.file) OR suffix(b.x.file, y.file)) AND (b.bug_id % 3 = 0 OR y.func = b.x.func))) > 0)"""
add("suffix_path_match", lambda s, d: matching.candidates(*_sides(s, d), "event_id"), WHOLE + " SELECT event_id, bug_id FROM c")
add(
    "matcher_scored",
    lambda s, d: matching.match(*_sides(s, d), "event_id"),
    WHOLE + """, n AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS n, CAST(aty <> bt AS INTEGER) + CAST(ak % 2 <> bk % 2 AS INTEGER) + CAST(ak % 8 <> bk % 8 AS INTEGER) + CAST(ak % 3 <> bk % 3 AS INTEGER) AS off FROM c),
    z AS (SELECT *, CASE WHEN off > 0 THEN -off ELSE 7 END AS score, len(list_filter(bf, lambda r: NOT (r.line = x.line AND (suffix(r.file, x.file) OR suffix(x.file, r.file)) AND (bug_id % 3 = 0 OR r.func = x.func))
          AND len(list_filter(af, lambda y: y.line = r.line AND y.func = r.func AND (suffix(y.file, r.file) OR suffix(r.file, y.file)))) > 0)) AS stack FROM n),
    y AS (SELECT *, max(score) OVER (PARTITION BY event_id) AS best FROM z WHERE n > 1), w AS (SELECT *, max(stack) OVER (PARTITION BY event_id) AS top FROM y WHERE best >= 0 AND score = best)
    SELECT event_id, bug_id FROM z WHERE n = 1 UNION ALL SELECT event_id, bug_id FROM w WHERE stack = top""",
)


def _print_bugs(s, d):
    """All logs with an odd k against a bug per fingerprint and crash type of all those with an even k."""
    rows = logs(s, d).withColumn("print", fr.fingerprint(fr.loose_frames(F.col("log"))))
    bugs = rows.where("k % 2 = 0").groupBy("print", "event_type").agg(F.min("event_id").alias("bug"))
    found = matching.fingerprint_matches(rows.where("k % 2 = 1").select("event_id", "print"), bugs.select("print", "bug"), "event_id", "print", "bug")
    return found.select("event_id", F.array_join(F.transform("bugs", lambda x: x.cast("string")), ",").alias("bugs"))


add(
    "fp_match_reference",
    _print_bugs,
    f"""WITH {LG}, q AS (SELECT *, {_parsed(LOOSE)} FROM lg), r AS (SELECT event_id, event_type, k, array_to_string(list_transform(range(1, len(f1) + 1), lambda i: f1[i] || '@' || f2[i])[1:3], '|') AS p FROM q),
    b AS (SELECT p, min(event_id) AS bug FROM r WHERE k % 2 = 0 GROUP BY p, event_type) SELECT a.event_id, array_to_string(list_sort(list(DISTINCT b.bug)), ',') AS bugs FROM r a JOIN b USING (p) WHERE a.k % 2 = 1 GROUP BY 1""",
)


def _pairs(s, d):
    """Pairs of neighbouring logs, each parsed once before the join."""
    rows = logs(s, d).select("event_id", "log")
    after = matching.parsed(rows.where("event_id % 2 = 1").select((F.col("event_id") - 1).alias("event_id"), "log"), "log", "b")
    return matching.verdicts(matching.parsed(rows.where("event_id % 2 = 0"), "log", "a").join(after, "event_id"))


def _texts(s, d):
    rows = logs(s, d).select("event_id", "log")
    return rows.alias("a").join(rows.select((F.col("event_id") - 1).alias("event_id"), F.col("log").alias("after")), "event_id").where("event_id % 2 = 0")


VERDICTS = CLEAN + f""", p AS (SELECT *, {KIND} AS kind, list_distinct(list_transform(fr, lambda x: string_split(x, '@')[1])) AS fn, list_distinct(list_transform(fr, lambda x: string_split(string_split(x, '@')[2], '/')[-1])) AS fl FROM c),
v AS (SELECT a.event_id, a.log, b.log AS after, a.kind AS ka, b.kind AS kb, a.fr AS ra, b.fr AS rb, list_intersect(a.fn, b.fn) AS fs, list_intersect(a.fl, b.fl) AS ps FROM p a JOIN p b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0),
u AS (SELECT *, CASE WHEN ka IS NULL OR kb IS NULL THEN 'no_data' WHEN ka = kb AND string_split(ra[1], '@')[1] = string_split(rb[1], '@')[1] AND ra[1:3] = rb[1:3] THEN 'exact' WHEN string_split(ra[1], '@')[1] = string_split(rb[1], '@')[1] THEN 'partial'
      WHEN ka = kb AND (len(fs) > 0 OR len(ps) > 0) THEN 'partial' WHEN len(list_filter(fs, lambda x: x <> 'LLVMFuzzerTestOneInput')) >= 2 THEN 'partial' ELSE 'rejected' END AS verdict FROM v)"""
add(
    "verdict_tiers",
    lambda s, d: _pairs(s, d).select("event_id", "verdict", F.col("shared_functions").cast("long").alias("shared_functions"), F.col("shared_files").cast("long").alias("shared_files")),
    f"WITH {VERDICTS} SELECT event_id, verdict, CAST(len(fs) AS BIGINT) AS shared_functions, CAST(len(ps) AS BIGINT) AS shared_files FROM u",
)
add(
    "loose_or_strict_match",
    lambda s, d: matching.with_verdicts(_texts(s, d), "log", "after").select("event_id", matching.strict_match(F.col("verdict"), matching.loose_match(F.col("log"), F.col("after"))).alias("same"), matching.loose_match(F.col("log"), F.col("after")).alias("loose")),
    f"WITH {VERDICTS} SELECT event_id, verdict IN ('exact', 'partial') AS same, true AS loose FROM u",
)
add(
    "verdict_rollup",
    lambda s, d: _pairs(s, d).rollup("verdict").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("verdict", F.lit("__overall__")).alias("verdict"), "n"),
    f"WITH {VERDICTS} SELECT verdict, count(*) AS n FROM u GROUP BY 1 UNION ALL SELECT '__overall__', count(*) FROM u",
)
add(
    "signature_fields",
    lambda s, d: logs(s, d).select("event_id", sn.signature(F.col("log")).alias("x")).select("event_id", "x.*"),
    rf"""WITH {LG} SELECT event_id, regexp_extract(log, 'ERROR:\s+([^:]+):\s+([^\s]+)', 1) AS sanitizer, regexp_extract(log, 'ERROR:\s+([^:]+):\s+([^\s]+)', 2) AS error_type, regexp_extract(log, '\b(READ|WRITE) of size (\d+)\b', 1) AS access_type,
    CAST(regexp_extract(log, '\b(READ|WRITE) of size (\d+)\b', 2) AS INTEGER) AS access_size, CAST(regexp_extract(log, 'is located (\d+) bytes', 1) AS INTEGER) AS region_offset, 'right' AS region_relation, CAST(regexp_extract(log, 'of (\d+)-byte', 1) AS INTEGER) AS region_size FROM lg""",
)
add(
    "class_direction",
    lambda s, d: logs(s, d).select("event_id", sn.crash_class(F.col("log"))[0].alias("kind"), sn.crash_class(F.col("log"))[1].alias("direction"), sn.error_class(F.col("log")).alias("error_class")),
    rf"WITH {LG} SELECT event_id, {KIND} AS kind, nullif(regexp_extract(log, '(READ|WRITE)\s+of\s+size', 1), '') AS direction, regexp_extract(log, '==ERROR: AddressSanitizer:\s*(.+?) on address', 1) AS error_class FROM lg",
)
add("infra_frame_filter", lambda s, d: logs(s, d).select("event_id", fr.joined(fr.clean_frames(F.col("log"))).alias("frames")), f"WITH {CLEAN} SELECT event_id, array_to_string(fr, '|') AS frames FROM c")
add(
    "first_project_frame",
    lambda s, d: logs(s, d).select("event_id", fr.first_project_frame(F.col("log")).alias("x")).select("event_id", "x.func", "x.file", "x.line"),
    rf"""WITH {LG}, q AS (SELECT event_id, {_parsed(r"#\d+\s+\S+\s+in\s+(\S+)\s+(/\S+?):(\d+)")} FROM lg), r AS (SELECT *, list_filter(range(1, len(f1) + 1), lambda i: NOT regexp_matches(f2[i], '/compiler-rt/|/llvm-project/|/lib/fuzzer/|/lib/asan/|/lib/msan/|/lib/ubsan/|/lib/tsan/|/lib/lsan/|/lib/dfsan/'))[1] AS i FROM q)
    SELECT event_id, f1[i] AS func, f2[i] AS file, CAST(f3[i] AS INTEGER) AS line FROM r""",
)
add(
    "function_stack",
    lambda s, d: logs(s, d).select("event_id", F.array_join(fr.function_stack(F.col("log")), ",").alias("stack"), F.array_join(fr.crash_files(F.col("log")), ",").alias("files")),
    rf"""WITH {LG} SELECT event_id, array_to_string(list_transform(regexp_extract_all(log, '#\d+\s+0x[0-9a-f]+\s+in\s+([^\s]+)', 1), lambda x: x), ',') AS stack,
    CASE WHEN k % 5 = 0 THEN 'asan_interceptors.cpp,' ELSE 'f' || CAST(k % 4 AS VARCHAR) || '.c,' END || 'g' || CAST(user_id % 2 AS VARCHAR) || '.c,harness.c' || CASE WHEN k % 5 = 0 THEN ',f' || CAST(k % 4 AS VARCHAR) || '.c' ELSE '' END AS files FROM lg""",
)
add(
    "regex_bucket_first_match",
    lambda s, d: logs(s, d).groupBy(sn.crash_type(F.concat_ws(" ", sn.error_class(F.col("log")), F.when(F.col("k") % 11 == 0, "timeout"))).alias("bucket"), fr.is_dispatch(F.expr("concat(if(k % 3 = 0, 'x__bug_dispatch', 'fn_'), k % 2)")).alias("dispatch")).agg(F.count(F.lit(1)).alias("n")),
    f"""WITH {LG} SELECT CASE WHEN k % 11 = 0 THEN 'resource/timeout' WHEN event_type = 'signup' THEN 'stack-overflow' WHEN event_type = 'error' THEN 'heap-overflow' WHEN event_type = 'click' THEN 'heap-use-after-free' WHEN event_type = 'purchase' THEN 'double-free'
    WHEN event_type = 'view' THEN 'segv/unknown' ELSE 'other' END AS bucket, k % 3 = 0 AS dispatch, count(*) AS n FROM lg GROUP BY ALL""",
)
add(
    "representative_stack",
    lambda s, d: matching.representatives(timed_logs(s, d), ["event_type", "k"], ["t", "event_id"], "log").select("event_type", "k", "n", F.md5("log").alias("log")),
    f"WITH {LG} SELECT event_type, k, count(*) AS n, md5(arg_min(log, (t, event_id))) AS log FROM lg GROUP BY ALL",
)
add(
    "name_clean",
    lambda s, d: table(s, d, "part").select("p_partkey", fr.clean_name(F.concat(F.expr("if(p_partkey % 2 = 0, '__revert_0aF_', '__interceptor_')"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".part."), F.col("p_size").cast("string"), F.lit("(int)+0x1"))).alias("name")),
    "SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part",
)
add(
    "rename_stack",
    lambda s, d: logs(s, d).select("event_id", F.array_join(fr.rename(fr.function_stack(F.col("log")), F.expr("map('fn_c', array('fn_d', 'fn_e'), 'x', cast(array() as array<string>))")), ",").alias("stack")),
    rf"WITH {LG} SELECT event_id, array_to_string(list_transform(regexp_extract_all(log, '#\d+\s+0x[0-9a-f]+\s+in\s+([^\s]+)', 1), lambda x: CASE WHEN x = 'fn_c' THEN 'fn_d' ELSE x END), ',') AS stack FROM lg",
)
