"""Experiments, groups of bugs, patches and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from crashlens.functions import bits, frames, text
from crashlens.operators import graphs, grouping, patches, sequences, trials
from crashlens.plans.base import EV, LG, Query, events, logs, table, timed_logs
from crashlens.plans.log_queries import LOOSE, SHORT, _parsed
from crashlens.sources import sinks

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _trials(s, d):
    """Customers as trials: a fuzzer by market segment, a benchmark by nation, each seventh one preempted."""
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("fuzzer"), F.concat(F.lit("b"), F.col("c_nationkey") % 3).alias("benchmark"), (F.col("c_custkey") % 7 == 0).cast("int").alias("preempted"), F.expr("if(c_acctbal > 0, c_name, null)").alias("time_ended"))


def _crashes(s, d):
    return timed_logs(s, d).where("event_type <> 'view'").select(F.col("user_id").alias("trial_id"), F.col("t").alias("time"), F.col("log").alias("crash_stacktrace"), F.concat_ws("\n", F.concat(F.lit("fn_"), F.col("k") % 7), F.col("event_type")).alias("crash_state"), F.concat(F.lit("k"), F.col("k") % 9, F.lit("|x")).alias("crash_key"))


TRIALS = f"{LG}, tr AS (SELECT c_custkey AS id, c_mktsegment AS fuzzer, 'b' || CAST(c_nationkey % 3 AS VARCHAR) AS benchmark, c_custkey % 7 = 0 AS preempted, CASE WHEN c_acctbal > 0 THEN c_name END AS time_ended FROM customer), cr AS (SELECT * FROM lg WHERE event_type <> 'view')"
add(
    "crash_trial_scan",
    lambda s, d: trials.crash_scan(_crashes(s, d), _trials(s, d), "b1").select("fuzzer", "trial", "time", F.md5("stack").alias("stack")),
    f"WITH {TRIALS} SELECT fuzzer, id AS trial, t AS time, md5(log) AS stack FROM cr JOIN tr ON id = user_id WHERE benchmark = 'b1' AND NOT preempted",
)
add(
    "trial_snapshot_times",
    lambda s, d: trials.snapshot_times(events(s, d).where("event_type = 'view'").select(F.col("user_id").alias("trial_id"), F.col("t").alias("time"))).select("trial", F.array_join(F.transform("times", lambda x: x.cast("string")), ",").alias("times")),
    f"WITH {EV} SELECT user_id AS trial, array_to_string(list_sort(list(t)), ',') AS times FROM ev WHERE event_type = 'view' GROUP BY 1",
)
TIMES = "CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN '+02:00' ELSE '' END END"
add(
    "experiment_start",
    lambda s, d: trials.experiment_start(table(s, d, "orders").where("o_orderkey % 3 > 0").select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 2 == 0, "+02:00").otherwise("")).alias("time_created"))),
    f"SELECT CAST(epoch(arg_min(o_orderdate, {TIMES})) - CASE WHEN min({TIMES}) LIKE '%+02:00' THEN 7200 ELSE 0 END AS DOUBLE) AS start FROM orders",
)
add(
    "epoch_of_text",
    lambda s, d: table(s, d, "orders").select("o_orderkey", trials.epoch_seconds(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 2 == 0, "+02:00").otherwise(""))).alias("start")),
    "SELECT o_orderkey, CAST(epoch(o_orderdate) - CASE WHEN o_orderkey % 2 = 0 THEN 7200 ELSE 0 END AS DOUBLE) AS start FROM orders",
)
add(
    "live_statistics",
    lambda s, d: trials.live_statistics(
        table(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("time_created"), F.col("o_orderstatus").alias("time_ended")), _trials(s, d),
        events(s, d).select(F.col("t").alias("time")), _crashes(s, d),
    ),
    f"""WITH {TRIALS} SELECT min(strftime(o_orderdate, '%Y-%m-%d')) AS time_created, arg_min(o_orderstatus, (strftime(o_orderdate, '%Y-%m-%d'), o_orderstatus)) AS time_ended, (SELECT count(*) FROM tr) AS total_trials,
    (SELECT count(time_ended) FROM tr) AS ended_trials, (SELECT max(t) FROM ev) AS latest_snapshot, (SELECT count(*) FROM cr) AS crash_rows FROM orders""",
)
add("live_crashes_by_fuzzer", lambda s, d: trials.crashes_by_fuzzer(_crashes(s, d), _trials(s, d)), f"WITH {TRIALS} SELECT fuzzer, count(*) AS n FROM cr JOIN tr ON id = user_id GROUP BY 1")
add(
    "live_top_crash_states",
    lambda s, d: trials.top_states(_crashes(s, d)),
    f"WITH {TRIALS} SELECT 'fn_' || CAST(k % 7 AS VARCHAR) || chr(10) || event_type AS crash_state, count(*) AS n FROM cr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
)


def _corpus(s, d):
    """Events as inputs of ten bytes, of one where k is a multiple of five; nations as bugs that a bit of up to 73 switches on, some always on."""
    head = F.unhex(F.when(F.col("k") % 5 == 0, F.lpad(F.hex(F.col("event_id") % 256), 2, "0")).otherwise(F.repeat(F.lpad(F.hex(F.col("event_id") % 65536), 4, "0"), F.lit(5))))
    inputs = events(s, d).select((F.col("user_id") % 3).alias("fuzzer"), F.col("user_id").alias("trial"), F.col("t").alias("time"), head.alias("head"))
    place = F.when(F.col("n_nationkey") % 9 != 8, F.col("n_nationkey") * 3)
    bugs = table(s, d, "nation").select(F.concat(F.lit("bug-"), "n_nationkey").alias("bug_id"), bits.mask(place, F.lit(10)).alias("dispatch_mask"))
    return trials.corpus_snapshots(inputs, bugs, 10)


add(
    "corpus_snapshots",
    _corpus,
    f"""WITH {EV}, i AS (SELECT user_id % 3 AS fuzzer, user_id AS trial, t, event_id % 65536 // 256 + event_id % 256 * 256 AS v FROM ev WHERE k % 5 <> 0), b AS (SELECT 'bug-' || CAST(n_nationkey AS VARCHAR) AS bug_id, n_nationkey % 9 = 8 AS always, CAST(n_nationkey * 3 % 16 AS INTEGER) AS p FROM nation)
    SELECT fuzzer, trial, bug_id, min(t) AS first_time FROM i JOIN b ON always OR (v >> p) & 1 = 1 GROUP BY ALL""",
)


def _bugs(s, d):
    """Parts as bugs: many share a location, each eleventh one has none."""
    none = F.col("p_partkey") % 11 == 0
    return table(s, d, "part").select(
        F.concat(F.lit("OSV-"), "p_partkey").alias("bug_id"), F.when(~none, F.concat(F.lit("src/"), F.col("p_size"), F.lit(".c"))).alias("crash_file"),
        F.when(~none & (F.col("p_partkey") % 13 > 0), F.col("p_partkey") % 4).cast("int").alias("crash_line"), F.when(none, "").when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("crash_function"),
    )


BUGS = """bg AS (SELECT 'OSV-' || CAST(p_partkey AS VARCHAR) AS bug_id, CASE WHEN p_partkey % 11 > 0 THEN 'src/' || CAST(p_size AS VARCHAR) || '.c' END AS crash_file,
CASE WHEN p_partkey % 11 > 0 AND p_partkey % 13 > 0 THEN p_partkey % 4 END AS crash_line, CASE WHEN p_partkey % 11 > 0 AND p_partkey % 3 > 0 THEN p_brand END AS crash_function FROM part)"""
add(
    "bugs_by_location",
    lambda s, d: grouping.by_location(_bugs(s, d))[0].select("crash_file", "crash_line", "crash_function", F.array_join("bugs", ",").alias("bugs"), F.col("n").cast("long").alias("n")),
    f"WITH {BUGS} SELECT coalesce(crash_file, '') AS crash_file, CAST(crash_line AS INTEGER) AS crash_line, coalesce(crash_function, '') AS crash_function, array_to_string(list_sort(list(bug_id)), ',') AS bugs, count(*) AS n FROM bg WHERE crash_file IS NOT NULL OR crash_line IS NOT NULL OR crash_function IS NOT NULL GROUP BY ALL",
)
add("bugs_without_location", lambda s, d: grouping.by_location(_bugs(s, d))[1], f"WITH {BUGS} SELECT bug_id FROM bg WHERE crash_file IS NULL AND crash_line IS NULL AND crash_function IS NULL")
add(
    "bugs_by_fingerprint",
    lambda s, d: grouping.by_fingerprint(logs(s, d).select(F.col("event_id").alias("bug_id"), frames.loose_frames(F.col("log")).alias("frames"))).select(F.array_join(F.transform("bugs", lambda x: x.cast("string")), ",").alias("bugs"), F.col("n").cast("long").alias("n")),
    f"""WITH {LG}, q AS (SELECT *, {_parsed(LOOSE)} FROM lg), r AS (SELECT event_id, array_to_string(list_transform(range(1, len(f1) + 1), lambda i: f1[i] || '@' || {SHORT.format("f2[i]")})[1:3], '|') AS p FROM q)
    SELECT array_to_string(list_sort(list(event_id)), ',') AS bugs, count(*) AS n FROM r GROUP BY p""",
)
add(
    "crashes_with_state",
    lambda s, d: grouping.with_state(
        events(s, d).select("event_id", F.concat(F.lit("fn_a"), F.col("k") % 9, F.lit("\n fn_b"), F.col("user_id") % 3, F.lit("_osv_2020_"), F.col("k") % 3, F.lit("\nfn_c\nmore")).alias("crash_state")),
        grouping.state_index(logs(s, d).select((F.col("event_id") % 400).alias("bug_id"), frames.loose_frames(F.col("log")).alias("frames"))),
    ).select("event_id", F.array_join(F.transform("bugs", lambda x: x.cast("string")), ",").alias("bugs")),
    f"""WITH {EV}, i AS (SELECT CASE WHEN k % 5 = 0 THEN NULL ELSE 'fn_a' || CAST(k % 7 AS VARCHAR) || '|' END AS a, 'fn_b' || CAST(user_id % 3 AS VARCHAR) || '_osv_2020_' || CAST(k % 3 AS VARCHAR) AS b, event_id % 400 AS bug_id, k FROM ev),
    m AS (SELECT a || b || '|fn_c' AS state, array_to_string(list_sort(list(DISTINCT bug_id)), ',') AS bugs FROM i WHERE k % 5 <> 0 GROUP BY 1)
    SELECT event_id, bugs FROM ev LEFT JOIN m ON state = 'fn_a' || CAST(k % 9 AS VARCHAR) || '|fn_b' || CAST(user_id % 3 AS VARCHAR) || '_osv_2020_' || CAST(k % 3 AS VARCHAR) || '|fn_c'""",
)
add(
    "known_key_semi_join",
    lambda s, d: grouping.known(
        events(s, d).select("event_id", F.col("event_type").alias("fuzzer"), F.concat(F.lit(" fn_"), F.col("k") % 9, F.lit("  |\n x")).alias("crash_key")),
        events(s, d).where("k % 9 < 4").select(F.col("event_type").alias("fuzzer"), text.normal_key(F.concat(F.lit("fn_"), F.col("k") % 9, F.lit("  |\n x"))).alias("key"), "k").where("event_type <> 'click' or k % 2 = 0").select("fuzzer", "key").distinct(),
    ).select("event_id"),
    f"WITH {EV} SELECT a.event_id FROM ev a WHERE EXISTS (SELECT 1 FROM ev b WHERE b.event_type = a.event_type AND b.k % 9 = a.k % 9 AND b.k % 9 < 4 AND (b.event_type <> 'click' OR b.k % 2 = 0))",
)


def _diffs(s, d):
    """Orders as diffs: a line per line item, added, removed or kept by its return flag, in two files."""
    line = F.concat(F.when(F.col("l_returnflag") == "R", "+").when(F.col("l_returnflag") == "A", "-").otherwise(" "), F.lit("line "), F.col("l_linenumber"))
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("x")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["x"]), "\n")
    at = F.col("l_orderkey") % 50 + 1
    head = lambda f, n: F.concat(F.lit(f"diff --git a/{f} b/{f}\n--- a/{f}\n+++ b/{f}\n@@ -1,2 +"), n, F.lit(",3 @@ int f(int x)\n"))
    return rows.select("l_orderkey", F.concat(head("src/a.c", at), body, F.lit("\n"), head("doc/a.txt", at), body, F.lit("\n"), head("src/b.HPP", at + 100), body).alias("diff"))


add(
    "diff_added_blocks",
    lambda s, d: patches.added_blocks(_diffs(s, d), "l_orderkey", "diff"),
    """WITH l AS (SELECT l_orderkey, l_returnflag, row_number() OVER o AS i, l_orderkey % 50 + 1 + sum(CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END) OVER o - 1 AS n FROM lineitem
    WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE l_returnflag WHEN 'R' THEN '+' WHEN 'A' THEN '-' ELSE ' ' END ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, i - row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS g FROM l WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey, g, CAST(min(n) AS BIGINT) AS start, count(*) AS count FROM p GROUP BY ALL)
    SELECT l_orderkey, 'src/a.c' AS file, start, count FROM b UNION ALL SELECT l_orderkey, 'src/b.HPP', start + 100, count FROM b""",
)


def _makefile(s, d):
    """Line items as lines of a makefile by order: an assignment by return flag, continued by line status."""
    value = F.concat(F.when(F.col("l_returnflag") == "R", F.lit("lib_x_SOURCES += ")).otherwise("  "), F.lit("f.c"), F.when(F.col("l_linestatus") == "O", F.lit(" \\  ")).otherwise(""))
    return table(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"), value.alias("value"))


add(
    "makefile_blocks",
    lambda s, d: patches.continued_blocks(_makefile(s, d), "l_orderkey").select("l_orderkey", F.col("start.l_linenumber").alias("start"), F.col("end.l_linenumber").alias("end")),
    """WITH l AS (SELECT *, coalesce(lag(l_linestatus) OVER o, 'F') <> 'O' AS new FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
    g AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS s FROM l)
    SELECT l_orderkey, min(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS start, max(l_linenumber) AS "end" FROM g GROUP BY l_orderkey, s HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 0""",
)
add(
    "blockers_with_fallback",
    lambda s, d: trials.blockers(
        s.range(1, 30).select(F.concat(F.lit("fn_none"), "id").alias("func")), table(s, d, "part").where("p_size < 5").select(F.concat(F.lit("f"), "p_size").alias("file")),
        table(s, d, "lineitem").join(table(s, d, "part"), F.expr("l_partkey = p_partkey")).groupBy(F.col("l_orderkey").alias("bug_id")).agg(F.collect_set("p_brand").alias("functions"), F.collect_list(F.concat(F.lit("f"), "p_size")).alias("files")),
    ).select("bug_id", "kind", F.array_join("items", ",").alias("items")),
    """SELECT l_orderkey AS bug_id, 'files' AS kind, array_to_string(list_sort(list(DISTINCT 'f' || CAST(p_size AS VARCHAR))), ',') AS items FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 5 GROUP BY 1""",
)


add(
    "blockers_by_function",
    lambda s, d: trials.blockers(
        table(s, d, "part").where("p_size < 3").select(F.col("p_brand").alias("func")), table(s, d, "part").where("p_size < 5").select(F.concat(F.lit("f"), "p_size").alias("file")),
        table(s, d, "lineitem").join(table(s, d, "part"), F.expr("l_partkey = p_partkey")).groupBy(F.col("l_orderkey").alias("bug_id")).agg(F.collect_list("p_brand").alias("functions"), F.collect_set(F.concat(F.lit("f"), "p_size")).alias("files")),
    ).select("bug_id", "kind", F.array_join("items", ",").alias("items")),
    """SELECT l_orderkey AS bug_id, 'functions' AS kind, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS items FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size < 3) GROUP BY 1""",
)


def _sources(s, d):
    """Events as cells of a matrix: bugs by k, commits by user, in an order of rows that no history has."""
    u = F.col("user_id")
    rank = F.expr("if((k + user_id) % 3 = 0, '0|0', case user_id % 5 when 0 then '1|1' when 1 then '0.5|1' when 2 then '0|1' when 3 then '0.5|0' else '0|0' end)")
    rows = events(s, d).select(F.col("k").alias("bug"), "user_id", F.sha1(u.cast("string")).alias("commit"), bits.status_rank(rank).alias("rank"), (u % 10 * 1000000 + u).alias("row")).distinct()
    users = events(s, d).select("user_id").distinct()
    up = users.select("user_id", F.explode(F.array_distinct(F.array(F.floor(u / 2), F.floor(u / 3)))).alias("parent")).where("parent > 0")  # histories that branch and merge
    edges = up.select(F.sha1(u.cast("string")).alias("child"), F.sha1(F.col("parent").cast("string")).alias("parent"))
    introduced = rows.where("bug < 100").select("bug").distinct().select("bug", F.substr(F.sha1((F.col("bug") * 5).cast("string")), F.lit(1), F.lit(12)).alias("introduced"))
    return graphs.best_sources(rows.drop("user_id"), edges, introduced.where("bug % 2 = 0"))


add(
    "best_sources_introduced",
    _sources,
    f"""WITH RECURSIVE {EV}, c AS (SELECT DISTINCT k AS bug, user_id AS u, user_id % 10 * 1000000 + user_id AS r FROM ev), us AS (SELECT DISTINCT user_id AS u FROM ev),
    e AS (SELECT u AS c, u // 2 AS p FROM us WHERE u // 2 > 0 UNION SELECT u, u // 3 FROM us WHERE u // 3 > 0), a AS (SELECT c AS d, p AS x FROM e UNION SELECT a.d, e.p FROM a JOIN e ON a.x = e.c),
    k AS (SELECT *, CASE WHEN (bug + u) % 3 = 0 THEN 0 WHEN u % 5 = 0 THEN 2 WHEN u % 5 = 1 THEN 1 ELSE 0 END AS rank FROM c),
    t AS (SELECT * FROM (SELECT *, max(rank) OVER (PARTITION BY bug) AS top FROM k) WHERE rank > 0 AND rank = top),
    n AS (SELECT x.bug, x.r, min(y.r) AS after FROM t x JOIN a ON a.x = x.u JOIN t y ON y.bug = x.bug AND y.u = a.d AND y.r > x.r GROUP BY 1, 2),
    f AS (SELECT bug, min(r) AS r FROM t GROUP BY 1 UNION SELECT f.bug, n.after FROM f JOIN n ON n.bug = f.bug AND n.r = f.r),
    z AS (SELECT bug, max(r) AS r FROM f GROUP BY 1), o AS (SELECT bug, u FROM t WHERE bug < 100 AND bug % 2 = 0 AND u = bug * 5)
    SELECT z.bug, sha1(CAST(coalesce(o.u, t.u) AS VARCHAR)) AS commit FROM z JOIN t ON t.bug = z.bug AND t.r = z.r LEFT JOIN o ON o.bug = z.bug""",
)
add(
    "common_prefix_renamed",
    lambda s, d: sequences.common_prefix(
        events(s, d).withColumn("i", F.expr("row_number() over (partition by user_id order by t, event_id)")).select("user_id", "i", F.concat("event_type", F.lit(" a")).alias("v")),
        events(s, d).withColumn("i", F.expr("row_number() over (partition by user_id order by t, event_id)")).select("user_id", "i", F.expr("case when event_type = 'error' and k % 4 > 0 then 'failure b' when event_type = 'view' and k % 2 = 1 then '__revert_view' when k % 17 = 5 then 'odd' else event_type end").alias("v")),
        ["user_id"], "i", "v", s.createDataFrame([("failure", "error"), ("x", "y")], "old string, new string"),
    ).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")),
    f"""WITH {EV}, e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev), m AS (SELECT user_id, min(i) FILTER (WHERE NOT (event_type = 'error' AND k % 4 > 0) AND NOT (event_type = 'view' AND k % 2 = 1) AND k % 17 = 5) AS x, max(i) AS y FROM e GROUP BY 1)
    SELECT user_id, coalesce(x - 1, y) AS n FROM m WHERE coalesce(x - 1, y) > 0""",
)
add(
    "bug_summary",
    lambda s, d: sinks.bug_summary(_bugs(s, d), table(s, d, "lineitem").groupBy(F.concat(F.lit("OSV-"), "l_partkey").alias("bug_id")).agg(F.min(F.when(F.col("l_quantity") > 45, F.col("l_orderkey"))).alias("time_first_reached"), F.min(F.when(F.col("l_quantity") > 49, F.col("l_orderkey"))).alias("time_first_triggered"))),
    f"WITH {BUGS}, e AS (SELECT 'OSV-' || CAST(l_partkey AS VARCHAR) AS bug_id, max(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT count(*) AS total_bugs, count(crash_line) AS bugs_with_crash_line, count(*) FILTER (WHERE q > 45) AS bugs_reached, count(*) FILTER (WHERE q > 49) AS bugs_triggered FROM bg LEFT JOIN e USING (bug_id)",
)
add(
    "report_blocks",
    # a table of few files is dealt out before its reports are parsed
    lambda s, d: table(s, d, "part").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "p_partkey").select("p_partkey", text.report_block(F.concat(F.lit("Detailed Report: https://x/"), "p_partkey", F.expr("if(p_partkey % 2 = 0, '\nnote one', '')"), F.lit("\nJob Type: asan_"), "p_size", F.expr("if(p_size % 3 > 0, concat('\n\nCrash State:\n  fn_', p_size, '\nKey: v\n  main'), '')"), F.lit("\n\nafter: all"))).alias("r")).select(
        "p_partkey", F.array_join("r.crash_state", "|").alias("state"), F.col("r.extra").alias("extra"), F.col("r.fields")["Job Type"].alias("job"), F.size("r.fields").cast("long").alias("n")),
    """SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 'fn_' || CAST(p_size AS VARCHAR) || '|main' END AS state, CASE WHEN p_partkey % 2 = 0 THEN 'note one' END AS extra, 'asan_' || CAST(p_size AS VARCHAR) AS job, CAST(3 AS BIGINT) AS n FROM part""",
)
