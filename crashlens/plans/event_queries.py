"""Survival, summaries, histograms and order over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from crashlens.functions import bits, text
from crashlens.operators import choices, rollups, sequences, survival
from crashlens.plans.base import EV, Query, events, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _first(s, d, kind=None):
    rows = events(s, d)
    return survival.first_events(rows if kind is None else rows.where(F.col("event_type") == kind), ["user_id", "event_type"], "t")


def matrix(s, d):
    rows = events(s, d)
    return survival.dense(rows.select("user_id").distinct(), rows.select("event_type").distinct(), _first(s, d), rows.agg(F.max("t").alias("censor")), ["user_id", "event_type"])


MATRIX = f"""WITH {EV}, u AS (SELECT DISTINCT user_id FROM ev), e AS (SELECT DISTINCT event_type FROM ev), c AS (SELECT max(t) AS censor FROM ev),
f AS (SELECT user_id, event_type, min(t) AS first_time FROM ev GROUP BY ALL),
m AS (SELECT u.user_id, e.event_type, c.censor, f.first_time, CAST(f.first_time IS NOT NULL AS INTEGER) AS event, coalesce(f.first_time, c.censor) AS time
      FROM u CROSS JOIN e CROSS JOIN c LEFT JOIN f ON f.user_id = u.user_id AND f.event_type = e.event_type)"""
KM = """, g AS (SELECT {0} AS stratum, time, sum(event) AS d, count(*) AS n FROM m GROUP BY ALL),
h AS (SELECT *, sum(n) OVER (PARTITION BY stratum ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM g),
i AS (SELECT *, product(1 - d / risk) OVER (PARTITION BY stratum ORDER BY time) AS alive FROM h)"""

add(
    "km_median_by_type",
    lambda s, d: survival.km_median(matrix(s, d), ["event_type"]),
    MATRIX + KM.format("event_type") + """ SELECT stratum AS event_type, CAST(sum(n) AS BIGINT) AS n_pairs, CAST(sum(d) AS BIGINT) AS n_events,
    CAST(min(CASE WHEN d > 0 AND alive <= 0.5 + 1e-12 THEN time END) AS BIGINT) AS km_median FROM i GROUP BY ALL""",
)
add(
    "km_running_window",
    lambda s, d: survival.km_curve(matrix(s, d), ["event_type"]).select("event_type", F.col("t").alias("time"), F.col("risk").cast("long").alias("risk"), F.round("alive", 6).alias("alive")),
    MATRIX + KM.format("event_type") + " SELECT stratum AS event_type, time, CAST(risk AS BIGINT) AS risk, round(alive, 6) AS alive FROM i",
)
add("first_seen_min", lambda s, d: _first(s, d), f"WITH {EV} SELECT user_id, event_type, min(t) AS first_time FROM ev GROUP BY ALL")


def _wide(s, d):
    rows = events(s, d)
    keys = ["user_id"]
    merged = survival.merge_events(survival.first_events(rows.where("event_type = 'view'"), keys, "t"), survival.first_events(rows.where("event_type = 'error'"), keys, "t"), keys)
    dense = rows.select("user_id").distinct().join(merged, keys, "left").crossJoin(F.broadcast(rows.agg(F.max("t").alias("censor"))))
    return survival.survival_wide(dense)


WIDE = f"""WITH {EV}, r AS (SELECT user_id, min(t) AS r FROM ev WHERE event_type = 'view' GROUP BY 1), g AS (SELECT user_id, min(t) AS time_first_triggered FROM ev WHERE event_type = 'error' GROUP BY 1),
mm AS (SELECT coalesce(r.user_id, g.user_id) AS user_id, coalesce(r, time_first_triggered) AS time_first_reached, time_first_triggered FROM r FULL JOIN g ON r.user_id = g.user_id),
w AS (SELECT u.user_id, time_first_reached, time_first_triggered, c.censor, CAST(time_first_reached IS NOT NULL AS INTEGER) AS reached_event, CAST(coalesce(time_first_reached, c.censor) AS BIGINT) AS reached_seconds,
      CAST(time_first_triggered IS NOT NULL AS INTEGER) AS triggered_event, CAST(coalesce(time_first_triggered, c.censor) AS BIGINT) AS triggered_seconds
      FROM (SELECT DISTINCT user_id FROM ev) u CROSS JOIN (SELECT max(t) AS censor FROM ev) c LEFT JOIN mm ON mm.user_id = u.user_id)"""
add("survival_wide", _wide, WIDE + " SELECT * FROM w")
add(
    "survival_long",
    lambda s, d: survival.survival_long(_wide(s, d), ["user_id"]),
    WIDE + " SELECT user_id, 'reached' AS event_type, reached_event AS event_observed, reached_seconds AS time_seconds FROM w UNION ALL SELECT user_id, 'triggered', triggered_event, triggered_seconds FROM w",
)
add(
    "merge_reach_trigger",
    lambda s, d: survival.merge_events(
        survival.first_events(events(s, d).where("event_type = 'view'"), ["user_id", "k"], "t"), survival.first_events(events(s, d).where("event_type = 'error'"), ["user_id", "k"], "t"), ["user_id", "k"]
    ),
    f"""WITH {EV}, r AS (SELECT user_id, k, min(t) AS r FROM ev WHERE event_type = 'view' GROUP BY ALL), g AS (SELECT user_id, k, min(t) AS g FROM ev WHERE event_type = 'error' GROUP BY ALL)
    SELECT coalesce(r.user_id, g.user_id) AS user_id, coalesce(r.k, g.k) AS k, coalesce(r, g) AS time_first_reached, g AS time_first_triggered FROM r FULL JOIN g ON r.user_id = g.user_id AND r.k = g.k""",
)
add(
    "snapshot_times",
    lambda s, d: events(s, d).where("event_type = 'signup'").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x.cast("string")), ",").alias("times")),
    f"WITH {EV} SELECT user_id, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS times FROM ev WHERE event_type = 'signup' GROUP BY 1",
)
add(
    "stratum_summary",
    lambda s, d: rollups.ratio_by(matrix(s, d).withColumn("stratum", bits.stratum(F.col("user_id") % 3)), ["event_type", "stratum"], "event").withColumn("share", F.round("share", 6)),
    MATRIX + " SELECT event_type, CASE WHEN user_id % 3 = 0 THEN 'always' ELSE 'gated' END AS stratum, count(*) AS n, CAST(sum(event) AS BIGINT) AS hits, round(sum(event) / count(*), 6) AS share FROM m GROUP BY ALL",
)
add(
    "stratum_zeros",
    lambda s, d: rollups.strata(matrix(s, d).where("event_type <> 'error' or user_id % 3 = 0").select(F.col("event_type").alias("fuzzer"), bits.stratum(F.col("user_id") % 3).alias("stratum"), "event"), table(s, d, "events").select(F.col("event_type").alias("fuzzer")), "event"),
    MATRIX + """, z AS (SELECT event_type AS fuzzer, CASE WHEN user_id % 3 = 0 THEN 'always' ELSE 'gated' END AS stratum, event FROM m WHERE event_type <> 'error' OR user_id % 3 = 0),
    g AS (SELECT event_type AS fuzzer, unnest(['gated', 'always']) AS stratum FROM e)
    SELECT g.fuzzer, g.stratum, count(event) AS n, CAST(coalesce(sum(event), 0) AS BIGINT) AS hits, round(sum(event) / count(event), 4) AS share FROM g LEFT JOIN z USING (fuzzer, stratum) GROUP BY 1, 2""",
)
add(
    "stratum_km",
    lambda s, d: survival.km_median(matrix(s, d).withColumn("stratum", bits.stratum(F.col("user_id") % 3)), ["stratum"]),
    MATRIX + KM.format("CASE WHEN user_id % 3 = 0 THEN 'always' ELSE 'gated' END") + " SELECT stratum, CAST(sum(n) AS BIGINT) AS n_pairs, CAST(sum(d) AS BIGINT) AS n_events, CAST(min(CASE WHEN d > 0 AND alive <= 0.5 + 1e-12 THEN time END) AS BIGINT) AS km_median FROM i GROUP BY ALL",
)
add(
    "classify_precedence",
    lambda s, d: events(s, d).groupBy("user_id", "event_type").agg(F.max((F.col("k") > 90)).alias("g"), F.max((F.col("k") < 20)).alias("a")).withColumn("kind", rollups.precedence(F.col("g"), F.col("a"))).groupBy("event_type", "kind").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {EV}, x AS (SELECT user_id, event_type, bool_or(k > 90) AS g, bool_or(k < 20) AS a FROM ev GROUP BY ALL) SELECT event_type, CASE WHEN g THEN 'gated' WHEN a THEN 'always' ELSE 'unmatched' END AS kind, count(*) AS n FROM x GROUP BY ALL",
)
add(
    "bit_histogram_dense",
    lambda s, d: rollups.dense_histogram(events(s, d).withColumn("bit", bits.bit_index(F.col("k"))), "event_type", "bit"),
    f"""WITH {EV}, b AS (SELECT event_type, CASE WHEN bit_count(k) = 1 THEN CAST(bit_count(k - 1) AS INTEGER) END AS bit FROM ev), g AS (SELECT event_type, unnest(range(0, (SELECT max(bit) + 1 FROM b))) AS bit FROM (SELECT DISTINCT event_type FROM b))
    SELECT g.event_type, CAST(g.bit AS INTEGER) AS bit, count(b.bit) AS n FROM g LEFT JOIN b ON b.event_type = g.event_type AND b.bit = g.bit GROUP BY ALL""",
)
add(
    "unmatched_by_key_first",
    lambda s, d: rollups.first_by_key(events(s, d), ["event_type", "k"], ["t", "event_id"], ["user_id"], "user_id"),
    f"WITH {EV} SELECT event_type, k, count(*) AS occurrences, count(DISTINCT user_id) AS seen, min(t) AS t, arg_min(event_id, (t, event_id)) AS event_id, arg_min(user_id, (t, event_id)) AS user_id FROM ev GROUP BY ALL",
)
add(
    "grouping_sets_breakdown",
    lambda s, d: rollups.breakdown(events(s, d).withColumn("fuzzer", F.col("user_id") % 4), ["fuzzer", "event_type"], "k"),
    f"WITH {EV} SELECT 'fuzzer' AS dimension, CAST(user_id % 4 AS VARCHAR) AS name, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM ev GROUP BY ALL UNION ALL SELECT 'event_type', event_type, count(*), CAST(sum(k) AS BIGINT) FROM ev GROUP BY ALL",
)
add(
    "rollup_with_overall",
    lambda s, d: rollups.with_total(events(s, d).withColumn("bench", F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string"))), "bench", "event_type"),
    f"WITH {EV}, x AS (SELECT 'b' || CAST(user_id % 3 AS VARCHAR) AS bench, event_type FROM ev) SELECT bench, event_type, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT '__overall__', event_type, count(*) FROM x GROUP BY ALL",
)
add(
    "fuzzer_summary_zero_filled",
    lambda s, d: survival.zero_filled_means(matrix(s, d).withColumn("fuzzer", F.col("user_id") % 4), "fuzzer", "user_id", "event_type").withColumn("mean", F.round(F.col("total_hits") / F.col("n_trials"), 6)),
    MATRIX + """, t AS (SELECT user_id % 4 AS fuzzer, user_id, sum(event) AS hits, min(CASE WHEN event = 1 THEN time END) AS first FROM m GROUP BY ALL),
    a AS (SELECT fuzzer, CAST(sum(x) AS BIGINT) AS hit_in_all FROM (SELECT user_id % 4 AS fuzzer, event_type, min(event) AS x FROM m GROUP BY ALL) GROUP BY 1)
    SELECT t.fuzzer, count(*) AS n_trials, CAST(sum(hits) AS BIGINT) AS total_hits, CAST(max(hits) AS BIGINT) AS max_hits, min(first) AS earliest, any_value(hit_in_all) AS hit_in_all, round(sum(hits) / count(*), 6) AS mean FROM t JOIN a USING (fuzzer) GROUP BY 1""",
)
add(
    "missing_lists",
    lambda s, d: survival.missing(_late(s, d), "user_id", "event_type"),
    MATRIX.replace("GROUP BY ALL),\nm", "GROUP BY ALL HAVING min(t) < 3600 * 24 * 3),\nm") + " SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (WHERE event = 0), '') AS missing FROM m GROUP BY 1",
)


def _late(s, d):
    rows = events(s, d)
    return survival.dense(rows.select("user_id").distinct(), rows.select("event_type").distinct(), _first(s, d).where("first_time < 3600 * 24 * 3"), rows.agg(F.max("t").alias("censor")), ["user_id", "event_type"])


add(
    "never_seen",
    lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("custkey")).join(table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey")), "custkey", "left_anti"),
    "SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
add(
    "pending_antijoin",
    lambda s, d: choices.pending(events(s, d).select("user_id", "event_type").distinct(), events(s, d).where("k > 96"), ["user_id", "event_type"]),
    f"WITH {EV} SELECT DISTINCT user_id, event_type FROM ev ANTI JOIN (SELECT user_id, event_type FROM ev WHERE k > 96) p USING (user_id, event_type)",
)
add(
    "run_collapse",
    lambda s, d: sequences.collapse_runs(events(s, d), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type"),
    f"WITH {EV}, x AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM ev) SELECT user_id, event_id, event_type FROM x WHERE b IS NULL OR b <> event_type",
)


def _numbered(s, d, shift):
    from pyspark.sql import Window

    rows = events(s, d).where(F.col("user_id") % 2 == shift)
    return rows.select((F.col("user_id") - shift).alias("pair"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"), F.expr("if(event_type in ('view', 'click'), 'a', 'b')").alias("func"))


add(
    "common_prefix",
    lambda s, d: sequences.common_prefix(_numbered(s, d, 0), _numbered(s, d, 1), ["pair"], "pos", "func"),
    f"""WITH {EV}, n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE WHEN event_type IN ('view', 'click') THEN 'a' ELSE 'b' END AS func FROM ev),
    j AS (SELECT x.user_id AS pair, CAST(x.pos AS INTEGER) AS pos, x.func AS a, y.func AS b FROM n x JOIN n y ON y.user_id = x.user_id + 1 AND y.pos = x.pos WHERE x.user_id % 2 = 0)
    SELECT pair, pos, a, b FROM (SELECT *, sum(CAST(a <> b AS INTEGER)) OVER (PARTITION BY pair ORDER BY pos) AS m FROM j) WHERE m = 0""",
)
add(
    "argmax_row",
    lambda s, d: sequences.top(events(s, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("strong"), F.count_if(F.col("event_type") == "view").alias("weak")), [F.desc("strong"), F.desc("weak"), F.col("user_id")], 1),
    f"WITH {EV} SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS strong, count(*) FILTER (WHERE event_type = 'view') AS weak, 1 AS rank FROM ev GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1",
)
add(
    "best_source_per_target",
    lambda s, d: sequences.first_wins(events(s, d).withColumn("r", bits.status_rank(bits.status_cell(F.col("value") / 10, F.col("k") > 50))), ["k"], [F.desc("r"), F.desc("t"), F.col("event_id")]).select("k", "event_id", "r"),
    f"""WITH {EV}, x AS (SELECT *, CASE WHEN value / 10 >= 1 THEN 2 WHEN value / 10 > 0 AND k > 50 THEN 1 ELSE 0 END AS r FROM ev)
    SELECT k, event_id, r FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r DESC, t DESC, event_id) AS i FROM x) WHERE i = 1""",
)
add(
    "unpivot_status_counts",
    lambda s, d: rollups.status_counts(
        rollups.to_long(events(s, d).withColumn("status", bits.status_cell(F.col("value") / 10, F.col("k") > 50)).groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(F.max("status")), ["user_id"]), ["user_id"]
    ),
    f"""WITH {EV}, x AS (SELECT user_id, event_type, max(CASE WHEN value / 10 >= 1 THEN '1' WHEN value > 0 THEN '0.5' ELSE '0' END || '|' || CAST(CAST(k > 50 AS INTEGER) AS VARCHAR)) AS status FROM ev WHERE event_type IN ('click', 'error', 'view') GROUP BY ALL)
    SELECT u.user_id, count(*) FILTER (WHERE status IN ('1|1', '1|0')) AS strong, count(*) FILTER (WHERE status = '0.5|1') AS weak, coalesce(max(CASE WHEN status IN ('1|1', '1|0') THEN 2 WHEN status = '0.5|1' THEN 1 ELSE 0 END), 0) AS best
    FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN x USING (user_id) GROUP BY 1""",
)
add(
    "subsequence_match",
    lambda s, d: _subsequence(s, d),
    f"""WITH {EV}, x AS (SELECT user_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, coalesce(bool_or(a IN ('error', 'click') AND b = 'view' AND c IN ('purchase', 'signup')), false) AS matches FROM x GROUP BY 1""",
)


def _subsequence(s, d):
    from crashlens.functions import frames

    stacks = events(s, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("stack"))
    return stacks.select("user_id", frames.contains_run(F.col("stack"), F.expr("array(array('error', 'click'), array('view'), array('purchase', 'signup'))")).alias("matches"))


add(
    "rename_expand",
    lambda s, d: sequences.expand_names(
        events(s, d).select(F.col("event_type").alias("name")).distinct(),
        sequences.rename_table(events(s, d).groupBy(F.col("event_type").alias("name"), F.concat(F.lit("n"), (F.col("k") % 3).cast("string")).alias("new")).agg(F.min("event_id").alias("o")), "o"),
    ),
    f"WITH {EV} SELECT DISTINCT event_type AS name FROM ev UNION SELECT DISTINCT 'n' || CAST(k % 3 AS VARCHAR) FROM ev",
)
add(
    "call_adjacency",
    lambda s, d: sequences.adjacency(sequences.neighbours(events(s, d), ["user_id"], ["ts", "event_id"], "event_type").where("next is not null"), "event_type", "next").select("event_type", F.array_join("targets", ",").alias("targets")),
    f"WITH {EV}, x AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev) SELECT event_type, string_agg(DISTINCT n, ',' ORDER BY n) AS targets FROM x WHERE n IS NOT NULL GROUP BY 1",
)
def _modes(s, d):
    """Events of three experiments, k modulo 3: times since the start, late ones too, and epochs, for some users without a start."""
    rows = events(s, d).select("event_id", "user_id", (F.col("k") % 3).alias("x"), (F.col("t") + F.col("k") % 3 * 800000000).alias("time"))
    latest = rows.groupBy("x").agg(survival.time_is_relative(F.max("time")).alias("relative"))
    return rows.join(F.broadcast(latest), "x").select("event_id", text.relative_seconds(F.col("time"), F.expr("if(user_id % 7 = 0, null, 1599999950)"), F.col("relative")).alias("seconds"))


add(
    "time_mode_convert",
    _modes,
    f"WITH {EV} SELECT event_id, CASE WHEN k % 3 < 2 THEN t + k % 3 * 800000000 WHEN user_id % 7 > 0 THEN t + 50 END AS seconds FROM ev",
)
add("hours_format", lambda s, d: events(s, d).select("event_id", text.hours(F.col("k") * 100).alias("hours")), f"WITH {EV} SELECT event_id, printf('%.2f', k * 100 / 3600.0) AS hours FROM ev")
add(
    "bytes_le_decode",
    lambda s, d: events(s, d).select("event_id", bits.little_endian(F.lpad(F.lower(F.hex(F.col("event_id"))), 8, "0")).alias("number"), F.size(bits.set_bits(F.lpad(F.lower(F.hex(F.col("event_id"))), 8, "0"))).cast("long").alias("n_bits")),
    f"WITH {EV} SELECT event_id, (event_id & 255) * 16777216 + ((event_id >> 8) & 255) * 65536 + ((event_id >> 16) & 255) * 256 + ((event_id >> 24) & 255) AS number, CAST(bit_count(event_id) AS BIGINT) AS n_bits FROM ev",
)
add(
    "json_pick_default",
    lambda s, d: table(s, d, "events").select("event_id", text.json_pick("props", ["$.missing", "$.k"], "-").alias("picked")),
    "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), '-') AS picked FROM events",
)
add(
    "live_stats_top_states",
    lambda s, d: sequences.top(events(s, d).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.col("event_type"), F.col("k")], 5),
    f"WITH {EV} , x AS (SELECT event_type, k, count(*) AS n FROM ev GROUP BY ALL) SELECT *, CAST(row_number() OVER (ORDER BY n DESC, event_type, k) AS INTEGER) AS rank FROM x ORDER BY rank LIMIT 5",
)
add(
    "dag_live_window",
    lambda s, d: _dag(s, d),
    f"""WITH {EV}, x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev)
    SELECT a.user_id AS bug, b.event_id AS commit FROM x a JOIN x b ON a.user_id = b.user_id AND a.i = 3 AND b.i >= 3 AND b.i < 9""",
)


def _dag(s, d):
    from pyspark.sql import Window

    rows = events(s, d).select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("i"))
    windows = rows.groupBy("user_id").agg(F.max(F.when(F.col("i") == 3, F.col("i"))).alias("introduced"), F.max(F.when(F.col("i") == 9, F.col("i"))).alias("fixed")).withColumn("bug", F.col("user_id"))
    return sequences.live_in_line(rows, windows, ["user_id"], "i", "event_id")
