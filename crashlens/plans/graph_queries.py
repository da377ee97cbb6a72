"""Commit graphs made of customers' orders, and numbered lines of files made of events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crashlens.operators import graphs
from crashlens.plans.base import EV, Query, events, table
from crashlens.sources import numbered, readers, shared

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _orders(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("bug"), F.col("o_orderkey").alias("node"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("i"))


def _history(rows):
    """A customer's orders as commits: short lines that branch off each fourth commit, every other one a merge as well."""
    back = F.expr("case when i % 4 <> 1 then array(i - 1) when i % 8 = 1 then array(i - 4, i - 1) else array(i - 4) end")
    up = rows.select("bug", F.col("node").alias("child"), F.explode(back).alias("i"))
    return graphs.history(up.join(rows.select("bug", "i", F.col("node").alias("parent")), ["bug", "i"]))


ORDERS = """o AS (SELECT o_custkey AS bug, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
e AS (SELECT bug, i AS c, i - 1 AS p FROM o WHERE i > 1 AND (i % 4 <> 1 OR i % 8 = 1) UNION SELECT bug, i, i - 4 FROM o WHERE i > 4 AND i % 4 = 1)"""


def _live(s, d):
    rows = _orders(s, d)
    windows = rows.groupBy("bug").agg(F.max(F.when(F.col("i") == 3, F.col("node"))).alias("introduced"), F.max(F.when(F.col("i") == 10, F.col("node"))).alias("fixed"))
    return graphs.live(_history(rows), windows)


add(
    "dag_live_merges",
    _live,
    f"""WITH RECURSIVE {ORDERS}, r AS (SELECT bug, i AS s, i FROM o WHERE i IN (3, 10) UNION SELECT r.bug, r.s, e.c FROM r JOIN e ON e.bug = r.bug AND e.p = r.i)
    SELECT r.bug, o.node AS commit FROM r JOIN o USING (bug, i) WHERE s = 3 AND NOT EXISTS (SELECT 1 FROM r x WHERE x.bug = r.bug AND x.s = 10 AND x.i = r.i)""",
)


def _ancestry(s, d):
    """Whether an order is an ancestor of the one five places on, and of the one two on."""
    rows = _orders(s, d)
    graph = _history(rows)
    pairs = rows.select("bug", F.col("node").alias("a"), F.explode(F.array(F.col("i") + 2, F.col("i") + 5)).alias("i")).join(rows.withColumnRenamed("node", "b"), ["bug", "i"]).select("a", "b")
    return graphs.ancestry(graph, pairs, graphs.levels(graph))


add(
    "dag_ancestry",
    _ancestry,
    f"""WITH RECURSIVE {ORDERS}, r AS (SELECT bug, c, p FROM e UNION SELECT r.bug, r.c, e.p FROM r JOIN e ON e.bug = r.bug AND e.c = r.p)
    SELECT x.node AS a, y.node AS b, EXISTS (SELECT 1 FROM r WHERE r.bug = x.bug AND r.c = y.i AND r.p = x.i) AS ancestor FROM o x JOIN o y ON y.bug = x.bug AND (y.i = x.i + 2 OR y.i = x.i + 5)""",
)


def _traces(s, d):
    """Events as lines of sixteen raw traces, written as text and read back with their numbers."""
    value = F.concat(F.lit("offset: "), F.lower(F.hex("event_id")), F.lit(" called by: "), F.lower(F.hex("k")))
    lines = events(s, d).select((F.col("user_id") % 16).alias("part"), "event_id", value.alias("value"))
    path = shared.folder(s, "traces")
    lines.repartition(16, "part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    return numbered.numbered(s, path).withColumn("part", F.regexp_extract("file", r"part=(\d+)/", 1).cast("long")).drop("file")


add(
    "numbered_lines",
    lambda s, d: readers.raw_trace(_traces(s, d)).select("part", "pos", F.conv("offset", 16, 10).cast("long").alias("event_id")),
    "SELECT user_id % 16 AS part, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS pos, event_id FROM events",
)
add(
    "trace_callees",
    lambda s, d: readers.trace_callees(readers.raw_trace(_traces(s, d)), ("part",)).select("part", F.conv("caller", 16, 10).cast("long").alias("k"), F.md5(F.array_join("callees", ",")).alias("callees")),
    f"WITH {EV} SELECT user_id % 16 AS part, CAST(k AS BIGINT) AS k, md5(string_agg(printf('%x', event_id), ',' ORDER BY event_id)) AS callees FROM ev GROUP BY ALL",
)


def _covered(s, d):
    """Events as archives of two files each, and parts as bugs in one of six files below either folder."""
    rows = events(s, d)
    file = lambda pos, folder, line: rows.select("user_id", F.col("event_id").alias("archive"), F.concat(F.lit(folder), F.lit("f"), F.col("k") % 4, F.lit(".c")).alias("file"), F.lit(pos).alias("file_pos"), line.cast("int").alias("line"), F.col("t").alias("time"))
    lines = file(0, "/src/p/lib/", F.col("k") % 9).unionByName(file(1, "", (F.col("k") + 1) % 9))
    folder = F.when(F.col("p_size") % 2 == 0, "lib/").otherwise("x/")
    bugs = table(s, d, "part").select(F.concat(folder, F.lit("f"), F.col("p_size") % 6, F.lit(".c")).alias("crash_file"), (F.col("p_partkey") % 9).cast("int").alias("crash_line")).distinct()
    return readers.first_covered(lines, bugs.withColumn("bug_id", F.concat_ws(":", "crash_file", "crash_line")), ["user_id"])


add(
    "coverage_first_reach",
    _covered,
    f"""WITH {EV}, b AS (SELECT DISTINCT p_size % 2 AS x, p_size % 6 AS f, p_partkey % 9 AS line FROM part)
    SELECT user_id, CASE WHEN x = 0 THEN 'lib/' ELSE 'x/' END || 'f' || CAST(f AS VARCHAR) || '.c:' || CAST(line AS VARCHAR) AS bug_id, min(t) AS first_time FROM ev JOIN b ON f = k % 4 AND line = (k + x) % 9 GROUP BY ALL""",
)
