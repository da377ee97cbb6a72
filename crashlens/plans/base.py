"""Tables, and synthetic crash logs made of events, for queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with k from props, and t, seconds since the first event."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    start = rows.agg(F.min("ts").alias("t0"))
    return rows.crossJoin(F.broadcast(start)).withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("t0").cast("timestamp"))).drop("t0")


#: SQL that both engines run: a sanitizer log of an event.
LOG = r"""'==7==ERROR: AddressSanitizer: ' || CASE event_type WHEN 'error' THEN 'heap-buffer-overflow' WHEN 'click' THEN 'heap-use-after-free' WHEN 'view' THEN 'SEGV' WHEN 'signup' THEN 'stack-overflow' ELSE 'double-free' END
|| ' on address 0x60' || chr(10) || CASE WHEN k % 2 = 0 THEN 'READ' ELSE 'WRITE' END || ' of size ' || CAST(k % 8 + 1 AS STRING) || chr(10)
|| '    #0 0x1f in ' || CASE WHEN k % 5 = 0 THEN '__asan_memcpy /src/llvm-project/compiler-rt/lib/asan/asan_interceptors.cpp:22:3' ELSE 'fn_a' || CAST(k % 7 AS STRING) || ' /src/proj/lib/f' || CAST(k % 4 AS STRING) || '.c:' || CAST(k % 9 + 1 AS STRING) || ':5' END || chr(10)
|| '    #1 0x2f in fn_b' || CAST(user_id % 3 AS STRING) || '_osv_2020_' || CAST(k % 3 AS STRING) || ' /src/proj/lib/g' || CAST(user_id % 2 AS STRING) || '.c:' || CAST(k % 6 + 10 AS STRING) || chr(10)
|| '    #2 0x3f in fn_c /src/proj/h.c' || chr(10) || '    #3 0x4f in LLVMFuzzerTestOneInput /src/proj/fuzz/harness.c:40:1' || chr(10)
|| '0x60 is located ' || CAST(k % 3 AS STRING) || ' bytes to the right of 16-byte region' || chr(10) || 'SUMMARY: AddressSanitizer: ' || CASE WHEN event_type = 'view' THEN 'SEGV' ELSE event_type END || ' /src/proj/lib/f' || CAST(k % 4 AS STRING) || '.c:7:1 in fn_s'"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with k and their log."""
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("log", F.expr(LOG))


def timed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """logs() with t, seconds since the first event."""
    return events(spark, sf_dir).withColumn("log", F.expr(LOG))


#: The same for SQL: `ev` with k and t, and `lg` with log.
EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(epoch(date_trunc('second', ts)) - (SELECT epoch(date_trunc('second', min(ts))) FROM events) AS BIGINT) AS t FROM events)"
LG = EV + f", lg AS (SELECT *, {LOG} AS log FROM ev)"
