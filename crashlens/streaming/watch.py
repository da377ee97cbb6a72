"""Watchers: crash statistics that go on after a restart, and a search that ends with its first hit."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crashlens.sources import shared

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, name: str, schema: str = EVENTS, files: int = 8) -> DataFrame:
    """New parquet files of a folder, each once (STR-02)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name).parquet(folder)


#: Partial states after which they are merged into one.
MERGE_EVERY = 16


def partial(batch: DataFrame) -> DataFrame:
    """What a batch adds to the state: by type, by type and user, and by type and the number in props, how many rows, the first and the latest time."""
    state = F.concat_ws("|", "event_type", F.get_json_object("props", "$.k"))
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in (("type", F.col("event_type")), ("user", F.concat_ws("\t", "event_type", "user_id")), ("state", state))))
    return batch.select("ts", F.explode(kinds).alias("x")).groupBy("x.kind", "x.key").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("latest"))


def merged(parts: DataFrame) -> DataFrame:
    """One state of several: counts add up, times take the least and the greatest."""
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("latest").alias("latest"))


STATE = "kind string, key string, n bigint, first timestamp_ntz, latest timestamp_ntz"


def _finished(spark: SparkSession, store: str, name: str) -> list[int]:
    """Numbers of the folders `name=<n>` of a store that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}=*/_SUCCESS")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path) or []
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found)


def state(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The state so far, of batches up to a number: the last merged one and the partial ones after it."""
    fit = lambda name: [n for n in _finished(spark, store, name) if before is None or n <= before]
    base = fit("base")[-1:]
    parts = [f"{store}/base={n}" for n in base] + [f"{store}/batch={n}" for n in fit("batch") if not base or n > base[0]]
    return merged(spark.read.schema(STATE).parquet(*parts)) if parts else spark.createDataFrame([], STATE)


def keep(rows: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Keeps the state of a stream's files in a store (STR-01, STR-02). It goes on where an earlier run with the same checkpoint ended.

    A batch writes its own part under its number, and every MERGE_EVERY-th the merged state; a batch that is run again writes
    the same folders again, so it counts once.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        partial(batch).coalesce(1).write.mode("overwrite").parquet(f"{store}/batch={number}")
        if number % MERGE_EVERY == MERGE_EVERY - 1:
            earlier = state(spark, store, number - 1).unionByName(spark.read.schema(STATE).parquet(f"{store}/batch={number}"))
            merged(earlier).write.mode("overwrite").parquet(f"{store}/base={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(state: DataFrame) -> DataFrame:
    """One row: rows, the first and the latest time."""
    return state.where("kind = 'type'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min("first").alias("first"), F.max("latest").alias("latest"))


def by_type(state: DataFrame) -> DataFrame:
    """event_type, n, distinct users, and the latest time."""
    kind = F.when(F.col("kind") == "user", F.split_part("key", F.lit("\t"), F.lit(1))).otherwise(F.col("key"))
    own = state.where("kind in ('type', 'user')").groupBy(kind.alias("event_type"))
    return own.agg(F.sum(F.when(F.col("kind") == "type", F.col("n"))).alias("n"), F.count_if(F.col("kind") == "user").alias("users"), F.max("latest").alias("latest"))


def top_states(state: DataFrame, k: int = 5) -> DataFrame:
    """The k commonest states, ties to the least name."""
    return state.where("kind = 'state'").select(F.col("key").alias("state"), "n").orderBy(F.desc("n"), "state").limit(k)


def until_match(rows: DataFrame, condition: str, seconds: float, keep: list[str], checkpoint: str | None = None) -> list[tuple]:
    """The first row, by `keep`, of the first batch that has one for a condition: the stream ends with it, or when time is up (STR-03, STR-04).

    With a checkpoint of its own it goes on after the batches that an earlier run has looked at.
    """
    found: list[tuple] = []

    def look(batch: DataFrame, _: int) -> None:
        if not found:
            found.extend(tuple(r) for r in batch.where(condition).orderBy(*keep).select(*keep).limit(1).collect())

    query = rows.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint or shared.folder(rows.sparkSession, "stream")).trigger(availableNow=True).start()
    until = time.monotonic() + seconds
    while query.isActive and not found and time.monotonic() < until:
        query.awaitTermination(0.1)
    error = query.exception() if not found else None
    query.stop()
    if error is not None:
        raise error
    return found


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, users and latest times by event type, from a stream that has read all events."""
    store = shared.folder(spark, "watched")
    keep(stream(spark, sf_dir, "events.parquet"), store, f"{store}-checkpoint").awaitTermination()
    return by_type(state(spark, store))


def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest states, the totals with them, of a folder that is watched, gets more files, and is watched again."""
    files, store = shared.folder(spark, "incoming"), shared.folder(spark, "watched")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for half in range(2):
        events.where(F.pmod("event_id", F.lit(2)) == half).repartition(3, "event_id").write.mode("append").parquet(files)
        keep(stream(spark, files, "*.parquet", files=2), store, f"{store}-checkpoint").awaitTermination()
    found = state(spark, store)
    return top_states(found).crossJoin(F.broadcast(totals(found)))  # one row


def stop_on_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error event with a value over 9, by id."""
    rows = until_match(stream(spark, sf_dir, "events.parquet"), "event_type = 'error' and value > 9", 120, ["event_id", "user_id"])
    return spark.createDataFrame(rows, "event_id bigint, user_id bigint")
