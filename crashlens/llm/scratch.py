"""Shared scratch space and small session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Removes the shuffle files of a write as soon as it has ended; what is read later is the written table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one, but only in a local session: executors share it there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not root:
        found = sc._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = found.get() if found.isDefined() else f"file://{tempfile.mkdtemp(prefix='crashlens-')}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared scratch space, as a URI."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage", codec: str = "snappy") -> DataFrame:
    """Writes a frame to the shared scratch space and reads it again: lineage is cut, sizes are known, shuffle files go."""
    spark = df.sparkSession
    path, before = folder(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes the tables of frames that stored() gave and that nothing reads any more."""
    for df in frames:
        jvm, path = df.sparkSession._jvm, getattr(df, "_scratch_path", None)
        if path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a table, as Spark reckons them, that a range of its rows has, about.
RANGE = 1 << 27


def ranges(df: DataFrame) -> int:
    """Ranges to deal a frame's rows to: as many as the session's shuffle partitions, and more where the frame is too big for those."""
    return max(partitions(df.sparkSession), int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // RANGE)


#: Rows of an Arrow batch where the session has Spark's default: texts are long, and workers hold a few batches each.
BATCH = 1500


def lean(spark: SparkSession) -> None:
    """Lowers the rows of Arrow batches, unless the session has set them."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
