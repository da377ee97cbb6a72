"""Tables that a step writes for the next ones, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one, but only in a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='crashlens-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared scratch space."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame and reads it again: what stands behind it is computed once, and lineage is cut."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what stored() has written, once nothing reads it any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        if path := getattr(df, "_shared_path", None):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
