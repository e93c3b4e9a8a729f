"""Lineage cuts that survive lost executors: tables written under the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one is set only where none is configured and all runs on one machine, as in tests."""
    where = spark.conf.get(CONF, None) or spark.sparkContext.getConf().get(CONF, None)
    if where:
        return where.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError(f"set {CONF} to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliospark-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df as Parquet in the shared folder and return a frame that reads it; one file is one later partition."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliospark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # noqa: SLF001  kept for discard()
    return out


def discard(*frames: DataFrame) -> None:
    """Remove staged tables that no pending result reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001
