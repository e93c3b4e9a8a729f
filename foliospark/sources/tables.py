"""The fixture tables, read through Spark only so that any path Spark can open will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the session has cores, if its scan has fewer.

    A small table in one file would keep one core busy through all the text work above its scan; a large
    table has more splits than cores and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()  # noqa: SLF001  plans, but runs nothing
    return df.repartition(cores) if 0 < have < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "conversations") else df
