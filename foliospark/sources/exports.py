"""Sinks and artifacts: builds that are skipped if their result is there, fan-outs, checksums, text exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a finished write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")  # noqa: SLF001
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)  # noqa: SLF001


def build(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The Parquet artifact at path, made only if it is missing or if force is set."""
    if force or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fan_out(df: DataFrame, path: str, sinks: dict[str, Column]) -> dict[str, int]:
    """Write the rows that meet each condition to a folder of its own; returns the counts. df is computed once."""
    held = df.persist()
    try:
        for name, condition in sinks.items():
            held.where(condition).write.mode("overwrite").parquet(f"{path}/{name}")
        counts = held.agg(*[F.count_if(c).alias(n) for n, c in sinks.items()]).first()
        return counts.asDict() if sinks else {}
    finally:
        held.unpersist()


def checksums(spark: SparkSession, glob: str) -> DataFrame:
    """(path, sha256, upper case) of binary files."""
    return spark.read.format("binaryFile").load(glob).select("path", F.upper(F.sha2("content", 256)).alias("sha256"))


def text(lines: DataFrame, path: str) -> None:
    """Write a column `line` as text, as for GraphML and Cypher exports."""
    lines.select("line").write.mode("overwrite").text(path)


def manifest(spark: SparkSession, path: str, values: dict) -> str:
    """Write values as one JSON document, indented by two; numbers that JSON lacks are refused. Returns its text."""
    import json

    text_ = json.dumps(values, ensure_ascii=False, indent=2, allow_nan=False)
    spark.createDataFrame([(text_,)], "line string").coalesce(1).write.mode("overwrite").text(path)
    return text_


def read_manifest(spark: SparkSession, path: str) -> dict:
    import json

    return json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))


def open_documents(spark: SparkSession, glob: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, sha256, text, error): one row per file; a file that is encrypted or not text has an error and no text, and stops no other. An empty file has no row."""
    raw = spark.read.format("binaryFile").load(glob)
    text_ = F.try_validate_utf8(F.col("content").cast("string")) if encoding.upper() == "UTF-8" else F.decode("content", encoding)
    head = F.hex(F.substring("content", 1, 4))
    error = F.when(head.isin("D0CF11E0", "504B0304"), "container").when(F.contains(F.hex("content"), F.lit("2F456E6372797074")), "encrypted").when(text_.isNull(), "not text")
    return raw.select("path", F.upper(F.sha2("content", 256)).alias("sha256"), error.alias("error"), F.when(error.isNull(), text_).alias("text"))
