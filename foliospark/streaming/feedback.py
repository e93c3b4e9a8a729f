"""Feedback as a stream: every micro-batch is deduplicated, ordered and folded into the table of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.routing import ALPHA, feedback_fold
from foliospark.scratch import shared_dir

SCHEMA = "event_id long, ts timestamp, state string, action string, reward double"


def read(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Feedback events from Parquet files that arrive in a folder; an event more than a day late or seen before is dropped."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])


def merge(values: DataFrame, batch: DataFrame) -> DataFrame:
    """values (state, action, q, n) after the batch's events: old values fade by the number of steps, the fold of the batch is added."""
    moved = feedback_fold(batch.withColumnRenamed("ts", "ord")).withColumnRenamed("n", "m").withColumnRenamed("q", "dq")
    out = values.join(moved, ["state", "action"], "full")
    fade = F.pow(F.lit(1 - ALPHA), F.coalesce("m", F.lit(0)))
    return out.select("state", "action", F.round(F.coalesce("q", F.lit(0.0)) * fade + F.coalesce("dq", F.lit(0.0)), 8).alias("q"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))


def run(spark: SparkSession, folder: str, table_dir: str, checkpoint: str | None = None) -> DataFrame:
    """Consume what the folder holds, one micro-batch a file, and return the table of values.

    Every batch writes the table anew under its own number and the last complete one counts, so a batch
    that is run again after a failure reads the same predecessor and leaves the same table.
    """
    empty = spark.createDataFrame([], "state string, action string, q double, n long")

    def path(batch_id: int) -> str:
        return f"{table_dir}/v{batch_id:09d}"

    def step(batch: DataFrame, batch_id: int) -> None:
        old = spark.read.parquet(path(batch_id - 1)) if batch_id > 0 else empty
        merge(old, batch).write.mode("overwrite").parquet(path(batch_id))

    last = {"id": -1}

    def each(batch: DataFrame, batch_id: int) -> None:
        step(batch, batch_id)
        last["id"] = batch_id

    query = read(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/feedback-stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path(last["id"])) if last["id"] >= 0 else empty
