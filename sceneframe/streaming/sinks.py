"""Shared parts of the streaming jobs: where they write, and how a finite run is driven."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneframe.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream, under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def run_append(df: DataFrame, folder: str, keep_metrics: bool = False) -> DataFrame:
    """Drive an append-only stream over what is there now; the written rows.

    With ``keep_metrics`` the observed metrics of every batch are written beside them.
    """
    spark = df.sparkSession
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out")
    with _progress_kept(spark, 100_000 if keep_metrics else None):
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    if keep_metrics:
        told = [(p["batchId"], name, json.dumps(row.asDict())) for p in query.recentProgress for name, row in p.observedMetrics.items()]
        for batch in sorted({b for b, _, _ in told}):
            rows = spark.createDataFrame([(n, v) for b, n, v in told if b == batch], "name string, value string")
            rows.coalesce(1).write.mode("overwrite").parquet(batch_path(folder, "metrics", batch))
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@contextmanager
def _progress_kept(spark: SparkSession, batches: int | None):
    name = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(name)
    if batches:
        spark.conf.set(name, batches)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def metrics(spark: SparkSession, folder: str, name: str) -> list[dict]:
    """One metric of every batch that was driven, this run's and earlier ones'."""
    found = read_batches(spark, folder, "metrics", "name string, value string").filter(F.col("name") == name)
    return [json.loads(r["value"]) for r in found.select("value").collect()]


def run_batches(df: DataFrame, folder: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Drive a stream through ``each(batch, batch_id)``.

    A batch that is run again after a failure carries the same id, so ``each`` writes to a
    place named by the id and overwrites it.
    """
    query = (
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(each).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def batch_path(folder: str, name: str, batch_id: int) -> str:
    return f"{folder}/{name}/batch={batch_id}"


def written_batches(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Ids of the batches of one sink that are in storage, this run's and earlier ones'."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/batch=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(status.getPath().getName().split("=")[1]) for status in found or [])


def read_batches(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Everything the batches of one sink wrote, with the ``batch`` that wrote it."""
    if not written_batches(spark, folder, name):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("bigint"))
    return spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}/batch=*").withColumn(
        "batch", F.col("batch").cast("bigint"))
