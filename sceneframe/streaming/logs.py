"""Streams over event logs: tailing, fanning out, progress, daily counts, first requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneframe.sources import logs
from sceneframe.streaming import sinks


def tail(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New log lines under ``path`` as events."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(path)
    return logs.parse_lines(lines)


def fan_out(events: DataFrame, folder: str, project_log: bool = True, machine_index: bool = True) -> None:
    """Redact each event and write it to the project log and to the machine index.

    Either sink may be absent. The batch is redacted once and read by both.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        clean = logs.redacted(batch).persist()
        if project_log:
            lines = clean.withColumns({"day": F.date_format("at", "yyyyMMdd"), "value": logs.json_line(clean)})
            lines.select("project", "day", "value").write.mode("overwrite").parquet(sinks.batch_path(folder, "log", batch_id))
        if machine_index:
            logs.activity_rows(clean).write.mode("overwrite").parquet(sinks.batch_path(folder, "index", batch_id))
        clean.unpersist()

    sinks.run_batches(events, folder, each)


def progress(events: DataFrame, watermark: str, quiet: str = "60 days") -> DataFrame:
    """Counts per run and kind, given out once, when the run is over. Takes ``at, run_id, kind``.

    A run is over when it has been ``quiet`` for so long: a session window of event time,
    whose state goes when the watermark has passed its end. A run that starts again later is
    a row of its own.
    """
    run = F.session_window("at", quiet)
    return (
        events.filter("run_id IS NOT NULL OR at IS NOT NULL").withWatermark("at", watermark).groupBy("run_id", "kind", run)
        .agg(F.count(F.lit(1)).alias("events"), F.max("at").alias("latest")).drop("session_window")
    )


def run_progress(events: DataFrame, folder: str, watermark: str = "1 hour", quiet: str = "60 days") -> DataFrame:
    """Drive ``progress``; the counts of the runs that are over."""
    return sinks.run_append(progress(events, watermark, quiet), folder)


def daily(events: DataFrame, watermark: str) -> DataFrame:
    """Errors and events of each scope per UTC day; a day is given out once it is over."""
    return (
        events.withWatermark("at", watermark)
        .groupBy(F.window("at", "1 day").alias("w"), "scope")
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("level") == "error").alias("errors"))
        .select(F.date_format("w.start", "yyyyMMdd").alias("day"), "scope", "events", "errors")
    )


def daily_counts(events: DataFrame, folder: str, watermark: str = "1 hour") -> DataFrame:
    """Drive ``daily`` with what arrives counted beside it (see ``daily_account``)."""
    arrived = events.observe("arrived", F.count(F.lit(1)).alias("rows"), F.count_if(F.col("at").isNull()).alias("untimed"))
    return sinks.run_append(daily(arrived, watermark), folder, keep_metrics=True)


def daily_account(spark: SparkSession, folder: str) -> dict[str, int]:
    """Where every row that arrived has gone: ``given`` out, still ``held``, ``untimed`` or ``late``.

    Rows that arrived are counted as they are read, those given out in the result, those
    held in the state of the days that are still open; what is missing from these came after
    its day was over and was dropped. The engine's own figure counts dropped groups, not rows.
    """
    arrived = sinks.metrics(spark, folder, "arrived")
    given = spark.read.parquet(f"{folder}/out").agg(F.sum("events")).first()[0] or 0
    # The state's columns are the two counts of ``daily``, both named alike; by place they are told apart.
    counts = F.col("value").cast("struct<events: bigint, errors: bigint>").getField("events")
    held = spark.read.format("statestore").load(f"{folder}/checkpoint").agg(F.sum(counts)).first()[0] or 0
    rows, untimed = sum(m["rows"] for m in arrived), sum(m["untimed"] for m in arrived)
    return {"arrived": rows, "given": given, "held": held, "untimed": untimed, "late": rows - given - held - untimed}


def first_requests(requests: DataFrame, watermark: str) -> DataFrame:
    """One row per key, however often it is asked for within the watermark. Takes ``at, key``."""
    return requests.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["key"])
