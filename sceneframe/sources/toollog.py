"""Audio analysis logs: silences, where speech starts and ends, loudness.

Lines carry ``file_id, line_no, line``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneframe.constants import SILENCE_MIN_SECONDS
from sceneframe.functions.numbers import plain_number
from sceneframe.functions.timing import trim_bounds
from sceneframe.operators.ordered import scan


def _after(key: str) -> Column:
    return plain_number(F.regexp_extract("line", rf"{key}\s*(\S+)", 1))


def silence_spans(lines: DataFrame) -> DataFrame:
    """Each silence with its end: the next edge in the file, where that edge is an end.

    Only edge lines are ordered; the rest of a log is dropped while it is read.
    """
    start, end = _after("silence_start:"), _after("silence_end:")
    edges = lines.filter(F.col("line").contains("silence_")).select(
        "file_id", "line_no", start.alias("start_s"), F.when(start.isNull(), end).alias("_end")
    ).filter("start_s IS NOT NULL OR _end IS NOT NULL")
    paired = scan(edges, ["file_id"], ["line_no"], following={"end_s": "_end"})
    return paired.filter("start_s IS NOT NULL").select("file_id", "line_no", "start_s", "end_s")


def speech_bounds(spans: DataFrame, durations: DataFrame) -> DataFrame:
    """Where speech starts and ends in every file. ``durations``: ``file_id, duration``."""
    place = F.col("line_no")
    edges = spans.groupBy("file_id").agg(
        F.min_by(F.struct("start_s", "end_s"), place).alias("first"), F.max_by(F.struct("start_s", "end_s"), place).alias("last"))
    d = durations.join(edges, "file_id", "left")
    starts = F.coalesce(F.when(F.col("first.start_s") <= SILENCE_MIN_SECONDS, F.col("first.end_s")), F.lit(0.0))
    d = d.withColumn("speech_starts", starts)
    runs_out = F.col("last.end_s").isNull() | (F.col("last.end_s") >= F.col("duration") - SILENCE_MIN_SECONDS)
    ends = F.when((F.col("last.start_s") > F.col("speech_starts")) & runs_out, F.col("last.start_s"))
    return d.select("file_id", "duration", "speech_starts", ends.alias("speech_ends"))


#: A cut of less than half a millisecond is none.
SMALLEST_CUT_SECONDS = 0.0005


def trim_plan(bounds: DataFrame, head: Column, tail: Column) -> DataFrame:
    """What to keep of every file so that ``head`` and ``tail`` seconds stay around its speech.

    ``bounds`` is what ``speech_bounds`` gives. An edge with less silence than is to stay is
    left alone; a file whose speech runs to its end is not cut there.
    """
    kept = bounds.withColumn("_t", trim_bounds(F.col("speech_starts"), F.col("speech_ends"), F.col("duration"), head, tail))
    return kept.select(
        "file_id", F.col("_t.start").alias("start_s"), F.col("_t.end").alias("end_s"), (F.col("_t.start") > SMALLEST_CUT_SECONDS).alias("cuts_head"),
        F.coalesce(F.col("_t.end") < F.col("duration") - SMALLEST_CUT_SECONDS, F.lit(False)).alias("cuts_tail"),
    )


def loudness(lines: DataFrame) -> DataFrame:
    """First loudness and peak figures of every file's report."""
    def figure(key: str) -> Column:
        found = plain_number(F.regexp_extract("line", rf'"{key}"\s*:\s*"([^"]*)"', 1))
        # A silent file reports infinities; they are no figures.
        return F.when(~F.isnan(found) & (F.abs(found) < float("inf")), found)

    seen = lines.filter(F.col("line").contains('"input_')).select("file_id", "line_no", figure("input_i").alias("i"), figure("input_tp").alias("tp"))
    return seen.groupBy("file_id").agg(
        F.min_by("i", F.when(F.col("i").isNotNull(), F.col("line_no"))).alias("loudness"),
        F.min_by("tp", F.when(F.col("tp").isNotNull(), F.col("line_no"))).alias("peak"))
