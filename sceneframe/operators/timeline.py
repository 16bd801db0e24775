"""Films as cumulative timelines. Segments carry ``film_id, scene, frames``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneframe.constants import AAC_FRAME_SECONDS
from sceneframe.functions.naming import safe_list_name
from sceneframe.functions.timing import boundary_micros
from sceneframe.operators.ordered import numbered, scan, with_totals


def occurrences(scenes: DataFrame, picture: str) -> DataFrame:
    """How many earlier scenes of the film show the same picture."""
    ranked = numbered(scenes, ["film_id", picture], ["scene"], "_n")
    return ranked.withColumn("occurrence", F.col("_n") - 1).drop("_n")


def timeline(segments: DataFrame, fps: Column) -> DataFrame:
    """Exact cumulative microseconds: boundaries are rounded, lengths are their differences.

    Rounding the running total rather than each length keeps the error from adding up.
    """
    run = scan(segments, ["film_id"], ["scene"], sums={"end_frames": "frames"})
    end = boundary_micros(F.col("end_frames"), fps)
    start = boundary_micros(F.col("end_frames") - F.col("frames"), fps)
    return run.withColumns({"start_us": start, "micros": end - start})


def join_list(timed: DataFrame, name: Column) -> DataFrame:
    """Ordered ``line`` of each film's join list from its timeline.

    A film with a name that is not safe in a list gets no list; ``refused_names`` says why.
    """
    unsafe = F.count_if(~F.coalesce(safe_list_name(name), F.lit(False)))
    timed = with_totals(timed, ["film_id"], {"_unsafe": unsafe}).filter("_unsafe = 0")
    text = F.concat(
        F.lit("file '"), name, F.lit("'\nduration "),
        F.call_function("div", F.col("micros"), F.lit(1_000_000)).cast("string"), F.lit("."),
        F.lpad((F.col("micros") % 1_000_000).cast("string"), 6, "0"),
    )
    return timed.select("film_id", "scene", text.alias("line"))


def refused_names(timed: DataFrame, name: Column) -> DataFrame:
    """``film_id, scene, name`` of every segment whose name cannot stand in a join list."""
    return timed.select("film_id", "scene", name.alias("name")).filter(~F.coalesce(safe_list_name(F.col("name")), F.lit(False)))


def stopped_at(segments: DataFrame, films: DataFrame) -> DataFrame:
    """First scene whose running total passes the frames a film really has.

    ``films``: ``film_id, actual``. Films that were joined whole are not listed.
    """
    run = scan(segments, ["film_id"], ["scene"], sums={"end_frames": "frames"})
    past = run.join(films, "film_id").filter("end_frames > actual")
    return past.groupBy("film_id").agg(F.min("scene").alias("scene"), F.first("actual").alias("actual"))


def film_totals(planned: DataFrame, fps: Column) -> DataFrame:
    """Per film: segments, frames, seconds, what was reused and what was newly spoken.

    Takes ``kind, reused_segment, reused_audio`` beside the segment columns.
    """
    return planned.groupBy("film_id").agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum("frames").alias("frames"),
        (F.sum("frames") / fps).alias("seconds"),
        F.count_if("reused_segment").alias("reused_segments"),
        F.count_if("reused_audio").alias("reused_audio"),
        F.count_if((F.col("kind") == "tts") & ~F.col("reused_audio")).alias("spoken"),
    )


def film_check(totals: DataFrame, probes: DataFrame, fps: Column) -> DataFrame:
    """What a joined film gets wrong against the scenes it was built from, one row per field.

    ``probes``: ``film_id, nb_frames, video_seconds, container_seconds``.
    """
    # Probes are a row per film: read from a small file of long texts, they look small enough to broadcast.
    d = totals.join(probes.hint("merge"), "film_id")
    tolerance = F.lit(1.0) / F.greatest(fps, F.lit(1))
    want = F.col("frames") / fps

    def usable(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))

    def wrong(field: str, when: Column, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(field).alias("field"), F.coalesce(value.cast("string"), F.lit("<undeclared>")).alias("actual")))

    off_video = ~usable("video_seconds") | (F.abs(F.col("video_seconds") - want) > tolerance)
    off_film = usable("container_seconds") & (F.abs(F.col("container_seconds") - want) > tolerance + AAC_FRAME_SECONDS)
    failures = F.array_compact(F.array(
        wrong("nb_frames", F.col("nb_frames").isNotNull() & (F.col("nb_frames") != F.col("frames")), F.col("nb_frames")),
        wrong("video duration", off_video, F.when(usable("video_seconds"), F.col("video_seconds"))),
        wrong("no container duration", ~usable("container_seconds"), F.lit(None)),
        wrong("duration", off_film, F.col("container_seconds")),
    ))
    return d.select("film_id", F.col("frames").alias("expected_frames"), F.inline(failures))


def cue_at(cues: DataFrame, moments: DataFrame) -> DataFrame:
    """The cue on screen at each moment: start closed, end open.

    Both sides are hashed by film and scene first, so the range test only meets the cues of
    one scene.
    """
    m = moments.select("film_id", "scene", "at")
    return m.join(cues, ["film_id", "scene"]).filter((F.col("at") >= F.col("start_s")) & (F.col("at") < F.col("end_s")))
