"""Probed media against the profile every segment has to share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneframe import constants as C


def expected_video(width: int, height: int, fps: int, level: int) -> dict[str, str]:
    return {**C.PROFILE_VIDEO, "level": str(level), "width": str(width), "height": str(height), "r_frame_rate": f"{fps}/1"}


def _first(streams: Column, kind: str) -> Column:
    """First stream of a kind; an empty array gives null."""
    return F.get(F.filter(streams, lambda s: s["codec_type"] == kind), F.lit(0))


def profile_mismatch(parsed: DataFrame, width: int, height: int, fps: int, level: int) -> DataFrame:
    """Every field of every file that differs from the profile: ``film_id, field, expected, actual``.

    The profile is one row of literals, so each file is compared where it lies: no join, no
    shuffle. Absent values count as different.
    """
    picked = parsed.select(
        "film_id", "format_name", "kinds",
        F.inline(F.array(F.struct(_first(F.col("streams"), "video").alias("v"), _first(F.col("streams"), "audio").alias("a")))),
    )

    def check(field: str, expected: str, actual: Column, when: Column = F.lit(True)) -> Column:
        seen = F.coalesce(actual, F.lit("<absent>"))
        row = F.struct(F.lit(field).alias("field"), F.lit(expected).alias("expected"), seen.alias("actual"))
        return F.when(when & (seen != expected), row)

    sar = F.col("v.sample_aspect_ratio")
    checks = [
        check("container", C.PROFILE_CONTAINER, F.col("format_name")),
        check("stream_order", C.PROFILE_STREAM_ORDER, F.when(F.col("kinds") == "", "no streams").otherwise(F.col("kinds"))),
    ]
    for name, want, side in (("video", expected_video(width, height, fps, level), "v"), ("audio", C.PROFILE_AUDIO, "a")):
        there = F.col(side).isNotNull()
        checks.append(F.when(~there, F.struct(
            F.lit(f"{name}_stream").alias("field"), F.lit("present").alias("expected"), F.lit("absent").alias("actual"))))
        for field, value in want.items():
            actual = F.col(f"{side}.{field}")
            if field == "sample_aspect_ratio":
                actual = F.when(sar.isNull() | sar.isin("0:1", "0:0", "N/A", ""), "1:1").otherwise(sar)
            label = f"{name}_{field}" if field in ("codec_name", "profile", "level", "time_base") else field
            checks.append(check(label.replace("_codec_name", "_codec"), value, actual, there))
    return picked.select("film_id", F.inline(F.array_compact(F.array(*checks))))
