"""Column functions over picture and output sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sceneframe import constants as C


def _div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def macroblocks(width: Column, height: Column) -> Column:
    return _div(width + 15, 16) * _div(height + 15, 16)


def long_edge(aspect: Column, short_edge: Column) -> Column:
    return F.when(aspect == "1:1", short_edge).otherwise(_div(short_edge, 9) * 16)


def output_width(aspect: Column, short_edge: Column) -> Column:
    return F.when(aspect == "16:9", long_edge(aspect, short_edge)).otherwise(short_edge)


def output_height(aspect: Column, short_edge: Column) -> Column:
    return F.when(aspect == "9:16", long_edge(aspect, short_edge)).otherwise(short_edge)


def output_refusal(aspect: Column, short_edge: Column, fps: Column) -> Column:
    """Why an output size cannot be made, the first reason only; null when it can."""
    return (
        F.when(short_edge <= 0, "not_positive")
        .when(short_edge % 2 != 0, "odd")
        .when((aspect != "1:1") & (short_edge % 9 != 0), "not_divisible_by_9")
        .when(long_edge(aspect, short_edge) % 2 != 0, "odd_long_edge")
        .when((fps <= 0) | (fps > 120), "unusable_fps")
        .when(macroblocks(output_width(aspect, short_edge), output_height(aspect, short_edge)) > C.MAX_MACROBLOCKS, "too_large")
    )


def display_width(width: Column, sar_num: Column, sar_den: Column) -> Column:
    """Width on screen; an aspect of zero means square pixels."""
    square = (sar_num == 0) | (sar_den == 0)
    return F.when(square, width).otherwise(_div(width * sar_num, F.when(square, 1).otherwise(sar_den)))


def native_short_edge(aspect: Column, width: Column, height: Column) -> Column:
    """Largest usable short edge of one aspect that a picture fills."""
    raw = (
        F.when(aspect == "16:9", F.least(_div(width * 9, 16), height))
        .when(aspect == "9:16", F.least(width, _div(height * 9, 16)))
        .otherwise(F.least(width, height))
    )
    step = F.when(aspect == "1:1", 2).otherwise(18)
    return _div(raw, step) * step


def h264_level(width: Column, height: Column, fps: Column) -> Column:
    """Smallest level whose two limits both hold, inside the floor and the ceiling."""
    blocks = macroblocks(width, height)
    level = F.lit(C.LEVEL_CEILING)
    for number, per_frame, per_second in reversed(C.H264_LEVELS):
        level = F.when((blocks <= per_frame) & (blocks * fps <= per_second), number).otherwise(level)
    return F.greatest(level, F.lit(C.LEVEL_FLOOR)).cast("bigint")
