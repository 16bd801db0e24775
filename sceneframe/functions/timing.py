"""Column functions over seconds, frames, samples and gain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sceneframe.constants import (
    LOUDNESS_TARGET_LUFS, MAX_GAIN_DB, SAMPLE_RATE, SMALLEST_GAIN_DB, TRUE_PEAK_CEILING_DBTP,
)


def frames_for(seconds: Column, fps: Column) -> Column:
    """Whole frames that hold ``seconds``, at least one."""
    usable = (seconds > 0) & ~F.isnan(seconds) & (seconds < float("inf")) & (fps > 0)
    exact = F.ceil(seconds * fps - F.lit(1e-9))
    return F.when(usable, F.greatest(F.lit(1).cast("bigint"), exact)).otherwise(F.lit(1).cast("bigint"))


def seconds_for(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, frames / fps).otherwise(F.lit(0.0))


def samples_for_frames(frames: Column, fps: Column) -> Column:
    return F.floor((frames * SAMPLE_RATE + F.floor(fps / 2)) / fps).cast("bigint")


def samples_for_seconds(seconds: Column) -> Column:
    return F.greatest(F.floor(seconds * SAMPLE_RATE + F.lit(0.5)), F.lit(0)).cast("bigint")


def pad_seconds(narration: Column, frames: Column, fps: Column) -> Column:
    return F.greatest(seconds_for(frames, fps) - narration, F.lit(0.0))


def boundary_micros(frames: Column, fps: Column) -> Column:
    """A cumulative frame position in whole microseconds, rounded half up, in integers only."""
    doubled = frames.cast("bigint") * 2_000_000 + fps
    return _whole(doubled, fps * 2)


def _whole(a: Column, b: Column) -> Column:
    """Integer division without passing through a double."""
    return F.call_function("div", a, b)


def gain_db(loudness: Column, peak: Column) -> Column:
    """Gain towards the loudness target, held under the peak ceiling; null when inaudible."""
    wanted = F.lit(LOUDNESS_TARGET_LUFS) - loudness
    allowed = F.coalesce(F.lit(TRUE_PEAK_CEILING_DBTP) - peak, F.lit(float("inf")))
    gain = F.greatest(F.least(wanted, allowed, F.lit(MAX_GAIN_DB)), F.lit(-MAX_GAIN_DB))
    return F.when(loudness.isNotNull() & (F.abs(gain) >= SMALLEST_GAIN_DB), gain)


def trim_bounds(starts: Column, ends: Column, duration: Column, head: Column, tail: Column) -> Column:
    """``struct(start, end)`` to keep around speech; end is null when unknown."""
    start = F.greatest(starts - F.greatest(head, F.lit(0.0)), F.lit(0.0))
    padded = ends + F.greatest(tail, F.lit(0.0))
    end = F.when(ends.isNotNull(), F.least(padded, duration))
    return F.struct(start.alias("start"), end.alias("end"))
