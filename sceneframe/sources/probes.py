"""Probe documents (JSON text per file) as typed streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneframe.functions.numbers import plain_number
from sceneframe.operators.sizing import spread

STREAM_FIELDS = [
    "index", "codec_type", "codec_name", "profile", "level", "pix_fmt", "color_range", "color_space",
    "color_primaries", "color_transfer", "width", "height", "sample_aspect_ratio", "r_frame_rate",
    "time_base", "sample_fmt", "sample_rate", "channels", "channel_layout", "duration",
    "nb_read_frames", "nb_frames",
]
# Numbers come as numbers or as strings, so all of them are read as text and cast leniently.
SCHEMA = (
    "streams array<struct<" + ", ".join(f"`{f}`: string" for f in STREAM_FIELDS) + ">>, "
    "format struct<format_name: string, duration: string>"
)


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """One document per file under ``path``: ``film_id`` is the file's name."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.regexp_extract("_metadata.file_name", r"^([^.]*)", 1).alias("film_id"), F.col("value").alias("document"))


def _number(text: Column) -> Column:
    n = plain_number(F.trim(text))
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def parse(documents: DataFrame) -> DataFrame:
    """``film_id, format_name, format_duration, kinds, streams``, or ``readable`` false."""
    raw = spread(documents, "film_id").select("film_id", F.inline(F.array(F.from_json("document", SCHEMA))))
    return raw.select(
        "film_id",
        (F.col("streams").isNotNull() | F.col("format").isNotNull()).alias("readable"),
        F.coalesce("format.format_name", F.lit("")).alias("format_name"),
        _number(F.col("format.duration")).alias("format_duration"),
        F.array_join(F.transform("streams", lambda s: F.coalesce(s["codec_type"], F.lit(""))), ", ").alias("kinds"),
        "streams",
    )


def streams(parsed: DataFrame) -> DataFrame:
    """One typed row per stream; a missing or empty pixel aspect means square pixels."""
    s = parsed.select("film_id", "format_name", "format_duration", F.posexplode("streams").alias("at", "s")).select(
        "film_id", "format_name", "format_duration", "at", "s.*"
    )
    sar = F.col("sample_aspect_ratio")
    return s.select(
        "film_id", "format_name", "format_duration", "at",
        F.coalesce(F.col("index").try_cast("bigint"), F.lit(0)).alias("index"),
        F.coalesce("codec_type", F.lit("")).alias("kind"),
        F.coalesce("codec_name", F.lit("")).alias("codec_name"),
        "profile", F.col("level").try_cast("bigint").alias("level"), "pix_fmt", "color_range", "color_space",
        "color_primaries", "color_transfer",
        F.col("width").try_cast("bigint").alias("width"), F.col("height").try_cast("bigint").alias("height"),
        F.when(sar.isNull() | sar.isin("0:1", "0:0", "N/A", ""), "1:1").otherwise(sar).alias("sample_aspect_ratio"),
        "r_frame_rate", "time_base", "sample_fmt",
        F.col("sample_rate").try_cast("bigint").alias("sample_rate"), F.col("channels").try_cast("bigint").alias("channels"),
        "channel_layout", _number(F.col("duration")).alias("duration"),
        F.col("nb_read_frames").try_cast("bigint").alias("nb_read_frames"),
        F.col("nb_frames").try_cast("bigint").alias("nb_frames"),
    )
