"""Scene manifests: CSV rows to drafts.

Drafts carry ``project_id, position, id, image, text, audio, duration, voice,
zoom_direction, zoom_anchor, caption``; an unreadable duration is a problem, not a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sceneframe.constants import MANIFEST_COLUMNS
from sceneframe.functions import naming as N
from sceneframe.functions.numbers import plain_number
from sceneframe.functions.settle import settle
from sceneframe.functions.text import clean_cell

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in MANIFEST_COLUMNS])
CSV_OPTIONS = {
    "quote": '"', "escape": '"', "mode": "FAILFAST",
    "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
}


# One cell: quoted, with doubled quotes inside, or everything up to the next comma.
_CELL = r'(?:"(?:[^"]++|"")*+"?[^,\r\n]*+|[^",\r\n][^,\r\n]*+|)'


def _cells(record: Column) -> Column:
    """The cells of one record, quotes taken off."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_CELL})"), 1)
    quoted = r'(?s)^"((?:[^"]++|"")*+)"?(.*)$'
    return F.transform(raw, lambda c: F.when(
        c.startswith('"'),
        F.concat(F.replace(F.regexp_extract(c, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, quoted, 2)),
    ).otherwise(c))


def split_manifests(files: DataFrame) -> DataFrame:
    """Each manifest by its own header: ``project_id, header, records, refused``.

    ``files``: ``project_id, content``, one manifest a row; null content is an empty file,
    which has no rows and is not refused. ``refused`` says why nothing of a manifest can be
    used: a column that means nothing here (a typo), one named twice, none for the image, or
    a row with more or fewer cells than the header.
    """
    text = F.regexp_replace(F.coalesce("content", F.lit("")), "^\\uFEFF", "")
    records = F.filter(F.regexp_extract_all(text, F.lit(f"({_CELL}(?:,{_CELL})*+)"), 1), lambda r: r != "")
    split = settle(files, {"every": F.transform(records, _cells)})
    found = settle(split.select("project_id", "every"), {
        "header": F.transform(F.coalesce(F.get("every", F.lit(0)), F.array().cast("array<string>")), lambda h: F.regexp_replace(h, r"^\s+|\s+$", "")),
        "records": F.slice("every", F.lit(2), F.greatest(F.size("every"), F.lit(1))),
    }).drop("every")
    unknown = F.array_except("header", F.array(*[F.lit(c) for c in MANIFEST_COLUMNS]))
    ragged = F.filter(F.transform("records", lambda r, i: F.when(F.size(r) != F.size("header"), i + 1)), lambda n: n.isNotNull())
    refused = (
        F.when(F.size("header") == 0, None)
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown columns: "), F.array_join(unknown, ", ")))
        .when(F.size(F.array_distinct("header")) < F.size("header"), F.lit("a column is named twice"))
        .when(~F.array_contains("header", "image"), F.lit("no image column"))
        .when(F.size(ragged) > 0, F.concat(F.lit("cells missing or left over in row "), ragged[0].cast("string")))
    )
    return found.withColumn("refused", refused)


def manifest_rows(split: DataFrame) -> DataFrame:
    """Rows of the manifests that are not refused, numbered as they stand in their file."""
    rows = split.filter("refused IS NULL").select("project_id", "header", F.posexplode("records").alias("at", "cells"))
    named = [F.get("cells", (F.array_position("header", c) - 1).cast("int")).alias(c) for c in MANIFEST_COLUMNS]
    return rows.select("project_id", (F.col("at") + 1).cast("bigint").alias("position"), *named)


def refused_manifests(split: DataFrame) -> DataFrame:
    """One row per manifest that nothing can be read from: ``project_id, refused``."""
    return split.filter("refused IS NOT NULL").select("project_id", "refused")


def read_manifests(spark: SparkSession, path: str, project_id: Column | None = None) -> DataFrame:
    """Manifests under ``path``, each one project, ready for ``manifest_rows`` and ``refused_manifests``.

    A file is one row, because quoted cells may hold line ends; a bad one hides no other.
    ``project_id`` may use ``file``, the path of the manifest, which is also its default.
    """
    files = spark.read.schema("value string").text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    named = files.select((project_id if project_id is not None else F.col("file")).alias("project_id"), "content")
    return split_manifests(named)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Manifest rows held as CSV text in ``line`` beside their ``project_id`` and ``position``."""
    parsed = F.from_csv("line", F.lit(SCHEMA.simpleString()[7:-1].replace(":", " ")), CSV_OPTIONS)
    return lines.select("project_id", "position", F.inline(F.array(parsed)))


def drafts(rows: DataFrame) -> DataFrame:
    """Manifest rows as drafts, cells trimmed, blanks null, the id taken from the picture."""
    cleaned = settle(rows.select("project_id", "position", *MANIFEST_COLUMNS),
                     {c: clean_cell(F.col(c)) for c in MANIFEST_COLUMNS})
    identifier = F.coalesce(N.manifest_stem(F.col("image")), F.concat(F.lit("row "), F.col("position").cast("string")))
    return cleaned.select(
        "project_id", "position", identifier.alias("id"), "image", "text", F.col("audio_file").alias("audio"),
        plain_number(F.col("duration")).alias("duration"),
        F.when(plain_number(F.col("duration")).isNull(), F.col("duration")).alias("unread_duration"),
        "voice", "zoom_direction", "zoom_anchor", "caption",
    )
