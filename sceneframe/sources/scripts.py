"""Script and chapter files: size asked before the content is read, UTF-8 checked, BOM dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneframe.constants import MAX_SCRIPT_BYTES
from sceneframe.functions.text import SPACES


def read_scripts(spark: SparkSession, root: str, cap: int = MAX_SCRIPT_BYTES) -> DataFrame:
    """Text files under ``root``: ``path, text, problem``.

    The size test is pushed to the file listing, so a file over the cap is never opened.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{[tT][xX][tT],[mM][dD]}").load(root)
    )
    small = files.filter(F.col("length") <= cap).select("path", "content")
    large = files.filter(F.col("length") > cap).select(
        "path", F.lit(None).cast("string").alias("text"), F.lit("too_large").alias("problem"))
    return decode(small).unionByName(large)


def decode(files: DataFrame) -> DataFrame:
    """``path, content`` as ``path, text, problem``; text that is not UTF-8 is a problem."""
    raw = F.col("content").cast("string")
    bare = F.regexp_replace(raw, f"^\\uFEFF+", "")
    text = F.regexp_replace(bare, f"^[{SPACES}]+|[{SPACES}]+$", "")
    valid = F.is_valid_utf8(raw)
    return files.select("path", F.when(valid, text).alias("text"), F.when(~valid, "not_utf8").alias("problem"))
