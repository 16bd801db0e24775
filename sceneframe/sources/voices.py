"""Fixed-width voice catalogues as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LETTERS = r"\p{IsAlphabetic}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """``table_id, line_no, line`` of voice tables; a table is one small file read in order."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("table_id"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")
    )
    return files


def locale_of(voice_id: Column) -> Column:
    """Language, script and region at the head of a voice id; its last segment is the name."""
    head = F.regexp_extract(voice_id, r"(?s)^(.*)-[^-]*$", 1)
    return F.regexp_extract(
        head, rf"^({_LETTERS}{{2,3}}(?![^-])(?:-{_LETTERS}{{4}}(?![^-]))?(?:-(?:{_LETTERS}{{2}}|[0-9]{{3}})(?![^-]))?)", 1
    )


def parse(lines: DataFrame) -> DataFrame:
    """Voices below each table's rule, or below its heading where there is no rule."""
    is_rule = F.col("line").startswith("---")
    heads = lines.groupBy("table_id").agg(
        F.min(F.when(is_rule, F.col("line_no"))).alias("rule"),
        F.min("line_no").alias("top"),
        F.min_by(F.ltrim("line").startswith("Name"), "line_no").alias("headed"),
    )
    # One row per table: a small side that adaptive execution may broadcast by itself.
    body = lines.join(heads, "table_id").filter(
        F.when(F.col("rule").isNotNull(), F.col("line_no") > F.col("rule"))
        .otherwise((F.col("line_no") > F.col("top")) | ~F.col("headed"))
    )
    cells = F.filter(F.transform(F.split("line", "  "), lambda c: F.trim(c)), lambda c: c != "")
    named = body.select("table_id", "line_no", cells.alias("cells")).filter(
        (F.size("cells") > 0) & ~F.col("cells")[0].rlike(r"\s")
    )
    return named.select(
        "table_id", "line_no", F.col("cells")[0].alias("voice_id"), locale_of(F.col("cells")[0]).alias("locale"),
        F.coalesce(F.get("cells", F.lit(1)), F.lit("")).alias("gender"),
        F.array_join(F.slice("cells", F.lit(3), F.size("cells")), " · ").alias("note"),
    )
