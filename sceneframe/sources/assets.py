"""Project folders as catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneframe.operators import catalog


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Listing of everything under ``root``; the content column is never asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", "modificationTime")


def read_assets(spark: SparkSession, root: str) -> DataFrame:
    """Catalog of every folder under ``root``.

    A project is a folder's path below the root, so folders of one name stay apart; files in
    the root itself belong to a project of the root's name.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    below = F.when(folder == top.toString(), top.getName()).when(
        folder.startswith(top.toString().rstrip("/") + "/"), F.substr(folder, F.lit(len(top.toString().rstrip("/")) + 2)))
    return catalog.from_paths(read_files(spark, root), F.coalesce(below, folder))


def from_inventory(inventory: DataFrame, root: str) -> DataFrame:
    """Catalog from an inventory of paths (``path, length``, as object stores write them): nothing is listed.

    The rows are read and worked on where they lie, however many there are. Paths outside
    ``root`` are left out, and so is what a listing hides: names that begin with a dot or an
    underscore, and what lies in such folders.
    """
    top = root.rstrip("/") + "/"
    below = F.substr(F.col("path"), F.lit(len(top) + 1))
    inside = inventory.filter(F.col("path").startswith(top) & ~below.rlike(r"(^|/)[._]"))
    folder = F.regexp_replace(below, "/?[^/]*$", "")
    return catalog.from_paths(inside.select("path", "length", "modificationTime"), F.when(folder == "", F.lit(top.rstrip("/").rsplit("/", 1)[-1])).otherwise(folder))


def asset_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What two inventories differ in: ``path, change, old_length, length``, a row per path.

    ``change`` is added, changed (size or time) or gone; paths that are the same have no
    row. A path listed more than once counts by its latest entry. One shuffle of each side
    by path; an inventory of the day before stands for a folder watch.
    """
    def latest(side: DataFrame) -> DataFrame:
        return side.filter("path IS NOT NULL").groupBy("path").agg(F.max(F.struct(F.col("modificationTime").alias("at"), "length")).alias("e"))

    old, new = latest(before).withColumnRenamed("e", "old"), latest(after).withColumnRenamed("e", "new")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed")
    found = old.join(new, "path", "full").withColumn("change", change)
    return found.filter("change IS NOT NULL").select("path", "change", F.col("old.length").alias("old_length"), F.col("new.length").alias("length"))
