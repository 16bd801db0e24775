"""Chapters imported into projects: read under a cap, planned whole, appended under a batch id."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneframe import constants as C
from sceneframe.functions import naming as N
from sceneframe.functions import text as T
from sceneframe.operators.ordered import numbered, with_totals

IMPORTED = "project_id bigint, piece int, scene_id string, text string"


def read_chapters(spark: SparkSession, root: str, cap: int = C.MAX_CHAPTER_BYTES) -> DataFrame:
    """Text files under ``root`` as ``path, chapter, problem``; of a file over the cap only the size is asked."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{[tT][xX][tT],[mM][dD]}").load(root)
    )
    large = files.filter(F.col("length") > cap).select("path", F.lit(None).cast("string").alias("chapter"), F.lit("too_large").alias("problem"))
    return decode_chapters(files.filter(F.col("length") <= cap)).unionByName(large)


def decode_chapters(files: DataFrame) -> DataFrame:
    """``path, content`` as ``path, chapter, problem``: UTF-8 or a problem, byte order marks dropped, nothing else."""
    raw = F.col("content").cast("string")
    valid = F.is_valid_utf8(raw)
    return files.select(
        "path", F.when(valid, F.regexp_replace(raw, "^\\uFEFF+", "")).alias("chapter"), F.when(~valid, "not_utf8").alias("problem"))


def import_plan(pieces: DataFrame, taken: DataFrame, manifests: DataFrame, max_bytes: int = C.MAX_SCRIPT_BYTES) -> DataFrame:
    """What importing pieces would write: ``project_id, piece, scene_id, text, problem``.

    An import is whole or not at all. A project led by a manifest, one without a word, or one
    with a piece too long to speak has a single row that says so, with the first such piece;
    any other has a row per piece with the scene name it takes after those in ``taken``
    (``project_id, next_scene``). Blank pieces are passed over. ``manifests``: ``project_id``.
    """
    lines = pieces.select("project_id", F.col("piece").cast("int").alias("piece"), T.collapse(F.col("text")).alias("text"))
    kept = F.coalesce(F.col("text") != "", F.lit(False))
    # Pieces with words first, so that their numbers have no holes.
    ranked = numbered(lines.withColumn("_blank", ~kept), ["project_id"], ["_blank", "piece"], "n")
    too_long = kept & (F.octet_length("text") > max_bytes)
    counted = with_totals(ranked, ["project_id"], {"count": F.count_if(kept), "long": F.min(F.when(too_long, F.col("n")))})
    led = manifests.select("project_id").distinct().withColumn("led", F.lit(True))
    placed = counted.join(led, "project_id", "left").join(taken.select("project_id", "next_scene"), "project_id", "left")
    placed = placed.withColumn("start", F.coalesce("next_scene", F.lit(1)))
    stem = N.numbered_stem(F.col("start") + F.col("n") - 1, N.number_width(F.col("start") + F.col("count") - 1))
    problem = (
        F.when(F.col("led"), "manifest_project").when(F.col("count") == 0, "empty").when(F.col("long").isNotNull(), "too_long")
    )
    told = placed.withColumn("problem", problem)
    first = F.col("n") == F.coalesce(F.when(F.col("problem") == "too_long", F.col("long")), F.lit(1))
    fine = F.col("problem").isNull()
    return told.filter(F.when(fine, F.col("n") <= F.col("count")).otherwise(first)).select(
        "project_id",
        F.when(fine | (F.col("problem") == "too_long"), F.col("piece")).alias("piece"),
        F.when(fine, stem).alias("scene_id"), F.when(fine, F.col("text")).alias("text"), "problem",
    )


class ImportStore:
    """Imported scenes in a folder, appended one batch after the other.

    A batch is written beside the others and counts once its number in the folder's log has
    been taken. Only one writer can take a number: another that planned on the same state
    plans again on what is there by then. A batch whose id is in the log is done, so running
    it again after a failure, or from a second place, neither repeats nor skips a scene.
    """

    PATIENCE_SECONDS = 60

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def log(self) -> list[str]:
        """Ids of the batches that count, in their order; a file of a few bytes each.

        A place that was taken but not yet signed belongs to a writer at work. If that
        writer is gone, going on could give a number twice, so after a while this fails.
        """
        for _ in range(self.PATIENCE_SECONDS):
            found = sorted(self._fs.globStatus(self._path(f"{self.path}/log/*")) or [], key=lambda s: str(s.getPath().getName()))
            unsigned = [str(s.getPath()) for s in found if s.getLen() == 0]
            if not unsigned:
                break
            time.sleep(1)
        else:
            raise RuntimeError(f"taken and never signed, remove it to go on: {unsigned[0]}")
        if not found:
            return []
        rows = self.spark.read.text([str(s.getPath()) for s in found]).select("value", F.col("_metadata.file_name").alias("name"))
        return [r["value"] for r in sorted(rows.collect(), key=lambda r: r["name"])]

    def _take(self, number: int, batch_id: str) -> bool:
        """Take place ``number`` of the log unless it is taken: only one writer can create a file."""
        try:
            out = self._fs.create(self._path(f"{self.path}/log/{number:012d}"), False)
        except Exception as error:  # noqa: BLE001 - the JVM's, told apart below
            if "AlreadyExists" in str(error):
                return False
            raise
        out.write(bytearray(batch_id.encode()))
        out.close()
        return True

    def scenes(self) -> DataFrame:
        """Everything that counts."""
        batches = self.log()
        if not batches:
            return self.spark.createDataFrame([], IMPORTED)
        # Named one by one: what an interrupted batch left behind is in none of them.
        return self.spark.read.schema(IMPORTED).parquet(*[f"{self.path}/data/{b}" for b in batches])

    def append(self, batch_id: str, pieces: DataFrame, taken: DataFrame, manifests: DataFrame, max_bytes: int = C.MAX_SCRIPT_BYTES) -> DataFrame:
        """Import pieces under ``batch_id``; the refusals (``project_id, piece, problem``).

        ``taken`` is what the projects' own files take; scenes imported before count too.
        """
        if not batch_id or set(batch_id) - set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._-"):
            raise ValueError(f"not a batch id: {batch_id!r}")
        while batch_id not in (log := self.log()):
            before = self.scenes().groupBy("project_id").agg((F.max(F.col("scene_id").cast("bigint")) + 1).alias("next_scene"))
            both = taken.select("project_id", F.col("next_scene").cast("bigint").alias("next_scene")).unionByName(before)
            plan = import_plan(pieces, both.groupBy("project_id").agg(F.max("next_scene").alias("next_scene")), manifests, max_bytes)
            target = f"{self.path}/data/{batch_id}"
            plan.write.mode("overwrite").parquet(f"{target}.plan")
            planned = self.spark.read.schema(f"{IMPORTED}, problem string").parquet(f"{target}.plan")
            planned.filter("problem IS NULL").drop("problem").write.mode("overwrite").parquet(target)
            self._take(len(log), batch_id)
        return self.spark.read.schema(f"{IMPORTED}, problem string").parquet(f"{self.path}/data/{batch_id}.plan").filter(
            "problem IS NOT NULL").select("project_id", "piece", "problem")
