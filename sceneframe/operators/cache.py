"""Planning against a content-addressed cache.

Plans carry ``film_id, scene, key, frames``; the store carries ``key`` and what was measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneframe.constants import SPARE_GENERATIONS
from sceneframe.functions.naming import owned_kind
from sceneframe.operators.ordered import numbered


def cache_plan(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``reused``: whether the key is already in the store.

    One join marks hits and misses together, instead of a semi and an anti join over the plan.
    """
    held = stored.select("key").distinct().withColumn("_held", F.lit(True))
    return plan.join(held, "key", "left").withColumn("reused", F.col("_held").isNotNull()).drop("_held")


def write_store(stored: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """The store as a table bucketed by ``key``, registered as ``name``.

    Everything that joins it by the key then moves the other side only: a plan of thousands
    of scenes meets a store of billions of artifacts where these lie.
    """
    stored.write.bucketBy(buckets, "key").sortBy("key").option("path", path).format("parquet").mode("errorifexists").saveAsTable(name)
    return stored.sparkSession.table(name)


def open_store(spark: SparkSession, name: str, path: str, buckets: int, schema: str) -> DataFrame:
    """Register a store that another session has written."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def work_list(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """One job per missing key, however many scenes want it."""
    wanted = plan.groupBy("key").agg(
        F.count(F.lit(1)).alias("wanted_by"), F.min(F.struct("film_id", "scene")).alias("first")
    )
    return wanted.join(stored.select("key"), "key", "left_anti").select(
        "key", "wanted_by", F.col("first.film_id").alias("film_id"), F.col("first.scene").alias("scene")
    )


def distinct_work(plan: DataFrame, compute) -> DataFrame:
    """Run ``compute`` once per key and give its columns back to every scene that shares it."""
    done = compute(plan.select("key", "frames").dropDuplicates(["key"]))
    return plan.join(done.drop("frames"), "key", "left")


def reuse_check(plan: DataFrame, stored: DataFrame, fps: Column) -> DataFrame:
    """Whether each stored artifact is the planned length: frames if declared, else within a frame.

    A key stored more than once counts once, by the smallest of its measurements.
    """
    measured = stored.groupBy("key").agg(F.min(F.struct("nb_frames", F.col("seconds").alias("stored_seconds"))).alias("m"))
    found = plan.join(measured.select("key", "m.*"), "key")
    by_frames = F.col("nb_frames") == F.col("frames")
    by_seconds = F.abs(F.col("stored_seconds") - F.col("frames") / fps) <= F.lit(1.0) / fps
    fits = F.when(F.col("nb_frames").isNotNull(), by_frames).otherwise(F.coalesce(by_seconds, F.lit(False)))
    return found.withColumn("fits", fits).select("film_id", "scene", "key", "fits")


def speech_needed(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """Lines still to be spoken, per provider."""
    wanted = plan.filter("kind = 'tts'").join(stored.select("key"), "key", "left_anti")
    return wanted.groupBy("provider").agg(F.count(F.lit(1)).alias("scenes"))


def speech_ready(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """Whether each scene can be heard now: not spoken at all, or spoken and in the store."""
    return cache_plan(plan, stored).select(
        "film_id", "scene", ((F.col("kind") != "tts") | F.col("reused")).alias("ready"))


def retention(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored files of one cache that are not in use, and which of them a sweep removes.

    ``stored``: ``film_id, key, name, bytes, modified_at``; ``live``: ``film_id, key``. A film
    keeps spare files for twice as many as it uses, newest first by ``age``. What an
    interrupted write left is always removed and never a spare; a stranger's file never is.
    """
    in_use = live.select("film_id", "key").distinct()
    kept = in_use.groupBy("film_id").agg((F.count(F.lit(1)) * SPARE_GENERATIONS).alias("spare"))
    marked = stored.select("film_id", "key", "name", "bytes", "modified_at", owned_kind(F.col("name")).alias("owner"))
    dead = marked.join(in_use, ["film_id", "key"], "left_anti")
    aged = numbered(dead, ["film_id", "owner"], [-F.unix_micros("modified_at"), "key", "name"], "n")
    ours = F.col("owner").isNotNull() & (F.col("owner") != "partial")
    return (
        aged.join(kept, "film_id", "left")
        .withColumn("age", F.when(ours, F.col("n")))
        .withColumn("swept", F.when(ours, F.col("n") > F.coalesce("spare", F.lit(0))).otherwise(F.col("owner").isNotNull()))
        .select("film_id", "key", "name", "owner", "bytes", "age", "swept")
    )


def retention_bytes(swept: DataFrame) -> DataFrame:
    return swept.filter("swept").groupBy("film_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")
    )


def newest(files: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The newest ``keep`` files of each group and the rest, told apart by ``kept``."""
    aged = numbered(files, keys, [-F.unix_micros("modified_at"), "name"], "age")
    return aged.withColumn("kept", F.col("age") <= keep)


def _field(value: Column) -> Column:
    """A value behind its length, so that no two lists of fields read the same."""
    text = value.cast("string")
    size = F.length(text).cast("string")
    # A missing value is marked, so it is told apart from an empty one.
    return F.coalesce(F.concat(F.lpad(size, F.greatest(F.length(size), F.lit(8)), F.lit("0")), text), F.lit("null"))


def content_key(*values: Column) -> Column:
    """The whole digest: a store of billions holds no two contents under one key."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def settings_field(settings: Column) -> Column:
    """A settings map as one field, its pairs sorted first."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(settings)), lambda e: F.concat(_field(e["key"]), _field(e["value"]))), "")


def segment_keys(scenes: DataFrame) -> DataFrame:
    """Add ``key`` over everything that changes a rendered segment."""
    names = ["content", "audio_key", "frames", "motion", "geometry", "encoder", "captions"]
    return scenes.withColumn("key", content_key(*[F.col(n) for n in names]))
