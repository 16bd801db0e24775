"""Files catalogued as they land, and the summary of every project they touch brought up to date."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import Row, StructType

from sceneframe.operators import pairing
from sceneframe.operators.ordered import with_totals
from sceneframe.operators.sizing import input_bytes
from sceneframe.streaming import sinks

#: Keys that a project's files are dealt to, so that a very large project is not one task.
PARTS = 4


class Held(StatefulProcessor):
    """Keeps the files of a key; a key that a batch touches gives out all it holds."""

    def __init__(self, schema: StructType):
        self.fields = schema

    def init(self, handle) -> None:
        self.files = handle.getListState("files", self.fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = []
        for row in rows:
            if row["_lands"]:
                fresh.append(tuple(row[f.name] for f in self.fields))
            if len(fresh) == 1000:
                self.files.appendList(fresh)
                fresh = []
        if fresh:
            self.files.appendList(fresh)
        for held in self.files.get():
            yield Row(**dict(zip(self.fields.names, held)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


def touched_files(assets: DataFrame, parts: int = PARTS) -> DataFrame:
    """A stream of assets as, batch by batch, all files of the projects it touches.

    For streams whose batches touch few projects: the catalog is keyed state, and every project
    of a batch is some calls of the state store. ``intake`` keeps its catalog as a table. Every file is dealt to one part of its project and wakes the
    others, so a batch reads the state of its own projects and of no others.
    """
    columns = [F.col(c) for c in assets.columns]
    own = F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")
    dealt = assets.select(F.col("project_id").alias("_project"), own.alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), *columns)
    lands = F.col("_own") == F.col("_part")
    # What only wakes a part is one row with nothing else in it.
    rows = dealt.select("_project", "_part", lands.alias("_lands"), *[F.when(lands, F.col(c)).alias(c) for c in assets.columns])
    return rows.groupBy("_project", "_part").transformWithState(Held(assets.schema), assets.schema, "update", "None")


#: Folders of a batch's files in the catalog: a batch reads the earlier files of its own ones only.
BUCKETS = 64

#: What the pairing of a project reads of its files.
PAIRED = ["project_id", "file_no", "name", "stem", "ext"]

#: Catalog files that a task pairs, so that its sorts stay in memory however large a batch is.
TASK_BYTES = 8 * 1024 * 1024


def intake(assets: DataFrame, folder: str) -> DataFrame:
    """Drive a stream of assets; the latest intake summary of every project.

    The catalog is a table: a batch appends its files in buckets by project, and pairs again
    the projects it touched with all the files they have by then, read from the buckets of
    these projects. Those files are shuffled once, by project, and kept so while they are
    paired, so that no step of the pairing shuffles them again. A batch that is run again
    overwrites its own files and its own summary.
    """
    spark = assets.sparkSession
    nothing = spark.createDataFrame([], assets.schema)
    summary_schema = pairing.intake_summary(nothing, nothing).schema
    stored = StructType([*assets.schema.fields]).add("_bucket", "integer")

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        placed = batch.withColumn("_bucket", F.pmod(F.xxhash64("project_id"), F.lit(BUCKETS)).cast("int"))
        own = sinks.batch_path(folder, "catalog", batch_id)
        # In order of projects, whose rows then lie together in every later shuffle and pack better.
        dealt = placed.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", "project_id", "file_no")
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(own)
        mine = session.read.schema(stored).parquet(own)
        # At most one for each bucket.
        buckets = [r["_bucket"] for r in mine.select("_bucket").distinct().collect()]
        earlier = [sinks.batch_path(folder, "catalog", b) for b in sinks.written_batches(spark, folder, "catalog") if b < batch_id]
        known = mine.select(*PAIRED, F.lit(True).alias("_lands"))
        size = input_bytes(mine)
        if earlier and buckets:
            before = reduce(DataFrame.unionByName, [session.read.schema(stored).parquet(path) for path in earlier])
            here = before.filter(F.col("_bucket").isin(buckets))
            known = known.unionByName(here.select(*PAIRED, F.lit(False).alias("_lands")))
            size += input_bytes(before) * len(buckets) // BUCKETS
        parts = max(session.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
        woken = with_totals(known.repartition(parts, "project_id"), ["project_id"], {"_woken": F.bool_or("_lands")})
        # The summary reads them more than once. They are there before it is planned, so that the plan knows how they lie.
        touched = woken.filter("_woken").select(*PAIRED).persist()
        try:
            touched.count()
            pairing.intake_summary(touched, touched).write.mode("overwrite").parquet(sinks.batch_path(folder, "summary", batch_id))
        finally:
            touched.unpersist()

    sinks.run_batches(assets, folder, each)
    rows = sinks.read_batches(spark, folder, "summary", summary_schema)
    columns = [c for c in rows.columns if c not in ("project_id", "batch")]
    latest = rows.groupBy("project_id").agg(F.max_by(F.struct(*columns), "batch").alias("s"))
    return latest.select("project_id", "s.*")
