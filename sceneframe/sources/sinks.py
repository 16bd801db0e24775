"""Writers for scene files and join lists. Folders are never overwritten."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.errors import AnalysisException

PIECES = "project_id bigint, piece int, scene_id string, text string, bucket int"


def write_pieces(pieces: DataFrame, path: str, buckets: int = 64) -> None:
    """Append numbered pieces, leaving out scene names that are already there.

    Partitioned by a bucket of the project rather than by the project, so that a million
    small projects do not make a million folders.
    """
    spark = pieces.sparkSession
    new = pieces.filter("NOT too_long").select(
        "project_id", F.col("piece").cast("int").alias("piece"), "scene_id", "text",
        F.pmod(F.hash("project_id"), F.lit(buckets)).alias("bucket"))
    try:
        taken = spark.read.schema(PIECES).parquet(path).select("bucket", "project_id", "scene_id")
        new = new.join(taken, ["bucket", "project_id", "scene_id"], "left_anti")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    new.repartition("bucket", "project_id").write.mode("append").partitionBy("bucket").parquet(path)


#: Entries of one film that lie in one container file; a longer film goes on in another.
ENTRIES = 50_000

INDEX = "film_id bigint, part bigint, bucket int, first bigint, bytes bigint, entries bigint"


def write_join_lists(lines: DataFrame, path: str, buckets: int = 64, entries: int = ENTRIES) -> DataFrame:
    """Join lists in container files, one a bucket, and an index of where each film lies.

    A film is dealt to a bucket by its id, and every further ``entries`` scenes of it to
    another, so files are as many as buckets, whatever the number of films, and a very long
    film is not one task. The index gives bucket, first byte and bytes of each part.
    """
    part = F.call_function("div", F.col("scene"), F.lit(entries))
    placed = lines.select(
        "film_id", "scene", part.alias("part"), F.pmod(F.hash("film_id", part), F.lit(buckets)).alias("bucket"),
        F.concat("line", F.lit("\n")).alias("text"))
    parts = placed.groupBy("bucket", "film_id", "part").agg(F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("entries"))
    # A bucket's parts, not its entries; in the order in which the file holds them.
    before = F.sum("bytes").over(W.partitionBy("bucket").orderBy("film_id", "part").rowsBetween(W.unboundedPreceding, -1))
    parts.select("film_id", "part", "bucket", F.coalesce(before, F.lit(0)).alias("first"), "bytes", "entries").write.mode("errorifexists").parquet(f"{path}/index")
    # A task holds whole buckets and writes each as one file.
    ordered = placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "film_id", "scene")
    ordered.select("bucket", F.col("text").substr(F.lit(1), F.length("text") - 1).alias("value")).write.mode("errorifexists").option(
        "maxRecordsPerFile", 0).partitionBy("bucket").text(f"{path}/lists")
    return lines.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


#: Bytes of a container that one read takes in.
BLOCK_BYTES = 4 * 1024 * 1024


def read_join_lists(spark: SparkSession, path: str, films: DataFrame | None = None) -> DataFrame:
    """``film_id, text`` of the asked films' join lists, cut out of the containers by the index.

    Asked parts are grouped by container and block; a task reads a block's span once and cuts
    its parts out of it. No container is held whole, and blocks without an asked part are not read.
    """
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    if films is not None:
        index = index.join(films.select("film_id").distinct(), "film_id", "left_semi")
    # Listed only: a row per container, of which no content is asked.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{path}/lists")
    held = listed.select("path", F.regexp_extract("path", r"/bucket=(\d+)/", 1).cast("int").alias("bucket"))
    block = F.call_function("div", F.col("first"), F.lit(BLOCK_BYTES))
    placed = index.join(F.broadcast(held), "bucket").select("path", block.alias("block"), "film_id", "part", "first", "bytes")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for batch in batches:
            names, spots, ids, parts, first, size = batch.columns
            firsts, stops = first.to_numpy(), first.to_numpy() + size.to_numpy()
            names, spots = names.to_pylist(), spots.to_numpy()
            edges = [0, *(i for i in range(1, len(names)) if spots[i] != spots[i - 1] or names[i] != names[i - 1]), len(names)]
            for low, high in zip(edges[:-1], edges[1:]):
                if low == high:
                    continue
                if names[low] != opened:
                    if file is not None:
                        file.close()
                    local = names[low].startswith("file:")
                    system, at = (pa_fs.LocalFileSystem(), "/" + names[low][5:].lstrip("/")) if local else pa_fs.FileSystem.from_uri(names[low])
                    opened, file = names[low], system.open_input_file(at)
                start = int(firsts[low])
                file.seek(start)
                data = file.read(int(stops[high - 1]) - start)
                texts = [data[a - start : b - start] for a, b in zip(firsts[low:high].tolist(), stops[low:high].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), parts.slice(low, high - low), pa.array(texts, pa.binary()).cast(pa.string())], ["film_id", "part", "text"])
        if file is not None:
            file.close()

    near = placed.repartition("path", "block").sortWithinPartitions("path", "block", "first")
    cut = near.mapInArrow(read, "film_id bigint, part bigint, text string")
    return cut.groupBy("film_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("text"))
