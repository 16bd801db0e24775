"""What several operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneframe.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; its file system removes it when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(at)
    system.deleteOnExit(at)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written table.

    What follows is planned on known sizes and is never recomputed, also after an executor
    is lost. Every call takes a folder of its own, which goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark, 'settled')}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(spark: SparkSession) -> int:
    """How many parts a table is dealt into: the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Rows of a few numbers that are worth a task.
TASK_ROWS = 50_000


def as_many_tasks(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df`` with its last step in as many tasks as so many rows ask for, at most as many as it has.

    Where tasks are not put together by the session, a table of some thousand rows would
    otherwise go through hundreds of nearly empty ones at every step.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, 2, -(-rows // each)))


#: Groups that can each hold more than a thousandth of all rows: never more than a thousand.
MOST_HOT = 1000


def with_group_facts(rows: DataFrame, groups: DataFrame, key: Column, group_key: str, spread: Column, facts: list[str]) -> DataFrame:
    """``rows`` with the ``facts`` of the group that ``key`` names; null where there is none.

    ``groups`` is a written table with one row per key (a string that is no number) and its
    number of rows ``n``. The groups that hold more than a thousandth of all grouped rows are
    at most a thousand, so they are broadcast; the rows they serve, and those with a null
    key, are dealt out by ``spread`` in the join that serves the rest. No key is one task.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * MOST_HOT > F.lit(total)
    few = groups.filter(hot).select(F.col(group_key).alias("_hot_key"), F.struct(*facts).alias("_hot"))
    rest = groups.filter(~hot).select(F.col(group_key).alias("_key"), F.struct(*facts).alias("_facts"))
    keyed = rows.withColumn("_look", key).join(F.broadcast(few), F.col("_look") == F.col("_hot_key"), "left")
    keyed = keyed.withColumn("_look", F.when(F.col("_hot_key").isNull() & F.col("_look").isNotNull(), F.col("_look")).otherwise(spread.cast("string")))
    found = keyed.join(rest, F.col("_look") == F.col("_key"), "left")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(F.col(f"_hot.{f}"), F.col(f"_facts.{f}")).alias(f) for f in facts])


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def record(fields: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for (_, t), c in zip(fields, columns)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def in_pieces(batch: pa.RecordBatch, column: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece holds about ``most_bytes`` of the column, one row at least."""
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))))
    start = 0
    while start < batch.num_rows:
        stop = start + 1
        while stop < batch.num_rows and ends[stop + 1] - ends[start] <= most_bytes:
            stop += 1
        yield batch.slice(start, stop - start)
        start = stop


def fold(key: Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def _known(labels: DataFrame, label: str, modulus: int, left_out: int, id_col: str) -> DataFrame:
    return (
        labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label).cast("int").alias("_label"))
        .filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & (fold(F.col("_id"), modulus) != left_out))
        .groupBy("_id").agg(F.max("_label").alias("_label"))
    )


def class_counts(labels: DataFrame, label: str, modulus: int, left_out: int, id_col: str = "doc_id") -> tuple[int, int]:
    """How many of the rows that may be learned from carry label 0 and label 1."""
    found = {r["_label"]: r["count"] for r in _known(labels, label, modulus, left_out, id_col).groupBy("_label").count().collect()}
    return found.get(0, 0), found.get(1, 0)


def logistic(features: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted ridge logistic regression by Newton steps: (mean, scale, coefficients with the intercept last)."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack([(features - mean) / scale, np.ones(len(y))])
    weights = weights / weights.mean()
    beta = np.zeros(x.shape[1])
    damp = np.r_[np.full(x.shape[1] - 1, ridge * len(y)), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(damp), x.T @ (weights * (y - p)) - damp * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def probability(features: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, beta = model
    return 1 / (1 + np.exp(-np.clip((features - mean) / scale @ beta[:-1] + beta[-1], -30, 30)))


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, most_rows: int, most_chars: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, bytes, int]]:
    """A bounded labelled sample for fitting, as (id, text, label): at most ``most_rows`` texts of each class.

    Rows whose crc32 of the id (as text) leaves ``left_out`` modulo ``modulus`` are never
    used, nor are texts longer than ``most_chars``. The rows with the smallest hash of
    their id are taken, so the sample does not depend on how the tables are dealt. At most
    ``2 * most_rows * most_chars`` characters come to the driver. A label other than 0 or 1,
    a null id and an empty text are passed over; an id labelled twice keeps its larger label.
    """
    known = _known(labels, label, modulus, left_out, id_col)
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    fitting = F.length("_text").between(1, most_chars)
    sizes = settle(texts.filter(fitting).select("_id").join(known, "_id"))
    rank = F.xxhash64(F.lit("fit"), F.col("_id"))
    # Ids alone are ordered; only the texts of the chosen ones are fetched.
    picked = [
        row["_id"]
        for value in (0, 1)
        for row in sizes.filter(F.col("_label") == value).distinct().orderBy(rank, "_id").limit(most_rows).select("_id").collect()
    ]
    if not picked:
        return []
    chosen = docs.sparkSession.createDataFrame([(i,) for i in sorted(set(picked))], "_id bigint")
    # At most 2 * most_rows ids: a bounded table, and one text for each.
    rows = (
        texts.filter(fitting).join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text"))
        .join(F.broadcast(sizes.join(F.broadcast(chosen), "_id").distinct()), "_id").collect()
    )
    rows.sort(key=lambda r: r["_id"])
    return [(r["_id"], r["_text"].encode("utf-8", "replace"), int(r["_label"])) for r in rows]
