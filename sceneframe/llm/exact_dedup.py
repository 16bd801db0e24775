"""Exact duplicates, combined in three stages that each compare full content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sceneframe.llm.common import settle

#: Groups of one text that are merged apart from each other before they meet.
SALTS = 16


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical; null counts as empty. The largest id of equal texts stays.

    1. Each task folds its own equal texts (the map side of the first aggregate).
    2. Folds meet by (digest, salt, text): a text that fills a third of the table is dealt to
       ``salts`` groups.
    3. The at most ``salts`` winners of a text meet by (digest, text).

    The text is a grouping key at every stage, so texts that share a digest stay apart;
    where that happens the documents find their winner by the text as well.

    Null ids lose to any other id and are kept only if no row of the group has an id. Rows
    repeated with one id are all marked kept when that id stays. Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    ).withColumn("_digest", digest(F.col("_text")))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
    merged = salted.groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    winners = (
        merged.repartition("_digest").groupBy("_digest", "_text")
        .agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
        .withColumn("_variants", F.count(F.lit(1)).over(W.partitionBy("_digest")))
        .select("_digest", "_keep", "_n", F.when(F.col("_variants") > 1, F.col("_text")).alias("_apart"))
    )
    winners = settle(winners)
    single = winners.filter(F.col("_apart").isNull()).drop("_apart")
    out = rows.select("_id", "_digest", F.sha2(F.col("_text").cast("binary"), 256).alias("_sha")).join(single, "_digest")
    apart = winners.filter(F.col("_apart").isNotNull())
    # Two contents under one digest: only then do texts travel once more.
    if not apart.isEmpty():
        by_text = rows.join(apart.withColumnRenamed("_apart", "_text"), ["_digest", "_text"])
        out = out.unionByName(by_text.select("_digest", "_id", F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"), "_keep", "_n"))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns kept.

    Of rows that repeat both the id and the text one stays.
    """
    def row_key(key: Column, sha: Column) -> Column:
        return F.concat(F.coalesce(key.cast("string"), F.lit("-")), F.lit(" "), sha)

    found = exact_dedup(docs, id_col, text_col).filter("kept")
    kept = settle(found.groupBy(row_key(F.col(id_col), F.col("text_sha256")).alias("_row")).agg(F.count(F.lit(1)).alias("_rows")))
    sha = sha256_hex(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    once = docs.withColumn("_row", row_key(F.col(id_col), sha)).join(kept.select("_row"), "_row", "left_semi")
    if not kept.filter("_rows > 1").isEmpty():
        once = once.dropDuplicates(["_row"])
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
