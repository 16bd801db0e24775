"""Mixing sources to weights by temperature, made real as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sceneframe.llm.common import settle

#: Share of the largest possible entropy that the mixture is to reach, at least.
TARGET_EVENNESS = 0.97
#: No source is repeated more often than this, on average over its documents.
MOST_REPEATS = 2.0
#: Blocks a source is permuted in.
BLOCKS = 256
#: Exponents looked at in one pass, and passes; each narrows the interval by the former.
_TRIES, _PASSES = 16, 7


def _tokens(text: Column) -> Column:
    """Words of a text, one at least so that an empty document still has a place."""
    return F.size(F.split(F.trim(text), r"\s+")).cast("bigint")


def solve_exponent(sources: DataFrame, budget: float | None, evenness: float, most_repeats: float) -> tuple[float, float, float]:
    """The largest exponent in 0..1 whose weights are even enough, raised where repeats forbid it.

    ``sources`` has ``tokens > 0``. Weights are shares to the power of the exponent,
    normalised: 1 keeps the shares, 0 makes all equal. Evenness (entropy over its maximum)
    falls with the exponent and so does the largest number of repeats, so both limits are
    bisected; repeats win. Every pass is one aggregate that returns a number per tried
    exponent: the sources themselves never come to the driver. Returns the exponent, the
    sum of the powers, and the budget (all tokens unless given).
    """
    first = sources.agg(F.sum("tokens").alias("all"), F.count(F.lit(1)).alias("n")).first()
    total, n = first["all"], first["n"]
    if not n:
        return 1.0, 1.0, 0.0
    budget = float(total if budget is None else budget)
    share = F.col("tokens") / F.lit(float(total))
    most = math.log(n)

    def measured(tried: list[float]) -> list[tuple[float, float]]:
        """Evenness and most repeats at each exponent."""
        sums = []
        for i, e in enumerate(tried):
            power = F.pow(share, F.lit(e))
            sums += [F.sum(power).alias(f"z{i}"), F.sum(power * F.ln(power)).alias(f"l{i}"), F.max(power / F.col("tokens")).alias(f"r{i}")]
        row = sources.agg(*sums).first()
        out = []
        for i in range(len(tried)):
            z = row[f"z{i}"]
            out.append(((math.log(z) - row[f"l{i}"] / z) / most if n > 1 else 1.0, budget * row[f"r{i}"] / z))
        return out

    def bisected(holds) -> float:
        """The exponent next to where ``holds`` stops being true, coming from 0."""
        low, high = 0.0, 1.0
        for _ in range(_PASSES):
            tried = [low + (high - low) * i / _TRIES for i in range(_TRIES + 1)]
            ok = [holds(m) for m in measured(tried)]
            if all(ok):
                return high
            stop = ok.index(False)
            if stop == 0:
                return low
            low, high = tried[stop - 1], tried[stop]
        return low

    even = bisected(lambda m: m[0] >= evenness)
    # The smallest exponent that keeps to the limit; at 1 every source is repeated alike.
    spare = bisected(lambda m: m[1] > most_repeats + 1e-9) if measured([0.0])[0][1] > most_repeats else 0.0
    exponent = min(1.0, max(even, spare))
    z = sources.agg(F.sum(F.pow(share, F.lit(exponent)))).first()[0]
    return exponent, float(z), budget


def mix(docs: DataFrame, budget: float | None = None, evenness: float = TARGET_EVENNESS, most_repeats: float = MOST_REPEATS, blocks: int = BLOCKS, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per place of a document in the mixture, and what the mixture asks of its source.

    Columns: the id, ``source``, ``n_tokens`` (words, one at least), ``weight`` and
    ``source_budget`` of the source, ``epoch`` from 0, ``block``, ``block_place`` (the
    block's turn in the epoch) and ``shuffle_key`` (the document's turn in the block).

    A source with weight w gets ``budget * w`` tokens: its documents are dealt by hash into
    ``blocks`` blocks, and blocks are taken in a permuted order, one permutation an epoch,
    until the budget is met. Only the block in which the budget ends is counted through by
    document; its last document is the first that reaches the budget. Sources therefore get
    their budget to within a document.

    A null source is a source of its own; null and empty texts count one token; rows that
    repeat an id are documents of their own; other columns are ignored; an empty table gives
    an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"),
        _tokens(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_tokens"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.length(text_col)).alias("_hash"),
    ).withColumn("_block", F.pmod("_hash", F.lit(blocks)).cast("int"))
    # A source's name as a key that is never null.
    rows = settle(rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), "_source"), F.lit("-"))))
    dealt = settle(rows.groupBy("_key", "_block").agg(F.sum("_tokens").alias("tokens")))
    sources = settle(dealt.groupBy("_key").agg(F.sum("tokens").alias("tokens")))
    exponent, z, budget = solve_exponent(sources, budget, evenness, most_repeats)
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    weight = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent)) / F.lit(z)
    asked = sources.withColumn("_weight", weight).withColumn("_asked", F.greatest(F.round(weight * F.lit(budget)).cast("bigint"), F.lit(1)))
    asked = asked.withColumn("_epochs", F.ceil(F.col("_asked") / F.col("tokens")).cast("int"))

    # At most `blocks` rows a source and epoch, whatever the number of documents.
    turn = F.xxhash64(F.lit(seed + 1), "_key", "epoch", "_block")
    along = W.partitionBy("_key", "epoch").orderBy(turn, "_block")
    plan = (
        dealt.withColumnRenamed("tokens", "_in_block").join(asked, "_key")
        .select("*", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1)).alias("epoch"))
        .withColumn("_before", F.col("epoch") * F.col("tokens") + F.sum("_in_block").over(along) - F.col("_in_block"))
        .withColumn("block_place", F.row_number().over(along))
        .withColumn("_left", F.col("_asked") - F.col("_before")).filter("_left > 0")
        .select("_key", "_block", "epoch", "block_place", "_left", "_in_block", "_weight", "_asked")
    )
    plan = settle(plan)
    taken = rows.join(plan, ["_key", "_block"])
    whole = taken.filter("_left >= _in_block").drop("_left", "_in_block")
    part = taken.filter("_left < _in_block")
    inside = W.partitionBy("_key", "_block", "epoch").orderBy("_hash", "_id", "_tokens").rowsBetween(W.unboundedPreceding, -1)
    part = part.withColumn("_sum", F.coalesce(F.sum("_tokens").over(inside), F.lit(0))).filter("_sum < _left").drop("_left", "_in_block", "_sum")
    return whole.unionByName(part).select(
        F.col("_id").alias(id_col), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"),
        F.col("_asked").alias("source_budget"), "epoch", F.col("_block").alias("block"), "block_place", F.col("_hash").alias("shuffle_key"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` as often as the mixture takes each document, all columns kept.

    A document that the mixture takes twice is there twice; one it leaves out is gone.
    """
    places = mix(docs, id_col=id_col, **options)
    times = settle(places.groupBy(F.col(id_col).alias("_mixed_id")).agg(F.count(F.lit(1)).alias("_times")))
    rows = docs.groupBy(F.col(id_col).alias("_own_id")).agg(F.count(F.lit(1)).alias("_rows"))
    times = times.join(rows, times["_mixed_id"].eqNullSafe(rows["_own_id"])).select("_mixed_id", (F.col("_times") / F.col("_rows")).cast("int").alias("_times"))
    taken = docs.join(times, docs[id_col].eqNullSafe(times["_mixed_id"]))
    return taken.withColumn("_time", F.explode(F.expr("sequence(1, greatest(_times, 1))"))).select(*[F.col(f"`{c}`") for c in docs.columns])
