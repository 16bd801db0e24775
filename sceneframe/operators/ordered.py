"""Ordered computation inside a key, safe when one key holds a large share of all rows.

Every function takes a *total* ascending order and only builds a plan: no job runs before the
caller asks for rows. The rows are one window over one shuffle by key, whatever the size of the
input: it spills what memory does not hold, and what follows by the same key is not shuffled
again. Where a session sets ``sceneframe.skew.taskBytes``, an input whose sources are larger is
range-partitioned by key *and* order, so that a hot key spans many slices; the edge rows of a
slice then travel to the slices that need them, and a window per slice does the rest. That
costs three shuffles, and every later step by key one more. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sceneframe.operators.sizing import one_task_holds

_SLICE = "_slice"


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    number: str | None = None,
    sums: Mapping[str, str | Column] | None = None,
    maxes: Mapping[str, str | Column] | None = None,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ordered columns per key.

    ``number`` is the row number from 1; ``sums`` and ``maxes`` are running, this row
    included; ``previous`` and ``following`` are the neighbouring row's column.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    previous, following = dict(previous or {}), dict(following or {})
    way = _windowed if one_task_holds(df) else _sliced
    return way(df, list(keys), list(order), number, sums, maxes, previous, following)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "n") -> DataFrame:
    """Row number from 1 inside each key."""
    return scan(df, keys, order, number=name)


def with_totals(df: DataFrame, keys: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Add whole-key aggregates to every row.

    Totals are combined map-side and joined back, which adaptive execution splits where a key
    is hot, where the session cuts hot keys; elsewhere they are a window, which reuses the
    partitioning of the caller's other windows.
    """
    if not one_task_holds(df):
        sums = df.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(*[c.alias(n) for n, c in totals.items()])
        # A null key is a key like any other, as it is for a window.
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys])
        return df.join(sums, same, "left").select(*df.columns, *totals)
    spec = W.partitionBy(*keys)
    return df.select("*", *[c.over(spec).alias(n) for n, c in totals.items()])


def _windowed(df, keys, order, number, sums, maxes, previous, following) -> DataFrame:
    spec = W.partitionBy(*keys).orderBy(*[_col(c) for c in order])
    running = spec.rowsBetween(W.unboundedPreceding, W.currentRow)
    added = [F.sum(_col(c)).over(running).alias(n) for n, c in sums.items()]
    added += [F.max(_col(c)).over(running).alias(n) for n, c in maxes.items()]
    added += [F.lag(_col(c)).over(spec).alias(n) for n, c in previous.items()]
    added += [F.lead(_col(c)).over(spec).alias(n) for n, c in following.items()]
    if number:
        added.append(F.row_number().over(spec).cast("bigint").alias(number))
    return df.select("*", *added)


def _sliced(df, keys, order, number, sums, maxes, previous, following) -> DataFrame:
    """The same columns with no key in one task, as one chain of plain shuffles.

    The last row of a slice is copied to every later slice with the totals of its key, the
    first row to every earlier one; a copy keeps only keys, order and figures. Sorted among
    the slice's own rows the copies stand where the neighbour slices' rows would, so one
    window over (slice, key) gives the whole answer. That is at most slices squared small rows
    on top of the input. The result does not depend on where the slices were cut.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = {f"_o{i}": _col(c) for i, c in enumerate(order)}
    added = {f"_s_{n}": _col(c) for n, c in sums.items()} | {f"_m_{n}": _col(c) for n, c in maxes.items()}
    placed = (
        df.select("*", *[c.alias(n) for n, c in (places | added).items()])
        .repartitionByRange(slices, *keys, *places)
        .withColumn(_SLICE, F.spark_partition_id())
    )
    inside = W.partitionBy(_SLICE).orderBy(*keys, *places)
    ends = placed.select(
        "*", F.lag(F.lit(1)).over(inside).isNull().alias("_first"), F.lead(F.lit(1)).over(inside).isNull().alias("_last")
    )
    running = W.partitionBy(_SLICE, *keys).orderBy(*places).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = [F.sum(f"_s_{n}").over(running).alias(f"_t_s_{n}") for n in sums]
    local += [F.max(f"_m_{n}").over(running).alias(f"_t_m_{n}") for n in maxes]
    edged = ends.select("*", F.count(F.lit(1)).over(running).alias("_rows"), *local)

    here, none = F.col(_SLICE), F.array().cast("array<int>")
    later = F.when(F.col("_last") & (here < slices - 1), F.sequence(here + 1, F.lit(slices - 1))).otherwise(none)
    earlier = F.when(F.col("_first") & (here > 0), F.sequence(F.lit(0), here - 1)).otherwise(none)
    goals = [F.array(here)]
    if number or sums or maxes or previous:
        goals.append(later)
    if following:
        goals.append(earlier)
    sent = edged.withColumn("_to", F.explode(F.concat(*goals)))

    copy = F.col("_to") != here
    travels = {*keys, *previous.values(), *following.values()}
    figures = [F.when(copy, F.col("_rows")).otherwise(1).alias("_rows")]
    # The sum of a key's rows stands in for them, in the type that a sum has.
    kinds = {f.name: f.dataType for f in edged.schema if f.name.startswith("_t_")}
    figures += [F.when(copy, F.col(f"_t{n}")).otherwise(F.col(n).cast(kinds[f"_t{n}"])).alias(n) for n in added]
    thin = sent.select(
        *[F.col(c) if c in travels else F.when(~copy, F.col(c)).alias(c) for c in df.columns],
        *places, *figures, "_to", copy.alias("_copy"),
    )
    spec = W.partitionBy("_to", *keys).orderBy(*places)
    whole = spec.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = [F.sum(f"_s_{n}").over(whole).cast(kinds[f"_t_s_{n}"]).alias(n) for n in sums]
    out += [F.max(f"_m_{n}").over(whole).alias(n) for n in maxes]
    out += [F.lag(_col(c)).over(spec).alias(n) for n, c in previous.items()]
    out += [F.lead(_col(c)).over(spec).alias(n) for n, c in following.items()]
    if number:
        out.append(F.sum("_rows").over(whole).alias(number))
    done = thin.select(*df.columns, "_copy", *out).filter(~F.col("_copy"))
    return done.drop("_copy")
