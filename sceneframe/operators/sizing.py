"""Checks made before a plan is chosen: how big an input is, by the statistics of its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame

# What one task may be given of one key. A window sorts and spills more than memory holds, so
# there is no limit unless the session sets one, for data with keys too long for one task.
TASK_BYTES = ("sceneframe.skew.taskBytes", 2**63 - 1)


def setting(df: DataFrame, entry: tuple[str, int]) -> int:
    name, default = entry
    return int(df.sparkSession.conf.get(name, str(default)))


def input_bytes(df: DataFrame) -> int:
    """Bytes of everything the plan reads, from the statistics of its leaves.

    Read off the analyzed plan: the sizes of the sources do not wait for the optimizer.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        total += int(str(leaves.apply(i).stats().sizeInBytes()))
    return total


def one_task_holds(df: DataFrame) -> bool:
    """Whether all sources together are within what a task may be given of one key, by their statistics; runs no job."""
    return input_bytes(df) <= setting(df, TASK_BYTES)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Share a small input out among all cores before work that is heavy per byte.

    One small file is one task however many cores there are. Moving it costs little; an input
    that already fills the cores is left where it is, with no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if input_bytes(df) > cores * 16 * 1024 * 1024:
        return df
    return df.repartition(cores, *(keys or df.columns[:1]))
