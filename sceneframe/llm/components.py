"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneframe.llm.common import as_many_tasks, settle


def connected_components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node, component`` of every linked node; ``links`` has ``a, b``, the component is the smallest id.

    Large-star and small-star steps in turn until the links are stars. Each step
    moves at most twice as many rows as there are links; a node with very many links is
    only ever a minimum and an equi-join key. Null and self links are passed over.
    """
    held = links.count()
    edges = settle(as_many_tasks(
        links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), held
    ))
    for _ in range(most_rounds):
        held = edges.count()
        if not held or _are_stars(edges, held):
            return as_many_tasks(_stars(edges), held)
        edges = settle(_small_star(_large_star(edges, held), held))
    raise RuntimeError(f"no stable components after {most_rounds} rounds")


def _are_stars(edges: DataFrame, held: int) -> bool:
    """Whether every node has one link to a smaller one or is the smallest of its own."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = as_many_tasks(ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")), held)
    return not nodes.agg(F.count_if(F.col("up") + F.col("down") > 1)).first()[0]


def _stars(edges: DataFrame) -> DataFrame:
    # Stable links are stars: each node has one link, to its component's smallest id.
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _large_star(edges: DataFrame, held: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = as_many_tasks(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), held)
    moved = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return as_many_tasks(as_many_tasks(moved, held).distinct(), held)


def _small_star(edges: DataFrame, held: int) -> DataFrame:
    least = as_many_tasks(edges.groupBy("u").agg(F.min("v").alias("m")), held)
    joined = edges.join(least, "u")
    linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = as_many_tasks(linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v"), held)
    return as_many_tasks(moved.distinct(), held)
