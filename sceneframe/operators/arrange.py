"""Numbered scenes of a folder and the rename plans that move, remove or close them up.

Plans only: nothing is renamed. Every plan row is ``project_id, from_name, to_name``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneframe.functions import naming as N
from sceneframe.operators.catalog import classified
from sceneframe.operators.ordered import numbered, with_totals


def all_scenes(assets: DataFrame) -> DataFrame:
    """Every numbered scene, pictured or waiting, with its position and its project's count."""
    known = classified(assets).filter("kind IS NOT NULL")
    scenes = (
        known.withColumn("number", N.scene_number(F.col("stem"))).filter("number IS NOT NULL")
        .groupBy("project_id", F.col("stem").alias("scene_id")).agg(
            F.min("number").alias("number"),
            F.count(F.lit(1)).alias("files"),
            (F.count_if(F.col("kind") == "image") == 0).alias("waiting"),
        )
    )
    placed = numbered(scenes, ["project_id"], ["number", "waiting", "scene_id"], "position")
    return with_totals(placed, ["project_id"], {"scenes": F.count(F.lit(1))})


def _renames(scenes: DataFrame, assets: DataFrame, position: Column, count: Column) -> DataFrame:
    wanted = N.numbered_stem(position, N.number_width(count))
    files = classified(assets).filter("kind IS NOT NULL").select(
        "project_id", F.col("stem").alias("scene_id"), "name", "ext", "file_no"
    )
    plan = scenes.withColumn("wanted", wanted).select("project_id", "scene_id", "wanted")
    return (
        plan.join(files, ["project_id", "scene_id"])
        .select("project_id", "file_no", F.col("name").alias("from_name"),
                F.concat_ws(".", "wanted", "ext").alias("to_name"))
        .filter("from_name <> to_name")
    )


def renumber(scenes: DataFrame, assets: DataFrame) -> DataFrame:
    """Close the numbering up in the present order."""
    return _renames(scenes, assets, F.col("position"), F.col("scenes"))


def move_plan(scenes: DataFrame, assets: DataFrame, moves: DataFrame) -> DataFrame:
    """Renames that put one scene of each project at another position.

    ``moves``: ``project_id, from_position, to_position``; the target is clamped.
    """
    at, p = F.col("from_position"), F.col("position")
    to = F.least(F.greatest(F.col("to_position"), F.lit(1)), F.col("scenes"))
    moved = (
        F.when(p == at, to)
        .when((at < to) & (p > at) & (p <= to), p - 1)
        .when((to < at) & (p >= to) & (p < at), p + 1)
        .otherwise(p)
    )
    asked = scenes.join(moves, "project_id").filter((at >= 1) & (at <= F.col("scenes")))
    return _renames(asked, assets, moved, F.col("scenes"))


def remove_plan(scenes: DataFrame, assets: DataFrame, removals: DataFrame) -> DataFrame:
    """Renames that close the gap after each project's ``removals`` (``project_id, scene_id``)."""
    kept = scenes.join(removals, ["project_id", "scene_id"], "left_anti")
    again = numbered(kept.select("project_id", "scene_id", "position"), ["project_id"], ["position"], "place")
    counted = with_totals(again, ["project_id"], {"scenes": F.count(F.lit(1))})
    return _renames(counted, assets, F.col("place"), F.col("scenes"))


def rename_conflicts(plan: DataFrame, assets: DataFrame, movers: DataFrame) -> DataFrame:
    """Planned names held by a file that is not itself moving.

    ``movers``: ``project_id, scene_id`` of every scene that takes part.
    """
    held = classified(assets).select("project_id", F.col("name").alias("to_name"), F.col("stem").alias("scene_id"), "kind")
    staying = (
        held.join(movers.select("project_id", "scene_id").distinct(), ["project_id", "scene_id"], "left_anti")
        .select("project_id", "to_name").distinct()
    )
    return plan.join(staying, ["project_id", "to_name"], "left_semi").select("project_id", "from_name", "to_name")


def fill_waiting(scenes: DataFrame, requests: DataFrame, pictures: DataFrame) -> DataFrame:
    """Pictures placed on the next scenes that have none, from a start position on.

    ``requests``: ``project_id, start``; ``pictures``: ``project_id, picture_no``. A project
    with fewer waiting scenes than pictures is refused whole.
    """
    asked = pictures.groupBy("project_id").agg(F.count(F.lit(1)).alias("pictures"))
    waiting = scenes.join(requests, "project_id").filter("waiting AND position >= start")
    slots = numbered(waiting.select("project_id", "scene_id", "position"), ["project_id"], ["position"], "k")
    room = slots.groupBy("project_id").agg(F.count(F.lit(1)).alias("room"))
    verdict = (
        asked.join(room, "project_id", "left")
        .withColumn("refused", F.coalesce("room", F.lit(0)) < F.col("pictures"))
        .select("project_id", "refused")
    )
    ranked = numbered(pictures, ["project_id"], ["picture_no"], "k")
    return (
        ranked.join(verdict, "project_id")
        .join(slots, ["project_id", "k"], "left")
        .select("project_id", "picture_no", "refused", F.when(~F.col("refused"), F.col("scene_id")).alias("scene_id"))
    )
