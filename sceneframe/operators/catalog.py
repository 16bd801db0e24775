"""Assets of a project folder: classified, grouped into scene slots, checked for gaps.

Assets carry ``project_id, file_no, name, stem, ext, bytes, modified_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneframe.functions import naming as N
from sceneframe.functions.settle import settle
from sceneframe.operators.ordered import numbered, with_totals

SLOTS = {"image": "image", "audio": "narration", "text": "text"}


def from_paths(files: DataFrame, project: Column | None = None) -> DataFrame:
    """Catalog rows from ``path, length, modificationTime``: no dotfiles, no bare names.

    ``project`` tells projects apart; by itself it is the name of a file's folder, which
    suits inventories of one root.
    """
    named = files.select(
        (_project(F.col("path")) if project is None else project).alias("project"),
        F.substring_index("path", "/", -1).alias("name"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified_at"),
    )
    kept = named.filter(~F.col("name").startswith(".") & N.extension(F.col("name")).isNotNull())
    return classified(kept.withColumns({"stem": N.stem(F.col("name")), "ext": N.extension(F.col("name"))}))


def _project(path: Column) -> Column:
    """Name of the folder a file lies in."""
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def interrupted_renames(files: DataFrame) -> DataFrame:
    """Files an unfinished renumbering left behind, counted per project."""
    left = files.filter(N.file_name(F.col("path")).rlike(r"^\.(arranging|removing)-"))
    return left.groupBy(_project(F.col("path")).alias("project")).agg(
        F.count(F.lit(1)).alias("files")
    )


def classified(assets: DataFrame) -> DataFrame:
    """Add ``kind`` (image, audio, text or null) and the case-folded stem."""
    return assets.withColumns({"kind": N.asset_kind(F.col("ext")), "folded": F.lower("stem")})


def scene_slots(assets: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """One row per scene: how many files compete for each slot and the first by name.

    One map-side combined aggregate of fixed-size state, however many files share a stem.
    ``keep_unknown`` keeps stems of which no file is a still, a recording or a text.
    """
    columns = [F.min_by("stem", F.struct("name", "stem")).alias("scene_id")]
    for kind in SLOTS:
        mine = F.col("kind") == kind
        columns.append(F.count_if(mine).alias(f"{kind}s"))
        columns.append(F.min(F.when(mine, F.col("name"))).alias(kind))
    files = classified(assets)
    if not keep_unknown:
        files = files.filter("kind IS NOT NULL")
    return files.groupBy("project_id", "folded").agg(*columns)


def ambiguous_scenes(assets: DataFrame) -> DataFrame:
    """Every file of a slot that more than one file competes for, one row per file."""
    known = classified(assets).filter("kind IS NOT NULL").select("project_id", "folded", "kind", "name")
    counted = with_totals(known, ["project_id", "folded", "kind"], {"candidates": F.count(F.lit(1))})
    slot = F.element_at(F.create_map(*[F.lit(x) for pair in SLOTS.items() for x in pair]), F.col("kind"))
    return counted.filter("candidates > 1").select(
        "project_id", "folded", slot.alias("slot"), "candidates", F.col("name").alias("candidate")
    )


def text_roles(slots: DataFrame) -> DataFrame:
    """Text beside a recording is a caption, text alone is the script."""
    role = F.when(F.col("audios") > 0, "caption").otherwise("script")
    return slots.filter("images > 0 AND texts > 0").select("project_id", "scene_id", "text", role.alias("role"))


def awaiting(slots: DataFrame) -> DataFrame:
    """Numbered scenes with words or a recording and no still."""
    number = N.scene_number(F.col("scene_id"))
    return slots.filter((F.col("images") == 0) & number.isNotNull()).select(
        "project_id", "scene_id", number.alias("number"), "audio", "text"
    )


def unpaired_files(slots: DataFrame) -> DataFrame:
    """Narration with no still under a name that is not a scene number."""
    orphans = slots.filter((F.col("images") == 0) & N.scene_number(F.col("scene_id")).isNull())
    named = F.explode(F.filter(F.array("audio", "text"), lambda f: f.isNotNull()))
    return orphans.select("project_id", "folded", named.alias("name"))


def awaiting_summary(slots: DataFrame) -> DataFrame:
    """Per project with waiting scenes: how many, the first, and whether none has a picture."""
    waiting = (F.col("images") == 0) & N.scene_number(F.col("scene_id")).isNotNull()
    first = F.struct(N.natural_key(F.col("scene_id")), F.col("folded"))
    return (
        slots.groupBy("project_id")
        .agg(
            F.count_if(waiting).alias("scenes"),
            F.min_by(F.when(waiting, F.col("scene_id")), F.when(waiting, first)).alias("first"),
            (F.count_if(F.col("images") > 0) == 0).alias("none_pictured"),
        )
        .filter("scenes > 0")
    )


def running_order(assets: DataFrame) -> DataFrame:
    """Position of every scene in its project, in natural order."""
    scenes = classified(assets).filter("kind IS NOT NULL").groupBy("project_id", "folded").agg(
        F.count(F.lit(1)).alias("files")
    )
    keyed = scenes.withColumn("nat", N.natural_key(F.col("folded")))
    return numbered(keyed, ["project_id"], ["nat", "folded"], "position").drop("nat")


def next_numbers(assets: DataFrame) -> DataFrame:
    """The number the next picture and the next scene of each project would take."""
    number = N.scene_number(F.col("stem"))
    return classified(assets).groupBy("project_id").agg(
        (F.coalesce(F.max(F.when(F.col("kind") == "image", number)), F.lit(0)) + 1).alias("next_picture"),
        (F.coalesce(F.max(F.when(F.col("kind").isNotNull(), number)), F.lit(0)) + 1).alias("next_scene"),
    )


def unlisted_images(assets: DataFrame, drafts: DataFrame) -> DataFrame:
    """Pictures in a folder that no manifest row names. ``drafts``: ``project_id, image``."""
    pictures = classified(assets).filter((F.col("kind") == "image") & ~F.col("name").startswith("."))
    said = drafts.filter("image IS NOT NULL").select("project_id", F.translate("image", "\\", "/").alias("said"))
    listed = settle(said, {"path": N.lexical_path(F.col("said"))}).select("project_id", "path")
    return (
        pictures.withColumn("path", F.concat(F.lit("/"), F.col("name")))
        .join(listed, ["project_id", "path"], "left_anti")
        .select("project_id", "file_no", "name")
    )


def owned_files(files: DataFrame) -> DataFrame:
    return files.withColumns({"owner": N.owned_kind(F.col("name")), "safe": N.safe_list_name(F.col("name"))})


def contained(requests: DataFrame) -> DataFrame:
    """Verdict on ``root, requested`` paths, worked out lexically."""
    return requests.withColumn("verdict", N.contained_path(F.col("root"), F.col("requested")))
