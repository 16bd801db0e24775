"""Everything wrong with every project, as one ordered table.

Rows: ``mode, project_id, scene_id, position, kind, severity, detail, line``. Problems are
rows and never failures, so one bad cell hides nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneframe.functions import naming as N
from sceneframe.functions.settle import settle
from sceneframe.operators import captions, catalog, problems, stills
from sceneframe.operators.ordered import scan, with_totals

_COLUMNS = ["project_id", "scene_id", "position", "kind", "detail", "none_pictured"]


def _rows(df: DataFrame, kind: str | Column, detail: Column, scene: str | None = None, position: str | None = None,
          none_pictured: Column | None = None) -> DataFrame:
    return df.select(
        F.col("project_id").cast("bigint").alias("project_id"),
        (F.col(scene) if scene else F.lit(None).cast("string")).alias("scene_id"),
        (F.col(position).cast("bigint") if position else F.lit(None).cast("bigint")).alias("position"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        detail.cast("string").alias("detail"),
        (none_pictured if none_pictured is not None else F.lit(None).cast("boolean")).alias("none_pictured"),
    )


def folder_problems(assets: DataFrame) -> DataFrame:
    """Problems of projects that are plain folders, paired by stem.

    The slots are worked out once and looked at once: what concerns the whole project is put
    on its first row, and every row then gives out its own problems.
    """
    slots = catalog.scene_slots(assets, keep_unknown=True)
    number = N.scene_number(F.col("scene_id"))
    spoken = (F.col("audios") + F.col("texts")) > 0
    d = settle(slots, {
        "nat": N.natural_key(F.col("folded")),
        "pictured": F.col("images") > 0,
        "waiting": (F.col("images") == 0) & spoken & number.isNotNull(),
        "orphan": (F.col("images") == 0) & spoken & number.isNull(),
    })
    d = scan(d, ["project_id"], ["nat", "folded"], number="row", sums={"position": F.when(F.col("pictured"), 1).otherwise(0)})
    d = with_totals(d, ["project_id"], {
        "pictures": F.count_if("pictured"),
        "waits": F.count_if("waiting"),
        "first": F.min_by("scene_id", F.when(F.col("waiting"), F.struct("nat", "folded"))),
    })

    def problem(when: Column, kind: str, detail: Column, scene: bool = False) -> Column:
        return F.when(when, F.struct(
            (F.col("scene_id") if scene else F.lit(None).cast("string")).alias("scene_id"),
            (F.when(F.col("pictured"), F.col("position")) if scene else F.lit(None).cast("bigint")).alias("position"),
            F.lit(kind).alias("kind"), detail.alias("detail"), (F.col("pictures") == 0).alias("none_pictured")))

    top = F.col("row") == 1
    found = [
        problem(F.col(f"{kind}s") > 1, "ambiguous_scene", F.concat_ws(":", F.lit(slot), F.col(f"{kind}s").cast("string")), True)
        for kind, slot in catalog.SLOTS.items()
    ]
    found += [problem(F.col("orphan") & F.col(c).isNotNull(), "unpaired_file", F.col(c)) for c in ("audio", "text")]
    found += [
        problem(top & (F.col("waits") > 0), "needs_picture", F.concat_ws(":", F.col("waits").cast("string"), "first")),
        # A project whose scenes all wait for pictures is told that, not that it has no scenes.
        problem(top & (F.col("waits") == 0) & (F.col("pictures") == 0), "no_scenes", F.lit("")),
    ]
    return d.select(F.col("project_id").cast("bigint").alias("project_id"), F.inline(F.array_compact(F.array(*found))))


def manifest_problems(drafts: DataFrame, files: DataFrame) -> DataFrame:
    """Problems of projects that come with a manifest. ``files``: ``project_id, path``.

    Drafts are read and checked once: repeats are counted along the way, the files a row names
    are looked up, and every row then gives out its own problems.
    """
    checked = problems.validate(drafts)
    clean = F.size("problems") == 0
    d = scan(checked, ["project_id", "scene_id"], ["position"], sums={"repeat": F.when(clean, 1).otherwise(0)})

    def path(c: str) -> Column:
        return N.lexical_path(F.translate(c, "\\", "/"))

    d = settle(d, {"image_path": path("image"), "audio_path": path("audio")})
    held = files.select("project_id", N.lexical_path(F.col("path")).alias("path")).distinct().withColumn("held", F.lit(True))
    for side in ("image", "audio"):
        there = held.withColumnsRenamed({"path": f"{side}_path", "held": f"{side}_held"})
        d = d.join(there, ["project_id", f"{side}_path"], "left")

    usable = F.col("id_problem").isNull()

    def problem(when: Column, kind: str, detail: Column, scene: str = "scene_id") -> Column:
        return F.when(when, F.struct(
            F.col(scene).alias("scene_id"), F.col("position").cast("bigint").alias("position"), F.lit(kind).alias("kind"),
            detail.alias("detail"), F.lit(None).cast("boolean").alias("none_pictured")))

    # A draft whose id cannot be used has no scene to report against.
    own = F.transform("problems", lambda p: F.struct(
        F.when(usable, F.col("scene_id")).alias("scene_id"), F.when(usable, F.col("position").cast("bigint")).alias("position"),
        p["kind"].alias("kind"), p["detail"].alias("detail"), F.lit(None).cast("boolean").alias("none_pictured")))
    more = [
        problem(clean & (F.col("repeat") > 1), "duplicate_id", F.lit("")),
        problem(F.col("unread_duration").isNotNull(), "unusable_setting", F.concat_ws(":", F.lit("duration"), "unread_duration"), "id"),
    ]
    for side, field in (("image", "image"), ("audio", "audio_file")):
        said = F.concat_ws(":", F.lit(field), side)
        asked = usable & F.col(side).isNotNull()
        more.append(problem(asked & F.col(f"{side}_path").isNull(), "path_outside", said))
        more.append(problem(asked & F.col(f"{side}_path").isNotNull() & F.col(f"{side}_held").isNull(), "path_missing", said))
    every = F.concat(own, F.array_compact(F.array(*more)))
    return d.select(F.col("project_id").cast("bigint").alias("project_id"), F.inline(every))


def setting_problems(rows: DataFrame) -> DataFrame:
    """``rows``: ``project_id, field, value``."""
    return _rows(rows, "unusable_setting", F.concat_ws(":", "field", "value"))


def still_problems(measured: DataFrame, aspect: Column, width: Column, height: Column) -> DataFrame:
    small = stills.undersized(measured, aspect, width, height)
    detail = F.concat_ws(":", F.col("scenes").cast("string"), F.col("total").cast("string"), "smallest")
    return _rows(small, "undersized_sources", detail)


def interrupted_problems(files: DataFrame) -> DataFrame:
    """What an unfinished renumbering left in a project, counted. ``files``: ``project_id, name``."""
    left = files.filter(F.col("name").rlike(r"^\.(arranging|removing)-")).groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))
    return _rows(left, "interrupted_rename", F.col("files"))


def unreadable_problems(slots: DataFrame, scripts: DataFrame) -> DataFrame:
    """Texts of scenes that cannot be read. ``scripts``: ``project_id, name, problem``.

    A text that belongs to no scene is an unpaired file, whatever is in it.
    """
    scenes = slots.filter((F.col("images") > 0) | N.scene_number(F.col("scene_id")).isNotNull())
    bad = scripts.filter("problem IS NOT NULL").select("project_id", F.col("name").alias("text"), "problem")
    found = scenes.select("project_id", "text").join(bad, ["project_id", "text"])
    return _rows(found, "not_usable_media", F.concat_ws(":", F.lit("text"), "text", "problem"))


def unlisted_problems(assets: DataFrame, drafts: DataFrame) -> DataFrame:
    """Pictures that a manifest project holds and no row of it names."""
    return _rows(catalog.unlisted_images(assets, drafts), "unlisted_image", F.col("name"))


def undrawable_problems(scenes: DataFrame, subtitled: DataFrame) -> DataFrame:
    """Captions with characters that no caption face draws, one row per project.

    ``scenes``: ``project_id, scene_id, position, caption_text``. Only projects of
    ``subtitled`` (``project_id``) draw their captions.
    """
    drawn = scenes.join(subtitled.select("project_id").distinct(), "project_id", "left_semi").filter("caption_text IS NOT NULL")
    texts = drawn.select(F.col("project_id").alias("film_id"), F.struct("position", "scene_id").alias("scene"), F.col("caption_text").alias("text"))
    found = captions.undrawable(texts).withColumnRenamed("film_id", "project_id")
    return _rows(found, "undrawable_caption", F.concat_ws(":", F.col("scenes").cast("string"), F.col("first.scene_id"), "characters"))


def for_run(found: DataFrame, again: DataFrame, runs: DataFrame) -> DataFrame:
    """Problems as a run has them whose choices replace some of a project's settings.

    ``runs`` (``project_id, kind``) names the kinds that the run decides anew: what was
    ``found`` of them goes, what ``again`` says of them comes, so a warning that left with
    the choice is gone and one that came with it is there. Everything else stays as it is.
    """
    anew = runs.select("project_id", "kind").distinct()
    kept = found.join(anew, ["project_id", "kind"], "left_anti")
    return kept.unionByName(again.join(anew, ["project_id", "kind"], "left_semi"))


def report(**by_mode: DataFrame) -> DataFrame:
    """All problems with their severity, each in its place in its project's report."""
    tagged = [df.withColumn("mode", F.lit(mode)) for mode, df in by_mode.items()]
    every = reduce(DataFrame.unionByName, tagged)
    graded = every.withColumn("severity", problems.severity(F.col("kind"), F.col("none_pictured"))).drop("none_pictured")
    return problems.ordered_report(graded)
