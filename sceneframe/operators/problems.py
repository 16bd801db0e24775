"""Every check on a scene, as rows: ``project_id, scene_id, position, kind, detail``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneframe import constants as C
from sceneframe.functions import naming as N
from sceneframe.functions.settle import settle
from sceneframe.functions.text import SPACES, is_blank
from sceneframe.operators.ordered import numbered, with_totals


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def _present(c: Column) -> Column:
    return c.isNotNull() & ~is_blank(c)


def declared_sources() -> Column:
    """Names of the audio columns a draft fills in."""
    return F.array_compact(F.array(
        F.when(F.col("text").isNotNull() & (F.col("text") != ""), "text"),
        F.when(_present(F.col("audio")), "audio_file"),
        F.when(F.col("duration").isNotNull(), "duration"),
    ))


def source_check(drafts: DataFrame) -> DataFrame:
    """Exactly one source of audio: add ``declared``, ``source_problem`` and ``source_kind``."""
    d = settle(drafts, {"declared": declared_sources()})
    only = F.when(F.size("declared") == 1, F.col("declared")[0])
    seconds = F.col("duration")
    problem = (
        F.when(F.size("declared") == 0, "no_audio_source")
        .when(F.size("declared") > 1, "conflicting_audio_sources")
        .when((only == "text") & is_blank(F.col("text")), "blank_text")
        .when((only == "duration") & (F.isnan(seconds) | (seconds <= 0) | (seconds == float("inf"))), "duration_not_positive")
        .when((only == "duration") & (seconds > C.MAX_SCENE_SECONDS), "duration_absurd")
    )
    kind = F.when(only == "text", "tts").when(only == "audio_file", "file").when(only == "duration", "silent")
    checked = settle(d, {"source_problem": problem})
    return checked.withColumn("source_kind", F.when(F.col("source_problem").isNull(), kind))


def _word(c: str) -> Column:
    """A motion or anchor word in its canonical spelling, null when blank."""
    bare = F.regexp_replace(F.lower(_trim(F.col(c))), "[_ ]", "-")
    return F.when(_present(F.col(c)), bare)


def resolve_aliases(drafts: DataFrame) -> DataFrame:
    """Add ``motion`` and ``anchor``; a word that means nothing leaves them null."""
    pairs = [F.lit(x) for value, words in C.ANCHOR_WORDS.items() for w in words for x in (w, value)]
    return settle(drafts, {
        "motion": F.when(_word("zoom_direction").isin(C.MOTION_KINDS), _word("zoom_direction")),
        "anchor": F.try_element_at(F.create_map(*pairs), _word("zoom_anchor")),
    })


def caption_of() -> Column:
    """The written caption, else the words spoken, else none."""
    return F.when(_present(F.col("caption")), _trim(F.col("caption"))).when(F.col("source_kind") == "tts", F.col("text"))


def validate(drafts: DataFrame) -> DataFrame:
    """Drafts with everything resolved and ``problems``: an array of (kind, detail), bounded per row."""
    d = resolve_aliases(source_check(drafts)).withColumn("id_problem", N.scene_id_problem(F.col("id")))

    def problem(kind: Column | str, detail: Column, when: Column) -> Column:
        name = F.lit(kind) if isinstance(kind, str) else kind
        return F.when(when, F.struct(name.alias("kind"), F.coalesce(detail, F.lit("")).alias("detail")))

    usable = F.col("id_problem").isNull()
    detail = (
        F.when(F.col("source_problem") == "conflicting_audio_sources", F.array_join("declared", ","))
        .when(F.col("source_problem").startswith("duration"), F.col("duration").cast("string"))
    )
    checks = F.array(
        problem("unusable_id", F.col("id_problem"), ~usable),
        problem("missing_image", F.lit(""), usable & ~_present(F.col("image"))),
        problem(F.col("source_problem"), detail, usable & F.col("source_problem").isNotNull()),
        problem("unknown_zoom_direction", _trim(F.col("zoom_direction")),
                usable & _present(F.col("zoom_direction")) & F.col("motion").isNull()),
        problem("unknown_zoom_anchor", _trim(F.col("zoom_anchor")),
                usable & _present(F.col("zoom_anchor")) & F.col("anchor").isNull()),
    )
    checked = settle(d, {"scene_id": _trim(F.col("id")), "problems": F.array_compact(checks)})
    return settle(checked, {"caption_text": F.when(F.size("problems") == 0, caption_of())})


def scene_problems(validated: DataFrame) -> DataFrame:
    rows = validated.select("project_id", "scene_id", "position", F.inline("problems"))
    # A draft whose id cannot be used has no scene to report against.
    return rows.withColumns({
        "scene_id": F.when(F.col("kind") != "unusable_id", F.col("scene_id")),
        "position": F.when(F.col("kind") != "unusable_id", F.col("position")),
    })


def valid_scenes(validated: DataFrame) -> DataFrame:
    """Drafts with no problem, numbered inside their id; the first one is the scene."""
    clean = validated.filter(F.size("problems") == 0)
    return numbered(clean, ["project_id", "scene_id"], ["position"], "repeat")


def duplicate_ids(validated: DataFrame) -> DataFrame:
    later = valid_scenes(validated).filter("repeat > 1")
    return later.select("project_id", "scene_id", "position", "repeat")


def resolve_scenes(validated: DataFrame, files: DataFrame) -> DataFrame:
    """Scenes whose files exist. ``files``: ``project_id, path``, one row per file.

    The files are those of the first draft under the scene's id, also where that draft failed.
    """
    scenes = valid_scenes(validated).filter("repeat = 1").select("project_id", "scene_id", "source_kind", "caption_text")
    first = numbered(validated.select("project_id", "scene_id", "position", "image", "audio"),
                     ["project_id", "scene_id"], ["position"], "nth").filter("nth = 1")

    def path(c: str) -> Column:
        return N.lexical_path(F.translate(_trim(F.col(c)), "\\", "/"))

    wanted = scenes.join(first, ["project_id", "scene_id"]).withColumns({"image": path("image"), "audio": path("audio")})
    held = files.select("project_id", N.lexical_path(F.col("path")).alias("held")).distinct()
    pictured = wanted.join(held.withColumnRenamed("held", "image"), ["project_id", "image"], "left_semi")
    silent = pictured.filter("source_kind <> 'file'").withColumn("audio", F.lit(None).cast("string"))
    heard = pictured.filter("source_kind = 'file'").join(
        held.withColumnRenamed("held", "audio"), ["project_id", "audio"], "left_semi"
    )
    columns = ["project_id", "scene_id", "position", "source_kind", "image", "audio", "caption_text"]
    return silent.select(*columns).unionByName(heard.select(*columns))


def severity(kind: Column, none_pictured: Column) -> Column:
    return (
        F.when(kind.isin(C.WARNING_KINDS), "warn")
        .when((kind == "needs_picture") & ~F.coalesce(none_pictured, F.lit(False)), "warn")
        .otherwise("error")
    )


def source_mix(validated: DataFrame) -> DataFrame:
    kinds = valid_scenes(validated).filter("repeat = 1").groupBy("project_id")
    return kinds.agg(*[
        F.count_if(F.col("source_kind") == kind).alias(name)
        for kind, name in (("tts", "narrated"), ("file", "supplied"), ("silent", "silent"))
    ])


def scene_listing(validated: DataFrame) -> DataFrame:
    """Scenes of projects small enough to list in full, in order."""
    scenes = valid_scenes(validated).filter("repeat = 1").select("project_id", "scene_id", "position", "source_kind", "image")
    small = with_totals(scenes, ["project_id"], {"scenes": F.count(F.lit(1))}).filter(f"scenes <= {C.SCENES_WORTH_LISTING}")
    return numbered(small, ["project_id"], ["position"], "line").select("project_id", "line", "scene_id", "source_kind", "image")


def ordered_report(problems: DataFrame) -> DataFrame:
    """Problems of a project first, then those of its scenes in scene order.

    Adds ``line``, the place of every problem in its project's report.
    """
    keyed = problems.withColumns({
        "_scene": F.when(F.col("scene_id").isNull(), 0).otherwise(1),
        "_at": F.when(F.col("scene_id").isNull(), 0).otherwise(F.coalesce("position", F.lit(2**62))),
    })
    order = ["_scene", "_at", "kind", F.coalesce("scene_id", F.lit("")), "detail"]
    return numbered(keyed, ["mode", "project_id"], order, "line").drop("_scene", "_at")


def problem_counts(problems: DataFrame) -> DataFrame:
    return problems.groupBy("mode", "project_id", "severity", "kind").agg(F.count(F.lit(1)).alias("problems"))
