"""Project settings: raw rows resolved against the defaults, with everything unusable listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneframe import constants as C
from sceneframe.functions import geometry as G
from sceneframe.functions.settle import settle
from sceneframe.functions.text import clean_cell
from sceneframe.operators.sizing import spread


def _lookup(word: Column, table: dict) -> Column:
    """Canonical value of a word, null when the word is unknown. A literal map, so no join."""
    pairs = [F.lit(x) for value, words in table.items() for w in words for x in (w, value)]
    return F.try_element_at(F.create_map(*pairs), word)


def aspect_of(word: Column) -> Column:
    return _lookup(F.translate(F.lower(word), "x", ":"), C.ASPECT_WORDS)


def size_of(word: Column) -> Column:
    return _lookup(F.lower(word), C.SIZE_WORDS)


def resolve(raw: DataFrame) -> DataFrame:
    """One row per project: settled values, and ``problems`` as an array of (field, value).

    Every step is settled: later ones name earlier ones many times, and copies of copies would
    multiply the work on a row. A row is small and heavy to work on, so small inputs are spread.
    """
    text = ["output", "aspect", "resolution", "manifest", "provider", "voice", "preset", "theme", "position", "motion_seed"]
    r = settle(spread(raw, "project_id"), {c: clean_cell(F.col(c)) for c in text})

    r = settle(r, {
        "_aspect": F.when(F.col("aspect").isNull(), F.lit(C.DEFAULT_ASPECT)).otherwise(aspect_of(F.col("aspect"))),
        "_size": size_of(F.col("resolution")),
        "_theme": F.when(F.lower("theme").isin(list(C.THEME_MAX_CHARS)), F.lower("theme")),
        "_place": F.when(F.lower("position").isin("bottom", "top"), F.lower("position")),
        "_seed": F.when(F.lower("motion_seed").isin("v1", "v2"), F.lower("motion_seed")),
    })
    r = r.withColumn("_named", F.when(F.col("short_edge").isNull(), F.col("_size")))
    edge = F.coalesce("short_edge", "_named", F.lit(C.DEFAULT_SHORT_EDGE)).cast("bigint")
    fps = F.coalesce("fps", F.lit(C.DEFAULT_FPS)).cast("bigint")
    r = settle(r, {"_edge": edge, "_fps": fps})
    refused = F.when(F.col("_aspect").isNotNull(), G.output_refusal(F.col("_aspect"), F.col("_edge"), F.col("_fps")))
    r = settle(r, {"_refused": refused})
    usable = F.col("_aspect").isNotNull() & F.col("_refused").isNull()
    size, theme, place, seed = F.col("_size"), F.col("_theme"), F.col("_place"), F.col("_seed")

    def finite(c: str) -> Column:
        return ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))

    ok_trim = {c: finite(c) & (F.col(c) <= C.MAX_TRIM_SECONDS) for c in ("trim_head", "trim_tail")}
    ok_crf = (F.col("crf") >= 0) & (F.col("crf") <= C.MAX_CRF)
    ok_duration = finite("duration") & (F.col("duration") > 0) & (F.col("duration") <= C.MAX_SCENE_SECONDS)
    ok_amount = finite("zoom_amount") & F.col("zoom_amount").between(C.MIN_AMOUNT, C.MAX_AMOUNT)

    geometry_field = (
        F.when(F.col("fps").isNotNull() & (F.col("_edge") == C.DEFAULT_SHORT_EDGE), "fps")
        .when(F.col("_named").isNotNull(), "resolution").otherwise("short_edge")
    )
    said = F.concat(F.col("_edge").cast("string"), F.lit(" at "), "_aspect", F.lit(", "), F.col("_fps").cast("string"), F.lit(" fps"))

    def problem(field: Column | str, value: Column, when: Column) -> Column:
        name = F.lit(field) if isinstance(field, str) else field
        return F.when(when, F.struct(name.alias("field"), value.cast("string").alias("value")))

    def given(c: str, ok: Column) -> Column:
        return F.col(c).isNotNull() & ~F.coalesce(ok, F.lit(False))

    problems = F.array_compact(F.array(
        problem("aspect", F.col("aspect"), F.col("aspect").isNotNull() & F.col("_aspect").isNull()),
        problem("resolution", F.col("resolution"),
                F.col("resolution").isNotNull() & (size.isNull() | F.col("short_edge").isNotNull())),
        problem(geometry_field, said, F.col("_refused").isNotNull()),
        problem("tts.trim_head", F.col("trim_head"), given("trim_head", ok_trim["trim_head"])),
        problem("tts.trim_tail", F.col("trim_tail"), given("trim_tail", ok_trim["trim_tail"])),
        problem("encode.crf", F.col("crf"), given("crf", ok_crf)),
        problem("defaults.duration", F.col("duration"), given("duration", ok_duration)),
        problem("defaults.zoom_amount", F.col("zoom_amount"), given("zoom_amount", ok_amount)),
        problem("subtitles.theme", F.col("theme"), F.col("theme").isNotNull() & theme.isNull()),
        problem("subtitles.position", F.col("position"), F.col("position").isNotNull() & place.isNull()),
        problem("motion_seed", F.col("motion_seed"), F.col("motion_seed").isNotNull() & seed.isNull()),
    ))

    def settled(c: str, ok: Column, default) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), F.col(c)).otherwise(F.lit(default)).alias(c)

    return r.select(
        "project_id",
        F.coalesce("output", F.lit(C.DEFAULT_OUTPUT)).alias("output"),
        F.when(usable, F.col("_aspect")).otherwise(C.DEFAULT_ASPECT).alias("aspect"),
        F.when(usable, F.col("_edge")).otherwise(C.DEFAULT_SHORT_EDGE).alias("short_edge"),
        F.when(usable, F.col("_fps")).otherwise(C.DEFAULT_FPS).alias("fps"),
        "manifest",
        F.coalesce("provider", F.lit(C.DEFAULT_PROVIDER)).alias("provider"),
        F.coalesce("voice", F.lit(C.DEFAULT_VOICE_WORD)).alias("voice"),
        settled("trim_head", ok_trim["trim_head"], C.DEFAULT_TRIM_HEAD),
        settled("trim_tail", ok_trim["trim_tail"], C.DEFAULT_TRIM_TAIL),
        F.coalesce("preset", F.lit(C.DEFAULT_PRESET)).alias("preset"),
        settled("crf", ok_crf, C.DEFAULT_CRF),
        settled("duration", ok_duration, C.DEFAULT_SILENT_SECONDS).alias("silent_seconds"),
        settled("zoom_amount", ok_amount, C.DEFAULT_AMOUNT).alias("amount"),
        F.coalesce("subtitles", F.lit(C.DEFAULT_SUBTITLES)).alias("subtitles"),
        F.coalesce(theme, F.lit(C.DEFAULT_THEME)).alias("theme"),
        F.coalesce(place, F.lit(C.DEFAULT_PLACEMENT)).alias("placement"),
        F.coalesce(seed, F.lit(C.DEFAULT_MOTION_SEED)).alias("motion_seed"),
        problems.alias("problems"),
    )


def setting_problems(resolved: DataFrame) -> DataFrame:
    return resolved.select("project_id", F.inline("problems"))
