"""Pairing narration with stills: by name first, then by position, and what is left over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneframe.constants import POSITIONAL_TEXT_EXTENSIONS
from sceneframe.functions import naming as N
from sceneframe.operators.catalog import classified, next_numbers
from sceneframe.operators.ordered import numbered, with_totals


def _sides(assets: DataFrame, pools: list[str]) -> DataFrame:
    """Stills and pool files as one frame, a still once per pool, so all are numbered in one pass."""
    known = classified(assets).filter(F.col("kind").isin("image", *pools))
    is_image = F.col("kind") == "image"
    joined = F.when(is_image, F.array(*[F.lit(p) for p in pools])).otherwise(F.array("kind"))
    guess = (F.col("kind") == "audio") | F.lower("ext").isin(POSITIONAL_TEXT_EXTENSIONS)
    keyed = known.select(
        "project_id", "folded", "file_no", is_image.alias("is_image"), (~is_image & guess).alias("may_guess"),
        N.natural_key(F.col("name")).alias("nat"), joined.alias("_pools"),
    )
    return keyed.withColumn("pool", F.explode("_pools")).drop("_pools")


def _by_name(assets: DataFrame, pools: list[str]) -> DataFrame:
    """k-th still of a stem beside the k-th file of that stem; either side may be missing."""
    sides = numbered(_sides(assets, pools), ["project_id", "folded", "pool", "is_image"], ["nat", "file_no"], "k")
    image, other = F.col("is_image"), ~F.col("is_image")
    return sides.groupBy("project_id", "pool", "folded", "k").agg(
        F.max(F.when(image, F.col("file_no"))).alias("image_no"),
        F.max(F.when(other, F.col("file_no"))).alias("file_no"),
        F.max(F.when(image, F.col("nat"))).alias("image_nat"),
        F.max(F.when(other, F.col("nat"))).alias("file_nat"),
        F.bool_or("may_guess").alias("may_guess"),
    )


def pair_by_stem(assets: DataFrame, pool: str = "audio") -> DataFrame:
    return _by_name(assets, [pool]).filter("image_no IS NOT NULL AND file_no IS NOT NULL").select(
        "project_id", "folded", "image_no", "file_no"
    )


def _assigned(assets: DataFrame, pools: list[str]) -> DataFrame:
    matched = _by_name(assets, pools)
    paired = F.col("image_no").isNotNull() & F.col("file_no").isNotNull()
    side = (
        F.when(paired, "name").when(F.col("image_no").isNotNull(), "image")
        .when(F.col("may_guess"), "file").otherwise("refused")
    )
    ranked = numbered(
        matched.withColumns({"side": side, "nat": F.coalesce("image_nat", "file_nat"), "any_no": F.coalesce("image_no", "file_no")}),
        ["project_id", "pool", "side"], ["nat", "any_no"], "ordinal",
    )
    tag = F.when(F.col("side").isin("image", "file"), "position").otherwise(F.col("side"))
    met = ranked.groupBy("project_id", "pool", tag.alias("tag"), "ordinal").agg(
        F.max("image_no").alias("image_no"), F.max("file_no").alias("file_no"), F.max("image_nat").alias("image_nat")
    )
    phase = (
        F.when(F.col("tag") != "position", F.col("tag")).when(F.col("file_no").isNull(), "alone")
        .when(F.col("image_no").isNull(), "spare").otherwise("position")
    )
    return met.select("project_id", "pool", "image_no", "file_no", phase.alias("phase"), "image_nat")


def pair_two_phase(assets: DataFrame, pools: list[str]) -> DataFrame:
    """Every still and every pool file once per pool: paired by name or position, or left alone.

    ``phase`` is name, position, alone (a still), spare (a file that could be guessed but ran
    out of stills) or refused (a file that may never be guessed).
    """
    return _assigned(assets, pools).drop("image_nat")


def waiting_files(assets: DataFrame) -> DataFrame:
    """First narration or text file under each numbered stem."""
    return (
        classified(assets).filter(F.col("kind").isin("audio", "text") & N.scene_number(F.col("stem")).isNotNull())
        .groupBy("project_id", "stem").agg(F.min("name").alias("waiting"))
    )


def intake_summary(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What adding the incoming files to each project comes to.

    Stills and everything left over go through one aggregate: a project's leftovers share the
    row that has no still, which holds counts only.
    """
    strangers = classified(incoming).filter("kind IS NULL").select(
        "project_id", F.lit(None).cast("string").alias("pool"), F.lit(None).cast("bigint").alias("image_no"),
        "file_no", F.lit("stranger").alias("phase"), F.lit(None).cast("string").alias("image_nat"))
    both = _assigned(incoming, ["audio", "text"]).unionByName(strangers)
    held = F.col("file_no").isNotNull()
    per_still = both.groupBy("project_id", "image_no").agg(
        F.bool_or((F.col("pool") == "audio") & held).alias("has_audio"),
        F.bool_or((F.col("pool") == "text") & held).alias("has_text"),
        F.max("image_nat").alias("nat"),
        F.count_if(F.col("phase") == "spare").alias("orphans"),
        F.count_if(F.col("phase").isin("refused", "stranger")).alias("skipped"),
    )
    still = F.col("image_no").isNotNull()
    ordered = numbered(per_still, ["project_id"], [F.col("image_no").isNull(), "nat", "image_no"], "ordinal")
    placed = with_totals(ordered, ["project_id"], {"_photos": F.count_if(F.col("image_no").isNotNull())})
    starts = next_numbers(existing).select("project_id", F.col("next_picture").alias("start"))
    placed = placed.join(starts, "project_id", "left").withColumn("start", F.coalesce("start", F.lit(1)))
    last = F.col("start") + F.col("_photos") - 1
    number = N.numbered_stem(F.col("start") + F.col("ordinal") - 1, N.number_width(last))
    audio, text = F.col("has_audio"), F.col("has_text")
    # Stills under their new stems beside the stems that wait: one aggregate by stem stands for a
    # join by project and stem, which would be shuffled anew however the projects already lie.
    stems = placed.select(
        "project_id", F.when(still, number).alias("stem"), F.lit(1).alias("added"), still.alias("photo"),
        (still & audio).alias("narrated"), (still & text & ~audio).alias("spoken"), (still & text & audio).alias("captioned"),
        (still & ~audio & ~text).alias("bare"), "orphans", "skipped", F.lit(None).cast("int").alias("waits"))
    waiting = waiting_files(existing).filter("project_id IS NOT NULL").select("project_id", "stem", F.lit(1).alias("waits"))
    per_stem = stems.unionByName(waiting, allowMissingColumns=True).groupBy("project_id", "stem").agg(
        F.count("added").alias("added"), F.count("waits").alias("waits"),
        *[F.count_if(c).alias(c) for c in ("photo", "narrated", "spoken", "captioned", "bare")],
        F.sum("orphans").alias("orphans"), F.sum("skipped").alias("skipped"),
    )
    waits = F.col("waits") > 0
    summed = per_stem.groupBy("project_id").agg(
        F.sum("added").alias("added"),
        F.sum("photo").alias("photos"),
        F.sum("narrated").alias("narrations"),
        F.sum("spoken").alias("spoken"),
        F.sum("captioned").alias("captions"),
        F.sum(F.when(waits, F.col("bare")).otherwise(0)).alias("filled"),
        F.sum(F.when(waits, 0).otherwise(F.col("bare"))).alias("silent"),
        F.sum("orphans").alias("orphans"),
        F.sum("skipped").alias("skipped"),
    )
    # A project that only has files waiting is given nothing.
    return summed.filter("added > 0").drop("added")
