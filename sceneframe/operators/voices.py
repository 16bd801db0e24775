"""Voices: which one reads a line, whether it can, and finding one in the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneframe.constants import DEFAULT_VOICE_WORD
from sceneframe.functions import language as L
from sceneframe.functions.settle import settle
from sceneframe.functions.text import clean_cell
from sceneframe.operators.sizing import spread


def languages(lines: DataFrame) -> DataFrame:
    """Add ``language`` to lines of text, null where no known script is used.

    Everything is worked out in the row; characters of no script go first, which leaves
    nothing to count in most lines.
    """
    d = settle(spread(lines), {"_scripted": L.scripted(F.col("line"))})
    d = settle(d, {"language": F.when(F.col("_scripted") != "", L.dominant(F.col("_scripted")))})
    return d.drop("_scripted")


def script_profile(lines: DataFrame) -> DataFrame:
    """Lines and characters per language."""
    return languages(lines).groupBy("language").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars")
    )


def default_voices(lines: DataFrame) -> DataFrame:
    return languages(lines).withColumn("default_voice", L.default_voice(F.col("language")))


def wrong_script(lines: DataFrame) -> DataFrame:
    """Lines whose voice cannot read their script, with a voice that can where there is one."""
    d = languages(lines).filter(L.cannot_read(F.col("language"), F.col("voice")))
    return d.withColumn("suggestion", L.suggested_voice(F.col("language")))


def _names(c: str) -> Column:
    """A cleaned voice name, null when it is blank or only says to use the default."""
    bare = clean_cell(F.col(c))
    return F.when(bare != DEFAULT_VOICE_WORD, bare)


def choose(requests: DataFrame) -> DataFrame:
    """Run, then project, then fallback, then nobody. Takes ``chosen, project, fallback, provider_default``."""
    d = settle(requests, {"_run": _names("chosen"), "_project": _names("project"), "_fallback": _names("fallback")})
    origin = (
        F.when(F.col("_run").isNotNull(), "run").when(F.col("_project").isNotNull(), "project")
        .when(F.col("_fallback").isNotNull(), "fallback").otherwise("unchosen")
    )
    d = d.withColumns({
        "voice": F.coalesce("_run", "_project", "_fallback", F.trim("provider_default")),
        "origin": origin,
    })
    named = F.col("origin") != "unchosen"
    return d.withColumn("is_fallback", named & F.coalesce(F.col("_fallback") == F.col("voice"), F.lit(False))).drop("_run", "_project", "_fallback")


def unchosen(scenes: DataFrame) -> DataFrame:
    """Spoken scenes per project that name no voice. Takes ``source_kind, voice``."""
    silent = (F.col("source_kind") == "tts") & _names("voice").isNull()
    return scenes.groupBy("project_id").agg(F.count_if(silent).alias("unchosen")).filter("unchosen > 0")


def search(catalogue: DataFrame, text: str, gender: str | None = None) -> DataFrame:
    """Voices whose id or locale holds ``text``."""
    wanted = text.lower()
    found = catalogue.filter(F.lower("voice_id").contains(wanted) | F.lower("locale").contains(wanted))
    return found.filter(F.lower("gender") == gender.lower()) if gender else found
