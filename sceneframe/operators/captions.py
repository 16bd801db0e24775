"""Captions as timed cues. Captions carry ``film_id, scene, text, seconds, theme``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneframe import constants as C
from sceneframe.functions import captions as K
from sceneframe.functions.settle import settle
from sceneframe.functions.text import collapse
from sceneframe.operators.ordered import numbered
from sceneframe.operators.sizing import spread


def theme_budget(theme: Column) -> Column:
    pairs = [F.lit(x) for name, chars in C.THEME_MAX_CHARS.items() for x in (name, chars)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), theme), F.lit(C.THEME_MAX_CHARS[C.DEFAULT_THEME])).cast("bigint")


def _packed(captions: DataFrame) -> DataFrame:
    """Captions with words, and their pieces before weak endings are moved."""
    words = settle(spread(captions, "film_id", "scene"), {"words": collapse(F.col("text")), "budget": theme_budget(F.col("theme"))})
    spoken = words.filter((F.col("words") != "") & (F.col("seconds") > 0) & (F.col("seconds") < float("inf")))
    return settle(spoken, {"packed": K.pack(F.col("words"), F.greatest("budget", F.lit(C.SMALLEST_BUDGET)))})


def cue_bins(captions: DataFrame) -> DataFrame:
    """Pieces of at most the theme's budget, weak endings moved on: ``film_id, scene, cue, text``."""
    d = settle(_packed(captions), {"cues": K.carry_weak_endings(F.col("packed"))})
    return d.select("film_id", "scene", F.posexplode("cues").alias("cue", "text"))


def weak_endings(captions: DataFrame) -> DataFrame:
    """Pieces that gave a word away or received one."""
    d = settle(_packed(captions), {"cues": K.carry_weak_endings(F.col("packed"))})
    both = d.select("film_id", "scene", F.posexplode(F.arrays_zip(F.col("packed").alias("before"), F.col("cues").alias("after"))).alias("cue", "z"))
    return both.select("film_id", "scene", "cue", "z.before", "z.after").filter("before <> after")


def short_cues(captions: DataFrame) -> DataFrame:
    """Per scene: its pieces, how many are on screen too briefly, whether there are too many."""
    d = _packed(captions)
    lengths = F.transform("packed", lambda p: F.greatest(F.length(p), F.lit(1)))
    d = settle(d, {"lengths": lengths})
    total = F.aggregate("lengths", F.lit(0), lambda a, x: a + x)
    brief = F.filter("lengths", lambda n: F.col("seconds") * n / F.col("total") < F.lit(C.MIN_CUE_SECONDS) - F.lit(1e-9))
    return settle(d, {"total": total}).select(
        "film_id", "scene", F.size("lengths").cast("bigint").alias("pieces"), F.size(brief).cast("bigint").alias("brief"),
        (F.size("lengths") > K.allowed_cues(F.col("seconds"))).alias("crowded"),
    )


def timed_cues(captions: DataFrame) -> DataFrame:
    """The cues of every scene with their times; no cue is too brief and none overlap.

    Boundaries come from running totals of characters, so the last cue ends on the scene's end.
    """
    d = settle(_packed(captions).drop("packed"), {"allowed": K.allowed_cues(F.col("seconds"))})
    d = settle(d, {"fitting": K.fitting_budget(F.col("words"), F.col("budget"), F.col("allowed"))})
    d = settle(d, {"pieces": K.carry_weak_endings(K.pack(F.col("words"), F.col("fitting")))})
    d = settle(d, {"pieces": K.join_tail(F.col("pieces"), F.col("allowed"))})
    d = settle(d, {"pieces": K.merge_short(F.col("pieces"), F.col("seconds"))})
    d = settle(d, {"lengths": F.transform("pieces", lambda p: F.greatest(F.length(p), F.lit(1)))})
    cues = d.select("film_id", "scene", "seconds", "lengths", F.posexplode("pieces").alias("cue", "text"))

    def upto(n: Column) -> Column:
        return F.aggregate(F.slice("lengths", F.lit(1), n), F.lit(0), lambda a, x: a + x)

    total = upto(F.size("lengths"))
    return cues.select(
        "film_id", "scene", "cue", "text",
        (F.col("seconds") * upto(F.col("cue")) / total).alias("start_s"),
        (F.col("seconds") * upto(F.col("cue") + 1) / total).alias("end_s"),
    )


_UNDRAWN = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in C.DRAWN_RANGES) + "]+"


def undrawable(captions: DataFrame) -> DataFrame:
    """Per film with characters no caption face draws: scenes, first scene, first characters.

    Takes ``film_id, scene, text``. Characters are reduced to distinct ones inside each row
    before anything is shuffled.
    """
    rest = F.regexp_replace("text", _UNDRAWN, "")
    left = settle(spread(captions.select("film_id", "scene", "text"), "film_id", "scene"), {"missing": F.array_distinct(F.split(rest, ""))}).drop("text")
    left = left.withColumn("missing", F.filter("missing", lambda c: c != "")).filter("size(missing) > 0")
    films = left.groupBy("film_id").agg(F.count(F.lit(1)).alias("scenes"), F.min("scene").alias("first"))
    chars = (
        left.select("film_id", "scene", F.posexplode("missing").alias("at", "ch"))
        .groupBy("film_id", "ch").agg(F.min(F.struct("scene", "at")).alias("seen"))
    )
    ranked = numbered(chars, ["film_id"], ["seen"], "n").filter(F.col("n") <= C.NAMED_CHARACTERS)
    # At most eight rows of a film reach this list.
    named = ranked.groupBy("film_id").agg(F.array_sort(F.collect_list(F.struct("n", "ch"))).alias("named"))
    return films.join(named, "film_id").select(
        "film_id", "scenes", "first", F.array_join(F.transform("named", lambda s: s["ch"]), " ").alias("characters")
    )
