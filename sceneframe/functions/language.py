"""Column functions that tell a text's language from its script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sceneframe.constants import DEFAULT_VOICES, PROVIDER_DEFAULT_VOICE, SCRIPTS


def _class(ranges) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


_ANY = "".join(_class(r) for _, r in SCRIPTS)


def scripted(text: Column) -> Column:
    """Only the characters that belong to one of the scripts.

    Everything below the first script goes by one plain range before the long class is tried.
    """
    first = min(low for _, ranges in SCRIPTS for low, _ in ranges)
    bulk = F.regexp_replace(text, f"[\\x{{0}}-\\x{{{first - 1:X}}}]+", "")
    return F.regexp_replace(bulk, f"[^{_ANY}]+", "")


def dominant(scripted_text: Column) -> Column:
    """The script with most characters, the earlier one on a tie; Han with kana is Japanese.

    Each script's characters are taken out in turn, so the text is gone once its own script
    has been met and the remaining scripts cost nothing.
    """
    scripts = F.array(*[F.struct(F.lit(n).alias("script"), F.lit(f"[{_class(r)}]+").alias("ranges")) for n, r in SCRIPTS])
    start = F.struct(scripted_text.alias("rest"), F.lit(None).cast("string").alias("best"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        def taken(rest: Column) -> Column:
            n = F.length(acc["rest"]) - F.length(rest)
            return F.struct(
                rest.alias("rest"),
                F.when(n > acc["n"], s["script"]).otherwise(acc["best"]).alias("best"),
                F.greatest(n, acc["n"]).alias("n"),
            )

        # A one-element array binds what is left, so that the text is scanned once a step.
        left = F.array(F.regexp_replace(acc["rest"], s["ranges"], F.lit("")))
        return F.when(acc["rest"] == "", acc).otherwise(F.transform(left, taken)[0])

    name = F.aggregate(scripts, start, step, lambda acc: acc["best"])
    kana = _class(dict(SCRIPTS)["ja"])
    return F.when((name == "zh") & scripted_text.rlike(f"[{kana}]"), "ja").otherwise(name)


def default_voice(language: Column) -> Column:
    pairs = [F.lit(x) for pair in DEFAULT_VOICES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), language), F.lit(PROVIDER_DEFAULT_VOICE))


def suggested_voice(language: Column) -> Column:
    pairs = [F.lit(x) for pair in DEFAULT_VOICES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), language)


def cannot_read(language: Column, voice: Column) -> Column:
    return language.isNotNull() & ~F.startswith(voice, F.concat(language, F.lit("-")))
