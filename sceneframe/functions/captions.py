"""Column functions that cut a caption into cues.

A caption is cut inside its row. Packing words up to a budget is a bounded greedy match, so
the regular expression engine does it in one pass over the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sceneframe.constants import MAX_CUES, MIN_CUE_SECONDS, SMALLEST_BUDGET, WEAK_ENDINGS
from sceneframe.functions.text import LETTER_OR_DIGIT

_ENDED = r"""(?<=[.!?…]["')\]»”’]{0,"""
_WEAK = rf"(?i) [^{LETTER_OR_DIGIT} ]*(?:{'|'.join(WEAK_ENDINGS)})[^{LETTER_OR_DIGIT} ]*$"


def pack(collapsed: Column, budget: Column) -> Column:
    """Pieces of at most ``budget`` characters, broken early after a sentence that fills half.

    A word longer than the budget is a piece of its own. Closing marks after a sentence are
    looked past as far as a piece can reach.
    """
    b = budget.cast("string")
    half = F.call_function("div", budget + 1, F.lit(2)).cast("string")
    pattern = F.concat(
        F.lit("(?s)(.{"), half, F.lit(","), b, F.lit("}?(?= |$)" + _ENDED), b, F.lit("})|.{1,"), b, F.lit("}(?= |$)|[^ ]+)(?: |$)")
    )
    return F.regexp_extract_all(collapsed, pattern, F.lit(1))


def carry_weak_endings(pieces: Column) -> Column:
    """A function word left at the end of a piece moves to the next one."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("carry"))

    def step(acc: Column, piece: Column) -> Column:
        whole = F.when(acc["carry"] == "", piece).otherwise(F.concat(acc["carry"], F.lit(" "), piece))
        gives = whole.rlike(_WEAK) & ~whole.rlike("[,;:.!?]$")
        kept = F.when(gives, F.regexp_replace(whole, " [^ ]+$", "")).otherwise(whole)
        carry = F.when(gives, F.regexp_extract(whole, "[^ ]+$", 0)).otherwise("")
        return F.struct(F.concat(acc["out"], F.array(kept)).alias("out"), carry.alias("carry"))

    def finish(acc: Column) -> Column:
        # The last piece has no next one and keeps its word.
        n = F.size(acc["out"])
        back = F.concat(F.slice(acc["out"], F.lit(1), n - 1), F.array(F.concat(F.element_at(acc["out"], -1), F.lit(" "), acc["carry"])))
        return F.when(acc["carry"] == "", acc["out"]).otherwise(back)

    return F.aggregate(pieces, start, step, finish)


def allowed_cues(seconds: Column) -> Column:
    by_time = F.greatest(F.floor(seconds / MIN_CUE_SECONDS), F.lit(1))
    return F.least(by_time, F.lit(MAX_CUES)).cast("int")


def fitting_budget(collapsed: Column, budget: Column, allowed: Column) -> Column:
    """The first budget, grown a step at a time, whose pieces are few enough."""
    first = F.greatest(budget, F.lit(SMALLEST_BUDGET)).cast("bigint")
    grown = F.greatest(first, F.ceil(F.length(collapsed) / allowed)) + 1
    later = F.sequence(grown, grown + 7)
    fits = F.filter(later, lambda b: F.size(pack(collapsed, b)) <= allowed)
    return F.when(F.size(pack(collapsed, first)) <= allowed, first).otherwise(
        F.coalesce(F.get(fits, F.lit(0)), grown + 7)
    )


def join_tail(pieces: Column, allowed: Column) -> Column:
    tail = F.array_join(F.slice(pieces, allowed, F.size(pieces)), " ")
    return F.when(F.size(pieces) > allowed, F.concat(F.slice(pieces, F.lit(1), allowed - 1), F.array(tail))).otherwise(pieces)


def _lengths(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: F.greatest(F.length(p), F.lit(1)))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def merge_short(pieces: Column, seconds: Column) -> Column:
    """Join the shortest cue to its neighbour until none is on screen too briefly.

    At most sixty cues arrive here, so the steps are few and bounded.
    """
    rounds = F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1)))

    def step(ps: Column, _: Column) -> Column:
        lengths = _lengths(ps)
        least = F.array_min(lengths)
        brief = seconds * least / _total(lengths) < F.lit(MIN_CUE_SECONDS) - F.lit(1e-9)
        worst = F.array_position(lengths, least).cast("int")
        into = F.when(worst < F.size(ps), worst).otherwise(worst - 1)
        both = F.concat_ws(" ", F.get(ps, into - 1), F.get(ps, into))
        merged = F.concat(F.slice(ps, F.lit(1), into - 1), F.array(both), F.slice(ps, into + 2, F.size(ps)))
        return F.when((F.size(ps) > 1) & brief, merged).otherwise(ps)

    return F.aggregate(rounds, pieces, step)
