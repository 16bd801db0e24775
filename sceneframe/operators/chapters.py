"""Long texts cut into pieces for pictures. Chapters carry ``doc_id, chapter``.

Each chapter is cut inside its own row by native expressions: the corpus is read once and
only the pieces leave the scan, so nothing is shuffled and a long chapter costs its own length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneframe import constants as C
from sceneframe.functions import text as T
from sceneframe.functions.settle import settle
from sceneframe.operators.sizing import spread


def paragraphs(chapters: DataFrame) -> DataFrame:
    found = F.posexplode(T.paragraphs(F.col("chapter"))).alias("paragraph", "text")
    return spread(chapters).select("doc_id", found)


def _pieces(chapters: DataFrame, cut) -> DataFrame:
    made = F.flatten(F.transform(T.paragraphs(F.col("chapter")), cut))
    rows = spread(chapters).select("doc_id", F.posexplode(made).alias("piece", "text"))
    chars = F.length("text").cast("bigint")
    return rows.withColumns({"chars": chars, "seconds": chars / F.lit(C.CHARS_PER_SECOND)})


def cut_sentences(chapters: DataFrame, count: int) -> DataFrame:
    """Pieces of ``count`` sentences that never cross a paragraph."""
    several = F.lit(rf"[^\n]+(?:\n[^\n]+){{0,{max(count, 1) - 1}}}")

    def cut(paragraph: Column) -> Column:
        groups = F.regexp_extract_all(T.mark_sentences(paragraph), several, F.lit(0))
        return F.transform(groups, lambda g: F.translate(g, "\n", " "))

    return _pieces(chapters, cut)


def cut_time(chapters: DataFrame, max_seconds: float = C.MAX_PIECE_SECONDS) -> DataFrame:
    """As many whole sentences as fit in ``max_seconds``; a longer sentence stands alone.

    A sentence mark stands in the place of a space, so one bounded greedy match is the
    longest run of sentences that fits.
    """
    most = max(int(math.floor(max_seconds * C.CHARS_PER_SECOND)), 1)
    packed = F.lit(rf"(?s)([^\n].{{0,{most - 1}}}|[^\n]+)(?:\n|\z)")

    def cut(paragraph: Column) -> Column:
        groups = F.regexp_extract_all(T.mark_sentences(paragraph), packed, F.lit(1))
        return F.transform(groups, lambda g: F.translate(g, "\n", " "))

    return _pieces(chapters, cut)


def speaking_time(pieces: DataFrame) -> DataFrame:
    """Estimated seconds of every chapter; an estimate, never a measurement."""
    return pieces.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("chars").alias("chars"),
        (F.sum("chars") / F.lit(C.CHARS_PER_SECOND)).alias("seconds"),
    )


def length_cost_units(chars: Column) -> Column:
    """Cost of a piece's length in 326ths, kept whole so that sums do not depend on order.

    Under 3 s: 2 a second, and 4 more a second under 2 s. Over 5 s: 3 a second, and 17 more
    a second past 7.5 s. A character lasts 10/163 s, so 326 makes every term an integer.
    """
    short = 4 * (489 - 10 * chars) + 8 * F.greatest(326 - 10 * chars, F.lit(0))
    over = 10 * chars - 815
    long = 6 * over + 17 * F.greatest(2 * over - 815, F.lit(0))
    return F.when(chars * 10 < 489, short).when(over > 0, long).otherwise(F.lit(0))


def pacing_report(pieces: DataFrame) -> DataFrame:
    """Pieces too short, right and too long, and what their lengths cost."""
    chars = F.col("chars")
    band = F.when(chars * 10 < 489, "under").when(chars * 10 > 815, "over").otherwise("within")
    return pieces.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("chars").alias("chars"),
        (F.sum(length_cost_units(chars)) / F.lit(326.0)).alias("cost"),
    )


def gap_cost(word: Column, following: Column, last: Column) -> Column:
    """Cost of cutting after a word: free at a sentence or paragraph end, dear inside a clause."""
    inside = F.when(T.opens_clause(following), 3).otherwise(25)
    base = (
        F.when(T.ends_plainly(word), inside)
        .when(T.ends_sentence(word), 0)
        .when(T.ends_clause(word), F.when(T.ends_with_comma(word), 2).otherwise(1))
        .otherwise(inside)
    )
    return F.when(last, 0).otherwise(base + F.when(T.dangles(word), 20).otherwise(0))


def gap_costs(chapters: DataFrame) -> DataFrame:
    """Every word of every chapter with the cost of a cut after it."""
    # A form feed closes a paragraph's last word; collapsing has left no other.
    closed = F.transform(T.paragraphs(F.col("chapter")), lambda p: F.concat(p, F.lit("\f")))
    split = settle(spread(chapters.select("doc_id", "chapter")), {"w": F.split(F.array_join(closed, " "), " ")}).drop("chapter")
    following = F.concat(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), F.array(F.lit("")))
    paired = F.arrays_zip(F.col("w").alias("word"), following.alias("next"))
    rows = split.filter("w[0] <> ''").select("doc_id", F.posexplode(paired).alias("i", "z"))
    bare = rows.select(
        "doc_id", "i", F.rtrim(F.col("z.word"), F.lit("\f")).alias("word"), F.rtrim(F.col("z.next"), F.lit("\f")).alias("next"),
        F.col("z.word").endswith("\f").alias("last"),
    )
    return bare.select("doc_id", "i", "word", gap_cost(F.col("word"), F.col("next"), F.col("last")).alias("cost"))


def straddle_costs(chapters: DataFrame, sentences_per_piece: int) -> DataFrame:
    """What pieces of whole sentences, cut across paragraphs, pay for what they join.

    4 for every join where a quotation opens or closes; for every paragraph crossed 3 when
    both end in a whole sentence, else 1000.
    """
    # Marks left free by collapsing: newline after a sentence, form feed after a paragraph
    # that ends one, vertical tab after one that does not; tab or return ahead of a
    # paragraph says the same of it to the piece before.
    def mark(p: Column) -> Column:
        ends = T.ends_sentence(F.substring_index(p, " ", -1))
        return F.concat(
            F.when(ends, "\t").otherwise("\r"), T.mark_sentences(p), F.when(ends, "\f").otherwise("\x0b")
        )

    text = F.array_join(F.transform(T.paragraphs(F.col("chapter")), mark), "")
    units = F.regexp_extract_all(text, F.lit("[\\t\\r]?[^\\n\\f\\x0B]+[\\n\\f\\x0B]"), F.lit(0))
    d = settle(spread(chapters.select("doc_id", "chapter")), {"u": units}).drop("chapter")
    following = F.concat(F.slice("u", F.lit(2), F.greatest(F.size("u") - 1, F.lit(0))), F.array(F.lit("")))

    def cost(unit: Column, after: Column) -> Column:
        crossing = (
            F.when(unit.endswith("\n"), 0)
            .when(unit.endswith("\f") & after.startswith("\t"), 3)
            .otherwise(1000)
        )
        quoted = after.rlike('^[\\t\\r]?["“«‘]') | unit.rlike('["”»’][\\n\\f\\x0B]$')
        return F.when(after == "", 0).otherwise(crossing + F.when(quoted, 4).otherwise(0))

    d = settle(d, {"c": F.zip_with("u", following, cost)}).filter("size(u) > 0")
    n = sentences_per_piece
    starts = F.sequence(F.lit(0), F.call_function("div", F.size("c") - 1, F.lit(n)).cast("int"))
    inner = F.transform(starts, lambda k: F.aggregate(
        F.slice("c", k * n + 1, F.lit(max(n - 1, 0))), F.lit(0), lambda a, x: a + x))
    return d.select("doc_id", F.posexplode(inner).alias("piece", "cost"))


#: What a piece pays for two paragraphs that do not both end in a whole sentence, for two that
#: do, and for a quotation that opens or closes inside it.
BROKEN_JOIN, WHOLE_JOIN, QUOTE_JOIN = 1000, 3, 4
#: A word as an integer: characters, cost of a cut after it, and four marks.
_STOPS, _LAST, _WHOLE, _QUOTE = 1, 2, 4, 8
#: All costs are whole numbers of this part of one, as those of ``length_cost_units``.
_UNITS = 326


#: Words of chapters that are searched side by side, with their padding.
_SIDE_BY_SIDE = 1_000_000


def cheapest_cuts(runs: list[np.ndarray], reach: int) -> list[np.ndarray]:
    """Where the pieces of the cheapest cut of each run of words end, as counts of words.

    A run has a row of characters, gap cost and marks for every word. One pass over the words:
    the best cost up to a word is the least, over the last pieces of at most ``reach``
    characters that end there, of the best cost before the piece, its length's cost, the cost
    of the cut and what it joins. Of equal costs the shorter last piece wins. A longer word is
    a piece alone. Runs of about the same length go through the pass side by side, a step for
    all of them at once.
    """
    found: list[np.ndarray] = [np.empty(0, np.int32)] * len(runs)
    order = sorted((i for i, r in enumerate(runs) if len(r)), key=lambda i: -len(runs[i]))
    while order:
        many = max(1, _SIDE_BY_SIDE // len(runs[order[0]]))
        group, order = order[:many], order[many:]
        for i, cuts in zip(group, _cheapest_of([runs[i] for i in group], reach)):
            found[i] = cuts
    return found


def _cheapest_of(runs: list[np.ndarray], reach: int) -> list[np.ndarray]:
    """The cuts of runs that are sorted from the longest to the shortest, none of them empty."""
    sizes = np.array([len(r) for r in runs])
    shape = len(runs), int(sizes[0]) + 1
    # A word's own column is its count; column 0 stands before the first word.
    upto, paid, seen, gaps = (np.zeros(shape, np.int64) for _ in range(4))
    starts_whole, may_end = np.zeros(shape, bool), np.zeros(shape, bool)
    low = np.zeros(shape, np.int32)
    longest = reach
    for d, run in enumerate(runs):
        chars, gap, marks = run.T
        n, stops = len(run), (marks & _STOPS) > 0
        upto[d, 1 : n + 1] = np.cumsum(chars + 1)  # a space after every word
        crossing = np.where(marks & _LAST, BROKEN_JOIN, 0)
        ends = np.flatnonzero(marks & _LAST)
        whole = (marks[ends] & _WHOLE) > 0
        if len(ends) > 1:
            crossing[ends[:-1][whole[:-1] & whole[1:]]] = WHOLE_JOIN
        paid[d, 1 : n + 1] = np.cumsum(np.where(stops, crossing + np.where(marks & _QUOTE, QUOTE_JOIN, 0), 0)) * _UNITS
        seen[d, 1 : n + 1] = np.cumsum(stops)
        gaps[d, 1:n] = gap[:-1] * _UNITS
        starts_whole[d, 0], starts_whole[d, 1 : n + 1] = True, stops
        may_end[d, 1 : n + 1] = stops
        may_end[d, n] = True
        spans = upto[d, : n + 1]
        low[d, 1 : n + 1] = np.minimum(np.searchsorted(spans, spans[1:] - 1 - reach), np.arange(n))
        longest = max(longest, int(chars.max()))
    length = np.arange(longest + 1)
    length = np.where(length * 10 < 489, 4 * (489 - 10 * length) + 8 * np.maximum(326 - 10 * length, 0), 0) + np.where(
        length * 10 > 815, 6 * (10 * length - 815) + 17 * np.maximum(20 * length - 2445, 0), 0)
    best, origin = np.zeros(shape, np.int64), np.zeros(shape, np.int32)
    far = np.iinfo(np.int64).max
    live = len(runs)
    for b in range(1, shape[1]):
        while sizes[live - 1] < b:
            live -= 1
        since = low[:live, b]
        s = int(since.min())
        a = slice(b - 1, s - 1 if s else None, -1)  # from the shortest last piece to the longest
        joined = np.where(starts_whole[:live, a] & may_end[:live, b, None], paid[:live, b - 1, None] - paid[:live, a], BROKEN_JOIN * _UNITS)
        joined[seen[:live, a] == seen[:live, b - 1, None]] = 0
        joined[:, 0] = 0
        spans = upto[:live, b, None] - upto[:live, a] - 1
        costs = best[:live, a] + length.take(spans, mode="clip") + joined
        costs[np.arange(b - 1, s - 1, -1) < since[:, None]] = far
        k = costs.argmin(axis=1)
        best[:live, b] = costs[np.arange(live), k] + gaps[:live, b]
        origin[:live, b] = b - 1 - k
    found = []
    for d, n in enumerate(sizes.tolist()):
        cuts = []
        while n > 0:
            cuts.append(n)
            n = int(origin[d, n])
        found.append(np.array(cuts[::-1], np.int32))
    return found


def cut_cheapest(chapters: DataFrame, max_seconds: float = C.MAX_PIECE_SECONDS) -> DataFrame:
    """Chapters cut where it costs least, in length, in where the cuts fall and in what pieces join.

    The words and their costs are native expressions of the chapter's row, as in ``gap_costs``
    and ``straddle_costs``; only the search itself, over three numbers a word, is a vectorised
    function. Costs are whole numbers, so the answer does not depend on the order of sums.
    """
    reach = int(math.ceil(max_seconds * C.CHARS_PER_SECOND * 3)) + 1
    closed = F.transform(T.paragraphs(F.col("chapter")), lambda p: F.concat(p, F.lit("\f")))
    split = settle(spread(chapters.select("doc_id", "chapter")), {"w": F.split(F.array_join(closed, " "), " ")}).drop("chapter").filter("w[0] <> ''")
    following = F.concat(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), F.array(F.lit("")))

    def measured(marked: Column, after: Column) -> Column:
        word, last = F.rtrim(marked, F.lit("\f")), marked.endswith("\f")
        after = F.rtrim(after, F.lit("\f"))
        ends = ~T.ends_plainly(word) & T.ends_sentence(word)
        flags = F.when(last | ends, _STOPS).otherwise(0) + F.when(last, _LAST).otherwise(0) + F.when(last & ends, _WHOLE).otherwise(0)
        quote = T.opens_quote(after) | T.closes_quote(word)
        return F.array(F.length(word), gap_cost(word, after, last), flags + F.when(quote, _QUOTE).otherwise(0))

    @F.arrow_udf("array<int>")
    def search(words: pa.Array) -> pa.Array:
        offsets, flat = words.offsets.to_numpy(), words.values.values.to_numpy(zero_copy_only=False).reshape(-1, 3).astype(np.int64)
        found = cheapest_cuts([flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])], reach)
        ends = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
        return pa.ListArray.from_arrays(ends, np.concatenate([*found, np.empty(0, np.int32)]).astype(np.int32))

    measured_ = settle(split, {"m": F.zip_with("w", following, measured)})
    d = measured_.select("doc_id", "w", search("m").alias("cuts"))
    starts = F.concat(F.array(F.lit(0)), F.slice("cuts", F.lit(1), F.size("cuts") - 1))
    texts = F.zip_with(starts, "cuts", lambda a, b: F.translate(F.array_join(F.slice("w", a + 1, b - a), " "), "\f", ""))
    rows = d.select("doc_id", F.posexplode(texts).alias("piece", "text"))
    chars = F.length("text").cast("bigint")
    return rows.withColumns({"chars": chars, "seconds": chars / F.lit(C.CHARS_PER_SECOND)})


def number_pieces(pieces: DataFrame, taken: DataFrame) -> DataFrame:
    """Scene names for new pieces, after the numbers each project has already taken.

    ``pieces``: ``project_id, piece, text``; ``taken``: ``project_id, next_scene``.
    """
    from sceneframe.functions import naming as N
    from sceneframe.operators.ordered import numbered, with_totals

    kept = pieces.withColumn("text", T.collapse(F.col("text"))).filter("text <> ''")
    ranked = with_totals(numbered(kept, ["project_id"], ["piece"], "n"), ["project_id"], {"count": F.count(F.lit(1))})
    placed = ranked.join(taken, "project_id", "left").withColumn("start", F.coalesce("next_scene", F.lit(1)))
    last = F.col("start") + F.col("count") - 1
    stem = N.numbered_stem(F.col("start") + F.col("n") - 1, N.number_width(last))
    too_long = F.octet_length("text") > C.MAX_SCRIPT_BYTES
    return placed.select("project_id", "piece", stem.alias("scene_id"), "text", too_long.alias("too_long"))
