"""Licence notices: a trained paragraph classifier, confirmed against templates.

Everything here is DataFrame and SQL functions; the classifier is Spark's own logistic
regression over word n-grams, and its weights are applied by a join.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneframe.functions.settle import settle as once
from sceneframe.llm.common import settle

UNKNOWN = "unknown"
#: Bound of the sample of corpus paragraphs that teaches the unknown class.
MOST_NEGATIVES, MOST_CHARS = 2_000, 2_000
#: A family is given where its calibrated probability and template likeness reach these.
LEAST_PROBABILITY, LEAST_LIKENESS = 0.5, 0.6
#: Neighbouring lines that are read as one unit besides lines and blocks; the share of a
#: template's word pairs that a unit of several lines needs; words of a template that is a
#: title, and its least share of a line.
WINDOW_LINES, LEAST_ORDER, TITLE_WORDS, LEAST_FILLED = (2, 3, 4), 0.5, 3, 0.5

#: How each family is announced; the wordings in common use.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "This project is licensed under the terms of the Apache License 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "This software is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3."),
    ("gpl-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "You can redistribute it under the terms of the GNU General Public License version 2 only."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "This library is free software under the terms of the GNU Lesser General Public License."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Use of this source code is governed by a BSD style license."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    # Headers that are put over source files.
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License; either version 2 of the License."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License; either version 2.1 of the License."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, either version 3 of the License."),
    # Titles of the texts.
    ("apache-2.0", "Apache License"),
    ("apache-2.0", "Apache License Version 2.0"),
    ("mit", "MIT License"),
    ("gpl-3.0", "GNU General Public License Version 3"),
    ("gpl-2.0", "GNU General Public License Version 2"),
    ("lgpl", "GNU Lesser General Public License Version 2.1"),
    ("lgpl", "GNU Lesser General Public License Version 3"),
    ("agpl-3.0", "GNU Affero General Public License Version 3"),
    ("bsd", "BSD 3-Clause License"),
    ("bsd", "BSD 2-Clause License"),
    ("mpl-2.0", "Mozilla Public License Version 2.0"),
    ("cc0-1.0", "CC0 1.0 Universal"),
] + [
    (family, f"SPDX-License-Identifier: {name}")
    for family, names in [
        ("apache-2.0", "Apache-2.0"), ("mit", "MIT"), ("gpl-3.0", "GPL-3.0 GPL-3.0-only GPL-3.0-or-later"), ("gpl-2.0", "GPL-2.0 GPL-2.0-only GPL-2.0-or-later"),
        ("lgpl", "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later"), ("agpl-3.0", "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later"),
        ("bsd", "BSD-2-Clause BSD-3-Clause"), ("mpl-2.0", "MPL-2.0"), ("cc-by-nc-4.0", "CC-BY-NC-4.0"), ("cc-by-sa-4.0", "CC-BY-SA-4.0"), ("cc-by-4.0", "CC-BY-4.0"),
        ("cc0-1.0", "CC0-1.0"), ("unlicense", "Unlicense"),
    ]
    for name in names.split()
]

#: Sentences that sound like licences and are none.
NOT_LICENCES = [
    "She got her driving licence in the spring and bought a car.", "The shop lost its licence to sell wine after the new law.",
    "Version 2.0 of the app was released under heavy rain.", "The general public is free to visit the work in the museum.",
    "Copyright is discussed in the third part of the course.", "All rights reserved.", "The source of the river is free of any restriction.",
    "The licensed driver must carry a copy of the document.", "This work is under way and the terms are not agreed.",
    "Members can redistribute the food under the new version of the rules.", "He is a public person with a licence to thrill.",
    "Permission to use the hall is granted by the school.", "The software of the car was released in version 3.",
    "Apache is the name of a people and of a helicopter.", "Students of MIT released a report.", "Mozilla released version 4.0 of its browser.",
]


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and inner points or hyphens."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9.\-]+|[.\-]+(?![a-z0-9])", " "), " +"), lambda w: w != "")


def ngrams(found: Column) -> Column:
    """Distinct runs of one, two and three words."""
    def run(i, n):
        return F.when(F.size(found) >= i + n, F.array_join(F.slice(found, i + 1, n), " "))
    spots = F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)))
    made = F.flatten(F.transform(spots, lambda i: F.array(*[run(i, n) for n in (1, 2, 3)])))
    return F.array_distinct(F.filter(made, lambda g: g.isNotNull() & (g != "")))


def _template_table(spark: SparkSession, templates) -> DataFrame:
    return spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(templates)], "template int, family string, text string").coalesce(1)


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, text`` of every line that is not blank, trimmed."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"\n")).alias("line_no", "text"))
    return lines.withColumn("text", F.trim("text")).filter("text != ''")


def train(docs: DataFrame, templates=TEMPLATES, most_negatives: int = MOST_NEGATIVES, most_chars: int = MOST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple], list[tuple]]:
    """The classifier: rows (n-gram, family, weight) and rows (family, intercept).

    Each template is learned whole and with a fifth of its words left out, five ways. The
    unknown class is taught by a bounded sample of corpus paragraphs that no template's
    words fill by half, and by sentences that only sound like licences. Variants with a
    third of the words left out are kept back; on them and on a quarter of the negatives one
    temperature is chosen that makes the probabilities fit best. The vocabulary is that of
    the templates, so weights do not grow with the corpus.
    """
    spark = docs.sparkSession
    known = _template_table(spark, templates).withColumn("w", words(F.col("text")))
    def left_out(part: int, of: int) -> Column:
        return F.filter("w", lambda w, i: F.pmod(F.xxhash64(w, i, F.lit(of)), F.lit(of)) != part)
    versions = [(F.col("w"), 0)] + [(left_out(i, 5), 0) for i in range(5)] + [(left_out(i, 3), 1) for i in range(3)]
    positive = known.select("family", F.inline(F.array(*[F.struct(v.alias("w"), F.lit(kept).alias("kept")) for v, kept in versions])))
    # The paragraphs of the documents with the smallest hashes: a bounded set of ids.
    ids = docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64(F.lit("negative"), "id"), "id").limit(most_negatives)
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    lines = paragraphs(some, "id", "text").filter(F.length("text") <= most_chars)
    rank = F.xxhash64(F.lit("negative"), "text")
    drawn = settle(lines.select("text", rank.alias("rank")).orderBy("rank", "text").limit(2 * most_negatives)).dropDuplicates(["text"])
    every = F.array(*[F.lit(w) for w in sorted({w for row in known.select("w").collect() for w in row["w"]})])
    plain = drawn.withColumn("w", words(F.col("text"))).filter(2 * F.size(F.array_intersect("w", every)) < F.size(F.array_distinct("w")) + 1)
    negative = plain.orderBy("rank", "text").limit(most_negatives).select("w", (F.pmod("rank", F.lit(4)) == 0).cast("int").alias("kept"))
    sounding = spark.createDataFrame([(t,) for t in NOT_LICENCES], "text string").coalesce(1).select(words(F.col("text")).alias("w"), F.lit(0).alias("kept"))
    rows = positive.select("family", "w", "kept").unionByName(negative.unionByName(sounding).withColumn("family", F.lit(UNKNOWN)))
    families = sorted({f for f, _ in templates}) + [UNKNOWN]
    codes = F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f), F.lit(float(i)))])
    ready = settle(rows.select("family", codes[F.col("family")].alias("label"), ngrams(F.col("w")).alias("grams"), "kept").coalesce(1))
    grams = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0, vocabSize=8192).fit(ready.filter((F.col("family") != UNKNOWN) & (F.col("kept") == 0)))
    sizes = {r["family"]: r["count"] for r in ready.groupBy("family").count().collect()}
    even = F.create_map(*[x for f in families for x in (F.lit(f), F.lit(math.sqrt(1.0 / max(1, sizes.get(f, 1)))))])
    fitted = LogisticRegression(regParam=2e-4, maxIter=60, family="multinomial", weightCol="weight", standardization=False).fit(
        grams.transform(ready.filter("kept = 0")).withColumn("weight", even[F.col("family")])
    )
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    weights = [(g, families[c], float(matrix[c, i])) for i, g in enumerate(grams.vocabulary) for c in range(len(families)) if abs(matrix[c, i]) > 1e-6]
    biases = [(f, float(intercepts[c])) for c, f in enumerate(families)]
    kept_back = ready.filter("kept = 1").withColumn("id", F.monotonically_increasing_id())
    scale = _temperature(kept_back, weights, biases)
    return [(g, f, w * scale) for g, f, w in weights], [(f, b * scale) for f, b in biases]


def _temperature(rows: DataFrame, weights: list[tuple], biases: list[tuple]) -> float:
    scores = settle(_scores(rows.select("id", "grams", F.col("family").alias("truth")), weights, biases, ["id", "truth"]))
    best = (math.inf, 1.0)
    for scale in (0.5, 0.7, 1.0, 1.4, 2.0):
        loss = scores.select(F.avg(
            -F.aggregate(F.filter("scores", lambda s: s["family"] == F.col("truth")), F.lit(0.0), lambda a, s: a + s["score"]) * scale
            + F.ln(F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s["score"] * scale)))
        ).alias("loss")).first()["loss"]
        if loss is not None:
            best = min(best, (loss, scale))
    return best[1]


def _scores(rows: DataFrame, weights: list[tuple], biases: list[tuple], keys: list[str]) -> DataFrame:
    """``scores`` (family, score) of every row; weights come in by a join on the n-gram."""
    spark = rows.sparkSession
    # At most 8192 n-grams times the families: bounded by the templates, not by the corpus.
    table = spark.createDataFrame(weights or [("", UNKNOWN, 0.0)], "gram string, family string, weight double").coalesce(1).groupBy("gram").agg(
        F.collect_list(F.struct("family", "weight")).alias("of")
    )
    hit = rows.select(*keys, F.explode("grams").alias("gram")).join(F.broadcast(table), "gram").select(*keys, F.inline("of"))
    summed = hit.groupBy(*keys, "family").agg(F.sum("weight").alias("score"))
    gathered = summed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("family", "score"))).alias("by"))
    out = rows.select(*keys).join(gathered, keys, "left")
    return out.select(*keys, F.array(*[
        F.struct(F.lit(f).alias("family"), (F.coalesce(F.col("by")[f], F.lit(0.0)) + b).alias("score")) for f, b in biases
    ]).alias("scores"))


#: Words too common to look for while others will do.
_COMMON = frozenset("this under with that from which work version free public following terms general you may use the of in and or to is by are not be it any can".split())


def anchors(templates=TEMPLATES, least: float = LEAST_LIKENESS, hits: int = 1) -> list[str]:
    """Words of which everything that shares ``least`` of some template's words has ``hits`` at least.

    Words are added, those of most templates first and common ones last, until what such a
    text must share with a template is, but for ``hits``, more than the template has left.
    A template that asks for fewer words than ``hits`` gives all of its words.
    """
    of = [set(re.findall(r"[a-z0-9]+(?:[.\-]+[a-z0-9]+)*", t.lower())) for _, t in templates]
    asked = [next(n for n in range(len(t) + 1) if n / len(t) >= least) for t in of]
    chosen: set[str] = set()
    while True:
        short = [t for t, n in zip(of, asked) if len(t - chosen) > max(0, n - hits)]
        if not short:
            return sorted(chosen)
        gain = Counter(w for t in short for w in t - chosen)
        chosen.add(min(gain, key=lambda w: (w in _COMMON or len(w) < 3, -gain[w], w)))


def told_apart(words_in: list[str], templates=TEMPLATES) -> tuple[list[str], list[str]]:
    """A part between points and hyphens of every anchor, and those parts that count for two.

    Anchors of one template get parts of their own, the longest that is left, so a text with
    two anchors of a template has two parts. Where there is none left, the part counts for two.
    """
    of = [set(re.findall(r"[a-z0-9]+(?:[.\-]+[a-z0-9]+)*", t.lower())) for _, t in templates]
    given: dict[str, str] = {}
    twice: set[str] = set()
    for word in words_in:
        beside = {given[w] for t in of if word in t for w in t if w in given}
        parts = sorted(re.split(r"[.\-]+", word), key=lambda p: (-len(p), p))
        free = [p for p in parts if p not in beside]
        given[word] = (free or parts)[0]
        if not free:
            twice.add(parts[0])
    return sorted(set(given.values())), sorted(twice)


def _pairs(found: Column) -> Column:
    return F.zip_with(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


#: What parts words, as in `words`.
_BETWEEN = r"(?:[^a-z0-9.\-]+|[.\-]+(?![a-z0-9]))+"


def units(rows: DataFrame, long: list[str], short: list[str], alone: list[str], every: Column) -> DataFrame:
    """``id, doc, line_no, n_lines, w, known`` of what is read as one notice.

    A line is read if it holds two of the ``long`` or two of the ``short`` anchors or one of
    ``alone``; 2 to 4 neighbouring lines, blank ones left out of the count, and a longer
    block between lines without a letter or digit, if they hold two long ones. ``w`` are the
    words and ``known`` those of ``every``; ``doc`` is the sha256 of the whole text. A text is
    split into lines and these into words once; all units of a row come out of one array.
    """
    def among(found: Column, of: list[str]) -> Column:
        return F.array_distinct(F.filter(found, lambda w: w.isin(of or [""])))

    whole = once(rows, {"_words": F.transform(F.split("text", r"\n"), lambda t: F.split(F.lower(t), _BETWEEN))})
    hits = F.transform("_words", lambda w: F.struct(among(w, long).alias("long"), (
        (F.size(among(w, short)) > 1) | F.exists(w, lambda x: x.isin(alone or [""]))).alias("short")))
    whole = once(whole, {"_hits": hits})
    whole = whole.filter(F.exists("_hits", lambda h: h["short"]) | (F.size(F.array_distinct(F.flatten(F.transform("_hits", lambda h: h["long"])))) > 1))
    whole = once(whole, {"doc": F.sha2("text", 256), "_lines": F.split("text", r"\n")}).drop("text")
    told = F.transform(F.arrays_zip("_lines", "_words", "_hits"), lambda x, i: F.struct(
        i.alias("at"), x["_lines"].rlike("[A-Za-z0-9]").alias("full"), F.filter(x["_words"], lambda w: w != "").alias("w"), x["_hits"]["long"].alias("long"), x["_hits"]["short"].alias("short")))
    whole = once(whole, {"_told": told}).drop("_lines", "_words", "_hits")
    single = F.transform(
        F.filter("_told", lambda x: x["short"] | (F.size(x["long"]) > 1)), lambda x: F.struct(x["at"].alias("line_no"), F.lit(1).alias("n_lines"), x["w"].alias("w")))

    whole = once(whole, {"_single": single, "_full": F.filter("_told", lambda x: x["full"])}).drop("_told")
    spots = F.filter(F.transform("_full", lambda x, i: F.when(F.size(x["long"]) > 0, i)), lambda i: i.isNotNull())
    # A block begins at a line that the one before does not reach, and ends where the next begins.
    opens = F.filter(F.transform("_full", lambda x, i: F.when((i == 0) | (F.get("_full", i - 1)["at"] < x["at"] - 1), i)), lambda i: i.isNotNull())
    whole = once(whole, {"_spots": spots, "_opens": opens, "_size": F.size("_full")})

    def around(i: Column, n: int) -> Column:
        return F.transform(F.sequence(i - n + 1, i), lambda f: F.struct(f.alias("first"), F.lit(n).alias("n")))

    windows = F.array_distinct(F.flatten(F.transform("_spots", lambda i: F.flatten(F.array(*[around(i, n) for n in WINDOW_LINES])))))
    windows = F.filter(windows, lambda w: (w["first"] >= 0) & (w["first"] + w["n"] <= F.col("_size")))
    blocks = F.filter(
        F.transform("_opens", lambda f, i: F.struct(f.alias("first"), (F.coalesce(F.get("_opens", i + 1), F.col("_size")) - f).alias("n"))),
        lambda w: w["n"] > WINDOW_LINES[-1],
    )
    cuts = F.filter(F.concat(windows, blocks), lambda w: F.size(F.array_distinct(F.flatten(F.transform(F.slice("_full", w["first"] + 1, w["n"]), lambda x: x["long"])))) > 1)

    def unit(w: Column) -> Column:
        first, last = F.get("_full", w["first"])["at"], F.get("_full", w["first"] + w["n"] - 1)["at"]
        return F.struct(first.alias("line_no"), (last - first + 1).alias("n_lines"), F.flatten(F.transform(F.slice("_full", w["first"] + 1, w["n"]), lambda x: x["w"])).alias("w"))

    found = whole.select("id", "doc", F.inline(F.concat("_single", F.transform(cuts, unit))))
    return once(found, {"known": F.array_intersect("w", every)})


def _apart(found: Column) -> Column:
    """Units, best first, without those that overlap one taken before."""
    def free(taken: Column, u: Column) -> Column:
        return ~F.exists(taken, lambda t: (t["line_no"] < u["line_no"] + u["n_lines"]) & (u["line_no"] < t["line_no"] + t["n_lines"]))
    return F.aggregate(found, F.filter(found, lambda u: F.lit(False)), lambda taken, u: F.when(free(taken, u), F.concat(taken, F.array(u))).otherwise(taken))


def scan_licences(docs: DataFrame, templates=TEMPLATES, model: tuple[list[tuple], list[tuple]] | None = None, least_probability: float = LEAST_PROBABILITY, least_likeness: float = LEAST_LIKENESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id of ``docs``: ``family``, ``probability``, ``likeness``, ``notices``.

    Lines, windows of 2 to 4 lines and blocks (`units`) that hold two anchor words (`anchors`:
    without them no template confirms the unit) and share at least ``least_likeness`` of some
    template's words are scored by their n-grams; softmax gives each family and the unknown
    class a probability. The best family counts where it beats the unknown class, reaches
    ``least_probability`` and is that of such a template. A unit of several lines needs half
    of the template's word pairs too, so that long texts do not gather a template's words by
    chance; a template of up to three words confirms only a line that it fills by half. Of
    units that overlap the likest counts, the shorter one if they are alike, and blocks last. ``notices`` lists (line_no, family,
    probability, likeness) by first line; the other columns are those of the likeliest
    notice, ``unknown``, null and null without any. The texts without anchors are read
    once and never moved.

    Null and empty texts have no notice. Rows that repeat an id are put together under it;
    null ids under one null row. Other columns are ignored; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    weights, biases = model or train(docs, templates, id_col=id_col, text_col=text_col)
    sized = [(t, len(set(re.findall(r"[a-z0-9]+(?:[.\-]+[a-z0-9]+)*", t[1].lower())))) for t in templates]
    # Titles are for lines alone; a title of one word is its own anchor.
    long = anchors([t for t, n in sized if n > TITLE_WORDS], least_likeness, hits=2)
    short = anchors([t for t, n in sized if 1 < n <= TITLE_WORDS], least_likeness, hits=2)
    alone = anchors([t for t, n in sized if n == 1], least_likeness)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The templates are few: their words are constants, so a unit is confirmed where it is read.
    known = [(r["family"], r["w"]) for r in _template_table(spark, templates).withColumn("w", words(F.col("text"))).collect()]
    every = F.array(*[F.lit(w) for w in sorted({w for _, of in known for w in of})])
    pairs = F.array(*[F.lit(g) for g in sorted({f"{a} {b}" for _, of in known for a, b in zip(of, of[1:])} | {""})])
    of = F.array(*[
        F.struct(
            F.lit(f).alias("family"), F.array(*[F.lit(x) for x in dict.fromkeys(w)]).alias("words"),
            F.array(*[F.lit(x) for x in dict.fromkeys([f"{a} {b}" for a, b in zip(w, w[1:])] or w)]).alias("pairs"),
        ) for f, w in known
    ])
    # Whole texts first, by parts of the anchors: most texts have no two and are not cut into lines.
    parts, twice = told_apart(sorted({*long, *short}), templates)
    enough = sorted({*twice, *told_apart(alone, templates)[0]})
    pieces = F.split(F.lower("text"), "[^a-z0-9]+")
    held = F.array_intersect(pieces, F.array(*[F.lit(p) for p in sorted({*parts, *enough})]))
    # One split a text: what it holds is at most as many words as there are anchors.
    likely_rows = once(rows, {"_held": held}).filter(
        (F.size("_held") > 1) | F.arrays_overlap("_held", F.array(*[F.lit(p) for p in enough or [""]]))).drop("_held")
    cut = units(likely_rows, long, short, alone, every)
    shared = F.transform(of, lambda t: F.struct(t["family"].alias("family"), F.size(F.array_intersect(t["words"], F.col("known"))).alias("n"), F.size(t["words"]).alias("of"), t["pairs"].alias("pairs")))
    cut = once(cut, {"_like": F.filter(shared, lambda t: t["n"] / t["of"] >= least_likeness)}).filter("size(_like) > 0")
    cut = once(cut, {"_pairs": F.when(F.col("n_lines") > 1, F.array_intersect(_pairs(F.col("w")), pairs)), "_size": F.size(F.array_distinct("w"))})
    holds = F.filter("_like", lambda t: F.when(
        F.col("n_lines") > 1, (t["of"] > TITLE_WORDS) & (F.size(F.array_intersect(t["pairs"], F.col("_pairs"))) >= LEAST_ORDER * F.size(t["pairs"]))
    ).otherwise((t["of"] > TITLE_WORDS) | (t["n"] >= LEAST_FILLED * F.col("_size"))))
    cut = once(cut, {"like": F.transform(holds, lambda t: F.struct(t["family"].alias("family"), (t["n"] / t["of"]).alias("likeness")))}).filter("size(like) > 0")
    # Units of one row are told apart by number, those of repeated ids by their text as well.
    key = F.struct("id", "doc", "line_no", "n_lines")
    cut = settle(cut.select(key.alias("key"), "w", "like").dropDuplicates(["key"]))
    scored = _scores(cut.select("key", ngrams(F.col("w")).alias("grams")), weights, biases, ["key"])
    top = F.array_max(F.transform("scores", lambda s: s["score"]))
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s["score"] - top))
    best = F.array_max(F.transform("scores", lambda s: F.struct(s["score"].alias("score"), s["family"].alias("family"))))
    likely = scored.select("key", best["family"].alias("family"), (F.lit(1.0) / total).alias("probability")).filter(
        (F.col("family") != UNKNOWN) & (F.col("probability") >= least_probability)
    )
    likeness = F.array_max(F.transform(F.filter("like", lambda t: t["family"] == F.col("family")), lambda t: t["likeness"]))
    confirmed = likely.join(cut.select("key", "like"), "key").withColumn("likeness", likeness).filter("likeness is not null")
    ranked = F.struct(
        (F.col("key.n_lines") > WINDOW_LINES[-1]).alias("block"), (-F.col("likeness")).alias("unlike"), F.col("key.n_lines").alias("n_lines"),
        (-F.col("probability")).alias("unlikely"), F.col("key.line_no").alias("line_no"), F.col("family"), F.col("probability"), F.col("likeness"),
    )
    per_row = confirmed.groupBy(F.col("key.id").alias("_id"), F.col("key.doc").alias("doc")).agg(F.sort_array(F.collect_list(ranked)).alias("found"))
    notice = F.struct("line_no", "family", "probability", "likeness")
    notices = per_row.select("_id", F.inline(_apart(F.col("found")))).select("_id", "line_no", "family", "probability", "likeness").distinct()
    by_id = notices.groupBy("_id").agg(F.sort_array(F.collect_list(notice)).alias("notices"), F.max(F.struct("probability", "likeness", "family")).alias("top"))
    ids = rows.select("id").distinct()
    return ids.join(by_id, ids["id"].eqNullSafe(by_id["_id"]), "left").select(
        F.col("id").alias(id_col), F.coalesce("top.family", F.lit(UNKNOWN)).alias("family"), F.col("top.probability").alias("probability"),
        F.col("top.likeness").alias("likeness"),
        F.coalesce("notices", F.array().cast("array<struct<line_no:int,family:string,probability:double,likeness:double>>")).alias("notices"),
    )
