"""Quality, toxicity, pages and licences: held-out accuracy, exact search, hostile input."""

import math
import random
import re

import numpy as np
import pytest

from sceneframe.llm import html_text, licences, quality, toxicity

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


@pytest.mark.parametrize("scored, label, least", [(quality.quality, "quality", 0.95), (toxicity.toxicity, "toxic", 0.97)])
def test_held_out_accuracy(labelled, scored, label, least):
    docs, labels = labelled
    rows = scored(docs, labels).join(labels, "doc_id").filter("held_out").select("predicted", label, "score").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r[0] == r[1] for r in rows) / len(rows) >= least


@pytest.mark.parametrize("scored", [quality.quality, toxicity.toxicity])
def test_models_on_hostile_and_empty_tables(spark, labelled, hostile, empty, scored):
    docs, labels = labelled
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (1, 7, -1)], labels.schema))
    assert scored(hostile, odd).count() == hostile.count()
    assert scored(hostile, labels.limit(0)).filter("score is null or score < 0 or score > 1").count() == 0
    assert scored(empty, labels).count() == 0
    assert scored(hostile.filter("doc_id is null"), labels).filter("not held_out").count() == 2


def test_keep_good_keeps_columns(labelled, hostile):
    docs, labels = labelled
    kept = quality.keep_good(docs, docs, labels)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in quality.quality(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == good
    assert quality.keep_good(hostile, docs, labels).columns == hostile.columns


def test_block_max_search_is_exact():
    rng = random.Random(4)
    def unit(k):
        spots = np.array(sorted(rng.sample(range(40), k)), np.int64)
        weights = np.array([rng.choice([0.5, 1.0, rng.random()]) for _ in spots])
        return spots, weights / math.sqrt(weights @ weights) if k else weights
    vectors = [unit(rng.randint(0, 6)) for _ in range(300)]
    index = toxicity.BlockMaxIndex(vectors, 40, block=16)
    for _ in range(100):
        spots, weights = unit(rng.randint(0, 5))
        query = dict(zip(spots.tolist(), weights.tolist()))
        scores = [(-sum(query.get(t, 0.0) * w for t, w in zip(s.tolist(), v.tolist())), i) for i, (s, v) in enumerate(vectors)]
        want = sorted((round(s, 9), i) for s, i in scores if s < 0)[:10]
        got = [(round(-s, 9), i) for s, i in index.nearest(spots, weights, 10)]
        assert [s for s, _ in got] == [s for s, _ in want]


def test_two_anchors_of_a_template_have_two_parts():
    import re

    words = sorted({*licences.anchors(hits=2)})
    parts, twice = licences.told_apart(words)
    for _, text in licences.TEMPLATES:
        of = set(re.findall(r"[a-z0-9]+(?:[.\-]+[a-z0-9]+)*", text.lower()))
        asked = next(n for n in range(len(of) + 1) if n / len(of) >= licences.LEAST_LIKENESS)
        # Whatever words of the template a text shares, it shares two anchors, so two parts or one that counts for two.
        assert len(of - set(words)) <= max(0, asked - 2)
        for a in of & set(words):
            for b in of & set(words) - {a}:
                held = {p for w in (a, b) for p in re.split(r"[.\-]+", w)} & {*parts, *twice}
                assert len(held) > 1 or held & set(twice)


def test_neighbours_are_those_of_the_cosine_over_all_words(labelled):
    """Evidence against a plain dictionary cosine over every word, frequencies counted over all documents."""
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    df = {}
    for text in texts.values():
        for w in set(toxicity.terms(text)):
            df[w] = df.get(w, 0) + 1
    inside = [texts[i] for i in model.ids]
    assert set(model.places) == {w for t in inside for w in toxicity.terms(t)}
    ties = toxicity._label_weights([(0, t, int(y)) for t, y in zip(inside, model.marks)], model.places)

    def weighed(text):
        counts = {}
        for w in toxicity.terms(text):
            if w in model.places:
                counts[w] = counts.get(w, 0) + 1
        made = {w: (1 + math.log(n)) * (math.log((len(texts) + 1) / (df[w] + 1)) + 1) * ties[model.places[w]] for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in made.values()))
        return {w: x / norm for w, x in made.items()}

    examples = [weighed(t) for t in inside]
    got = {r.doc_id: [e.cosine for e in r.evidence] for r in toxicity.toxicity(docs, labels).select("doc_id", "evidence").collect()}
    for key in sorted(texts)[:60]:
        query = weighed(texts[key])
        want = sorted((sum(x * e.get(w, 0.0) for w, x in query.items()) for e in examples), reverse=True)[:3]
        assert got[key] == pytest.approx([x for x in want if x > 0], abs=1e-9)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a> Site</header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice">We use cookies on this site for this and that.</div>
<article><h1>Fish &amp; chips&nbsp;today</h1><p>First  <b>para</b>graph
of text.<br>Same block.<p>Second &#233;&lt;p&gt; one.</p><!-- gone <p>gone</p> --><script>var t="</p>";</script>
<aside>Buy this</aside><p>Short.</p><section id="comments"><p>I am a reader and I write a long comment on it.</p></section></article>
<form><label>Name</label><input></form><footer>&copy; us</footer></body></html>"""


def test_main_text_of_a_page():
    tree = html_text.grow_tree(html_text.LABELLED)
    assert html_text.main_text(PAGE, tree) == "Fish & chips today\nFirst paragraph of text. Same block.\nSecond é<p> one.\nShort."
    for stop in range(0, len(PAGE), 7):  # cut anywhere
        html_text.main_text(PAGE[:stop], tree)
    plain = "<div><a href=1>a</a> <a href=2>b</a></div><h2>A title of it</h2><p>" + "word " * 40 + "</p><p>Short one.</p><p>" + "more " * 30 + "</p><div><a href=3>c</a></div>"
    assert html_text.main_text(plain, tree).startswith("A title of it\nword word")
    for odd in ("", "<", "<p", "a < b", "<a b=\"c>d", "</p></div>", "<script>", "<!--", "<![CDATA[x]]>", "<p class='>'>x</p>", "<" * 5000, "<p>" * 5000):
        html_text.main_text(odd, tree)


def test_every_labelled_block_is_learned():
    tree = html_text.grow_tree(html_text.LABELLED)
    wrong = 0
    for row in html_text.LABELLED:
        node = tree
        while not isinstance(node, int):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        wrong += node != row[-1]
    assert wrong <= 2


def test_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (1, "u", "")], "page_id bigint, url string, html string")
    found = html_text.extract_text(pages).collect()
    assert len(found) == pages.count() and all(r.n_chars == len(r.text) for r in found)
    assert sorted(r.n_chars for r in html_text.extract_text(odd).collect())[:2] == [0, 0]
    assert html_text.extract_text(odd.limit(0)).count() == 0


def test_licences(spark, labelled, hostile, empty):
    docs, _ = labelled
    model = licences.train(docs)
    notices = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "released under the mit license": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "the driver is licensed": "unknown", "general public": "unknown",
        "Version 2.0 was released under the sun.": "unknown",
    }
    table = spark.createDataFrame([(i, f"Some text.\n  {t}\nMore text.") for i, t in enumerate(notices)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licences.scan_licences(table, model=model).collect()}
    assert [got[i].family for i in range(len(notices))] == list(notices.values())
    assert got[0].notices[0].line_no == 1 and got[4].notices == []
    # Every corpus line that is a notice is found, and nothing else.
    lines = {"Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."}
    want = {r.doc_id for r in docs.collect() if any(x.strip() in lines for x in r.text.split("\n"))}
    assert {r.doc_id for r in licences.scan_licences(docs, model=model).filter("family != 'unknown'").collect()} == want
    assert licences.scan_licences(hostile, model=model).count() == hostile.select("doc_id").distinct().count()
    assert licences.scan_licences(empty, model=model).count() == 0


def test_no_template_confirms_a_line_without_an_anchor():
    marks = set(licences.anchors())
    assert len(marks) < 60 and not marks & {"the", "of", "is", "in", "this", "to"}
    for _, text in licences.TEMPLATES:
        of = set(re.findall(r"[a-z0-9]+(?:[.\-]+[a-z0-9]+)*", text.lower()))
        assert len(of - marks) < licences.LEAST_LIKENESS * len(of)


WRAPPED = {
    "Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.": "mit",
    "#include <x.h>\n/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\nint main;": "gpl-3.0",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions keep this.": "bsd",
    "Permission is hereby granted,\nfree of charge, to any person\nobtaining a copy of this software\nand associated documentation\nfiles, to deal in the Software\nwithout restriction.": "mit",
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/": "apache-2.0",
    "MIT License\n\nCopyright (c) 2021 Someone": "mit",
    "// SPDX-License-Identifier: Apache-2.0\nint main;": "apache-2.0",
    "# SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0",
    "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007": "gpl-3.0",
    "the driver has\na license that the\ngeneral public can see": "unknown",
    "She took a general view of the public and went\nto the software fair without any\npermission of the school": "unknown",
}


def test_licences_over_several_lines(spark, labelled):
    model = licences.train(labelled[0])
    table = spark.createDataFrame(list(enumerate(WRAPPED)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in licences.scan_licences(table, model=model).collect()}
    assert [got[i].family for i in range(len(WRAPPED))] == list(WRAPPED.values())
    # Two notices of one row are two, and a notice is told once.
    first, second = list(WRAPPED)[0], list(WRAPPED)[2]
    both = spark.createDataFrame([(1, f"{first}\n\n{second}"), (1, f"{first}\n\n{second}"), (2, "x\nReleased under the MIT License.\ny")], "doc_id bigint, text string")
    got = {r.doc_id: [n.family for n in r.notices] for r in licences.scan_licences(both, model=model).collect()}
    assert got == {1: ["mit", "bsd"], 2: ["mit"]}


ARTICLE = "<article><h1>A title</h1><p>" + "word " * 40 + "end.</p></article>"


@pytest.mark.parametrize("tag", ["button", "select", "object", "canvas", "audio", "video", "svg", "math", "iframe", "noscript", "template"])
def test_an_unclosed_element_hides_no_text(tag):
    tree = html_text.grow_tree(html_text.LABELLED)
    for page in (f"<body><{tag}>Share{ARTICLE}", f"<body><{tag} class=x>{ARTICLE}<p>more</p><{tag}>gone</{tag}>"):
        assert html_text.main_text(page, tree).endswith("end."), page
    closed = html_text.main_text(f"<article><p>{'word ' * 30}</p><{tag}><{tag}>gone</{tag}>gone</{tag}><p>kept too</p></article>", tree)
    assert "gone" not in closed and closed.endswith("kept too")


@pytest.mark.parametrize("wrapper", ["div class='has-sidebar'", "div class='page-with-sidebar'", "div class='no-footer'", "div class='search-results'", "form id=aspnetForm"])
def test_a_wrapper_around_the_page_is_not_boilerplate(wrapper):
    tree = html_text.grow_tree(html_text.LABELLED)
    name = wrapper.split()[0]
    for inside in (ARTICLE, f"<main>{ARTICLE}</main>", f"<div><p>{'word ' * 40}</p><p>{'word ' * 30}end.</p></div>"):
        page = f"<body><{wrapper}><nav><a href=/>Home</a></nav>{inside}<footer>about us</footer></{name}>"
        text = html_text.main_text(page, tree)
        assert text.endswith("end.") and "Home" not in text, page
    head = f"<article><header class='entry-header'><h1>A title</h1></header><p>{'word ' * 30}</p><div class=comments><p>{'talk ' * 90}</p></div></article>"
    text = html_text.main_text(head, tree)
    assert text.startswith("A title") and "talk" not in text
    aside = f"{ARTICLE}<aside><article><p>{'other ' * 60}</p></article></aside><div id=comments><article class='comment'><p>{'talk ' * 90}</p></article></div>"
    text = html_text.main_text(aside, tree)
    assert text.endswith("end.") and "other" not in text and "talk" not in text
