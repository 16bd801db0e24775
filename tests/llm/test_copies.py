"""Exact and near duplicates against brute force."""

import hashlib
import re

import pytest
import pyspark.sql.functions as F

from sceneframe.llm import components, near_dedup
from sceneframe.llm.exact_dedup import exact_dedup, keep_winners


def _exact(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    out = []
    for key, text in rows:
        ids = [i for i in groups[text or ""] if i is not None]
        keep = max(ids) if ids else None
        out.append((key, keep, len(groups[text or ""]), key == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_matches_brute_force(docs, hostile):
    for table in (docs, hostile):
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        assert sorted((tuple(r) for r in exact_dedup(table).collect()), key=str) == _exact(rows)


def test_equal_digests_of_different_texts_stay_apart(hostile):
    rows = [(r.doc_id, r.text) for r in hostile.select("doc_id", "text").collect()]
    weak = exact_dedup(hostile, salts=2, digest=lambda t: F.pmod(F.length(t), F.lit(2)).cast("string"))
    assert sorted((tuple(r) for r in weak.collect()), key=str) == _exact(rows)


def test_one_row_of_equal_texts_stays(hostile, empty):
    kept = keep_winners(hostile)
    assert kept.columns == hostile.columns
    assert sorted((r.text or "" for r in kept.collect())) == sorted({r.text or "" for r in hostile.collect()})
    assert keep_winners(empty).count() == 0 and exact_dedup(empty).count() == 0


def _sets(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def _near(rows, n, percent):
    keys = [k for k, _ in rows]
    sets = [_sets(t, n) for _, t in rows]
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                if keys[i] is not None and keys[i] == keys[j]:
                    of[root(i)] = root(j)
                shared = len(sets[i] & sets[j])
                if 100 * shared >= percent * len(sets[i] | sets[j]):
                    of[root(i)] = root(j)
    out = []
    for i in range(len(rows)):
        ids = [keys[j] for j in range(len(rows)) if root(j) == root(i) and keys[j] is not None]
        component = min(ids) if ids else None
        out.append((keys[i], len(sets[i]), component, keys[i] == component))
    return sorted(out, key=str)


def _near_rows(spark, docs):
    """Documents, chains of ever further copies, copies of copies, and a passage many share."""
    words = [f"w{i}" for i in range(400)]
    rows = [(r.doc_id + 1000, r.text) for r in docs.limit(120).collect()]
    chain = list(words[:120])
    for step in range(30):
        chain[(step * 4) % 120] = f"changed{step}"
        rows.append((step, " ".join(chain)))
    rows += [(100 + i, " ".join(words[i : i + 60])) for i in range(0, 40)]
    rows += [(200 + i, " ".join(words[:40] + [f"own{i}x{j}" for j in range(60)])) for i in range(40)]
    rows += [(300 + i, "a b c") for i in range(20)] + [(400, "A b\tC"), (401, "a b"), (402, "a"), (403, None), (404, ""), (None, "a b c"), (405, "a"), (406, "a b c d e f g h i"), (407, "a b c d e f g h")]
    # Near copies without ids, one of them the only bridge between two that have ids; an id with two texts.
    apart = words[200:320]
    rows += [(500, " ".join(apart)), (None, " ".join(apart[:-3] + ["x1", "x2", "x3"])), (501, " ".join(["y1", "y2", "y3"] + apart[3:-3] + ["x1", "x2", "x3"]))]
    rows += [(None, " ".join(f"n{i}" for i in range(100))), (None, " ".join([f"n{i}" for i in range(100)] + ["z"]))]
    rows += [(600, " ".join(f"p{i}" for i in range(50))), (600, " ".join(f"q{i}" for i in range(50))), (601, " ".join([f"q{i}" for i in range(50)] + ["z"])), (600, " ".join(f"p{i}" for i in range(50)))]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


def test_near_matches_brute_force(spark, docs):
    table, rows = _near_rows(spark, docs)
    for n, percent in ((3, 85), (5, 80)):
        got = near_dedup.near_duplicates(table, shingle_words=n, percent=percent)
        assert sorted((tuple(r) for r in got.collect()), key=str) == _near(rows, n, percent)


def test_near_on_hostile_and_empty_tables(hostile, empty):
    rows = [(r.doc_id, r.text) for r in hostile.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in near_dedup.near_duplicates(hostile).collect()), key=str) == _near(rows, 3, 85)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.keep_representatives(hostile)
    assert kept.columns == hostile.columns
    assert near_dedup.keep_representatives(empty).count() == 0


def test_one_row_of_each_group_stays(spark, docs):
    table, rows = _near_rows(spark, docs)
    groups, none = {}, 0
    for r in near_dedup._linked_rows(table, 5, 80, None, near_dedup.ROWS, "doc_id", "text", False).collect():
        none += r.n_shingles == 0
        if r.n_shingles:
            groups.setdefault((r.component_id, bytes(r.chosen_sha)), []).append(r.id)
    kept = [(r.doc_id, r.text) for r in near_dedup.keep_representatives(table, shingle_words=5, percent=80).collect()]
    assert len(kept) == len(groups) + none
    assert sorted((k for k, t in kept if _sets(t, 5)), key=str) == sorted((k for k, _ in groups), key=str)


def test_crowded_buckets_take_rounds_of_leads(spark, monkeypatch):
    """Edited copies of one text, most pairs of them below the limit: every link is found, no pair twice."""
    import random

    rng = random.Random(5)
    base, rows = [f"b{i}" for i in range(150)], []
    for key in range(60):
        words = list(base)
        for place in rng.sample(range(150), rng.choice((3, 4, 5))):
            words[place] = f"e{key}x{place}"
        rows.append((key, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(near_dedup, "LEADS", 1)
    monkeypatch.setattr(near_dedup, "MORE_LEADS", 3)
    got = near_dedup.near_duplicates(table, shingle_words=5, percent=80)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _near(rows, 5, 80)


def test_odd_sketches_keep_alike_pairs_and_weed_out_the_rest():
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    passed = {0.85: [], 0.65: []}
    for similarity, seen in passed.items():
        for size in (7, 20, 180, 900, 1500, 6000, 20_000):
            for _ in range(60):
                shared = math.ceil(size * similarity)
                base = rng.permutation(np.unique(rng.integers(0, 1 << 63, size + 64, dtype=np.uint64) << np.uint64(1)))[:size]
                extra = rng.integers(0, size - shared + 1)
                left, right = np.sort(base[: shared + extra]), np.sort(np.concatenate((base[:shared], base[shared + extra :])))
                with np.errstate(over="ignore"):
                    a, b = near_dedup.odd_sketch(left), near_dedup.odd_sketch(right)
                odd = sum((int(x) & 0xFFFFFFFFFFFFFFFF).bit_count() for x in a ^ b)
                seen.append((size, odd <= near_dedup.most_odd_bits(float(len(left)), float(len(right)), 85, math.exp, math.sqrt)))
    assert all(ok for _, ok in passed[0.85])
    assert not any(ok for size, ok in passed[0.65] if size >= 20)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_components_of_few_links_take_few_tasks_however_many_partitions_there_are(spark, monkeypatch):
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    steps = []

    def settle(df, write=components.settle):
        rows = write(df)
        steps.append(df.rdd.getNumPartitions())
        return rows

    monkeypatch.setattr(components, "settle", settle)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        # A hub above its leaves, a hub below them, a chain downwards and links that are stars at once.
        links = [(50, i) for i in range(40, 50)] + [(100, i) for i in range(101, 140)] + [(i + 1, i) for i in range(200, 220)]
        least = {**{i: 40 for i in range(40, 51)}, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in range(200, 221)}}
        for rows, goal in ((links, least), ([(1, 2), (1, 3), (5, 9)], {1: 1, 2: 1, 3: 1, 5: 5, 9: 5})):
            found = components.connected_components(spark.createDataFrame(rows, "a bigint, b bigint"))
            assert {r.node: r.component for r in found.collect()} == goal
            assert found.rdd.getNumPartitions() < 64
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert steps and max(steps) < 64


def test_bands_follow_from_the_similarity(monkeypatch, hostile):
    assert near_dedup.bands_for(85) == 24
    for percent in (70, 80, 85, 90, 100):
        assert (1 - (percent / 100) ** near_dedup.ROWS) ** near_dedup.bands_for(percent) <= near_dedup.MOST_MISSED
    import corpus_pipeline

    def seen(rows, words, bands, band_rows):
        raise LookupError(bands)

    monkeypatch.setattr(near_dedup, "signatures", seen)
    with pytest.raises(LookupError, match="^38$"):
        corpus_pipeline.distinct_contents(None, hostile, "")
