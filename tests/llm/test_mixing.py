"""Mixing against the same arithmetic done in Python."""

import math

from sceneframe.llm import mixing


def _weights(tokens, exponent):
    total = sum(tokens.values())
    powers = {s: (n / total) ** exponent for s, n in tokens.items()}
    return {s: p / sum(powers.values()) for s, p in powers.items()}


def _skewed(spark):
    rows = [(i, "w " * (i % 9 + 1), "hot" if i % 3 else f"s{i % 5}") for i in range(1500)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def _check(table, got, most_repeats, evenness):
    tokens, rows = {}, {}
    for r in table.collect():
        n = max(1, len((r.text or "").split()) or 1)
        tokens[r.source] = tokens.get(r.source, 0) + n
    weights = {r.source: r.weight for r in got}
    assert set(weights) == set(tokens) and abs(sum(weights.values()) - 1) < 1e-9
    # The weights are shares to one exponent.
    ratios = sorted((n, weights[s]) for s, n in tokens.items())
    if ratios[0][0] != ratios[-1][0]:
        exponent = math.log(ratios[-1][1] / ratios[0][1]) / math.log(ratios[-1][0] / ratios[0][0])
        want = _weights(tokens, exponent)
        assert all(abs(want[s] - weights[s]) < 1e-6 for s in tokens) and -1e-9 <= exponent <= 1 + 1e-9
        total = sum(tokens.values())
        repeats = max(total * weights[s] / tokens[s] for s in tokens)
        even = -sum(w * math.log(w) for w in weights.values()) / math.log(len(weights))
        assert repeats <= most_repeats + 1e-3
        assert even >= evenness - 1e-3 or abs(repeats - most_repeats) < 1e-2
    budget = {r.source: r.source_budget for r in got}
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.n_tokens
    longest = {s: max(r.n_tokens for r in got if r.source == s) for s in budget}
    assert all(budget[s] <= taken[s] < budget[s] + longest[s] for s in budget)


def test_budgets_are_met_to_a_document(spark):
    table = _skewed(spark)
    for blocks in (1, 7, 64):
        got = mixing.mix(table, most_repeats=1.6, evenness=0.99, blocks=blocks).collect()
        _check(table, got, 1.6, 0.99)
        # A full epoch holds every document of its source once.
        whole = {}
        for r in got:
            whole.setdefault((r.source, r.epoch), []).append(r.doc_id)
        assert all(len(ids) == len(set(ids)) for ids in whole.values())
        sizes = {s: sum(1 for r in table.collect() if r.source == s) for s in {r.source for r in got}}
        assert all(len(ids) == sizes[s] for (s, e), ids in whole.items() if (s, e + 1) in whole)


def test_even_target_wins_where_repeats_allow_it(spark):
    got = mixing.mix(_skewed(spark), most_repeats=50.0, evenness=0.999).collect()
    _check(_skewed(spark), got, 50.0, 0.999)


def test_documents_as_often_as_taken(spark):
    table = _skewed(spark).selectExpr("*", "1 as epoch", "2 as block")
    times = {}
    for r in mixing.mix(table).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    mixed = mixing.mixed_documents(table)
    assert mixed.columns == table.columns
    seen = {}
    for r in mixed.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == times


def test_mixing_hostile_and_empty_tables(hostile, empty):
    got = mixing.mix(hostile, most_repeats=3.0).collect()
    assert {r.source for r in got} == {r.source for r in hostile.collect()}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(hostile).columns == hostile.columns
