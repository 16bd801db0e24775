"""The cheapest cut against a search over every cut, with costs worked out word by word."""

import random
import re

import pytest

from sceneframe.operators import chapters

OPENERS = "and but or so then when while as because though although until before after where which".split()
CLOSING = "\"')]»”’*_"


def _ends_sentence(word):
    bare = word.rstrip(CLOSING)
    if not bare or bare[-1] not in ".!?…":
        return False
    stem = bare[:-1] if bare.endswith(".") else None
    return not (stem is not None and (stem.lower() in ("mr", "dr", "etc") or len(stem) == 1 and stem.isupper()))


def _gap(words, breaks, i, dangling):
    if breaks[i]:
        return 0
    word, bare = words[i], words[i].rstrip(CLOSING)
    if _ends_sentence(word):
        base = 0
    elif bare and (bare[-1] in ",;:—–"):
        base = 2 if bare.endswith(",") else 1
    elif words[i + 1].lower() in OPENERS:
        base = 3
    else:
        base = 25
    return base + (20 if word.lower() in dangling else 0)


def _length(chars):
    seconds = chars / 16.3
    cost = 0.0
    if seconds < 3:
        cost += 2 * (3 - seconds) + 4 * max(2 - seconds, 0)
    if seconds > 5:
        cost += 3 * (seconds - 5) + 17 * max(seconds - 7.5, 0)
    return cost


def _straddle(words, breaks, a, b):
    stops = [breaks[i] or _ends_sentence(words[i]) for i in range(len(words))]
    inside = [i for i in range(a, b - 1) if stops[i]]
    if not inside:
        return 0
    if not ((a == 0 or stops[a - 1]) and (b == len(words) or stops[b - 1])):
        return 1000
    ends = [i for i, x in enumerate(breaks) if x]
    cost = 0
    for i in inside:
        if breaks[i]:
            following = next(e for e in ends if e > i)
            cost += 3 if _ends_sentence(words[i]) and _ends_sentence(words[following]) else 1000
        if words[i + 1][0] in '"“«‘' or words[i][-1] in '"”»’':
            cost += 4
    return cost


def _cost(words, breaks, ends, dangling):
    total, a = 0.0, 0
    for b in ends:
        total += _length(len(" ".join(words[a:b]))) + (0 if b == len(words) else _gap(words, breaks, b - 1, dangling)) + _straddle(words, breaks, a, b)
        a = b
    return total


def _every_cut(n):
    for mask in range(1 << (n - 1)):
        yield [i + 1 for i in range(n - 1) if mask >> i & 1] + [n]


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    vocabulary = ["extraordinarily", "lighthouse", "the", "and", "keeper,", "walked;", "slowly", "home.", "Mr.", "“Stop!”", "which", "shore.", "of", "said", "\"Now", "then.", "overwhelming", "A."]
    out = []
    for key in range(60):
        paragraphs = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 8))] for _ in range(rng.choice((1, 1, 2, 3)))]
        while sum(map(len, paragraphs)) > 13:
            paragraphs.pop()
        if paragraphs:
            out.append((key, paragraphs))
    return out


def test_no_cut_is_cheaper(spark, made):
    from sceneframe import constants as C

    dangling = set(C.DANGLING_WORDS)
    df = spark.createDataFrame([(k, "\n\n".join(" ".join(p) for p in ps)) for k, ps in made], "doc_id long, chapter string")
    got = {}
    for r in chapters.cut_cheapest(df).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    packed = {}
    for r in chapters.cut_time(df).orderBy("doc_id", "piece").collect():
        packed.setdefault(r["doc_id"], []).append(r["text"])
    assert set(got) == {k for k, _ in made}
    for key, paragraphs in made:
        words = [w for p in paragraphs for w in p]
        breaks = [i == len(p) - 1 for p in paragraphs for i in range(len(p))]

        def cost_of(pieces):
            ends, at = [], 0
            for piece in pieces:
                at += len(piece.split(" "))
                ends.append(at)
            assert " ".join(pieces).split(" ") == words
            return _cost(words, breaks, ends, dangling)

        least = min(_cost(words, breaks, ends, dangling) for ends in _every_cut(len(words)))
        assert cost_of(got[key]) == pytest.approx(least), (key, got[key])
        assert cost_of(got[key]) <= cost_of(packed[key]) + 1e-9


def test_hostile_chapters(spark):
    rows = [(1, None), (2, ""), (3, " \n\n \n"), (4, "x" * 1000), (5, "a " * 3000), (6, "…\n\nword"), (None, "Two. Sentences here.")]
    df = spark.createDataFrame(rows, "doc_id long, chapter string").selectExpr("*", "'x' as w", "1 as cuts", "2 as piece")
    pieces = {}
    for r in chapters.cut_cheapest(df).orderBy("piece").collect():
        pieces.setdefault(r["doc_id"], []).append(r["text"])
    assert set(pieces) == {4, 5, 6, None}
    assert pieces[4] == ["x" * 1000] and " ".join(pieces[5]) == ("a " * 3000).strip() and max(map(len, pieces[5])) < 130
    assert all(re.search(r"\w", p) for ps in pieces.values() for p in ps)
    assert chapters.cut_cheapest(df.limit(0)).count() == 0
