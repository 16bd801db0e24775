"""Fingerprints and edited texts against a plain walk through the table."""

import hashlib

from sceneframe.llm import fingerprints as marks


def _walk(rows):
    low = -(1 << 63)
    rows = sorted(rows, key=lambda r: (-(low if r[0] is None else r[0]), (r[1] or "").encode()))
    out = []
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed = marks.fingerprint(text.encode()), marks.fingerprint(edited.encode())
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, marks.likeness(own, changed), marks.likeness(own, marks.fingerprint(after.encode()))))
    return sorted(out, key=str)


def test_edited_fingerprints_match_a_walk(docs, hostile, empty):
    for table in (docs, hostile, hostile.filter("doc_id = 6"), hostile.filter("doc_id = 2")):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        for parts in (1, 3, 40):
            got = sorted((tuple(r) for r in marks.edited_fingerprints(table, parts=parts).collect()), key=str)
            assert got == _walk(rows), parts
    assert marks.edited_fingerprints(empty).count() == 0
    assert marks.fingerprints(empty).count() == 0 and marks.fingerprints(hostile).count() == hostile.count()


def test_an_insertion_moves_few_marks(docs):
    texts = [r.text for r in docs.collect() if len(r.text) > 800]
    for text in texts[:60]:
        own = marks.fingerprint(text.encode())
        assert own == marks.fingerprint(text.encode())
        middle = len(text) // 2
        near = marks.likeness(own, marks.fingerprint((text[:middle] + " inserted " + text[middle:]).encode()))
        assert near == marks.likeness(marks.fingerprint((text[:middle] + " inserted " + text[middle:]).encode()), own)
        assert near > 0.6 or len(set(text.split())) < 40
    assert sum(marks.likeness(marks.fingerprint(a.encode()), marks.fingerprint(b.encode())) > 0.5 for a, b in zip(texts, texts[1:]) if a != b) < len(texts) / 5


def test_edit_distance_by_bits_is_the_plain_one():
    import random

    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (0 if x == y else 2))
        run = min(marks.COMMON_RUN, len(a), len(b))
        shares = any(a[i : i + run] in b for i in range(len(a) - run + 1))
        want = 1 - row[-1] / (len(a) + len(b)) if shares else 0.0
        assert abs(marks._signature_likeness(a, b) - want) < 1e-12
