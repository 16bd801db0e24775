"""Filter interactions against a direct count of every order."""

import itertools
import re
from collections import Counter

import numpy as np

from sceneframe.llm import filter_audit as audit

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _direct(rows, labels):
    """rows: (id, text, part); labels: (id, quality, toxic). Applies every order, one document at a time."""
    least, good, toxic = {}, set(), set()
    for key, text, _ in rows:
        if key is not None:
            least[text or ""] = min(least.get(text or "", key), key)
    for key, q, t in labels:
        good |= {key} if q == 1 else set()
        toxic |= {key} if t == 1 else set()
    parts = {}
    for key, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": key is not None and key > least[text],
        }
        parts.setdefault(part or "", []).append(({f for f, v in fails.items() if v}, key is not None and key in good, key is not None and key in toxic))
    out, total = {}, Counter()
    for part, found in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = found
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[part, f] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(f in x[0] for x in found) - len(gone), sum(x[0] == {f} for x in found),
                    sum(x[1] for x in gone), sum(x[2] for x in gone),
                )
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _got(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    found = {r[:3]: r[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_every_order_of_the_corpus(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert _got(audit.filter_audit(docs, labels)) == _direct(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_hostile_rows(spark, hostile, empty):
    many = "Alpha beta# " * 300
    extra = spark.createDataFrame(
        [(20, many, "a"), (21, many, None), (19, many, ""), (19, many, ""), (None, many, "a"), (None, many, "a"), (22, "w " * 100 + "x " * 100, "a"), (23, "ABC " + "é " * 200, "b"),
         (24, "\x0b\x0c" + "one two " * 100 + "  ", "c"), (25, "\x1c " * 250, "c")],
        "doc_id bigint, text string, source string",
    )
    table = hostile.select("doc_id", "text", "source", "kept", "id", "length").unionByName(extra, allowMissingColumns=True).selectExpr("*", "'x' as part", "1 as mask", "2 as n", "'z' as digest")
    labels = spark.createDataFrame([(20, 1, 0), (20, 0, 1), (22, 0, None), (19, 1, 1), (None, 1, 1), (999, 1, 1)], "doc_id bigint, quality int, toxic int").selectExpr("*", "1 as n", "true as good")
    rows = [(r.doc_id, r.text, r.source) for r in table.collect()]
    assert _got(audit.filter_audit(table, labels)) == _direct(rows, [tuple(r)[:3] for r in labels.collect()])
    assert audit.filter_audit(empty, labels).count() == 0
    assert _got(audit.filter_audit(table, labels.limit(0))) == _direct(rows, [])


def test_walk_counts_the_survivors_of_every_subset():
    cells = np.random.default_rng(3).integers(0, 1000, (32, 3))
    states = audit.walk(cells, 5)
    for subset in range(32):
        assert (states[subset] == sum((cells[m] for m in range(32) if not m & subset), np.zeros(3, int))).all()
