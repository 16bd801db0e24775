"""Toxicity from the nearest labelled examples by TF-IDF cosine."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneframe.llm.common import class_counts, fold, in_pieces, learning_rows, logistic, probability, record, text_bytes

#: Bound of the labelled sample: texts of each class, and characters of a text in it.
MOST_ROWS, MOST_CHARS = 1_000, 8_000
#: Neighbours that vote, and examples of a block of the index.
NEIGHBOURS, BLOCK = 15, 256
#: Rows whose crc32 of the id leaves this modulo 5 are never learned from.
FOLDS, LEFT_OUT = 5, 0

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def terms(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def vector(text: bytes, places: dict[bytes, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term places and weights of unit length; both empty where no term occurs."""
    counts = Counter(w for w in terms(text) if w in places)
    if not counts:
        return np.empty(0, np.int64), np.empty(0)
    # One order of terms for one bag of words, so equal texts sum alike.
    spots, times = (np.array(x) for x in zip(*sorted((places[w], n) for w, n in counts.items())))
    weights = (1 + np.log(times)) * idf[spots]
    return spots, weights / math.sqrt(float(weights @ weights))


class BlockMaxIndex:
    """Postings of unit vectors in blocks of examples, with the largest weight of a block.

    A query adds up, per block, its weights times the block's largest ones: no example of the
    block can score higher. Blocks are worked through from the highest bound down until the
    bound falls below the worst neighbour, so the answer is that of comparing with every
    example. Ties go to the example with the smaller number.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.n = len(vectors)
        self.blocks = -(-self.n // block) if self.n else 0
        self.block = block
        self.top = np.zeros((n_terms, self.blocks))
        #: Per block: where each term's postings begin, the examples in them and their weights.
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in range(self.blocks):
            own = vectors[b * block : (b + 1) * block]
            spots = np.concatenate([s for s, _ in own]).astype(np.int64)
            weights = np.concatenate([w for _, w in own])
            of = np.repeat(np.arange(len(own)), [len(s) for s, _ in own])
            order = np.argsort(spots, kind="stable")
            begins = np.concatenate(([0], np.cumsum(np.bincount(spots, minlength=n_terms)))).astype(np.int32)
            self.postings.append((begins, of[order].astype(np.int32), weights[order]))
            np.maximum.at(self.top[:, b], spots, weights)

    def nearest(self, spots: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The up to ``k`` examples with the highest cosine above 0, as (cosine, number)."""
        if not len(spots) or not self.blocks:
            return []
        bounds = weights @ self.top[spots]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or len(best) == k and bounds[b] < -best[-1][0] - 1e-12:
                break
            begins, of, held = self.postings[b]
            first, lengths = begins[spots], begins[spots + 1] - begins[spots]
            # The postings of all the query's terms, one after the other.
            at = np.arange(int(lengths.sum())) + np.repeat(first - np.cumsum(lengths) + lengths, lengths)
            scores = np.bincount(of[at], np.repeat(weights, lengths) * held[at], self.block)
            found = np.flatnonzero(scores > 0)
            if len(found) > k:  # no more than k of a block can be among the k nearest; ties stay
                found = found[scores[found] >= np.partition(scores[found], -k)[-k]]
            best = sorted(best + [(-float(scores[i]), b * self.block + i) for i in found.tolist()])[:k]
        return [(-s, i) for s, i in best]


@dataclass(frozen=True)
class NeighbourModel:
    places: dict
    idf: np.ndarray
    index: BlockMaxIndex
    ids: list
    marks: np.ndarray
    calibration: tuple | None
    prior: float
    neighbours: int


def _vote(near: list[tuple[float, int]], marks: np.ndarray) -> tuple[float, float]:
    """The distance-weighted share of label 1, drawn to 0 by one vote, and the best cosine."""
    if not near:
        return 0.0, 0.0
    weights = np.array([1 / (1.1 - min(s, 1.0)) for s, _ in near])
    ones = marks[[i for _, i in near]]
    return float(weights @ ones / (weights.sum() + 1.0)), near[0][0]


def document_frequencies(docs: DataFrame, vocabulary: list[bytes], text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each word of a bounded vocabulary occurs, and how many they are."""
    places = {w: i for i, w in enumerate(vocabulary)}
    fields = [("term", pa.int32()), ("n", pa.int64())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(len(places) + 1, np.int64), 0
        for whole in batches:
            for batch in in_pieces(whole, 0):
                for text in batch.column(0).to_pylist():
                    rows += 1
                    spots = [places[w] for w in set(terms(text)) if w in places]
                    found[spots] += 1
        found[-1] = rows
        held = np.flatnonzero(found)
        if len(held):
            yield record(fields, [held.astype(np.int32), found[held]])

    counted = docs.select(text_bytes(F.col(text_col)).alias("text")).mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(places) + 1, np.int64)
    for row in counted:
        out[row["term"]] = row["n"]
    return out[:-1], int(out[-1])


def _label_weights(rows: list[tuple[int, bytes, int]], places: dict[bytes, int]) -> np.ndarray:
    """How closely each word goes with the label: chi-squared over the examples, 1 at most and never 0."""
    marks = np.array([y for _, _, y in rows])
    held = np.zeros((2, len(places)))
    for _, text, y in rows:
        held[y, [places[w] for w in set(terms(text))]] += 1
    size = np.array([max(1, int((marks == v).sum())) for v in (0, 1)], float)
    a, b = held[1], held[0]
    c, d = size[1] - a, size[0] - b
    chi = (a * d - b * c) ** 2 * size.sum() / np.maximum((a + b) * (c + d) * size[0] * size[1], 1.0)
    return np.maximum(chi / max(chi.max(initial=0.0), 1e-9), 1e-6)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS, neighbours: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text") -> NeighbourModel:
    """An index of labelled examples and the calibration of their votes.

    Two thirds of a bounded labelled sample (`learning_rows`) make the index, over every word
    that occurs in them; the rest calibrates, weighted to the shares of the classes among all
    rows that may be learned from. A word weighs its inverse document frequency, counted over
    all documents, times how closely it goes with the label among the examples. A text in
    both parts counts in the index alone. Without both classes the score is the share of
    label 1.
    """
    rows = learning_rows(docs, labels, "toxic", FOLDS, LEFT_OUT, most_rows, most_chars, id_col, text_col)
    counts = class_counts(labels, "toxic", FOLDS, LEFT_OUT, id_col)
    prior = counts[1] / sum(counts) if sum(counts) else 0.5
    seen: set[bytes] = set()
    rows = [r for r in rows if not (r[1] in seen or seen.add(r[1]))]
    by_class = [[r for r in rows if r[2] == v] for v in (0, 1)]
    empty = NeighbourModel({}, np.ones(1), BlockMaxIndex([], 1), [], np.zeros(0), None, prior, neighbours)
    if min(map(len, by_class)) < 3:
        return empty
    shares = (1 - prior, prior)
    inside = [r for part in by_class for i, r in enumerate(part) if i % 3]
    outside = [r for part in by_class for r in part[::3]]
    weights = np.array([counts[y] / len(by_class[y]) for _, _, y in outside], float)
    y = np.array([r[2] for r in outside], float)
    places = {w: i for i, w in enumerate(sorted({w for r in inside for w in terms(r[1])}))}
    frequencies, total = document_frequencies(docs, list(places), text_col)
    idf = (np.log((total + 1) / (frequencies + 1)) + 1) * _label_weights(inside, places)
    made = [(r, vector(r[1], places, idf)) for r in inside]
    # Examples with like terms share blocks, so that the bounds are tight.
    made.sort(key=lambda m: (m[0][2], m[1][0][np.argmax(m[1][1])] if len(m[1][0]) else -1, m[0][0]))
    index = BlockMaxIndex([v for _, v in made], max(1, len(idf)))
    marks = np.array([r[2] for r, _ in made], float)
    x = np.array([_vote(index.nearest(*vector(r[1], places, idf), neighbours), marks) for r in outside])
    return NeighbourModel(places, idf, index, [r[0] for r, _ in made], marks, logistic(x, y, weights), prior, neighbours)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Fit on what may be learned from, then one row per row of ``docs``.

    Columns: the id, ``held_out`` (never learned from; false for a null id), ``score``
    (probability of label 1), ``predicted`` (1 if ``score >= 0.5``) and ``evidence``: the
    nearest examples with id, cosine and label. The whole text is read. Null and empty
    texts, and texts without any term of the index, have no neighbours and the score that
    calibration gives to that. Null and repeated ids give one row each; other columns are
    ignored; an empty table gives an empty result.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    evidence = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
    fields = [("id", pa.int64()), ("score", pa.float64()), ("evidence", evidence)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_pieces(whole, 1):
                votes, shown = [], []
                for text in batch.column(1).to_pylist():
                    near = model.index.nearest(*vector(text, model.places, model.idf), model.neighbours)
                    votes.append(_vote(near, model.marks))
                    shown.append([{"example": model.ids[i], "cosine": s, "label": int(model.marks[i])} for s, i in near[:3]])
                x = np.array(votes, float)
                scores = probability(x, model.calibration) if model.calibration else np.full(len(x), model.prior)
                yield record(fields, [batch.column(0), scores, shown])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_bytes(F.col(text_col)).alias("text"))
    held = F.coalesce(fold(F.col("id"), FOLDS) == LEFT_OUT, F.lit(False))
    return rows.mapInArrow(score, "id bigint, score double, evidence array<struct<example: bigint, cosine: double, label: int>>").select(
        F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )
