"""How filters interact: every subset of them walked once in Gray-code order, orders read off as differences."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneframe.llm.common import record, settle

#: The filters of `document_filters`, in the order of their bits.
LETTERS = "ABCDE"

_SPACE = " \t\n\x0b\f\r"


def document_filters(text: Column) -> list[Column]:
    """Whether a text fails A (few words), B (repeated words), C (capitals), D (marks); null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACE))
    pieces = F.split(trimmed, r"[\x20\x09-\x0D]+", -1)
    # After the trim only a text without words has an empty piece, and that one alone.
    none = (trimmed == "").cast("int")
    words, distinct = F.size(pieces) - none, F.size(F.array_distinct(pieces)) - none
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        words < 200,
        distinct.cast("bigint") * 100 < words.cast("bigint") * 50,
        capitals.cast("bigint") * 100 > F.length(text).cast("bigint") * 2,
        text.rlike("[#$%&*|]"),
    ]


def document_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, part, digest of the text and ``mask``, a bit per failed filter of A to D."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mask = sum((F.when(fails, F.lit(1 << bit)).otherwise(F.lit(0)) for bit, fails in enumerate(document_filters(F.col("_text")))), F.lit(0))
    return docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("_text"),
    ).select("id", "part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def mask_cells(marks: DataFrame, labels: DataFrame, label_id: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """Documents, good ones and toxic ones of each part and failure mask, E included; at most 32 rows a part.

    Rows that repeat id, text and part become one counted row before anything is joined.
    A copy passes E if it carries the smallest id of its text. Both joins are by the id
    (with the digest), never by a text that many rows share; rows without an id, which no
    label and no E concerns, skip them.
    """
    named = marks.filter("id is not null").groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = marks.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.select(F.col(label_id).cast("bigint").alias("id"), F.col(good).eqNullSafe(F.lit(1)).alias("good"), F.col(toxic).eqNullSafe(F.lit(1)).alias("toxic"))
    known = known.filter("id is not null").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    found = named.join(first, ["id", "digest"], "left").join(known, "id", "left").select(
        "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << LETTERS.index("E"))).alias("mask"), "n",
        F.when(F.col("good"), F.col("n")).otherwise(0).alias("good"), F.when(F.col("toxic"), F.col("n")).otherwise(0).alias("toxic"),
    )
    unnamed = marks.filter("id is null").select("part", "mask", F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("toxic"))
    return found.unionByName(unnamed).groupBy("part", "mask").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n", "good", "toxic")])


def walk(cells: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every subset of ``filters`` filters: row ``s`` belongs to the subset with the bits of ``s``.

    ``cells`` has a row per failure mask. The walk starts without filters, where all survive,
    and turns one filter on or off a step, as the Gray code does. Each mask counts how many
    active filters it fails; its cell leaves the running survivors when that count rises
    from 0 and comes back when it falls to 0.
    """
    states = np.zeros((1 << filters, *cells.shape[1:]), cells.dtype)
    failures = np.zeros(1 << filters, np.int64)
    holds = [np.flatnonzero(np.arange(1 << filters) >> bit & 1) for bit in range(filters)]
    survivors, active = cells.sum(axis=0), 0
    states[0] = survivors
    for step in range(1, 1 << filters):
        bit = (step & -step).bit_length() - 1
        active ^= 1 << bit
        masks = holds[bit]
        if active >> bit & 1:
            survivors = survivors - cells[masks[failures[masks] == 0]].sum(axis=0)
            failures[masks] += 1
        else:
            failures[masks] -= 1
            survivors = survivors + cells[masks[failures[masks] == 0]].sum(axis=0)
        states[active] = survivors
    return states


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders(states: np.ndarray, letters: str) -> list[tuple]:
    """A row per order of the filters and step: order, step and the counts, from the stored states.

    ``states`` holds documents, good and toxic ones of each subset. What a filter removes
    at a step is the difference of two neighbouring states, whatever came before in which
    order; its sum over all orders weighs each difference by the orders that pass there.
    """
    n, every = len(letters), (1 << len(letters)) - 1
    fails = [int(states[0][0] - states[1 << f][0]) for f in range(n)]
    unique = [int(states[every ^ 1 << f][0] - states[every][0]) for f in range(n)]
    over_all = [
        sum(
            math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()) * int(states[s][0] - states[s | 1 << f][0])
            for s in range(every + 1) if not s >> f & 1
        )
        for f in range(n)
    ]
    rows = []
    for order in permutations(range(n)):
        name, active = "".join(letters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            after = active | 1 << f
            removed, good, toxic = (int(x) for x in states[active] - states[after])
            rows.append((name, step, int(states[after][0]), removed, fails[f] - removed, unique[f], good, toxic, over_all[f]))
            active = after
    return rows


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``part, filter_order, step`` and the counts, for every part, order and step, zeros included.

    ``cells``: part, mask, n, good, toxic. A part is one row here, with at most 32 cells.
    """
    packed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    fields = [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in _COUNTS]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = np.zeros((1 << len(letters), 3), np.int64)
                for cell in found:
                    table[cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                yield record(fields, list(zip(*((part, *row) for row in orders(walk(table, len(letters)), letters)))))

    return packed.mapInArrow(read, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What each of five filters removes at each step of each of their 120 orders, by part.

    A row fails A with under 200 words, B if under half of its words are distinct, C if more
    than a fiftieth of its code points are in A-Z, D if it holds one of ``#$%&*|``, E if a row
    with a smaller id has the same text, removed or not. ``kept`` and ``removed`` count rows
    after and at the step, ``redundant`` those that fail the step's filter but left earlier,
    ``unique_fails`` those that fail nothing else, ``good_lost`` and ``toxic_lost`` the
    labelled ones removed here, ``shapley`` what the filter removes summed over all orders.

    Texts are read once; what remains of a row is its id, part, digest and mask. The counts
    meet in at most 32 cells a part, which one Gray-code walk turns into the survivors of all
    32 subsets.

    A null text counts as empty (it fails A; it has no distinct words to fail B), a null part
    is the empty string. A row without an id has no label and never fails E, nor does it
    make others fail it. Repeated rows count each; those with the smallest id of their text
    all pass E. An id labelled more than once counts as good or toxic if any of its labels
    says so. Other columns are ignored; an empty table gives an empty result.
    """
    return interactions(mask_cells(settle(document_marks(docs, id_col, text_col, part_col)), labels))
