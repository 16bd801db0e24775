"""Context-triggered piecewise hashes of texts and how alike two of them are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneframe.llm.common import in_pieces, record, slices, text_bytes

#: Bytes the rolling hash looks at, the smallest block size and the most marks of a signature.
WINDOW, MIN_BLOCK, MARKS = 7, 3, 64
#: Marks in a row that two signatures must share before they count as alike at all.
COMMON_RUN = 4

_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_LOW = np.iinfo(np.int64).min


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last ``WINDOW`` bytes at every position (fewer at the start)."""
    values = data.astype(np.uint32) + np.uint32(1)
    out, factor = values.copy(), np.uint32(1)
    for back in range(1, min(WINDOW, len(data))):
        factor = np.uint32((int(factor) * 0x01000193) & 0xFFFFFFFF)
        out[back:] += values[:-back] * factor
    return _mixed(out)


def fingerprint(data: bytes) -> str:
    """``block:signature:signature at twice the block`` of a text; equal texts give equal ones.

    A chunk ends where the rolling hash leaves ``block - 1`` modulo the block size, so an
    insertion moves only the boundaries near it. A chunk's mark is the sum of the hashes of
    its windows. The block size is the smallest ``3 * 2**i`` that would give at most 64 chunks,
    halved while fewer than 16 come out; the last mark gathers what exceeds 64.
    """
    if not data:
        return f"{MIN_BLOCK}::"
    old = np.seterr(over="ignore")
    try:
        rolled = _rolling(np.frombuffer(data, np.uint8))
        block = MIN_BLOCK
        while block * MARKS < len(data):
            block *= 2
        chunk = _mixed(rolled ^ np.uint32(0x5BD1E995))
        while True:
            ends = np.flatnonzero(rolled % np.uint32(block) == block - 1) + 1
            if block == MIN_BLOCK or len(ends) >= MARKS // 4:
                break
            block //= 2
        wide = ends[rolled[ends - 1] % np.uint32(2 * block) == 2 * block - 1]
        return f"{block}:{_marks(chunk, ends, MARKS)}:{_marks(chunk, wide, MARKS // 2)}"
    finally:
        np.seterr(**old)


def _marks(chunk: np.ndarray, ends: np.ndarray, most: int) -> str:
    starts = np.concatenate(([0], ends[: most - 1]))
    starts = starts[starts < len(chunk)]
    return _ALPHABET[_mixed(np.add.reduceat(chunk, starts, dtype=np.uint32)) & np.uint32(63)].tobytes().decode()


def _signature_likeness(left: str, right: str) -> float:
    """1 less the edit distance (insert and delete 1, change 2) over both lengths."""
    if left == right:
        return 1.0
    run = min(COMMON_RUN, len(left), len(right))
    if not run:
        return 0.0
    there = {left[i : i + run] for i in range(len(left) - run + 1)}
    if not any(right[i : i + run] in there for i in range(len(right) - run + 1)):
        return 0.0
    # The longest common subsequence, a row of the table at a time as bits of one number.
    full = (1 << len(left)) - 1
    where: dict[str, int] = {}
    for i, mark in enumerate(left):
        where[mark] = where.get(mark, 0) | 1 << i
    row = full
    for mark in right:
        hit = row & where.get(mark, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(left) - row.bit_count()
    return 2 * common / (len(left) + len(right))


def likeness(left: str, right: str) -> float:
    """How alike two fingerprints are, 0 to 1: equal 1, incompatible block sizes 0."""
    if left == right:
        return 1.0
    size_l, one_l, two_l = left.split(":")
    size_r, one_r, two_r = right.split(":")
    pairs = []
    if size_l == size_r:
        pairs = [(one_l, one_r), (two_l, two_r)]
    elif int(size_l) == 2 * int(size_r):
        pairs = [(one_l, two_r)]
    elif 2 * int(size_l) == int(size_r):
        pairs = [(two_l, one_r)]
    # Different texts are never wholly alike.
    return min(max((_signature_likeness(a, b) for a, b in pairs if a and b), default=0.0), 0.99)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_chars`` and ``fingerprint`` of every row; null text counts as empty."""
    fields = [("id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_pieces(whole, 1):
                raw = batch.column(1).to_pylist()
                yield record(fields, [batch.column(0), [len(b.decode("utf-8", "replace")) for b in raw], [fingerprint(b) for b in raw]])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_bytes(F.col(text_col)).alias("text"))
    return rows.mapInArrow(mark, "id bigint, n_chars bigint, fingerprint string").withColumnRenamed("id", id_col)


def in_descending_runs(spark: SparkSession, rows: DataFrame, parts: int) -> DataFrame:
    """``key, text`` dealt by ranges of ``key``, each part in descending order with its follower.

    The range edges are keys that occur, at most ``parts`` numbers. The largest key of a
    range is the follower of the next higher range's smallest, so its rows are dealt to both,
    marked ``tail`` in the second; the largest key of all follows the smallest.
    """
    fractions = [i / parts for i in range(1, parts + 1)]
    found = rows.agg(F.percentile_approx("key", F.array(*map(F.lit, fractions)), 100 * parts).alias("edges"), F.max("key").alias("top")).first()
    edges = sorted({*(found["edges"] or []), *([found["top"]] if found["top"] is not None else [])})
    last = len(edges) - 1
    spot = F.lit(0)
    for_edges = F.array(*[F.lit(e).cast("bigint") for e in edges] or [F.lit(0).cast("bigint")])
    # The part of a key: how many edges lie below it.
    spot = F.size(F.filter(for_edges, lambda e: e < F.col("key"))).cast("int")
    on_edge = F.array_position(for_edges, F.col("key")) > 0
    following = F.when(F.col("part") == last, F.lit(0)).otherwise(F.col("part") + 1)
    dealt = rows.withColumn("part", spot).withColumn(
        "to", F.when(on_edge, F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("tail")), F.struct(following.cast("int").alias("part"), F.lit(True).alias("tail"))))
        .otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("tail")))),
    ).select("key", "id", "text", F.inline("to"))
    return dealt.repartitionById(max(len(edges), 1), F.col("part")).sortWithinPartitions(F.col("tail"), F.col("key").desc(), "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they are.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first as
    many (or all) of the next document in descending id order; the first one follows the
    last. Columns: the id, ``n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    Texts move once, dealt by ranges of the id; a range is worked through in order, with one
    text and the range's first held at a time. Null text is empty; null ids come last in the
    order; rows that share an id are ordered by their text. A single document follows itself.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(_LOW)).cast("bigint")).alias("key"), F.col(id_col).cast("bigint").alias("id"), text_bytes(F.col(text_col)).alias("text")
    )
    fields = [
        ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(this: tuple, after: tuple) -> tuple:
            key, text, own = this
            half = len(text) // 2
            edited = (text[: len(text) - half] + after[1][:half]).encode("utf-8", "surrogatepass")
            changed = fingerprint(edited)
            return key, len(text), hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, after[2])

        held, ended, out = None, False, []
        for whole in batches:
            for batch in in_pieces(whole, 1):
                for key, raw, tail in zip(*(c.to_pylist() for c in batch.columns)):
                    if ended:
                        continue
                    now = key, raw.decode("utf-8", "surrogatepass"), fingerprint(raw)
                    if held is not None:
                        out.append(row(held, now))
                    # Of several rows with the follower's id the first one in order follows.
                    ended, held = tail, now
                if out:
                    yield record(fields, list(zip(*out)))
                    out = []
        if held is not None and not ended:
            raise ValueError("a part without the document that follows it")

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = in_descending_runs(spark, rows, parts or slices(spark))
    return dealt.select("id", "text", "tail").mapInArrow(mark, schema).withColumnRenamed("id", id_col)
