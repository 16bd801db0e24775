"""Best-fit packing planned over a histogram of lengths."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sceneframe.llm.common import in_pieces, record, settle, slices, text_bytes
from sceneframe.llm.tokens import tokenizer

#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 400_000
#: Bytes of one text whose words are looked at together.
SPAN_BYTES = 4 << 20

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

# A letter ends before such a mark in any case, so the two never share a token.
_MARKED = re.compile(rb"([a-z])([.,!?;:%$*&#])")
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")

_ids: dict = {}


def plan_slots(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: where the pieces of each length go.

    Rows are (length, first rank, rank past the last, pieces per sequence, first sequence,
    offset): the piece of that length and rank r goes to sequence
    ``first + (r - first rank) // per`` at ``offset + (r - first rank) % per * length``.
    Sequences with the same room are one entry, so the work grows with the number of
    lengths, not with the number of pieces.
    """
    slots, used = [], 0
    rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit into {capacity}")
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room]
                    rooms.pop(at)
            else:
                room, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            per = min(room // length, left)
            take = min(n, left // per)
            slots.append((length, rank, rank + take * per, per, first, capacity - room))
            rank, left = rank + take * per, left - take * per
            put(room - per * length, first, take)
            put(room, first + take, n - take)
    return slots


def _token_bytes(path: str, texts: list[bytes], special: list[bytes]) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers, looked up by word.

    White space is dropped and never part of a token, so the ids of a text are those of its
    words; a word is encoded by the library once and remembered. A text that holds a special
    token's string goes to the library whole.
    """
    known = _ids.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    lib = tokenizer(path)

    def raw(ids: list[int]) -> bytes:
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return numbers.tobytes()

    def learn(words: set[bytes]) -> None:
        new = [w for w in words if w not in known]
        for first in range(0, len(new), 20_000):
            part = new[first : first + 20_000]
            found = lib.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            known.update(zip(part, (raw(e.ids) for e in found)))

    def spans(text: bytes) -> Iterator[bytes]:
        start = 0
        while start < len(text):
            gap = _SPACE.search(text, start + SPAN_BYTES)
            stop = gap.start() if gap else len(text)
            yield text[start:stop]
            start = stop

    def words_of(text: bytes) -> list[bytes]:
        return _MARKED.sub(rb"\1 \2", text.lower()).split()

    # Lower case must not make a special string of an ordinary one either.
    whole = [any(s in text.lower() for s in special) for text in texts]
    small = [None if w or len(t) > SPAN_BYTES else words_of(t) for w, t in zip(whole, texts)]
    learn(set().union(*(words for words in small if words)))
    out = []
    for odd, text, words in zip(whole, texts, small):
        if words is not None:
            out.append(b"".join(map(known.__getitem__, words)))
        elif odd:
            out.append(raw(lib.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids))
        else:
            parts = []
            for span in spans(text):
                words = words_of(span)
                learn(set(words))
                parts.append(b"".join(map(known.__getitem__, words)))
            out.append(b"".join(parts))
    return out


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut only above ``capacity``."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = [t.content.encode() for t in tokenizer(tokenizer_path).get_added_tokens_decoder().values()]
        for whole in batches:
            for batch in in_pieces(whole, 1, 2 << 20):
                rows: list[tuple] = []
                for key, ids in zip(batch.column(0).to_pylist(), _token_bytes(tokenizer_path, batch.column(1).to_pylist(), special)):
                    ids += end
                    for n, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        row = (key, n, start, len(part) // 4, zlib.crc32(part))
                        rows.append(row + (np.frombuffer(part, "<u4").tolist(),) if with_ids else row)
                yield record(fields, list(zip(*rows)))

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(F.col(text_col)).alias("text"))
    return rows.mapInArrow(pieces, PIECES + (", ids array<bigint>" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give every piece (``doc_id, piece, length, ...``) a ``sequence_id`` and an ``offset``.

    ``pieces`` must be a written table: it is read once for the histogram, which has at most
    ``capacity`` rows, and once for the ranks. Ranks within a length are counted in slices of
    the ids' hash, so a length that a third of all pieces share is ranked by many tasks.
    """
    spark = pieces.sparkSession
    cut = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices(spark))).cast("int"))
    counts = settle(cut.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = W.partitionBy("length").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    slots = settle(spark.createDataFrame(
        plan_slots(histogram, capacity),
        "length bigint, _from bigint, _to bigint, _per bigint, _first bigint, _at bigint",
    ).coalesce(1))
    order = W.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_n", F.row_number().over(order)).join(bases, ["length", "_slice"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_n") - 1).drop("_slice", "_n", "_base")
    placed = ranked.join(slots, "length").filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    into = F.col("_rank") - F.col("_from")
    return placed.select(
        *pieces.columns,
        (F.col("_first") + F.floor(into / F.col("_per"))).cast("bigint").alias("sequence_id"),
        (F.col("_at") + into % F.col("_per") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as best fit can.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and
    ``ids`` on request). Null text is empty: one piece that holds only ``end_id``. Rows that
    repeat an id are documents of their own; null ids are packed like others; other columns
    are ignored; an empty table gives an empty result.
    """
    pieces = settle(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids, id_col, text_col))
    return pack(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pieces packed with ``with_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
