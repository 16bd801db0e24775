"""Quality from how well a text compresses with a good and a bad dictionary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneframe.llm.common import class_counts, fold, in_pieces, learning_rows, logistic, probability, record, text_bytes

#: Bound of the labelled sample: texts of each class, and characters of a text in it.
MOST_ROWS, MOST_CHARS = 900, 8_000
#: Bytes compressed at a time; every chunk of a text starts with the dictionary alone.
CHUNK_BYTES = 4096
DICTIONARY_BYTES, LEVEL = 112_640, 3
#: Rows whose crc32 of the id leaves this modulo 3 are never learned from.
FOLDS, LEFT_OUT = 3, 1


@dataclass(frozen=True)
class CompressionModel:
    bad: bytes
    good: bytes
    trained: tuple[bool, bool]
    calibration: tuple | None
    prior: float


_compressors: dict = {}


def _compressor(content: bytes, trained: bool):
    key = hash(content), len(content), trained
    if key not in _compressors:
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        found = zstandard.ZstdCompressionDict(content, dict_type=kind)
        found.precompute_compress(level=LEVEL)
        _compressors[key] = zstandard.ZstdCompressor(level=LEVEL, dict_data=found, write_content_size=False, write_checksum=False, write_dict_id=False)
    return _compressors[key]


def _dictionary(texts: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary, or the texts themselves where there are too few to train one."""
    chunks = [t[i : i + CHUNK_BYTES] for t in texts for i in range(0, len(t), CHUNK_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, chunks).as_bytes(), True
    except zstandard.ZstdError:
        # A raw dictionary of fewer than 8 bytes means none.
        return b"".join(chunks)[-DICTIONARY_BYTES:] or b" ", False


def _features(text: bytes, bad, good) -> tuple[float, float, float]:
    """The size difference and the smaller size per byte of text, and their product."""
    a = b = 0
    for i in range(0, len(text), CHUNK_BYTES):
        part = text[i : i + CHUNK_BYTES]
        a += len(bad.compress(part))
        b += len(good.compress(part))
    n = max(len(text), 1)
    difference, ratio = (a - b) / n, min(a, b) / n
    return difference, ratio, difference / (ratio + 0.05)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> CompressionModel:
    """Two dictionaries and the calibration of their size difference.

    Two thirds of a bounded labelled sample (`learning_rows`) make the dictionaries, the rest
    calibrates, weighted to the shares of the classes among all rows that may be learned
    from. Without both classes the score is the share of label 1 (0.5 without any label).
    """
    sample = learning_rows(docs, labels, "quality", FOLDS, LEFT_OUT, most_rows, most_chars, id_col, text_col)
    counts = class_counts(labels, "quality", FOLDS, LEFT_OUT, id_col)
    prior = counts[1] / sum(counts) if sum(counts) else 0.5
    by_class = [[t for _, t, y in sample if y == value] for value in (0, 1)]
    if min(map(len, by_class)) < 3:
        return CompressionModel(b"", b"", (False, False), None, prior)
    made = [_dictionary([t for i, t in enumerate(texts) if i % 3]) for texts in by_class]
    tools = [_compressor(*m) for m in made]
    rows = [(_features(t, *tools), value, counts[value] / len(texts)) for value, texts in enumerate(by_class) for t in texts[::3]]
    x, y, w = (np.array(c, float) for c in zip(*rows))
    return CompressionModel(made[0][0], made[1][0], (made[0][1], made[1][1]), logistic(x, y, w), prior)


def score_quality(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``score`` (probability of label 1) and ``bits_saved`` of every row.

    ``bits_saved`` is the normalised difference: bits a byte that the good dictionary saves
    over the bad one. The whole text is compressed, chunk by chunk. Null and empty texts
    have a difference of 0; null and repeated ids give one row each.
    """
    fields = [("id", pa.int64()), ("score", pa.float64()), ("bits_saved", pa.float64())]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.calibration is not None:
            bad, good = _compressor(model.bad, model.trained[0]), _compressor(model.good, model.trained[1])
        for whole in batches:
            for batch in in_pieces(whole, 1):
                if model.calibration is None:
                    n = batch.num_rows
                    yield record(fields, [batch.column(0), [model.prior] * n, [0.0] * n])
                    continue
                x = np.array([_features(t, bad, good) for t in batch.column(1).to_pylist()], float)
                yield record(fields, [batch.column(0), probability(x, model.calibration), 8 * x[:, 0]])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_bytes(F.col(text_col)).alias("text"))
    return rows.mapInArrow(score, "id bigint, score double, bits_saved double").withColumnRenamed("id", id_col)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on what may be learned from, then one row per row of ``docs``.

    Columns: the id, ``held_out`` (never learned from; false for a null id), ``score``,
    ``predicted`` (1 if ``score >= 0.5``) and ``bits_saved``. Other columns are ignored; an
    empty table gives an empty result.
    """
    scored = score_quality(docs, fit(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    held = F.coalesce(fold(F.col(id_col), FOLDS) == LEFT_OUT, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "bits_saved")


def keep_good(docs: DataFrame, training: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose score is below 0.5, all columns kept.

    The text of a row is scored in place, so nothing is shuffled. Where too few labels of
    either class are known to tell good from bad, no document is rejected. Null and empty
    texts are scored as empty; repeated rows stay or go alike; an empty table stays empty.
    """
    model = fit(training, labels, id_col=id_col, text_col=text_col)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.calibration is None:
            yield from batches
            return
        bad, good = _compressor(model.bad, model.trained[0]), _compressor(model.good, model.trained[1])
        for batch in batches:
            texts = (t.as_py() for t in batch.column(place))
            x = np.array([_features((t or "").encode("utf-8", "replace"), bad, good) for t in texts], float).reshape(-1, 3)
            yield batch.filter(pa.array(probability(x, model.calibration) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
