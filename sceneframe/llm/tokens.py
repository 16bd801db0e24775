"""Token counts of texts of any length, huge ones encoded in overlapping chunks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneframe.llm.common import in_pieces, record, text_bytes

#: A text longer than this many characters is encoded in chunks of this size.
CHUNK_CHARS = 32_768
#: Characters that neighbouring chunks share at first; doubled while they do not align.
OVERLAP_CHARS = 512
#: Words whose counts a worker remembers before it starts anew.
REMEMBERED = 300_000

# Where a byte-level pattern always starts a token, whatever stands further left: a single
# space or line end between two visible characters. The pattern never carries visible
# characters over white space, and looks only one character ahead.
_STABLE = re.compile(r"(?<=\S)[ \n](?=\S)")

_tokenizers: dict = {}
_counts: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker, without truncation or padding."""
    if path not in _tokenizers:
        # Spark has a task for every core; the library's own threads only add memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _tokenizers[path] = loaded
    return _tokenizers[path]


def encode_huge(encode, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[list[int]]:
    """Token ids of ``text``, in runs, equal to those of one ``encode`` call.

    ``encode`` gives an object with ``ids`` and character ``offsets``. Neighbouring chunks
    share ``overlap`` characters. Both encodings are cut at one position inside the overlap
    where each of them starts a token and where the pattern is known to start one; the left
    one is used before it and the right one from it on. Where the overlap has no such
    position, or the two sides do not both start a token there, the left chunk is lengthened
    and the overlap doubled, up to the whole rest of the text.
    """
    start = 0
    while True:
        size, shared = max(chunk, 2 * overlap), overlap
        while True:
            stop = min(len(text), start + size)
            left = encode(text[start:stop])
            if stop == len(text):
                yield left.ids
                return
            from_ = max(start + 1, stop - shared)
            # The last character's neighbour is unseen by the left chunk, so it is left out.
            spots = [m.start() for m in _STABLE.finditer(text, from_, stop - 1)]
            begins_left = {start + a: i for i, (a, _) in reversed(list(enumerate(left.offsets)))}
            right = encode(text[from_:stop])
            begins_right = {from_ + a for a, _ in right.offsets}
            common = [s for s in spots if s in begins_left and s in begins_right]
            if common:
                # The token that begins at the splice, and all before it, agree on both sides
                # from the first shared boundary on.
                cut = common[-1]
                if _agrees(left, right, start, from_, common[0], cut):
                    yield left.ids[: begins_left[cut]]
                    start = cut
                    break
            size, shared = size + shared, 2 * shared


def _agrees(left, right, left_from: int, right_from: int, first: int, last: int) -> bool:
    def run(found, base):
        return [(i, a + base) for i, (a, _) in zip(found.ids, found.offsets) if first <= a + base < last]

    return run(left, left_from) == run(right, right_from)


def _word_counts(path: str, texts: list[str], special: list[str]) -> list[int]:
    """Tokens of each text, counted by words cut at stable places and remembered."""
    known = _counts.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    cut, odd, wanted = [], {}, set()
    for n, text in enumerate(texts):
        if any(s in text for s in special):
            odd[n] = text
            cut.append(())
            continue
        words = _STABLE.sub("\x00\\g<0>", text).split("\x00") if "\x00" not in text else [text]
        cut.append(words)
        wanted.update(words)
    new = [w for w in wanted if w not in known]
    lib = tokenizer(path)
    for first in range(0, len(new), 20_000):
        part = new[first : first + 20_000]
        known.update(zip(part, map(len, lib.encode_batch_fast(part, add_special_tokens=False))))
    count = known.__getitem__
    found = [sum(map(count, words)) for words in cut]
    for n, text in odd.items():
        found[n] = sum(len(ids) for ids in encode_huge(lambda t: lib.encode(t, add_special_tokens=False), text))
    return found


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Tokens are those the library gives for a byte-level file, with no begin, end or added
    special tokens, no truncation and no padding. Texts above ``chunk`` characters are
    encoded in overlapping chunks (`encode_huge`), so a task never holds the tokens of more
    than one chunk; shorter ones go to the library as the words between stable places,
    which adds up to the same count. Null counts as empty and has no tokens; null and
    repeated ids give one row each; other columns are ignored.
    """
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = tokenizer(tokenizer_path)
        special = [t.content for t in lib.get_added_tokens_decoder().values()]

        def encode(text: str):
            return lib.encode(text, add_special_tokens=False)

        for whole in batches:
            for batch in in_pieces(whole, 1):
                raw = batch.column(1).to_pylist()
                texts = [b.decode("utf-8", "replace") for b in raw]
                small = [i for i, t in enumerate(texts) if len(t) <= chunk]
                found = dict(zip(small, _word_counts(tokenizer_path, [texts[i] for i in small], special)))
                for i, text in enumerate(texts):
                    if i not in found:
                        found[i] = sum(len(ids) for ids in encode_huge(encode, text, chunk, overlap))
                yield record(fields, [batch.column(0), [len(b) for b in raw], [found[i] for i in range(len(texts))]])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_bytes(F.col(text_col)).alias("text"))
    return rows.mapInArrow(count, "id bigint, n_bytes bigint, n_tokens bigint").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
