"""Token counts and packing against the library and against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sceneframe.llm import packing, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def test_counts_match_the_library(docs, hostile, empty):
    lib = Tokenizer.from_file(BYTES)
    for table in (docs, hostile):
        want = sorted((r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in table.collect() if r.doc_id is not None)
        got = sorted(tuple(r) for r in tokens.token_counts(table, BYTES, chunk=2000, overlap=64).collect() if r.doc_id is not None)
        assert got == want
    assert tokens.token_counts(empty, BYTES).count() == 0


def test_overlapping_chunks_splice_to_the_whole():
    lib = tokens.tokenizer(BYTES)
    calls = []

    def encode(text):
        calls.append(len(text))
        return lib.encode(text, add_special_tokens=False)

    rng = random.Random(5)
    parts = [*"ab  \n\n'sé.,1\t 中　", "<|endoftext|>", "hello", "x" * 90, " " * 50]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
        assert sum(tokens.encode_huge(encode, text, 40, 8), []) == encode(text).ids
    calls.clear()
    whole = "no gap" + "z" * 5000
    assert sum(tokens.encode_huge(encode, whole, 100, 10), []) == lib.encode(whole, add_special_tokens=False).ids
    assert max(calls) == len(whole)  # widened to the end


def test_word_ids_match_the_library():
    lib = tokens.tokenizer(WORDS)
    special = [b"<|startoftext|>", b"<|endoftext|>"]
    rng = random.Random(1)
    parts = [*"ab  \n'sE.,1\t 中ΣΆ̸=K \x85\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", "Hello", "'S", "I'LL"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        want = np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert packing._token_bytes(WORDS, [text.encode()], special) == [want]


def _pieces(table, capacity):
    lib = Tokenizer.from_file(WORDS)
    out = []
    for r in table.select("doc_id", "text").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [1]
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out.append((r.doc_id, n, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def _sound(packed, capacity):
    placed = {}
    for r in packed:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


def test_packing_is_whole_gapless_and_tight(docs, hostile, empty):
    for table, capacity in ((docs, 512), (hostile, 4096)):
        packed = packing.pack_documents(table, WORDS, capacity).collect()
        assert sorted((tuple(r)[:5] for r in packed), key=str) == _pieces(table, capacity)
        used = _sound(packed, capacity)
        # Best-fit decreasing, a piece at a time.
        rooms = []
        for length in sorted((r.length for r in packed), reverse=True):
            fit = [i for i, room in enumerate(rooms) if room >= length]
            if fit:
                i = min(fit, key=lambda i: rooms[i])
                rooms[i] -= length
            else:
                rooms.append(capacity - length)
        assert used == len(rooms)
    assert packing.pack_documents(empty, WORDS).count() == 0


def test_sequences_hold_the_ids(hostile):
    packed = packing.pack_documents(hostile.filter("doc_id in (1, 2, 6, 10)"), WORDS, 16, with_ids=True)
    got = sorted(i for r in packing.sequences(packed).collect() for i in r.ids)
    lib = Tokenizer.from_file(WORDS)
    want = sorted(i for r in hostile.filter("doc_id in (1, 2, 6, 10)").collect() for i in lib.encode(r.text, add_special_tokens=False).ids + [1])
    assert got == want


def test_one_length_that_most_pieces_share():
    slots = packing.plan_slots({4096: 1_000_000_000, 1500: 7, 100: 3}, 4096)
    assert len(slots) < 10 and sum(b - a for _, a, b, *_ in slots) == 1_000_000_010
