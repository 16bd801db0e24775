"""Near duplicates: MinHash bands propose, odd sketches weed out, full sets confirm."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneframe.llm.common import as_many_tasks, in_pieces, record, settle, text_bytes, with_group_facts
from sceneframe.llm.components import connected_components

#: Words of a shingle and the similarity, as a whole percentage, that links two documents.
SHINGLE_WORDS, PERCENT = 3, 85
#: MinHash samples of a band, and the chance of missing a link right at the limit that the
#: number of bands keeps to: 24 bands at 0.85, (1 - 0.85**6)**24, and 38 at 0.8.
ROWS, MOST_MISSED = 6, 1 / 86_000
#: MinHash samples of the odd sketch: the smallest hash of each of so many equal parts of the
#: hash range, at every size of the set. And bits of the parity bitmap they are folded into.
SKETCH_PARTS, SKETCH_BITS = 4096, 2048
#: Standard deviations below the limit at which a pair is weeded out.
SKETCH_MARGIN = 5.0
#: Bands that the first comparisons use.
FIRST_BANDS = 4
#: Members of a crowded bucket that are compared with the others in the first round, and how
#: many times as many in each next one.
LEADS, MORE_LEADS = 8, 64
#: Pairs whose full sets one task compares.
TASK_PAIRS = 250
#: Digests of texts that may be broadcast: under 4 megabytes.
FEW_TEXTS = 100_000

_WORDS = SKETCH_BITS // 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _coefficients(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _MIX)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SPAN = 1 << 12
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(_SPAN, np.uint64(0xD6E8FEB86659FD93), np.uint64), dtype=np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, in order."""
    data = np.frombuffer(text.lower(), np.uint8)
    inside = ~_IS_SPACE[data]
    edges = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    data = data[inside]
    lengths = stops - starts
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(begins, lengths)
    values = _BYTES[data]
    if lengths.max() > _SPAN:  # a word of many bytes: each span is told apart
        values = _mixed(values + (place // _SPAN).astype(np.uint64) * _MIX)
    return _mixed(np.add.reduceat(values * _POWERS[place % _SPAN], begins) + lengths.astype(np.uint64))


def shingle_set(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of the shingles; fewer words make one shingle, none none."""
    found = word_hashes(text)
    if not len(found):
        return found
    n = min(words, len(found))
    made = np.full(len(found) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        made = _mixed(made * np.uint64(0x2545F4914F6CDD1D) + found[i : len(found) - n + 1 + i])
    return np.unique(made)


def signature(hashes: np.ndarray, bands: int, rows: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and the odd sketch of a set that is not empty."""
    a, b = _coefficients(seed, bands * rows)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for first in range(0, len(low), 8192):
        part = low[first : first + 8192]
        np.minimum(least, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=least)
    sample = _mixed(least.astype(np.uint64) + (np.arange(bands * rows, dtype=np.uint64) << np.uint64(32)) + _MIX)
    keys = np.zeros(bands, np.uint64)
    for r in range(rows):
        keys = _mixed(keys * np.uint64(0x2545F4914F6CDD1D) + sample.reshape(bands, rows)[:, r])
    return keys.view(np.int64), odd_sketch(hashes)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap of the set's MinHash samples; ``hashes`` are sorted and distinct."""
    parts = hashes >> np.uint64(64 - SKETCH_PARTS.bit_length() + 1)
    sample = hashes[np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1])))]
    bits = _mixed(sample ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def word_digest(text: bytes) -> bytes:
    """SHA-256 of the lower-cased words with one space between them: texts that share it share their shingles."""
    return hashlib.sha256(b" ".join(text.lower().split())).digest()


_SIGNS = "id bigint, sha binary, n_shingles bigint, digest binary, keys array<bigint>, sketch array<bigint>"


def bands_for(percent: int, band_rows: int = ROWS, most_missed: float = MOST_MISSED) -> int:
    """The fewest bands that miss a link of exactly ``percent`` with no more than that chance."""
    single = 1 - (percent / 100) ** band_rows
    return max(FIRST_BANDS, math.ceil(math.log(most_missed) / math.log(single)) if single > 0 else 1)


def signatures(rows: DataFrame, shingle_words: int = SHINGLE_WORDS, bands: int = bands_for(PERCENT), band_rows: int = ROWS) -> DataFrame:
    """Per row of ``id, sha, text``: size of its shingle set, digest of its words, band keys, odd sketch."""
    fields = [("id", pa.int64()), ("sha", pa.binary()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = np.seterr(over="ignore")
        try:
            for whole in batches:
                for batch in in_pieces(whole, 2):
                    out = []
                    for key, sha, text in zip(*(c.to_pylist() for c in batch.columns)):
                        hashes = shingle_set(text, shingle_words)
                        if not len(hashes):
                            out.append((key, sha, 0, None, None, None))
                            continue
                        keys, sketch = signature(hashes, bands, band_rows)
                        out.append((key, sha, len(hashes), word_digest(text), keys, sketch))
                    yield record(fields, list(zip(*out)))
        finally:
            np.seterr(**old)

    return rows.mapInArrow(sign, _SIGNS)


def _confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose full shingle sets are similar enough.

    Only the texts of classes in question are kept for it, one each. Up to ``FEW_TEXTS``
    digests are sent to where the texts are; more of them meet the texts in a merge join.
    """
    held = pairs.count()
    asked = as_many_tasks(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), held)
    wanted = classes.join(asked, "node", "left_semi").select("node", "sha")
    few = 2 * held <= FEW_TEXTS
    if not few:
        wanted = settle(wanted)
        few = wanted.count() <= FEW_TEXTS
    there = rows.join(F.broadcast(wanted) if few else wanted.hint("merge"), "sha").groupBy("node").agg(F.first("text").alias("text"))
    there = settle(as_many_tasks(there, held, TASK_PAIRS))
    both = (
        pairs.join(there.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(there.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    both = as_many_tasks(both, held, TASK_PAIRS)
    fields = [("a", pa.int64()), ("b", pa.int64())]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = np.seterr(over="ignore")
        last, left = None, None
        try:
            for whole in batches:
                for batch in in_pieces(whole, 2):
                    out = []
                    for a, b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns)):
                        if a != last:
                            last, left = a, shingle_set(text_a, shingle_words)
                        right = shingle_set(text_b, shingle_words)
                        shared = len(np.intersect1d(left, right, assume_unique=True))
                        if 100 * shared >= percent * (len(left) + len(right) - shared):
                            out.append((a, b))
                    if out:
                        yield record(fields, list(zip(*out)))
        finally:
            np.seterr(**old)

    return both.mapInArrow(compare, "a bigint, b bigint")


def _alike(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and odd sketches leave room for the similarity asked."""
    sides = pairs
    for side in "ab":
        sides = sides.join(classes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
    return sides.filter(_may_be_alike("n_a", "n_b", "s_a", "s_b", percent)).select("a", "b")


def most_odd_bits(n_a, n_b, percent: int, exp, sqrt):
    """Bits that the bitmaps of two sets at the similarity's limit may differ in.

    At the limit the union holds (n_a + n_b) / (1 + s) shingles, and a share s of its
    samples is in both sets. The number of samples that differ gets the margin; of so many,
    those that meet at one bit in pairs cancel out. Sets of few shingles are nearly their
    own samples, which makes the margin small for them.
    """
    s, parts, bits = percent / 100, float(SKETCH_PARTS), float(SKETCH_BITS)
    union = (n_a + n_b) / (1 + s)

    def held(n):
        return (1 - exp(n / -parts)) * parts

    spread = sqrt(held(union) * (1 - held(union) / union) * (s * (1 - s))) * 2
    differ = held(n_a) + held(n_b) - held(union) * (2 * s) + spread * SKETCH_MARGIN + 1
    odd = (1 - exp(differ * (-2 / bits))) * (bits / 2)
    return odd + sqrt(differ - odd) * 4


def _may_be_alike(n_a: str, n_b: str, s_a: str, s_b: str, percent: int):
    odd = sum((F.bit_count(F.col(s_a)[i].bitwiseXOR(F.col(s_b)[i])) for i in range(_WORDS)), F.lit(0))
    sizes = F.lit(100) * F.least(n_a, n_b) >= F.lit(percent) * F.greatest(n_a, n_b)
    return sizes & (odd <= most_odd_bits(F.col(n_a).cast("double"), F.col(n_b).cast("double"), percent, F.exp, F.sqrt))


def _same_ids(signs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between the classes of rows that carry one id, None without such rows."""
    named = signs.filter("id is not null and digest is not null")
    if named.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo < hi").isEmpty():
        return None
    held = named.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n"))
    shared = settle(held.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").withColumn("key", F.concat(F.lit("id "), "id")))
    nodes = classes.select("digest", "node")
    ends = with_group_facts(held, shared, F.concat(F.lit("id "), "id"), "key", F.xxhash64("digest"), ["lo"]).filter("lo is not null")
    return (
        ends.join(nodes.withColumnRenamed("node", "b"), "digest").select(F.col("lo").alias("digest"), "b")
        .join(nodes.withColumnRenamed("node", "a"), "digest").select("a", "b")
    )


def _linked_rows(docs: DataFrame, shingle_words: int, percent: int, bands: int | None, band_rows: int, id_col: str, text_col: str, one_id_one_node: bool) -> DataFrame:
    """Per row of ``docs``: ``id, sha, n_shingles, component_id`` and ``chosen_sha``.

    With ``one_id_one_node``, texts under one id hang together whatever they say.

    ``component_id`` is the smallest id of the row's component, null where none of it has
    an id; ``chosen_sha`` belongs to the text that stands for the component: of the rows
    with that id (or, without ids, of all) the smallest.
    """
    bands = bands or bands_for(percent, band_rows)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_bytes(F.col(text_col)).alias("text"))
    rows = rows.select("id", F.unhex(F.sha2("text", 256)).alias("sha"), "text")
    signs = settle(signatures(rows, shingle_words, bands, band_rows))
    # Rows with the same words are one class from here on; a class is known by its node.
    worded = signs.filter("n_shingles > 0").groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "sha")).alias("first"),
        *[F.first(c).alias(c) for c in ("n_shingles", "keys", "sketch")],
    )
    classes = settle(worded.select(F.monotonically_increasing_id().alias("node"), "digest", "n", "first", "first.sha", "n_shingles", "keys", "sketch"))

    def in_buckets(found: DataFrame, most: int) -> DataFrame:
        """A row per class and band, with the class's component so far."""
        placed = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        return placed.select("node", "component", F.posexplode(F.slice("keys", 1, most)).alias("band", "key")).withColumn("key", F.xxhash64("band", "key"))

    def several(rows: DataFrame) -> DataFrame:
        """Buckets of several components, with their size, first class and its component."""
        lead = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct("node", "component")).alias("lead"))
        return lead.filter("lo < hi").select("key", "size", F.col("lead.node").alias("a"), F.col("lead.component").alias("component_a"))

    def to_lead(rows: DataFrame) -> DataFrame:
        """Pairs of a bucket's first class and its members of other components."""
        lead = several(rows)
        return rows.join(lead, (rows["key"] == lead["key"]) & (rows["component"] != lead["component_a"])).select("a", F.col("node").alias("b"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return settle(_confirmed(pairs, classes, rows, shingle_words, percent))

    def components(more: DataFrame) -> DataFrame:
        """What new links make of the components so far."""
        return settle(connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))

    found: DataFrame = classes.select("node", F.col("node").alias("component")).limit(0)
    links = _same_ids(signs, classes) if one_id_one_node else None
    if links is not None:
        found = components(settle(links))
    first = settle(to_lead(in_buckets(found, FIRST_BANDS)).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    found = components(confirmed(settle(_alike(classes, first, percent))))

    # Members of the buckets that hold several components; from here on these only get fewer.
    placed = in_buckets(found, bands)
    members = settle(placed.join(several(placed).select("key", "size"), "key"))

    def put_together(alike: DataFrame) -> None:
        """Compare pairs not compared before and take what they link into the components."""
        nonlocal found, tried
        fresh = settle(alike.join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(fresh)
        if fresh.isEmpty():
            return
        more = confirmed(fresh)
        if not more.isEmpty():
            found = components(more)

    def still_open(before: int) -> DataFrame:
        """Members of the buckets that hold several components yet, of more members than ``before``."""
        now = members.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        crowded = several(now.filter(F.col("size") > before)).select("key")
        return settle(now.join(crowded, "key", "left_semi"))

    tried = first
    put_together(_alike(classes, settle(to_lead(members).distinct()), percent))

    # Where a member stands in every bucket's order of leads, from 0 to 1.
    turn = (F.xxhash64(F.lit("lead"), "node").cast("double") / F.lit(2.0**64)) + 0.5
    # Whether two members share an earlier band; 38 bands of 32 bits differ by chance once in 100 million.
    looks = classes.select("node", "n_shingles", "sketch", F.transform("keys", lambda k: F.hash(k)).alias("short"))
    before, leads = 0, LEADS
    while True:
        members = still_open(before)
        if members.isEmpty():
            break
        open_ = members.join(looks, "node").withColumn("turn", turn)
        sides = ("node", "component", "turn", "short", "n_shingles", "sketch")
        now = open_.filter((F.col("turn") >= F.lit(float(before)) / F.col("size")) & (F.col("turn") < F.lit(float(leads)) / F.col("size")))
        left = now.select("key", "band", *[F.col(c).alias(f"{c}_a") for c in sides])
        right = open_.select("key", *[F.col(c).alias(f"{c}_b") for c in sides])
        later = (F.col("turn_a") < F.col("turn_b")) | ((F.col("turn_a") == F.col("turn_b")) & (F.col("node_a") < F.col("node_b")))
        # A pair that shares several bands is looked at in the first of them, so it is one row.
        band = F.array_position(F.zip_with("short_a", "short_b", lambda x, y: x == y), True) - 1
        pairs = left.join(
            right,
            (left["key"] == right["key"]) & (F.col("component_a") != F.col("component_b")) & later
            & _may_be_alike("n_shingles_a", "n_shingles_b", "sketch_a", "sketch_b", percent) & (F.col("band") == band),
        )
        put_together(pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))
        before, leads = leads, leads * MORE_LEADS

    named = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("chosen"))
    facts = settle(named.join(least, "component").select(F.hex("digest").alias("key"), "n", F.col("chosen.id").alias("component_id"), F.col("chosen.sha").alias("chosen_sha")))
    member = signs.select("id", "sha", "n_shingles", "digest")
    return with_group_facts(member, facts, F.hex("digest"), "key", F.xxhash64("id", "sha"), ["component_id", "chosen_sha"]).select(
        "id", "sha", "n_shingles", "component_id", "chosen_sha"
    )


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int | None = None, band_rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when ``100 * shared >= percent * union`` of their shingle sets.

    1. Rows with the same words (exact copies among them) are one class from here on.
    2. In its first bands, a class is compared with the first class of its buckets: one
       pair a class. That joins most copies into components.
    3. In all bands, buckets of several components are looked for; members that are not of
       one component with the bucket's first class are compared with it.
    4. In the buckets that still hold several components, rounds of other leads follow: the
       first 8 members in an order by hash, then 512 and so on, each against the members
       of other components, until every member of such a bucket has been a lead. What a
       round links is one component in the next, so copies that hang together are not paired.

    The bands follow from ``percent`` (`bands_for`) unless they are given. Every pair passes
    size and odd sketch, then its full sets are compared; a pair at the limit fails the
    sketch by a chance of about 1 in 3 million. Texts without words have no shingles and no
    links. A null id never names a component: such a row takes the smallest id it is linked
    with, whatever lies between, or null; it is kept only in that last case. Rows that repeat
    an id with the same text are kept or dropped alike; one id with several texts links what
    each of them links. Other columns are ignored; an empty table gives an empty result.
    """
    found = _linked_rows(docs, shingle_words, percent, bands, band_rows, id_col, text_col, True)
    # A text without words is its own component.
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )


def keep_representatives(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int | None = None, band_rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns kept.

    The row with the smallest id stays (rows without an id come last; of several texts under
    that id, the one with the smallest SHA-256; of rows that repeat both, one). Different
    texts under one id are documents of their own here. Texts without words are in no group and stay, repeated ones too. An empty table stays empty.
    """
    def row_key(key, sha):
        return F.concat(F.coalesce(key.cast("string"), F.lit("-")), F.lit(" "), sha)

    found = _linked_rows(docs, shingle_words, percent, bands, band_rows, id_col, text_col, False)
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("sha") == F.col("chosen_sha"))
    chosen = found.filter((F.col("n_shingles") == 0) | stays)
    kept = settle(
        chosen.groupBy(row_key(F.col("id"), F.lower(F.hex("sha"))).alias("_row")).agg(F.count(F.lit(1)).alias("_rows"), F.max("n_shingles").alias("_shingles"))
    )
    keyed = docs.withColumn("_row", row_key(F.col(id_col).cast("bigint"), F.sha2(text_bytes(F.col(text_col)), 256)))
    once = keyed.join(kept.select("_row"), "_row", "left_semi")
    again = kept.filter("_rows > 1 and _shingles > 0").select("_row")
    if not again.isEmpty():
        once = once.join(again, "_row", "left_anti").unionByName(once.join(again, "_row", "left_semi").dropDuplicates(["_row"]))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
