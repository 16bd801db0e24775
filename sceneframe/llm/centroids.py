"""k-means in whole numbers: Ptolemaic pivots rule centroids out, the rest are measured exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneframe.llm.common import record, settle

#: Vectors that stay the reference points of all rounds, and the pairs of them that give bounds.
PIVOTS, PAIRS = 6, 15
#: Share of a bound's terms that rounding may have touched; doubles keep 1e-16 an operation,
#: and none of these distances is the end of more than a few hundred.
ROUNDING = 1e-12
#: Components up to here have squared distances that doubles hold exactly: 64 * (2 * 2**22)**2
#: is 2**52. Larger ones are measured with Python's integers.
NARROW = 1 << 22
#: Sums travel in digits of this base, so that none outgrows a long.
LIMB_BITS = 40
#: Vectors that a task looks at together.
BLOCK = 2048

_LONG_MAX = (1 << 63) - 1


def _exact(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances, as Python integers, of whole numbers held as doubles."""
    other = [int(x) for x in centroid]
    return np.array([sum((int(x) - y) ** 2 for x, y in zip(row, other)) for row in vectors], object)


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid: doubles where those are exact, else Python integers."""
    if not len(vectors):
        return np.empty(0)
    if max(np.abs(vectors).max(), np.abs(centroid).max()) > NARROW:
        return _exact(vectors, centroid)
    apart = vectors - centroid
    return np.einsum("ij,ij->i", apart, apart)


def _roots(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of rows to points, as doubles."""
    out = np.empty((len(vectors), len(points)))
    with np.errstate(over="ignore"):
        for j, point in enumerate(points):
            apart = vectors - point
            out[:, j] = np.sqrt(np.einsum("ij,ij->i", apart, apart))
    return out


def spread_out(starts: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Pivots among the starting centroids: each next one is the farthest from those before."""
    chosen = [0] if len(starts) else []
    while chosen and len(chosen) < min(most, len(starts)):
        nearest = _roots(starts, starts[chosen]).min(axis=1)
        if not nearest.max() > 0:
            break
        chosen.append(int(nearest.argmax()))
    return starts[chosen]


def pivot_pairs(pivots: np.ndarray, most: int = PAIRS) -> list[tuple[int, int, float]]:
    """The pairs of pivots that give bounds, farthest first, with their distance."""
    apart = _roots(pivots, pivots)
    pairs = [(i, j, float(apart[i, j])) for i, j in combinations(range(len(pivots)), 2) if 0 < apart[i, j] < np.inf]
    return sorted(pairs, key=lambda p: -p[2])[:most]


def lower_bounds(cached: np.ndarray, centroids: np.ndarray, pairs: list[tuple[int, int, float]]) -> np.ndarray:
    """A distance that each row is at least away from each centroid, by Ptolemy's inequality.

    ``cached`` and ``centroids`` hold distances to the pivots. For pivots p and q, a row v
    and a centroid c, ``d(v, c) * d(p, q) >= |d(v, p) * d(c, q) - d(v, q) * d(c, p)|``.
    Every bound is lowered by more than rounding can have raised it.
    """
    most = np.zeros((len(cached), len(centroids)))
    with np.errstate(over="ignore", invalid="ignore"):
        for p, q, apart in pairs:
            one, other = np.outer(cached[:, p], centroids[:, q]), np.outer(cached[:, q], centroids[:, p])
            least = (np.abs(one - other) - ROUNDING * (one + other)) * ((1 - ROUNDING) / apart)
            np.fmax(most, least, out=most)
    return most


def nearest(vectors: np.ndarray, cached: np.ndarray, centroids: np.ndarray, at_pivots: np.ndarray, pairs: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row, the smaller number among equals, and its squared distance.

    The centroid with the least bound is measured first; those whose bound lies above what
    has been measured so far are left out, the others are measured in turn.
    """
    bounds = lower_bounds(cached, at_pivots, pairs)
    guess = bounds.argmin(axis=1)
    best = np.empty(len(vectors), object if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) > NARROW else float)
    for c in np.unique(guess):
        rows = np.flatnonzero(guess == c)
        best[rows] = squared(vectors[rows], centroids[c])
    cluster = guess.copy()
    reach = np.sqrt(best.astype(float)) * (1 + ROUNDING)
    for c in range(len(centroids)):
        rows = np.flatnonzero(~(bounds[:, c] > reach) & (guess != c))
        if not len(rows):
            continue
        found = squared(vectors[rows], centroids[c])
        better = (found < best[rows]) | ((found == best[rows]) & (c < cluster[rows]))
        won = rows[better]
        best[won], cluster[won] = found[better], c
        reach[won] = np.sqrt(best[won].astype(float)) * (1 + ROUNDING)
    return cluster, best


def _limbs(value: int) -> list[int]:
    """Digits of a whole number, low ones first; all but the last lie in 0 to the base."""
    out = []
    while not -(1 << LIMB_BITS) < value < 1 << LIMB_BITS:
        out.append(value & ((1 << LIMB_BITS) - 1))
        value >>= LIMB_BITS
    return [*out, value]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def whole_vectors(vectors: DataFrame, width: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, parts``: vectors of exactly ``width`` finite components, each ``floor(scale * x)`` held as a double."""
    parts = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(float(scale)))
    usable = (F.size(vector_col) == width) & F.forall(F.col("parts"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col)).withColumn("parts", parts).filter(F.coalesce(usable, F.lit(False)))
    fields = [("id", pa.int64()), ("parts", pa.list_(pa.float64()))]

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.floor(_matrix(batch.column(1), width)).ravel()
            yield record(fields, [batch.column(0), pa.ListArray.from_arrays(np.arange(0, len(whole) + 1, width, dtype=np.int32), whole)])

    return rows.select("id", "parts").mapInArrow(floor, "id bigint, parts array<double>")


def starting_centroids(whole: DataFrame, clusters: int, seed: str, width: int) -> np.ndarray:
    """The ``clusters`` vectors with the smallest sha256 of ``seed`` and id, in that order."""
    rank = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = whole.select(rank.alias("rank"), "parts").orderBy("rank", "parts").limit(clusters).collect()
    return np.array([r["parts"] for r in rows]).reshape(len(rows), width)


def _with_pivots(whole: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    fields = [("id", pa.int64()), ("parts", pa.list_(pa.float64())), ("pivots", pa.list_(pa.float64()))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _roots(_matrix(batch.column(1), width), pivots)
            lists = pa.ListArray.from_arrays(np.arange(0, apart.size + 1, max(1, len(pivots)), dtype=np.int32), apart.ravel())
            yield record(fields, [batch.column(0), batch.column(1), lists])

    return whole.mapInArrow(measure, "id bigint, parts array<double>, pivots array<double>")


def _placed(batch: pa.RecordBatch, width: int, pivots: int, centroids: np.ndarray, at_pivots: np.ndarray, pairs: list) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    vectors, cached = _matrix(batch.column(1), width), _matrix(batch.column(2), pivots)
    for first in range(0, len(vectors), BLOCK):
        rows = slice(first, first + BLOCK)
        yield rows, vectors[rows], *nearest(vectors[rows], cached[rows], centroids, at_pivots, pairs)


def _sums(cached: DataFrame, centroids: np.ndarray, at_pivots: np.ndarray, pairs: list) -> DataFrame:
    """Per cluster and digit: members and the sum of each component's digit; a few rows a task."""
    width, pivots = centroids.shape[1], at_pivots.shape[1]
    fields = [("cluster", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), *[(f"s{i}", pa.int64()) for i in range(width)]]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centroids), np.int64)
        sums = np.zeros((len(centroids), width), object)
        for batch in batches:
            for _, vectors, cluster, _ in _placed(batch, width, pivots, centroids, at_pivots, pairs):
                narrow = np.abs(vectors).max(axis=1, initial=0) <= NARROW
                n += np.bincount(cluster, minlength=len(n))
                for c in np.unique(cluster):
                    here = cluster == c
                    sums[c] += vectors[here & narrow].sum(axis=0).astype(np.int64).astype(object)
                    for row in vectors[here & ~narrow]:
                        sums[c] += np.array([int(x) for x in row], object)
        rows = []
        for c in np.flatnonzero(n):
            digits = [_limbs(int(x)) for x in sums[c]]
            for limb in range(max(map(len, digits))):
                rows.append((int(c), limb, int(n[c]) if limb == 0 else 0, *[d[limb] if limb < len(d) else 0 for d in digits]))
        if rows:
            yield record(fields, list(zip(*rows)))

    schema = "cluster int, limb int, n bigint, " + ", ".join(f"s{i} bigint" for i in range(width))
    found = cached.mapInArrow(add, schema)
    return found.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])


def _moved(centroids: np.ndarray, rows: list) -> np.ndarray:
    width, totals, counts = centroids.shape[1], {}, {}
    for row in rows:
        c = row["cluster"]
        counts[c] = counts.get(c, 0) + row["n"]
        known = totals.setdefault(c, [0] * width)
        totals[c] = [t + (row[f"s{i}"] << (LIMB_BITS * row["limb"])) for i, t in enumerate(known)]
    out = centroids.copy()
    for c, total in totals.items():
        out[c] = [float(t // counts[c]) for t in total]
    return out


def _as_long(column):
    return F.least(column, F.lit(_LONG_MAX).cast("decimal(38,0)")).cast("bigint")


def cluster_vectors(
    vectors: DataFrame, clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2:", pivots: int = PIVOTS, pairs: int = PAIRS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per usable vector: id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Usable are vectors of exactly ``width`` components, none null or not finite (nor so
    large that ``scale`` times it is not finite); the others have no row. Components become
    ``floor(scale * x)``. The ``clusters`` vectors with the smallest sha256 of ``seed`` and id
    start as centroids. A round assigns every vector to its nearest centroid and moves each
    centroid that has vectors to their componentwise floored mean; empty ones stay. After
    ``rounds`` rounds vectors are assigned once more. Distances are squared.

    Some starting centroids far apart serve as pivots of all rounds. The distances of a
    vector to them are worked out once and written beside it; those of a centroid once a
    round. From them, Ptolemy's inequality over pairs of pivots bounds each distance from
    below, lowered for rounding, and only centroids that the bounds leave possible are
    measured, in whole numbers. A round moves a few rows a task; the driver sees ``clusters``
    sums.

    Ties go to the smaller number. Rows that repeat an id count each; a null id is written
    as the empty string where ids are hashed, and rows with one id start in the order of
    their components. Fewer usable vectors than ``clusters`` give as many centroids. Sums and
    distances are exact at any size; one above the largest long is given as that. (A mean
    beyond 2**53 is held as the nearest double.) Other columns are ignored; a table without
    usable vectors gives an empty result.
    """
    spark = vectors.sparkSession
    whole = settle(whole_vectors(vectors, width, scale, id_col, vector_col))
    centroids = starting_centroids(whole, clusters, seed, width)
    points = spread_out(centroids, pivots) if len(centroids) else np.zeros((1, width))
    fixed = pivot_pairs(points, pairs)
    cached = settle(_with_pivots(whole, points, width))
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(centroids, _sums(cached, centroids, _roots(centroids, points), fixed).collect())
    at_pivots = _roots(centroids, points)
    fields = [("id", pa.int64()), ("cluster", pa.int32()), ("exact", pa.decimal128(38, 0))]
    ceiling = 10**38 - 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, cluster, best in _placed(batch, width, len(points), centroids, at_pivots, fixed):
                exact = pa.array([min(int(x), ceiling) for x in best], pa.decimal128(38, 0))
                yield record(fields, [batch.column(0).slice(rows.start, len(cluster)), pa.array(cluster, pa.int32()), exact])

    placed = settle(cached.mapInArrow(assign, "id bigint, cluster int, exact decimal(38,0)").withColumn("exact", _as_long(F.col("exact"))))
    # At most one row a centroid.
    per = placed.groupBy("cluster").agg(F.sum(F.col("exact").cast("decimal(38,0)")).alias("sum")).collect()
    marks = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    total = min(sum(int(r["sum"]) for r in per), _LONG_MAX)
    facts = spark.createDataFrame(
        [(r["cluster"], min(int(r["sum"]), _LONG_MAX), total, marks[r["cluster"]]) for r in per], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return placed.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(id_col), "cluster", F.col("exact").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256"
    )
