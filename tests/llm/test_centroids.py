"""k-means in whole numbers against plain Python."""

import hashlib
import math

import numpy as np
import pytest

from sceneframe.llm import centroids as km


def _direct(rows, clusters, rounds, width, scale=256, seed="2:"):
    kept = []
    for key, vector in rows:
        if vector is not None and len(vector) == width and all(x is not None and math.isfinite(x) and math.isfinite(x * scale) for x in vector):
            kept.append((key, [math.floor(x * scale) for x in vector]))
    by_hash = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in by_hash[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for c in range(len(centres)):
            own = [v for (_, v), i in zip(kept, at) if i == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    at = [near(v) for _, v in kept]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    long = 2**63 - 1
    at = [(min(d, long), c) for d, c in at]
    per = {c: min(sum(d for d, i in at if i == c), long) for c in range(len(centres))}
    total = min(sum(d for d, _ in at), long)
    return sorted(((k, c, d, per[c], total, marks[c]) for (k, _), (d, c) in zip(kept, at)), key=str)


def _got(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert _got(km.cluster_vectors(table)) == _direct(rows, 40, 5, 64)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_hostile_vectors(spark, kind):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [1.0, -1.0, 0.5]), (3, [2.0, 2.0, 2.0]), (None, [0.1, 0.2, 0.3]), (None, None),
        (4, []), (5, [1.0, 2.0]), (6, [1.0, None, 2.0]), (7, [1.0, nan, 2.0]), (8, [1.0, inf, 2.0]), (9, [-inf, 0.0, 0.0]), (10, [-0.001, -0.004, -0.0]), (11, [1.0, 2.0, 3.0, 4.0]),
        (12, [30000.0, -20000.0, 5.0]), (13, [1e7, 1e7, -1e7]), (14, [1e7, 1e7, -1.1e7]),
    ] + [(100 + i, [float(i % 5), float(i % 3), -1.0]) for i in range(60)]
    table = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").selectExpr("*", "1 as id", "'x' as cluster", "2 as parts")
    held = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    for clusters in (1, 4, 200):
        assert _got(km.cluster_vectors(table, clusters=clusters, rounds=3, width=3)) == _direct(held, clusters, 3, 3)
    assert km.cluster_vectors(table.limit(0), width=3).count() == 0
    assert km.cluster_vectors(table.filter("vec_id in (4, 5, 7)"), width=3).count() == 0


def test_distances_beyond_a_long(spark):
    table = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 3.0]), (3, [1e30, 1.0]), (4, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    rows = _got(km.cluster_vectors(table, clusters=2, rounds=1, width=2))
    assert len(rows) == 4 and max(r[2] for r in rows) == 2**63 - 1


def test_bounds_never_pass_the_distance_and_leave_centroids_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-300, 300, (12, 8)).astype(float)
    vectors = np.concatenate([c + rng.integers(-40, 40, (50, 8)) for c in centres])
    pivots = km.spread_out(centres, 6)
    pairs = km.pivot_pairs(pivots)
    bounds = km.lower_bounds(km._roots(vectors, pivots), km._roots(centres, pivots), pairs)
    exact = np.stack([km.squared(vectors, c) for c in centres], axis=1)
    assert (bounds**2 <= exact).all()
    assert (bounds > np.sqrt(exact.min(axis=1))[:, None]).mean() > 0.5
    cluster, best = km.nearest(vectors, km._roots(vectors, pivots), centres, km._roots(centres, pivots), pairs)
    assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
