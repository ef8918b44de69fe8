"""Centroid clustering against plain rounds over all centroids."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import exponion

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=40, rounds=5, dim=64, scale=256, seed=2):
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centres = [v for *_, v in named[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    inertia = [sum(d for d, c in at if c == j) for j in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(kept, at, strict=True)), key=repr)


def got(df, **kw):
    out = exponion.cluster_vectors(df, **kw).drop("centroid")
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def test_clusters(spark):
    """Groups, copies of one vector, ties between centroids, null and repeated ids, unusable vectors, clashing columns."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 64))
    rows = [(i, [float(x) for x in (middles[i % 12] + rng.normal(size=64) * 0.4).astype(np.float32)]) for i in range(400)]
    same = [0.25] * 64
    rows += [(1000 + i, same) for i in range(200)] + [(7, rows[7][1]), (7, same), (None, same), (None, rows[3][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [float("nan")] + same[1:]), (2005, [float("inf")] + same[1:]), (2006, [None] + same[1:]), (2007, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    df = df.withColumns({n: F.lit("x") for n in ("vec", "kind", "cluster", "upper", "lower", "n", "sums", "v", "d", "distance")})
    assert got(df) == plain(rows)


def test_clusters_of_small_grids(spark):
    """Vectors on a grid: most distances tie and clusters run empty."""
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(2)), float(rng.randrange(3))]) for i in range(150)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert got(df, dim=2, clusters=9, scale=1, rounds=4) == plain(rows, k=9, rounds=4, dim=2, scale=1)


def test_clusters_of_few_and_none(spark):
    rows = [(i, [i / 3.0] * 64) for i in range(3)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert got(df) == plain(rows)
    assert got(df.limit(1)) == plain(rows[:1])
    assert got(df.limit(0)) == []


def test_large_components(spark):
    """Beyond exact doubles the distances are whole numbers still; beyond 64 bits vectors are refused."""
    rows = [(i, [float((i * 7919) % 97 * 5000), -float(i)] * 32) for i in range(60)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert max(x for _, v in rows for x in v) * 256 > exponion.MOST_DOUBLE
    assert got(df, clusters=7) == plain(rows, k=7)
    with pytest.raises(Exception, match="after scaling"):
        exponion.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64, 0)], SCHEMA))


def test_search_leaves_out_centroids():
    """Once centroids settle, most vectors see few centroids or none, and all have their nearest."""
    rng = np.random.default_rng(1)
    middles = rng.integers(-3000, 3000, (200, 8))
    x = (middles[rng.integers(0, 200, 5000)] + rng.integers(-60, 60, (5000, 8))).astype(np.int64)
    c = exponion.Centres(middles)
    state = exponion.search(x, None, None, None, c)[:3]
    spent = []
    for _ in range(4):
        moved = exponion.Centres(c.at + rng.integers(-20, 20, c.at.shape), c.at)
        *state, n = exponion.search(x, *state, moved)
        d = exponion.table_of(x, moved.at)
        assert (state[0] == d.argmin(1)).all()
        exact = np.sqrt(np.sort(d, axis=1).astype(float))
        assert (state[1] >= exact[:, 0]).all() and (state[2] <= exact[:, 1]).all()
        spent.append(n / d.size)
        c = moved
    assert max(spent) < 0.1
