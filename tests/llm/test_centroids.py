"""Centroid clustering against a plain version."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import centroids

SCHEMA = "vec_id long, vector array<bigint>, cluster string"


def plain(rows, clusters=8, rounds=10, dimensions=64):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dimensions]
    start = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    middle = [v for _, _, v in start[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(middle)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(middle)):
            mine = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]
            if mine:
                middle[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = assign()
    largest = 2**63 - 1
    inertia = {j: sum(d for d, c in own if c == j) for j in range(len(middle))}
    out = [(i, c, min(d, largest), min(inertia[c], largest), min(sum(inertia.values()), largest), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, own, strict=True)]
    return sorted(out, key=repr)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "theirs") for i, v in rows], SCHEMA)
    got = centroids.clustered(frame, **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def cloud(seed, n, dimensions, spread=60):
    draw = random.Random(seed)
    middles = [[draw.randrange(-500, 500) for _ in range(dimensions)] for _ in range(5)]
    return [(i, [m + draw.randrange(-spread, spread) for m in draw.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize(("seed", "dimensions", "clusters"), [(1, 64, 8), (2, 3, 8), (3, 2, 4), (4, 1, 8), (5, 64, 1)])
def test_same_as_plain(spark, seed, dimensions, clusters):
    rows = cloud(seed, 200, dimensions)
    assert found(spark, rows, dimensions=dimensions, clusters=clusters) == plain(rows, clusters=clusters, dimensions=dimensions)


def test_ties_repeats_nulls_and_lengths(spark):
    rows = [(i % 7, [i % 3, i % 2]) for i in range(40)] + [(None, [1, 1]), (None, None), (50, None), (51, [1]), (52, [1, 2, 3]), (53, [])]
    assert found(spark, rows, dimensions=2) == plain(rows, dimensions=2)


def test_few_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == []
    rows = [(1, [5, 5]), (2, [5, 5]), (3, [9, 9])]
    assert found(spark, rows, dimensions=2) == plain(rows, dimensions=2)


def test_large_components(spark):
    rows = cloud(6, 40, 3) + [(100, [2**63 - 1, -(2**63), 0]), (101, [2**62, 1, 2**40]), (102, [2**27, 2**28, -(2**30)])]
    assert found(spark, rows, dimensions=3, clusters=4) == plain(rows, clusters=4, dimensions=3)


def test_quantized(spark):
    nan, inf = float("nan"), float("inf")
    frame = spark.createDataFrame([(1, [0.5, -0.0001]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [1.0]), (6, None)], "vec_id long, e array<float>")
    got = {r["vec_id"]: r["v"] for r in frame.select("vec_id", centroids.quantized(F.col("e"), dimensions=2).alias("v")).collect()}
    assert got == {1: [512, -1], 2: None, 3: None, 4: None, 5: None, 6: None}


def test_bounds_hold_and_filter():
    draw = np.random.default_rng(1)
    middles = draw.integers(-900, 900, (8, 64))
    vectors = middles[draw.integers(0, 8, 4000)] + draw.integers(-80, 80, (4000, 64))
    simplex = centroids.Simplex(vectors[:8])
    now = middles + draw.integers(-5, 5, (8, 64))
    a, c = simplex.apexes(vectors), simplex.apexes(now)
    true = np.stack([((vectors - m) ** 2).sum(axis=1) for m in now], axis=1)
    lower = ((a[:, None] - c[None]) ** 2).sum(axis=2)
    upper = lower + 4 * a[:, -1:] * c[:, -1]
    assert (lower <= true + 1e-3).all() and (upper >= true - 1e-3).all()
    cluster, distance, computed = centroids.nearest(vectors, a, now, c)
    assert (cluster == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all()
    assert computed < 0.7 * true.size
