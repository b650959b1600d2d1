"""The ball index against all pairs."""

import numpy as np
import pytest

from quarrylight.operators import metric
from shuffles import shuffled

SCHEMA = "id long, embedding array<double>, v string"


def brute(rows, most):
    seen = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all():
            seen[tuple(x + 0.0 for x in v)] = min(i, seen.get(tuple(x + 0.0 for x in v), i))
    ids, points = list(seen.values()), np.array(list(seen))
    out = set()
    for x in range(len(ids)):
        for y in np.flatnonzero(((points - points[x]) ** 2).sum(axis=1) <= most):
            if ids[x] != ids[y]:
                out.add((min(ids[x], ids[y]), max(ids[x], ids[y])))
    return out


def clusters(seed, n, middles, dimensions, spread):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(middles, dimensions))
    return [(int(i), (centres[draw.integers(middles)] + spread * draw.normal(size=dimensions)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("rows", "most", "per_cell"), [
    (clusters(1, 600, 12, 8, 0.05), 0.05, 40),
    (clusters(2, 600, 1, 3, 1.0), 0.1, 25),
    (clusters(3, 300, 5, 64, 0.1), 1.2, 64),
    ([(i, [float(i % 7), 0.0]) for i in range(200)] + [(500, [0.0, -0.0]), (None, [1.0, 1.0]), (501, None), (502, [float("nan"), 0.0]), (503, [None, 1.0])], 1.0, 4),
])
def test_same_as_all_pairs(spark, rows, most, per_cell):
    frame = spark.createDataFrame([(i, v, "theirs") for i, v in rows], SCHEMA)
    got = [(r["a"], r["b"]) for r in metric.near_pairs(frame, max_distance=most, rows_per_cell=per_cell).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, most)


def test_far_fewer_pairs_meet_in_clusters(spark):
    met = {}
    for n in (1000, 4000):
        frame = spark.createDataFrame([(i, v, "") for i, v in clusters(4, n, n // 100, 16, 0.02)], SCHEMA)
        met[n] = metric.BallIndex(frame, key="id", vector="embedding", rows_per_cell=50).pairs_met(0.02)
    assert met[1000] < 0.25 * 1000**2 / 2
    assert met[4000] < 0.08 * 4000**2 / 2
    assert met[4000] < 8 * met[1000]  # not 16 times


def test_equal_distances_and_no_rows(spark):
    """A ring whose rows are all as far from the pivot is dealt into several cells."""
    draw = np.random.default_rng(5)
    points = draw.normal(size=(400, 3))
    rows = [(i, p.tolist()) for i, p in enumerate(points / np.linalg.norm(points, axis=1)[:, None])]
    frame = spark.createDataFrame([(i, v, "") for i, v in rows], SCHEMA)
    index = metric.BallIndex(frame, key="id", vector="embedding", rows_per_cell=20, most_pivots=1)
    assert {(r["a"], r["b"]) for r in index.pairs(0.01).collect()} == brute(rows, 0.01)
    assert max(r["n"] for r in index.cells.collect()) <= 40
    assert metric.near_pairs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_row_is_sent_as_often_in_larger_tables(spark):
    """Where every cell meets every other, too."""
    sent = {}
    for n in (500, 2000):
        points = np.random.default_rng(6).normal(size=(n, 16))
        frame = spark.createDataFrame([(i, p.tolist(), "") for i, p in enumerate(points / np.linalg.norm(points, axis=1)[:, None])], SCHEMA)
        sent[n] = shuffled(spark, lambda: metric.near_pairs(frame, max_distance=0.9, rows_per_cell=25).count())[0]  # noqa: B023
    assert sent[2000] < 5 * sent[500]  # not 16 times


def test_strips_give_the_pairs_of_all_cells(spark, monkeypatch):
    """Strips of a few cells, single numbers, and keys that different vectors share."""
    monkeypatch.setattr(metric, "NUMBERS_PER_STRIP", 200)
    monkeypatch.setattr(metric, "PAIRS_AT_ONCE", 7)
    points = np.random.default_rng(7).normal(size=(300, 4)).astype(np.float32)
    rows = [(i // 2 if i < 60 else i, p.astype(float).tolist()) for i, p in enumerate(points)]
    frame = spark.createDataFrame([(i, v, "") for i, v in rows], "id long, embedding array<float>, v string")
    index = metric.BallIndex(frame, key="id", vector="embedding", rows_per_cell=20)
    assert index.rows.select("strip").distinct().count() > 5
    want = sorted((min(i, j), max(i, j)) for x, (i, v) in enumerate(rows) for j, w in rows[:x] if i != j and ((np.array(v) - np.array(w)) ** 2).sum() <= 0.7)
    assert sorted((r["a"], r["b"]) for r in index.pairs(0.7).collect()) == want
