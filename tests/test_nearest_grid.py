"""Vector search with more queries, and fan-out with more channels, than are broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import relations, vectors

DISTANCE = {
    "l2sq": lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)),
    "cosine": lambda a, b: 1 - sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5),
}


def frames(spark, n, queries):
    """Vectors of small whole numbers, so that there are ties; queries are the first rows."""
    rng = random.Random(n)
    rows = [(i, [float(rng.randint(1, 4)) for _ in range(3)], i % 3) for i in range(n)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>, label long")
    asked = spark.createDataFrame([(i, v) for i, v, _ in rows[:queries]], "query_id long, query_vector array<double>")
    return rows, frame, asked


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_grid_equals_brute_force(spark, metric):
    rows, frame, asked = frames(spark, 60, 25)
    options = dict(k=4, max_distance=0.9, before=F.col("label") != 2, after=F.col("id") % 5 != 0, metric=metric, most_queries=10, rows_per_cell=8)
    if metric == "cosine":  # rounding can swap ties: all places, by their distances
        options |= dict(max_distance=9, before=None, after=None)
    found = vectors.nearest(frame, asked, **options).collect()
    want = []
    for q, v, _ in rows[:25]:
        best = sorted((round(DISTANCE[metric](e, v), 9), i, label) for i, e, label in rows if metric == "cosine" or label != 2)[:4]
        want += [(q, place, i, round(d, 6)) for place, (d, i, _) in enumerate(best, 1) if metric == "cosine" or (d <= 0.9 and i % 5)]
    drop = 1 if metric == "cosine" else 0
    shown = lambda r: (*r[: 3 - drop], abs(r[3]))
    assert sorted(shown((r["query_id"], r["place"], r["id"], round(r["distance"], 6))) for r in found) == sorted(map(shown, want))


def test_grid_equals_the_broadcast_way(spark):
    _, frame, asked = frames(spark, 300, 40)
    frame = frame.unionByName(spark.createDataFrame([(1000, None, 1)], frame.schema))
    few, many = (vectors.nearest(frame, asked, k=3, most_queries=m, rows_per_cell=50) for m in (1000, 7))
    assert few.columns == many.columns
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect())) and few.count() > 50


@pytest.mark.parametrize("most", [1000, 7])
def test_pairs_are_never_rows_and_odd_vectors_take_no_place(spark, most):
    rows, frame, asked = frames(spark, 300, 40)
    odd = [(1000, None, 1), (1001, [1.0, None, 1.0], 1), (1002, [float("nan")] * 3, 1), (1003, [1.0], 1), (1004, [], 1)]
    found = vectors.nearest(frame.unionByName(spark.createDataFrame(odd, frame.schema)), asked, k=3, max_distance=9, most_queries=most, rows_per_cell=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "SortMergeJoin" not in plan and "HashJoin" not in plan
    want = {(q, place, i) for q, v, _ in rows[:40] for place, (_, i) in enumerate(sorted((DISTANCE["l2sq"](e, v), i) for i, e, _ in rows)[:3], 1)}
    assert {(r["query_id"], r["place"], r["id"]) for r in found.collect()} == want


def test_more_than_a_thousand_queries_are_answered(spark):
    _, frame, asked = frames(spark, 1100, 1001)
    found = vectors.nearest(frame, asked, k=1)
    assert found.count() == 1001 == found.where("distance = 0").count()


def test_more_channels_than_are_broadcast(spark):
    frame, channels = spark.range(5), spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    want = sorted((i, c, v) for i in range(5) for c in "abc" for v in "xy")
    assert sorted(map(tuple, relations.fan_out(frame, channels, ["x", "y"], most_channels=2).collect())) == want
