import math
import random

from pyspark.sql import functions as F

from quarrylight.llm import topk


def brute(rows, is_query, k, scale=64):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for q, a in good:
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(40)]) for i in range(400)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)]  # ties beyond k
    rows += [(2000, None), (2001, [None] * 40), (2002, [math.nan] * 40), (2003, [math.inf] * 40), (None, [1.0] * 40), (2020, [0.5] * 3), (2040, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, row int").repartition(3)
    vectors = frame.select("vec_id", topk.quantized(F.col("embedding")).alias("vector"), "row")
    want = brute(rows, lambda i: i % 20 == 0, 20)
    for options in ({}, {"candidates_per_cell": 50, "queries_per_cell": 7, "block": 8}):
        got = topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20, **options)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want


def test_large_numbers_and_small_tables(spark):
    rows = [(0, [1e9, -3.5e9]), (1, [2e9, 1e9]), (2, [-1e9, 4e9]), (20, [0.1, 0.2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.quantized(F.col("embedding"), 4).alias("vector"))
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=20)
    want = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute(rows, lambda i: i % 20 == 0, 20, 4)]
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0, k=20).count() == 0
    assert topk.top_k(frame.limit(1), F.col("vec_id") % 20 == 0, k=20).count() == 0
