import random

from pyspark.sql import functions as F

from quarrylight.operators import graph, relations, metric


def test_related_equals_brute_force_for_few_and_many_tags(spark):
    rng = random.Random(3)
    items = [(i, rng.sample([f"t{j}" for j in range(12)], rng.choice([0, 1, 2, 3, 5, 8]))) for i in range(120)]
    weights = {f"t{j}": float(j % 4) for j in range(12)}  # some are 0
    frame = spark.createDataFrame(items, "id long, tags array<string>")
    table = spark.createDataFrame(list(weights.items()), "tag string, weight double")
    got = graph.related(frame, frame, weights=table, penalty=(F.col("id") % 5) / F.lit(10.0), most=4).collect()
    want = set()
    for i, mine in items:
        scores = []
        for o, theirs in items:
            shared = sum(weights[t] for t in set(mine) & set(theirs))
            if o != i and shared:
                scores.append((-round(shared - (o % 5) / 10, 6), o))
        want |= {(i, o, -s, r) for r, (s, o) in enumerate(sorted(scores)[:4], 1)}
    assert {(r["id"], r["other"], round(r["score"], 6), r["rank"]) for r in got} == want


def test_exploded_tags_are_not_broadcast(spark):
    """However small a table's file: what exploding makes of it can be too large for the driver."""
    frame = spark.createDataFrame([(i, ["a", f"b{i % 3}"]) for i in range(30)], "id long, tags array<string>")
    weights = spark.createDataFrame([("a", 1.0), ("b0", 2.0), ("b1", 2.0)], "tag string, weight double")
    plan = graph.related(frame, frame, weights=weights)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 3
    assert plan.count("BroadcastHashJoin") == 6  # of the weights only


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)] + [(200, [0.0] * 4), (201, [0.0] * 4), (202, [0.1, 0.0, 0.0, 0.0]), (203, None), (None, [0.0] * 4)]
    got = {(r["a"], r["b"]) for r in metric.near_pairs(spark.createDataFrame(rows, "id long, embedding array<double>"), max_distance=0.5).collect()}
    alone = [(i, v) for i, v in rows if v is not None and i is not None and i != 201]
    want = {(a, b) for a, x in alone for b, y in alone if a < b and sum((p - q) ** 2 for p, q in zip(x, y, strict=True)) <= 0.5}
    assert got == want and (200, 202) in got


def test_numbered_with_a_null_group(spark):
    frame = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "g string, n long")
    got = {r["g"]: (r["text"], r["n"]) for r in relations.numbered(frame, "g", ["n"], F.col("n").cast("string"), 1).collect()}
    assert got == {None: ("1. 1\n...и ещё 1", 2), "a": ("1. 3", 1)}
