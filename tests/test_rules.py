"""Corner cases of the rules, worked out by hand."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.functions import text as tx
from quarrylight.functions import times
from quarrylight.operators import changes, relations, search, sequences, vectors
from quarrylight.operators.ingest import outcomes, wing_of


def value(spark, column, **names):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in names.items())) if names else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "target", "overlap", "want"),
    [
        ("", 10, 3, []),
        ("   ", 2000, 200, []),
        ("  a  ", 2000, 200, ["a"]),
        ("aaaa\n\nbbbb\n\ncccc", 10, 3, ["aaaa\n\nbbbb", "bbb\n\ncccc"]),
        ("aaaa\n\nbbbbbbbb", 10, 8, ["aaaa", "bbbbbbbb"]),
        ("Ab cd. Ef gh. Ij.", 10, 3, ["Ab cd.", "cd. Ef gh.", "gh. Ij."]),
        ("x" * 25, 10, 3, ["x" * 25]),
    ],
)
def test_chunks(spark, text, target, overlap, want):
    assert value(spark, tx.chunks(F.lit(text), target, overlap)) == want


def fold_chunks(text, target, overlap):
    """The chunker's rules in plain Python."""
    import re

    if len(text) <= target:
        return [text.strip()] if text.strip() else []
    units = []
    for p in filter(None, (p.strip() for p in text.split("\n\n"))):
        units += [(" ", s.strip()) for s in re.split(r"(?<=[.!?…])\s+", p) if s.strip()] if len(p) > target else [("\n\n", p)]
    done, now = [], ""
    for sep, body in units:
        if now and len(now) + len(body) + 2 > target:
            done.append(now.strip())
            now = ((now[-overlap:] if len(now) > overlap else "") + sep + body).strip()
        else:
            now = (now + sep + body).strip() if now else body
    return done + ([now.strip()] if now.strip() else [])


def test_chunks_of_random_texts(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(["ab", "c. ", "d! ", "\n\n", "\n", " ", "efgh", "… ", "ж"], k=rng.randint(0, 60))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", tx.chunks(F.col("text"), 20, 5).alias("c")).collect()
    for r in rows:
        assert r["c"] == fold_chunks(texts[r["id"]], 20, 5), texts[r["id"]]


def test_rate_limit(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, i, start + dt.timedelta(seconds=s)) for i, s in enumerate([0, 10, 20, 61, 70])]
    out = sequences.rate_limited(spark.createDataFrame(rows, "user_id long, id long, ts timestamp"), user="user_id", time="ts", key="id", window_seconds=60, most=2)
    assert [r["accepted"] for r in out.orderBy("id").collect()] == [True, True, False, True, True]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 200)), max_size=60), st.integers(1, 4))
def test_rate_limit_never_lets_too_many_through(spark, events, most):
    start = dt.datetime(2024, 1, 1)
    rows = [(u, i, start + dt.timedelta(seconds=s)) for i, (u, s) in enumerate(events)]
    got = sequences.rate_limited(spark.createDataFrame(rows, "user_id long, id long, ts timestamp"), user="user_id", time="ts", key="id", window_seconds=60, most=most).collect()
    assert len(got) == len(rows)
    passed = [(r["user_id"], r["ts"]) for r in got if r["accepted"]]
    for u, t in passed:
        assert sum(v == u and 0 <= (t - s).total_seconds() < 60 for v, s in passed) <= most


def test_classification(spark):
    rules = spark.createDataFrame([(1, "pics", [".jpg"], [], None), (2, "docs", [".PDF"], ["image/"], "D")], "id long, name string, extension_patterns array<string>, mime_patterns array<string>, destination_folder_name string")
    files = [("A.JPG", "image/jpeg"), ("b.pdf", "application/pdf"), ("c.png", "image/png"), ("d.png", "Image/png"), ("e.txt", "text/plain"), (None, None)]
    frame = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "id long, name string, mime_type string")
    got = lambda strategy: [r["destination"] for r in relations.classify(frame, rules, strategy=strategy).orderBy("id").collect()]
    assert got("by_type") == ["pics", "D", "D", None, "TextFiles", None]
    assert got("by_date") == ["pics", "D", "D", None, None, None]


def test_titles_and_previews(spark):
    title = lambda s: value(spark, tx.first_line_title(F.lit(s), "none"))
    assert title("x" * 80) == "x" * 80 and title("x" * 81) == "x" * 80 + "..."
    assert title(" a\nb") == "a" and title(" \n ") == "none" and title(None) == "none"
    assert value(spark, tx.preview(F.lit("y" * 80), 80)) == "y" * 80 + "…"
    assert [value(spark, tx.relevance(F.lit(d))) for d in (0.0, 0.999, 1.3, 2.5)] == [100, 51, 35, 0]


def test_times_and_mail(spark):
    at = F.to_timestamp_ntz(F.lit("2025-12-25 14:00:00"))
    end = lambda s: value(spark, times.end_time(at, F.lit(s)))
    assert end("60") == dt.datetime(2025, 12, 25, 15) and end("25.12.2025 15:30") == dt.datetime(2025, 12, 25, 15, 30) and end("soon") is None
    assert value(spark, tx.normal_email(F.lit(" A@B.c "))) == "a@b.c" and value(spark, tx.normal_email(F.lit("ab.c"))) is None
    assert value(spark, tx.signature_holds(F.lit("100"), F.lit("7"), "pw", F.lit("A85BC189CA43DF7A0C07C13D7914B38D")))
    assert [value(spark, changes.next_version(F.lit(v).cast("int"))) for v in (None, 0, 3)] == [2, 2, 4]


def test_upsert_keeps_first_and_takes_last(spark):
    log = spark.createDataFrame([("f", 1, "u1", "old", False), ("f", 2, "u2", "new", False), ("g", 1, "u", "x", False), ("g", 2, None, None, True), ("h", 1, None, None, True), ("h", 2, "u3", "back", False)], "id string, seq int, owner string, title string, gone boolean")
    out = changes.fold(log, "id", ["seq"], keep_first=["owner"], take_last=["title"], deleted=F.col("gone"))
    assert sorted(map(tuple, out.collect())) == [("f", "u1", "new"), ("h", "u3", "back")]
    again = changes.fold(log.union(log), "id", ["seq"], keep_first=["owner"], take_last=["title"], deleted=F.col("gone"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_lookups_after_top(spark):
    rows = [(f"{i:03d}", i) for i in range(150)]
    frame = spark.createDataFrame(rows, "id string, created_at int")
    assert search.prefix_after_top(frame, "049").count() == 0  # the 101st newest
    assert search.prefix_after_top(frame, "050").count() == 1
    assert search.prefix_after_top(frame, "14", unique=True, newest_rows=50).count() == 0
    local, remote = frame.where("created_at < 19").select("id"), frame.where("created_at between 10 and 38").select("id")
    assert search.local_then_remote(local, remote, key="id", most=20).count() == 19 + 20
    assert search.local_then_remote(frame.limit(20).select("id"), remote, key="id", most=20).count() == 20


def test_vector_filters(spark):
    rows = [(i, [float(i), 0.0], "system_init" if i == 1 else "u") for i in range(6)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>, added_by string")
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, query_vector array<double>")
    near = lambda **o: [r["id"] for r in vectors.nearest(frame, q, k=3, **o).orderBy("place").collect()]
    assert near(max_distance=4.0) == [0, 1, 2]  # equal to the bound is kept
    assert near(max_distance=4.0, after=F.col("added_by") != "system_init") == [0, 2]
    assert vectors.nearest(frame, q, k=3, max_distance=1.0, before=F.col("id") > 2).count() == 0


def test_wings_and_outcomes(spark):
    assert [value(spark, wing_of(F.lit(p))) for p in ("a.txt", "books/a.txt", "other/a.txt", "misc/b/c.md")] == ["misc", "books", "misc", "misc"]
    tries = spark.createDataFrame([("a", False), ("b", True), *[("b", False)] * 9, *[("c", True)] * 5], "id string, ok boolean")
    assert {r["id"]: r["outcome"] for r in outcomes(tries, "id", F.col("ok")).collect()} == {"a": "failed", "b": "warning", "c": "processed"}


def test_two_passes(spark):
    from quarrylight.operators.generate import drafted

    frame = spark.createDataFrame([(1, "a\n\nkeep"), (2, "b\n\ndrop"), (3, None)], "id long, prompt string")
    out = drafted(frame, "prompt", clean=lambda texts: ["" if t == "drop" else t.upper() for t in texts])
    assert {r["id"]: r["body"] for r in out.collect()} == {1: "KEEP", 2: "drop", 3: None}
