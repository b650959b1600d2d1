"""The streamed rate limiter: bounded memory, and state from batch to batch."""

import random
from datetime import datetime, timedelta

import pyarrow as pa

from quarrylight.operators import sequences
from quarrylight.streaming import jobs


def test_a_user_is_never_held_as_a_whole():
    """Verdicts on a batch of rows leave before the next batch is read, though all rows are one user's."""
    read = []

    def batches():
        for b in range(50):
            read.append(b)
            n = [b * 10 + i for i in range(10)]
            yield pa.RecordBatch.from_arrays([pa.array([7] * 10), pa.array(n), pa.array(n), pa.array([None] * 10, pa.list_(pa.int64()))], ["user", "micros", "id", "kept"])

    seen = []
    for i, out in enumerate(jobs.passed(batches(), span=100, most=3)):
        assert len(read) == min(i + 1, 50)
        seen += [r["accepted"] for r in out.to_pylist() if r["kept"] is None]
        states = [r["kept"] for r in out.to_pylist() if r["kept"] is not None]
        assert states == ([[400, 401, 402]] if i == 50 else [])
    assert seen == [n % 100 < 3 for n in range(500)]


def test_batches_in_time_order_equal_the_batch_limiter(spark, tmp_path):
    rng, at, start = random.Random(5), 0, datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        at += rng.randint(0, 20)
        rows.append((i, start + timedelta(seconds=at), 1 if i % 3 == 0 else rng.randint(2, 6)))
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    for part in range(4):  # files are taken in the order of their times
        frame.where(f"event_id div 100 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.limit_stream(events, f"{tmp_path}/out", f"{tmp_path}/state", window_seconds=300, most=4, once=True).awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=*"))) == 4
    want = sequences.rate_limited(frame, user="user_id", time="ts", key="event_id", window_seconds=300, most=4)
    want = sorted(map(tuple, want.select("user_id", "event_id", "accepted").collect()))
    assert sorted(map(tuple, jobs.verdicts(spark, f"{tmp_path}/out").collect())) == want
    assert 50 < sum(r[2] for r in want) < 350


def test_state_ends_with_the_window(spark, tmp_path):
    """A user's state goes once the window behind the newest time is empty, and old batches' states are removed."""
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=s), u) for i, (s, u) in enumerate([(0, 1), (1, 1), (2, 2), (100, 3), (101, 3), (200, 4), (201, 4), (202, 4), (90, 1)])]
    for part, ids in enumerate([(0, 1, 2), (3, 4), (5, 6), (7, 8)]):
        spark.createDataFrame([rows[i] for i in ids], "event_id long, ts timestamp, user_id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.limit_stream(events, f"{tmp_path}/out", f"{tmp_path}/state", window_seconds=60, most=2, once=True).awaitTermination()
    assert not (tmp_path / "out/batch=0/state=true").exists() and not (tmp_path / "out/batch=1/state=true").exists()
    assert {r["user"] for r in jobs.states(spark, f"{tmp_path}/out", 2).collect()} == {3, 4}  # user 1's and 2's times were over before
    got = {r["id"]: r["accepted"] for r in jobs.verdicts(spark, f"{tmp_path}/out").collect()}
    assert got == {i: i != 7 for i in range(9)}  # the late row of user 1 meets no times any more
