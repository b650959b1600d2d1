"""The rate limiter over a stream, with state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery



def passed(batches: Iterator[pa.RecordBatch], span: int, most: int) -> Iterator[pa.RecordBatch]:
    """Verdicts on rows (user, micros, id, kept) that are sorted by user, with a user's kept times, if any, in its first row.

    A batch's verdicts leave before the next batch is read; after a user's last row its kept times follow.
    """
    current, kept, began = None, [], False
    for batch in batches:
        users, ids, verdicts, states = [], [], [], []

        def put(user, key, verdict, state, users=users, ids=ids, verdicts=verdicts, states=states) -> None:
            users.append(user)
            ids.append(key)
            verdicts.append(verdict)
            states.append(state)

        for user, now, key, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not began or user != current:
                if began:
                    put(current, None, None, kept)
                current, kept, began = user, [], True
            if before is not None:
                kept = before
                continue
            kept = [t for t in kept if now - t < span]
            verdict = len(kept) < most
            if verdict:
                kept.append(now)
            put(user, key, verdict, None)
        yield pa.RecordBatch.from_arrays([pa.array(users, pa.int64()), pa.array(ids, pa.int64()), pa.array(verdicts, pa.bool_()), pa.array(states, pa.list_(pa.int64()))], _NAMES)
    if began:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.bool_()), pa.array([kept], pa.list_(pa.int64()))], _NAMES)


_NAMES = ["user", "id", "accepted", "kept"]
_VERDICTS = "user long, id long, accepted boolean, kept array<long>"


def limit_stream(events: DataFrame, out: str, checkpoint: str, *, user: str = "user_id", time: str = "ts", key: str = "event_id", window_seconds: float = 60, most: int = 30, lateness_seconds: float = 0, once: bool = False) -> StreamingQuery:
    """The rate limiter over a stream: each event's key and whether it is accepted, in time order within a batch.

    A user's rows pass as a sorted stream, never as a group.  The state of a user is the accepted
    times still in the window, at most ``most``; it is written with a batch's verdicts and is the
    next one's beginning.  A user whose times all lie a window and ``lateness_seconds`` before the newest accepted time has
    no state any more, so a batch costs its own rows and the users of the last window.  An event that comes later than that
    is judged by the times that are left.  A batch that is run again overwrites what it wrote; states before
    the last two are removed.  ``verdicts`` reads the verdicts.
    """
    span, late = int(window_seconds * 1_000_000), int(lateness_seconds * 1_000_000)
    rows = events.select(F.col(user).alias("user"), F.unix_micros(F.col(time).cast("timestamp")).alias("micros"), F.col(key).alias("id"), F.lit(None).cast("array<long>").alias("kept"))

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            last = spark.read.schema(_VERDICTS).parquet(f"{out}/batch={number - 1}/state=true")
            newest = last.agg(F.max(F.array_max("kept"))).first()[0]
            if newest is not None:
                last = last.withColumn("kept", F.filter("kept", lambda t: newest - t < span + late)).where(F.size("kept") > 0)
            batch = batch.unionByName(last.select("user", F.lit(None).cast("long").alias("micros"), F.lit(None).cast("long").alias("id"), "kept"))
        ordered = batch.repartition("user").sortWithinPartitions("user", F.col("kept").isNull(), "micros", "id")
        judged = ordered.mapInArrow(lambda batches: passed(batches, span, most), _VERDICTS).withColumn("state", F.col("kept").isNotNull())
        # Both folders are there even if a batch has no rows of a kind.
        judged = judged.unionByName(spark.createDataFrame([(None, None, None, None, True), (None, None, None, None, False)], f"{_VERDICTS}, state boolean"))
        judged.write.mode("overwrite").partitionBy("state").parquet(f"{out}/batch={number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/batch={number - 2}/state=true")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def states(spark: SparkSession, out: str, number: int) -> DataFrame:
    """The state that a batch left: user and kept times (microseconds)."""
    return spark.read.schema(_VERDICTS).parquet(f"{out}/batch={number}/state=true").where(F.col("user").isNotNull()).select("user", "kept")


def verdicts(spark: SparkSession, out: str) -> DataFrame:
    """What ``limit_stream`` wrote: user, id, accepted."""
    return spark.read.schema(f"{_VERDICTS}, batch long, state boolean").parquet(out).where(~F.col("state") & F.col("accepted").isNotNull()).select("user", "id", "accepted")
