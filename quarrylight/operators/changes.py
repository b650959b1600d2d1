"""Keyed change logs: upserts with partial update, deletes, versions, transitions, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(log: DataFrame, key: str, seq: Sequence[str], *, keep_first: Sequence[str] = (), take_last: Sequence[str] = (), deleted: Column | None = None) -> DataFrame:
    """The table that a log of upserts and deletes leaves.

    A delete forgets everything before it; after it the first row of a key gives ``keep_first``
    and the last one ``take_last``.  One aggregation with partial results, whatever a key's history.
    """
    order = F.struct(*seq)
    if deleted is not None:
        log = log.withColumn("__gone", F.coalesce(deleted, F.lit(False)))
        last = log.where("__gone").groupBy(F.col(key).alias("__key")).agg(F.max(order).alias("__last"))
        log = log.where(~F.col("__gone")).join(last, F.col(key) == F.col("__key"), "left").where(F.col("__last").isNull() | (order > F.col("__last")))
    return log.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in keep_first), *(F.max_by(c, order).alias(c) for c in take_last))


def next_version(version: Column) -> Column:
    """One more than the version, which counts as 1 if it is missing or 0."""
    return F.coalesce(F.nullif(version, F.lit(0)), F.lit(1)) + 1


def version_chain(frame: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: Column, cap: int = 70) -> DataFrame:
    """Numbers each key's rows as versions and names those after the first ``[vN] name``."""
    versions = Window.partitionBy(*keys).orderBy(*order)
    out = frame.withColumn("version", F.row_number().over(versions))
    return out.withColumn("version_name", F.when(F.col("version") == 1, F.left(name, F.lit(cap))).otherwise(F.concat(F.lit("[v"), F.col("version").cast("string"), F.lit("] "), F.left(name, F.lit(cap)))))


def transition(frame: DataFrame, when: Column, state: str, at: Column, *, state_column: str = "lifecycle", time_column: str = "processed_at") -> DataFrame:
    """Rows that meet the condition get the state and its time."""
    return frame.withColumns({state_column: F.when(when, F.lit(state)).otherwise(F.col(state_column)), time_column: F.when(when, at).otherwise(F.col(time_column))})


def retained(frame: DataFrame, time: str, key: str, *, daily: int = 7, weekly: int = 4, monthly: int = 6) -> DataFrame:
    """The last row of each of the latest days, weeks and months that have any."""
    parts = []
    for unit, most in (("day", daily), ("week", weekly), ("month", monthly)):
        bucket = F.date_trunc(unit, time)
        last = frame.groupBy(bucket.alias("__bucket")).agg(F.max_by(key, F.struct(time, key)).alias(key))
        parts.append(last.orderBy(F.desc("__bucket")).limit(most).select(key))
    return frame.join(parts[0].union(parts[1]).union(parts[2]).distinct(), key, "left_semi")
