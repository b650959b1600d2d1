"""Ordered folds over a key's rows: rate limits and dialogs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def rate_limited(events: DataFrame, *, user: str, time: str, key: str, window_seconds: float = 60, most: int = 30) -> DataFrame:
    """Adds ``accepted``: an event passes if fewer than ``most`` accepted ones lie less than the window before it.

    Rejected events don't occupy the window, so this is a fold in time order and no window frame.  The
    rows of a user pass as a sorted stream; the state is the last ``most`` accepted times.
    """
    rows = events.withColumn("__t", F.unix_micros(F.col(time).cast("timestamp")))
    rows = rows.repartition(user).sortWithinPartitions(user, "__t", key)
    at_user, at_time, span = rows.columns.index(user), rows.columns.index("__t"), int(window_seconds * 1_000_000)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept = object(), deque()
        for batch in batches:
            verdicts = []
            for who, now in zip(batch.column(at_user).to_pylist(), batch.column(at_time).to_pylist(), strict=True):
                if who != current:
                    current, kept = who, deque()
                while kept and now - kept[0] >= span:
                    kept.popleft()
                verdicts.append(len(kept) < most)
                if verdicts[-1]:
                    kept.append(now)
            columns = [c for i, c in enumerate(batch.columns) if i != at_time]
            names = [n for i, n in enumerate(batch.schema.names) if i != at_time]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(verdicts, pa.bool_())], [*names, "accepted"])

    schema = StructType([*events.schema, StructField("accepted", BooleanType())])
    return rows.mapInArrow(fold, schema)


#: Answers that confirm.
YES = ("да", "yes", "д", "y")
SKIP = "/skip"


def dialogs(turns: DataFrame, steps: Sequence[str], *, key: str, order: Sequence[str], text: Column, optional: Sequence[str] = (), lists: Sequence[str] = ()) -> DataFrame:
    """What each conversation's answers say: the steps' values and ``state`` (open, cancelled, done).

    The last step is a confirmation.  ``/skip`` empties an optional step; list steps are split at white space.
    """
    from ..functions.text import strip

    rows = turns.withColumn("__step", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    wide = rows.where(F.col("__step") <= len(steps)).groupBy(key).agg(*(F.max(F.when(F.col("__step") == i, F.coalesce(text, F.lit("")))).alias(s) for i, s in enumerate(steps, 1)))
    answer = F.lower(strip(F.col(steps[-1])))
    state = F.when(F.col(steps[-1]).isNull(), "open").when(answer.isin(*YES), "done").otherwise("cancelled")
    values = []
    for s in steps[:-1]:
        value = F.when(strip(F.col(s)) == SKIP, F.lit("")).otherwise(F.col(s)) if s in optional else F.col(s)
        values.append((F.filter(F.split(strip(value), r"(?U)\s+"), lambda x: x != "") if s in lists else value).alias(s))
    return wide.select(key, *values, state.alias("state"))
