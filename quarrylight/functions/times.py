"""Scalar date and time rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MINUTE = "dd.MM.yyyy HH:mm"


def parsed(text: Column) -> Column:
    """``31.12.2025 15:30`` as a timestamp without zone; null if it is something else."""
    return F.try_to_timestamp(text, F.lit(DAY_MINUTE)).cast("timestamp_ntz")


def end_time(start: Column, text: Column) -> Column:
    """Digits alone are minutes after the start; anything else must be a full time."""
    minutes = F.when(text.rlike(r"^\d{1,9}$"), text).otherwise(F.lit(None)).cast("int")
    return F.when(minutes.isNotNull(), start + F.make_dt_interval(mins=minutes)).otherwise(parsed(text))


def valid_interval(start: Column, end: Column) -> Column:
    return F.coalesce(end > start, F.lit(False))
