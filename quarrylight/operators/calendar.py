"""Intervals in time: agenda windows, due and upcoming rows, delayed pulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def agenda(events: DataFrame, since: Column, days: int, *, start: str = "start", end: str = "end", key: str = "id", limit: int = 10) -> DataFrame:
    """The first events that overlap the window: end after its begin, start before its end."""
    until = since + F.make_dt_interval(days=F.lit(days))
    return events.where((F.col(end) > since) & (F.col(start) < until)).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(key)).limit(limit)


def due(frame: DataFrame, as_of: Column, *, at: str = "scheduled_at", state: str = "approved", state_column: str = "lifecycle") -> DataFrame:
    return frame.where((F.col(state_column) == state) & (F.col(at) <= as_of))


def split_at(frame: DataFrame, as_of: Column, at: str) -> DataFrame:
    """Adds ``phase``: upcoming from the reference time on, past before it."""
    return frame.withColumn("phase", F.when(F.col(at) >= as_of, "upcoming").when(F.col(at) < as_of, "past"))


def pulls(frame: DataFrame, at: str, hours: Sequence[int] = (1, 24, 168)) -> DataFrame:
    """A row for each delay after ``at``: delay_hours and pull_at."""
    delayed = frame.withColumn("delay_hours", F.explode(F.array(*map(F.lit, hours))))
    return delayed.withColumn("pull_at", F.col(at) + F.make_dt_interval(hours=F.col("delay_hours")))


# Days of the week as recurrence rules name them, from Monday.
WEEKDAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
_UNITS = {"DAILY": "DAY", "WEEKLY": "WEEK", "MONTHLY": "MONTH", "YEARLY": "YEAR"}


def rule_parts(rule: Column) -> dict[str, Column]:
    """Parts of a rule like ``RRULE:FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,WE;COUNT=9;UNTIL=20240301T000000Z``: freq, interval, count, until, days (0 is Monday), each null
    if it isn't there."""
    part = lambda name: F.nullif(F.regexp_extract(F.upper(rule), rf"(?:^|[:;]){name}=([^;]*)", 1), F.lit(""))
    until = part("UNTIL")
    # A date alone is its whole day.
    until = F.coalesce(F.try_to_timestamp(F.regexp_extract(until, r"^(\d{8}T\d{6})Z?$", 1), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(F.concat(F.regexp_extract(until, r"^(\d{8})$", 1), F.lit("235959")), F.lit("yyyyMMddHHmmss")))
    days = F.filter(F.transform(F.split(part("BYDAY"), ","), lambda d: F.array_position(F.lit(list(WEEKDAYS)), d).cast("int") - 1), lambda d: d >= 0)
    return {"freq": part("FREQ"), "interval": F.greatest(F.lit(1), part("INTERVAL").try_cast("int")), "count": part("COUNT").try_cast("int"), "until": until.cast("timestamp_ntz"), "days": F.array_sort(F.array_distinct(days))}


def occurrences(events: DataFrame, since: Column, until: Column, *, start: str = "start", end: str = "end", rule: str = "rule", except_: str | None = None) -> DataFrame:
    """Events with a row for each occurrence that overlaps the window (end after ``since``, start before ``until``), whose start
    and end replace the event's, and its ``occurrence`` (from 1).

    Rules repeat daily, weekly (on days of the week, by default the start's; weeks begin on Monday), monthly or yearly (on the start's day; months without it are
    passed over), every ``interval``-th time, up to ``count`` occurrences or an inclusive time.  ``except_``: a column of starts
    that don't take place; they count all the same.  A null, empty or unknown rule is a single event.  Starts and ends are times
    without a zone.  Rows are made only for the window, give or take one period at its ends: how many occurrences lie
    before it is reckoned, not generated.  Events with a null start or end have no occurrences.
    """
    stem = "__occ_"
    parts = rule_parts(F.col(rule))
    known = parts["freq"].isin(*_UNITS)
    rows = events.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumns({f"{stem}{n}": c for n, c in parts.items()}).withColumn(f"{stem}freq", F.when(known, F.col(f"{stem}freq")))
    freq, step, most, last, days = (F.col(f"{stem}{n}") for n in ("freq", "interval", "count", "until", "days"))
    step = F.coalesce(step, F.lit(1))
    begin, length = F.col(start).cast("timestamp_ntz"), F.col(end) - F.col(start)
    own_day = F.weekday(begin)
    days = F.when(freq == "WEEKLY", F.when(F.coalesce(F.size(days), F.lit(0)) > 0, days).otherwise(F.array(own_day))).otherwise(F.array(F.lit(0)))
    # Weeks are reckoned from the Monday of the start's week, at the start's time of day; the rest from the start.
    base = F.when(freq == "WEEKLY", begin - F.make_dt_interval(days=own_day)).otherwise(begin)
    rows = rows.withColumns({f"{stem}base": base, f"{stem}days": days, f"{stem}length": length, f"{stem}step": step})
    base, days, length, step = (F.col(f"{stem}{n}") for n in ("base", "days", "length", "step"))

    def periods(to: Column) -> Column:
        """Whole periods of the rule from its base to a time."""
        units = F.lit(None).cast("long")
        for name, unit in _UNITS.items():
            units = F.when(freq == name, F.timestamp_diff(unit, base, to)).otherwise(units)
        return F.floor(units / step).cast("int")

    low = F.greatest(F.lit(0), periods(since.cast("timestamp_ntz") - length) - 1)
    high = F.least(periods(until.cast("timestamp_ntz")) + 1, F.coalesce(periods(last) + 1, F.lit(2**31 - 1)))
    span = F.when(freq.isNull(), F.array(F.lit(0))).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn(f"{stem}n", F.explode(span)).withColumn(f"{stem}day", F.explode(days))
    n, day = F.col(f"{stem}n"), F.col(f"{stem}day")
    at = base
    for name, unit in _UNITS.items():
        at = F.when(freq == name, F.timestamp_add(unit, n * step, base)).otherwise(at)
    at = F.when(freq == "WEEKLY", at + F.make_dt_interval(days=day)).otherwise(at)
    rows = rows.withColumn(f"{stem}at", at)
    at = F.col(f"{stem}at")
    monthly = freq.isin("MONTHLY", "YEARLY")
    months = F.when(freq == "YEARLY", F.lit(12)).otherwise(1) * step
    # Periods before this one whose month has no such day.
    without = lambda i: F.dayofmonth(F.add_months(F.to_date(base), (i * months).cast("int"))) != F.dayofmonth(base)
    skipped = F.when(monthly & (F.dayofmonth(base) > 28) & most.isNotNull() & (n > 0), F.size(F.filter(F.sequence(F.lit(0), n - 1), without))).otherwise(0)
    weekly_place = n * F.size(days) + F.array_position(days, day).cast("int") - F.size(F.filter(days, lambda d: d < own_day))
    place = F.when(freq == "WEEKLY", weekly_place).otherwise(n + 1 - skipped)
    rows = rows.withColumn("occurrence", place)
    keep = (at >= begin) & ~(F.coalesce(monthly, F.lit(False)) & (F.dayofmonth(at) != F.dayofmonth(base))) & (most.isNull() | (F.col("occurrence") <= most) | freq.isNull()) & (last.isNull() | (at <= last) | freq.isNull())
    keep = keep & (at + length > since) & (at < until)
    if except_ is not None:
        keep = keep & ~F.coalesce(F.array_contains(except_, at), F.lit(False))
    rows = rows.where(keep).withColumns({start: at, end: at + length, "occurrence": F.col("occurrence").cast("int")})
    return rows.drop(*(c for c in rows.columns if c.startswith(stem)))
