"""Occurrences of repeating events against day-by-day enumeration."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import calendar

SCHEMA = "id long, start timestamp_ntz, end timestamp_ntz, rule string, off array<timestamp_ntz>"


def plain(start, end, since, until, *, freq=None, interval=1, count=None, last=None, days=None, off=()):
    out, n, at = [], 0, start
    while at < until and (freq or at == start):
        months = (at.year - start.year) * 12 + at.month - start.month
        weeks = ((at.date() - timedelta(at.weekday())) - (start.date() - timedelta(start.weekday()))).days // 7
        takes = {None: at == start, "DAILY": (at - start).days % interval == 0, "WEEKLY": weeks % interval == 0 and at.weekday() in (days or [start.weekday()]), "MONTHLY": at.day == start.day and months % interval == 0, "YEARLY": (at.day, at.month) == (start.day, start.month) and (at.year - start.year) % interval == 0}[freq]
        if takes:
            n += 1
            if (count is None or n <= count) and (last is None or at <= last) and at + (end - start) > since and at not in off:
                out.append((at, at + (end - start), n))
        at += timedelta(1)
    return out


def found(spark, rows, since, until):
    stamp = lambda t: F.to_timestamp_ntz(F.lit(str(t)))
    got = calendar.occurrences(spark.createDataFrame(rows, SCHEMA), stamp(since), stamp(until), except_="off")
    assert got.columns == ["id", "start", "end", "rule", "off", "occurrence"]
    return sorted((r["id"], r["start"], r["end"], r["occurrence"]) for r in got.collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_rules(spark, seed):
    draw = random.Random(seed)
    rows, want = [], []
    since, until = datetime(2026, 2, 20, 12), datetime(2026, 4, 2)
    for i in range(120):
        start = datetime(2020 + draw.randrange(7), draw.randrange(1, 13), draw.choice([1, 15, 28]), draw.randrange(24), 30) + timedelta(draw.randrange(3))
        end = start + timedelta(hours=draw.choice([1, 30, 200]))
        freq = draw.choice([None, "DAILY", "WEEKLY", "MONTHLY", "YEARLY"])
        interval, count = draw.choice([1, 1, 2, 3, 5]), draw.choice([None, None, 3, 40, 400])
        last = draw.choice([None, None, datetime(2026, 3, 10, 9, 30)])
        days = sorted(draw.sample(range(7), draw.randrange(1, 4))) if freq == "WEEKLY" and draw.random() < 0.7 else None
        rule = "" if freq is None else f"RRULE:FREQ={freq};INTERVAL={interval}"
        if freq:
            rule += f";COUNT={count}" if count else ""
            rule += f";UNTIL={last:%Y%m%dT%H%M%SZ}" if last else ""
            rule += ";BYDAY=" + ",".join(calendar.WEEKDAYS[d] for d in days) if days else ""
        off = [x[0] for x in plain(start, end, since, until, freq=freq, interval=interval, days=days)[:1]] if draw.random() < 0.3 else []
        rows.append((i, start, end, rule or draw.choice([None, "", "FREQ=SECONDLY"]), off))
        limits = {"count": count, "last": last} if freq else {}
        want += [(i, *x) for x in plain(start, end, since, until, freq=freq, interval=interval, days=days, off=off, **limits)]
    assert found(spark, rows, since, until) == sorted(want)


def test_days_that_months_lack(spark):
    start = datetime(2023, 10, 31, 8)
    rows = [(1, start, start + timedelta(hours=1), "FREQ=MONTHLY;COUNT=4", None), (2, datetime(2020, 2, 29), datetime(2020, 3, 1), "FREQ=YEARLY;COUNT=2", None), (3, None, start, "FREQ=DAILY", None), (4, start, None, "FREQ=DAILY", None)]
    got = found(spark, rows, datetime(2024, 1, 1), datetime(2024, 12, 31))
    assert got == [(1, datetime(2024, m, 31, 8), datetime(2024, m, 31, 9), n) for m, n in ((1, 3), (3, 4))] + [(2, datetime(2024, 2, 29), datetime(2024, 3, 1), 2)]


def test_only_the_window_is_generated(spark):
    """A rule that has run daily for centuries gives about a window's rows before the filter."""
    frame = spark.createDataFrame([(1, datetime(1600, 1, 1), datetime(1600, 1, 1, 1), "FREQ=DAILY", None)], SCHEMA)
    got = calendar.occurrences(frame, F.to_timestamp_ntz(F.lit("2024-03-01")), F.to_timestamp_ntz(F.lit("2024-03-04")))
    assert [r["occurrence"] for r in got.orderBy("start").collect()] == [(datetime(2024, 3, d) - datetime(1600, 1, 1)).days + 1 for d in (1, 2, 3)]
    assert found(spark, [], datetime(2024, 1, 1), datetime(2024, 2, 1)) == []
