"""Dialogs: steps that repeat, skip, end; many in one conversation."""

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import dialogs

SCHEMA = "who string, at long, said string, number long"


def outcome(spark, *answers):
    frame = spark.createDataFrame([("u", i, a, 0) for i, a in enumerate(answers)], SCHEMA)
    return [(r["number"], r["command"], r["state"], r["waits_for"], r["values"], r["turns"]) for r in dialogs.run(frame, key="who", order=["at"], text=F.col("said")).orderBy("number").collect()]


def test_event_repeats_until_times_can_be_read(spark):
    got = outcome(spark, "hello", "/event", " Talk ", "tomorrow", "31.02.2025 10:00", " 25.12.2025 14:00 ", "soon", "90", "/skip", " ДА ")
    assert got == [(1, "/event", "done", None, {"title": " Talk ", "start": "2025-12-25T14:00:00+00:00", "end": "2025-12-25T15:30:00+00:00", "description": ""}, 9)]


@pytest.mark.parametrize(("end", "state"), [("0", "rejected"), ("24.12.2025 10:00", "rejected"), ("26.12.2025 10:00", "done")])
def test_an_event_ends_after_it_starts(spark, end, state):
    assert outcome(spark, "/event", "t", "25.12.2025 14:00", end, "text", "y")[0][2] == state


def test_minutes_beyond_all_calendars_and_other_digits_are_asked_again(spark):
    got = outcome(spark, "/event", "t", "25.12.2025 14:00", "9" * 30, "²", "30")
    assert got[0][2:4] == ("open", "description")


def test_note_and_rule(spark):
    got = outcome(spark, "/note", "a", " /skip ", "x  y\tz", "no", "/add_rule", "r", " .jpg  .png ", " folder ", "Yes", "/note", "b", None, "", "д")
    assert [(g[1], g[2], g[4]) for g in got] == [
        ("/note", "cancelled", {"title": "a", "content": "", "tags": "x y z"}),
        ("/add_rule", "done", {"name": "r", "patterns": ".jpg .png", "destination": "folder"}),
        ("/note", "done", {"title": "b", "content": "", "tags": ""}),
    ]


def test_cancel_empty_and_open(spark):
    got = outcome(spark, "/event", "/note", "/cancel", "/note", None, "/add_rule", "r")
    assert [(g[1], g[2], g[3], g[4]) for g in got] == [("/event", "cancelled", None, {"title": "/note"}), ("/note", "ended", None, {}), ("/add_rule", "open", "patterns", {"name": "r"})]


def test_conversations_apart_null_keys_and_no_rows(spark):
    rows = [(None, 1, "/note", 0), (None, 2, "t", 0), ("a", 2, "t", 0), ("a", 1, "/note", 0), ("b", 1, "x", 0)]
    got = {r["who"]: r["values"] for r in dialogs.run(spark.createDataFrame(rows, SCHEMA), key="who", order=["at"], text=F.col("said")).collect()}
    assert got == {None: {"title": "t"}, "a": {"title": "t"}}
    assert dialogs.run(spark.createDataFrame([], SCHEMA), key="who", order=["at"], text=F.col("said")).count() == 0
