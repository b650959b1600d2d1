"""Dialogs: a finite automaton over each conversation's turns in order.

A dialog begins with its command and asks one thing after the other.  What an answer does depends on the
step: it is kept and the next step follows, or it can't be read and the step is asked again, or the dialog ends.
A conversation can hold many dialogs, one after the other; turns outside of any are passed over.

The turns of a conversation pass as a sorted stream and the state is one open dialog, so a long conversation is never
gathered; a dialog's row leaves when it ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from datetime import UTC, datetime, timedelta
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

# Answers that confirm, the answer that skips a step, the one that ends a dialog, and how times are written.
YES = ("да", "yes", "д", "y")
SKIP = "/skip"
CANCEL = "/cancel"
TIME = "%d.%m.%Y %H:%M"


class Again(Exception):
    """The answer can't be read: the step is asked again."""


class Step(NamedTuple):
    """``kind``: text, stripped, words, time, end (a time, or minutes after ``since``) or confirm.  A step that can be skipped takes an
    empty answer as it is; any other step ends the dialog on one."""

    field: str
    kind: str = "text"
    skips: bool = False
    since: str | None = None


class Dialog(NamedTuple):
    """``after``: pairs of time fields of which the second has to be later, or the confirmed dialog is rejected."""

    command: str
    steps: tuple[Step, ...]
    after: tuple[tuple[str, str], ...] = ()


NOTE = Dialog("/note", (Step("title"), Step("content", skips=True), Step("tags", "words", skips=True), Step("confirm", "confirm")))
EVENT = Dialog("/event", (Step("title"), Step("start", "time"), Step("end", "end", since="start"), Step("description", skips=True), Step("confirm", "confirm")), after=(("start", "end"),))
RULE = Dialog("/add_rule", (Step("name"), Step("patterns", "words"), Step("destination", "stripped"), Step("confirm", "confirm")))


def _time(text: str) -> datetime:
    try:
        return datetime.strptime(text, TIME).replace(tzinfo=UTC)
    except ValueError:
        raise Again from None


def read(step: Step, answer: str, values: Mapping[str, str]) -> str:
    """The step's value for the answer, as text: words are joined by a space, times in ISO form."""
    bare = answer.strip()
    if step.skips and bare == SKIP:
        return ""
    if step.kind == "words":
        return " ".join(bare.split())
    if step.kind == "stripped":
        return bare
    if step.kind == "time" or (step.kind == "end" and not bare.isdigit()):
        return _time(bare).isoformat()
    if step.kind == "end":
        try:
            return (datetime.fromisoformat(values[step.since]) + timedelta(minutes=int(bare))).isoformat()
        except (ValueError, OverflowError):  # digits of other scripts and lengths beyond all calendars
            raise Again from None
    return answer


class _Open:
    """A dialog that has begun."""

    def __init__(self, dialog: Dialog, number: int):
        self.dialog, self.number, self.at, self.values, self.turns = dialog, number, 0, {}, 1

    def turn(self, answer: str) -> str | None:
        """The state in which the answer ends the dialog, if it does."""
        self.turns += 1
        step = self.dialog.steps[self.at]
        if answer.strip() == CANCEL:
            return "cancelled"
        if not answer and not step.skips:
            return "ended"
        try:
            value = read(step, answer, self.values)
        except Again:
            return None
        if step.kind == "confirm":
            if value.strip().lower() not in YES:
                return "cancelled"
            late = all(self.values[a] < self.values[b] for a, b in self.dialog.after)
            return "done" if late else "rejected"
        self.values[step.field] = value
        self.at += 1
        return None

    def row(self, state: str) -> tuple:
        return (self.number, self.dialog.command, state, self.dialog.steps[self.at].field if state == "open" else None, self.values, self.turns)


def run(turns: DataFrame, dialogs: Sequence[Dialog] = (NOTE, EVENT, RULE), *, key: str, order: Sequence[str], text: Column) -> DataFrame:
    """A row for each dialog: the key, number (from 1 in its conversation), command, state (done, cancelled, rejected, ended or open), waits_for
    (the open step's field), values (by field) and turns (how many it took).

    A null answer is an empty one.  A command of a dialog within an open one is an answer like any other; the
    command that cancels ends it in any step.  Turns with equal order are taken by their text.  A null key is a conversation like others.
    """
    commands = {d.command: d for d in dialogs}
    rows = turns.select(F.col(key).alias("key"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.repartition("key").sortWithinPartitions("key", *(f"o{i}" for i in range(len(order))), "text").select("key", "text")
    kind = turns.schema[key].dataType
    schema = StructType([StructField(key, kind), StructField("number", IntegerType()), StructField("command", StringType()), StructField("state", StringType()), StructField("waits_for", StringType()), StructField("values", MapType(StringType(), StringType())), StructField("turns", IntegerType())])
    parts = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_, number, began = None, None, 0, False
        key_type = None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(len(parts) + 1)]
            values = [list(v.items()) for v in columns[5]]
            columns = [*columns[:5], values, columns[6]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key_type, *parts], strict=True)], schema.names)

        for batch in batches:
            key_type = batch.column(0).type
            out = []
            for who, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not began or who != current:
                    if open_:
                        out.append((current, *open_.row("open")))
                    current, open_, number, began = who, None, 0, True
                if open_ is None:
                    if answer.strip() in commands:
                        number += 1
                        open_ = _Open(commands[answer.strip()], number)
                elif state := open_.turn(answer):
                    out.append((current, *open_.row(state)))
                    open_ = None
            yield batch_of(out)
        if open_:
            yield batch_of([(current, *open_.row("open"))])

    return rows.mapInArrow(fold, schema)
