"""Chat formatting by prefix-target expansion.

Every assistant turn is exploded into a training example, a row of its own: all preceding turns of the
conversation are its context, and only that reply is trainable.  Written out, the examples of
a conversation take space with the square of its length, so contexts are referenced: the output has the
turns once, as segments, and after its assistant turn each example as a row of bounds: the example's
text is the concatenation of all segments up to and including its ``position``, the context is its first
``context_chars`` characters, and ``loss_start`` to ``loss_end`` is the reply.  ``expanded``
writes the texts out where they are wanted.

Template: ``<|im_start|>role``, a line break, the text, ``<|im_end|>``, a line break.  Inside
texts ``<|`` gets a backslash between its characters, and one more is put where there are some
already, so that no text can end its turn or begin another and the text can be read back
exactly.  Roles are treated so too, and their backslashes and line breaks are escaped.

Defined results: null texts and roles are empty; turns are ordered by ``turn`` (null last),
ties by role and text; rows with a null conversation id form one conversation; repeated rows are
turns of their own; other columns are not read.  A conversation of any length passes as a
stream: a task holds one batch of rows, and running hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import own_columns

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|", text)


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def format_chats(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """Segments, with conv_id, position (from 0), segment and start (of the segment in the conversation's text), and
    examples, with conv_id, position (of the reply), example (from 0), context_chars, loss_start and loss_end (within
    the example's text); what a row doesn't have is null.

    Rows of a conversation are in one partition, in order.
    """
    turns = own_columns(conversations, conv_id=conv_id, turn=turn, role=role, text=text)
    turns = turns.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text")
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select("conv_id", F.concat(head, escape(F.col("text")), F.lit(END + "\n")).alias("segment"), (F.col("role") == trained_role).alias("trained"), F.length(head).cast("long").alias("head"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    tail = len(END) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position, start, example = object(), 0, 0, 0
        for batch in batches:
            rows = []
            for conv, segment, trained, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != current:
                    current, position, start, example = conv, 0, 0, 0
                end = start + len(segment)
                rows.append((conv, position, segment, start, None, None, None, None))
                if trained:
                    rows.append((conv, position, None, None, example, start, start + head, end - tail))
                position, start, example = position + 1, end, example + trained
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["conv_id", "position", "segment", "start", "example", "context_chars", "loss_start", "loss_end"])

    return turns.mapInArrow(place, f"conv_id {kind}, position long, segment string, start long, example long, context_chars long, loss_start long, loss_end long")


def expanded(formatted: DataFrame) -> DataFrame:
    """The examples written out: conv_id, example, text, context_chars, loss_start, loss_end."""
    examples, segments = formatted.where(F.col("example").isNotNull()), formatted.where(F.col("segment").isNotNull())
    examples = examples.select(F.col("conv_id").alias("c"), F.col("position").alias("last"), "example", "context_chars", "loss_start", "loss_end")
    parts = segments.select("conv_id", "position", "segment").join(examples, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("position") <= F.col("last")))
    texts = parts.groupBy("conv_id", "example", "context_chars", "loss_start", "loss_end").agg(F.array_sort(F.collect_list(F.struct("position", "segment"))).alias("s"))
    return texts.select("conv_id", "example", F.array_join("s.segment", "").alias("text"), "context_chars", "loss_start", "loss_end")


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from the output, a row for each conversation: conv_id, n_turns, turns_sha256 (role, line break,
    text, line break of each turn), loss_chars and loss_sha256 (the text under the examples' loss bounds), formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        current, state, done, segment, start = none, None, [], "", 0

        def close() -> None:
            if current is not none:
                turns, whole, loss_chars, loss, chars = state
                done.append((current, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate([conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], fields)
            done.clear()
            return out

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv, found, begin, loss_start, loss_end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "start", "loss_start", "loss_end")), strict=True):
                if current is none or conv != current:
                    close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if found is None:  # an example; its text ends with the last segment
                    reply = unescape(segment[loss_start - start : loss_end - start])
                    state[2] += len(reply)
                    state[3].update(reply.encode())
                    continue
                segment, start = found, begin
                role, text = _TURN.fullmatch(segment).groups()
                state[0] += 1
                state[1].update(f"{_unescape_role(role)}\n{unescape(text)}\n".encode())
                state[4] += len(segment)
            yield flush()
        close()
        if done:
            yield flush()

    return formatted.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
