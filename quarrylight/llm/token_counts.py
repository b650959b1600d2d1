"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton over the vocabulary lists every piece that matches in a text; dynamic
programming over the text's positions carries the best score and the number of pieces of
the path that has it.  Rules of the tokenizer that are kept:

* blanks become U+2581 and one is put before the text;
* a path's score is the sum of its pieces' scores; of paths with equal scores the one whose last
  piece begins earlier wins (the candidate that is met first, begins being visited in order);
* a character that is no piece by itself may be passed at the lowest score less 10, and counts
  as many tokens as it has UTF-8 bytes (byte fallback).

Where no piece holds a blank after another character, the best path of a text is made of the
best paths of its units (blanks and the characters up to the next blank); the same holds at
line breaks if no piece has one.  So each distinct unit is solved once and remembered, within a
bound of bytes.  A vocabulary with such pieces is handled too, text by text.  Solving holds as many
positions as the longest piece has, however long the unit is.

Defined results: null and empty texts have 0 tokens and score 0; a null id stays null;
repeated rows are each counted; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .shared import own_columns

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of solved units that a worker remembers; a unit of over a hundredth of that is solved each time.
REMEMBERED = 60_000_000


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces that can match a text, with their scores: no control, unknown or byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Counter:
    """Best score and piece count of texts."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        self.longest = max(len(piece) for piece, _ in pieces)
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        whole = any(BLANK in piece.lstrip(BLANK) for piece, _ in pieces)
        breaks = any("\n" in piece for piece, _ in pieces)
        if whole:
            self.units = None
        else:
            self.units = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if breaks else f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
        self.known: dict[str, tuple[int, float]] = {}
        self.held = 0

    def solve(self, text: str) -> tuple[int, float]:
        """Piece count and score of the best path over the text."""
        n, width = len(text), self.longest + 1  # positions that a piece can still begin at, and its end
        score: list[float | None] = [None] * width
        count = [0] * width
        score[0] = 0.0
        done = 0

        def close(to: int) -> None:
            """The ends up to `to` get no more pieces; what is left for each is to pass its character as unknown."""
            nonlocal done
            while done < to:
                before, done = done % width, done + 1
                at = done % width
                char = text[done - 1]
                if char not in self.single:
                    passed = score[before] + self.unknown
                    if score[at] is None or passed > score[at]:
                        score[at], count[at] = passed, count[before] + len(char.encode())
                score[(done + 1) % width] = None

        for last, (length, value) in self.automaton.iter(text):  # for each end the longest piece first
            close(last)
            begin, end = (last + 1 - length) % width, (last + 1) % width
            reached = score[begin] + value
            if score[end] is None or reached > score[end]:
                score[end], count[end] = reached, count[begin] + 1
        close(n)
        return count[n % width], score[n % width]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = BLANK + text.replace(" ", BLANK)
        if self.units is None:
            return self.solve(text)
        known, tokens, total = self.known, 0, 0.0
        for match in self.units.finditer(text):
            unit = match[0]
            found = known.get(unit)
            if found is None:
                found = self.solve(unit)
                size = 150 + 4 * len(unit)
                if size <= REMEMBERED // 100:
                    if self.held + size > REMEMBERED:
                        known.clear()
                        self.held = 0
                    known[unit] = found
                    self.held += size
            tokens += found[0]
            total += found[1]
        return tokens, total


_counters: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens long, score double (of the best path) for each document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # as large as the tokenizer's vocabulary
    key = hash(tuple(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(key)
        if counter is None:
            _counters.clear()
            counter = _counters[key] = Counter(shared.value)
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in counts], pa.int64()), pa.array([s for _, s in counts], pa.float64())], ["doc_id", "n_tokens", "score"])

    source = own_columns(docs, doc_id=doc_id, text=text)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(count, f"doc_id {kind}, n_tokens long, score double")
