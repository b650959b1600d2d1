"""Quality rules: a table of thresholds, compiled into one projection of built-in expressions.

A measure is a whole number taken from one text; a rule bounds the ratio of two measures (or one
measure, over 1) from below, from above or both, in thousandths, so a verdict is a comparison of
whole numbers and never of rounded fractions.  ``judged`` adds all measures and the verdict; what a text
needs is in its own row, so nothing is shuffled and one long text costs no more than its length
(times the logarithm of it, for the sorting of its windows).

Words are runs of characters that are none of space, tab, line feed, vertical tab, form feed and carriage return.
Repeated windows are told by 64-bit hashes of their five words, sorted within the text.

Defined results: a null text has no words, lines or symbols, as an empty one; a ratio over nothing counts as 0;
lines without a word are no lines; documents with null ids, repeated ids or repeated rows are judged row
by row; an empty table gives an empty one; other columns stay as they are, and one that has the name of
a measure is replaced (``prefix`` avoids that).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Characters that may stand at a word without making it another word.
MARKS = ".,;:!?\"()"
WINDOW = 5

#: Function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with a an in is it for on as at was are this from by or not "
    "der die das und ist in zu den von mit für auf ein eine nicht sich des dem als im auch an es "
    "le la les de des du et en un une que qui est pour dans par sur au avec pas il elle ce se "
    "el la los las de del y en que un una por con para es se no su al lo como más"
).split()


class Rule(NamedTuple):
    """``least`` <= 1000 * of / per <= ``most``, where given; ``per`` None stands for 1."""

    name: str
    of: str
    per: str | None = None
    least: int | None = None
    most: int | None = None


RULES: tuple[Rule, ...] = (
    Rule("mean word length", "word_chars", "n_words", least=2_000, most=14_000),
    Rule("symbols a word", "n_symbols", "n_words", most=100),
    Rule("exclamation marks a word", "n_exclamations", "n_words", most=250),
    Rule("stop words", "n_stop_words", "n_words", least=30),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=400),
    Rule("lines that break off", "n_ellipsis_lines", "n_lines", most=300),
)
#: The same for every rule table: too few words, or too many of them in repeated windows.
BASE: tuple[Rule, ...] = (Rule("words", "n_words", least=10_000), Rule("repeated words", "n_repeat_words", "n_words", most=200))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclamations", "n_stop_words", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_repeat_words")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def _repeated(words: Column) -> tuple[Column, Column]:
    """For the column of words: its windows' hashes with their places, in order, and, for the column that holds these,
    how many words lie in windows that are there twice."""
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW))).alias("hash"), i.alias("at"))))

    def covered(found: Column) -> Column:
        again = F.filter(found, lambda x, i: F.coalesce(x["hash"] == F.get(found, i - 1)["hash"], F.lit(False)) | F.coalesce(x["hash"] == F.get(found, i + 1)["hash"], F.lit(False)))
        at = F.sort_array(F.transform(again, lambda x: x["at"]))
        # Each place adds what it covers beyond the one before; the first has none before it.
        return F.aggregate(F.transform(F.array(at), lambda p: F.aggregate(F.transform(p, lambda v, i: F.least(F.lit(WINDOW), v - F.get(p, i - 1))), F.lit(0), lambda a, b: a + b)), F.lit(0), lambda a, b: a + b)

    return windows, covered


def measured(docs: DataFrame, *, text: str = "text", stop_words: Sequence[str] = STOP_WORDS, prefix: str = "") -> DataFrame:
    """Adds the measures of the text, each a bigint."""
    stem = "_" * (1 + max((len(c) for c in docs.columns), default=0))  # names that no column has
    whole, words, lines, windows = (f"{stem}{n}" for n in ("text", "words", "lines", "windows"))
    out = docs.withColumn(whole, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    out = out.withColumns({
        words: _words(F.col(whole)),
        lines: F.filter(F.split(F.col(whole), "\n"), lambda x: _without(x, BLANKS) != ""),
    })
    sorted_windows, covered = _repeated(F.col(words))
    out = out.withColumn(windows, sorted_windows)
    plain = _words(_without(F.lower(F.col(whole)), MARKS))
    found = {
        "n_words": F.size(words),
        "word_chars": F.length(_without(F.col(whole), BLANKS)),
        "n_symbols": F.length(whole) - F.length(_without(F.col(whole), SYMBOLS)),
        "n_exclamations": F.length(whole) - F.length(_without(F.col(whole), "!")),
        "n_stop_words": F.size(F.filter(plain, lambda w: w.isin(*stop_words))),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
        "n_repeat_words": covered(F.col(windows)),
    }
    return out.withColumns({prefix + n: c.cast("long") for n, c in found.items()}).drop(whole, words, lines, windows)


def broken(rules: Sequence[Rule], prefix: str = "") -> Column:
    """The names of the rules that a row of measures breaks."""

    def breaks(rule: Rule) -> Column:
        of = F.col(f"`{prefix}{rule.of}`") * 1000
        per = F.lit(1) if rule.per is None else F.col(f"`{prefix}{rule.per}`")
        of = of if rule.per is None else F.when(per == 0, F.lit(0)).otherwise(of)
        per = per if rule.per is None else F.when(per == 0, F.lit(1)).otherwise(per)
        bounds = ([of < per * rule.least] if rule.least is not None else []) + ([of > per * rule.most] if rule.most is not None else [])
        return reduce(lambda a, b: a | b, bounds, F.lit(False))

    return F.filter(F.array(*(F.when(breaks(r), F.lit(r.name)) for r in rules)), lambda name: name.isNotNull()) if rules else F.array().cast("array<string>")


def judged(docs: DataFrame, *, rules: Sequence[Rule] = RULES, text: str = "text", stop_words: Sequence[str] = STOP_WORDS, prefix: str = "") -> DataFrame:
    """Adds the measures, ``base_failed``, ``broken`` (names of the table's rules that are not kept) and ``kept``."""
    out = measured(docs, text=text, stop_words=stop_words, prefix=prefix)
    base = F.size(broken(BASE, prefix)) > 0
    out = out.withColumns({f"{prefix}base_failed": base, f"{prefix}broken": broken(rules, prefix)})
    return out.withColumn(f"{prefix}kept", ~F.col(f"`{prefix}base_failed`") & (F.size(f"`{prefix}broken`") == 0))


def filtered(docs: DataFrame, **options) -> DataFrame:
    """The documents that keep all rules, with their own columns only."""
    prefix = "_" * (1 + max((len(c) for c in docs.columns), default=0))
    return judged(docs, prefix=prefix, **options).where(F.col(f"`{prefix}kept`")).select(*(F.col(f"`{c}`") for c in docs.columns))
