"""Language-model scores by context-tree weighting.

A text's words, A-Z lower-cased and joined by single spaces, and an end mark (the byte 0xFF, which UTF-8
never has) are a sequence of bytes.  Each byte is eight binary decisions.  For each
decision (the bits of the byte so far) there is a binary context tree over the ``DEPTH``
bytes before: every node has the Krichevsky-Trofimov estimate of the bits that training texts
had in its context, and is weighted half and half against the product of its children, at all
depths.  The trees are then frozen; a text's score is log10 of the product of its bytes' probabilities.

Training counts are counts of (context, byte) strings.  They are gathered from the corpus by
aggregation and stay a table: the trees below a context's last two bytes are computed group by
group, the two levels above from those groups' roots, for each decision by itself, and the results
go back down.  What comes out is a table of the log-probability of each string that any document has.
Scoring looks strings up; those that are frequent, at most ``HEAD`` of them, in a table that is sent to all
executors, the others by a join.  Word counts, for the baseline, are looked up in the same way.

Defined results: a null text is empty and is scored for its end mark; rows with a null id are scored but
not learned from; with nothing to learn from all decisions are even; repeated rows are each scored
(and learned from); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, own_columns
from .tokens import LOWER, Chunk, chunks

DEPTH = 5
END = 0xFF
#: Entries of a table that is sent to executors (16 bytes each).
HEAD = 1 << 20
#: The hash under which the end mark is counted as a word.
END_WORD = -(2**63)
_GATHERED = 500_000
STRING, WORD = 0, 1


def byte_strings(chunk: Chunk, depth: int, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (context, byte) strings of the chunk's texts, the context's oldest byte highest, and each one's row."""
    n_rows, lengths = chunk.n_rows, ends - starts
    words_in = np.diff(first)
    inner = np.concatenate(([0], np.cumsum(lengths + 1)))
    sizes = np.where(words_in > 0, inner[first[1:]] - inner[first[:-1]], 1)  # words, blanks between them, end mark
    begins = depth + np.concatenate(([0], np.cumsum(sizes + depth - 1)[:-1]))
    stream = np.full(depth + int((sizes + depth - 1).sum()), END, dtype=np.uint8)
    row = np.repeat(np.arange(n_rows), words_in)
    to = begins[row] + inner[:-1] - inner[first[:-1]][row]
    total = int(lengths.sum())
    source = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
    target = np.repeat(to - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
    stream[target] = LOWER[chunk.data[source]]
    last = np.zeros(len(starts), dtype=bool)
    last[first[1:][words_in > 0] - 1] = True
    stream[(to + lengths)[~last]] = 0x20
    wide = stream.astype(np.uint64)
    m = len(stream) - depth
    out = wide[:m].copy()
    for j in range(1, depth + 1):
        out <<= np.uint64(8)
        out |= wide[j : j + m]
    rows = np.repeat(np.arange(n_rows), sizes)
    at = np.repeat(begins - depth - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return out[at], rows


def _runs(ordered: np.ndarray) -> np.ndarray:
    """The indices at which a new value begins."""
    new = np.empty(len(ordered), dtype=bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


class _Tally:
    """Keys with two counts, merged when many have gathered."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, learned: np.ndarray) -> None:
        order = np.argsort(keys)
        keys = keys[order]
        at = _runs(keys)
        self._put(keys[at], np.stack([np.diff(np.append(at, len(keys))), np.add.reduceat(learned[order].astype(np.int64), at)]) if len(at) else np.zeros((2, 0), dtype=np.int64))

    def _put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)

    def merge(self) -> None:
        if len(self.keys) > 1:
            keys, counts = np.concatenate(self.keys), np.concatenate(self.counts, axis=1)
            order = np.argsort(keys)
            keys = keys[order]
            at = _runs(keys)
            self.keys, self.counts, self.size = [], [], 0
            self._put(keys[at], np.add.reduceat(counts[:, order], at, axis=1))

    def take(self, kind: int) -> pa.RecordBatch:
        self.merge()
        keys = self.keys[0] if self.keys else np.zeros(0, dtype=np.uint64)
        counts = self.counts[0] if self.counts else np.zeros((2, 0), dtype=np.int64)
        self.keys, self.counts, self.size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind), pa.int32()), pa.array(keys.view(np.int64)), pa.array(counts[0]), pa.array(counts[1])], ["kind", "key", "seen", "learned"])


def gathered(docs: DataFrame, depth: int) -> DataFrame:
    """Strings and words of (text, learned): kind, key, seen (in all documents), learned (in training documents)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {STRING: _Tally(), WORD: _Tally()}
        for batch in batches:
            learned = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for chunk in chunks(batch.column(0)):
                own = learned[chunk.first_row : chunk.first_row + chunk.n_rows]
                starts, ends, first = chunk.words()
                strings, rows = byte_strings(chunk, depth, starts, ends, first)
                tallies[STRING].add(strings, own[rows])
                words = chunk.hashes(starts, ends, lower=True)
                marks = np.full(chunk.n_rows, np.uint64(END_WORD % 2**64))
                tallies[WORD].add(np.concatenate((words, marks)), np.concatenate((np.repeat(own, np.diff(first)), own)))
                for kind, tally in tallies.items():
                    if tally.size > 2 * _GATHERED:
                        tally.merge()
                        if tally.size > _GATHERED:
                            yield tally.take(kind)
        for kind, tally in tallies.items():
            yield tally.take(kind)

    return docs.mapInArrow(gather, "kind int, key long, seen long, learned long").groupBy("kind", "key").agg(F.sum("seen").alias("seen"), F.sum("learned").alias("learned"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] -= np.log(y[low])
        y[low] += 1
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - np.log(np.pi) - _log_gamma(zeros + ones + 1)


def _weighted(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability of nodes, and the share that their own estimate has in it."""
    own = _estimate(zeros, ones)
    both = np.logaddexp(own, children) - np.log(2)
    return both, np.exp(own - np.log(2) - both)


class Trees:
    """Context trees below one context of ``top`` bytes, for all decisions."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray, depth: int, top: int):
        context, byte = strings >> np.uint64(8), (strings & np.uint64(255)).astype(np.int64)
        self.byte, self.top, self.depth = byte, top, depth
        number = np.unique(context, return_inverse=True)
        keys, zeros, ones = [], [], []
        for i in range(8):
            bit = (byte >> (7 - i)) & 1
            keys.append(number[1] * 256 + ((1 << i) | (byte >> (8 - i))))
            zeros.append(counts * (bit == 0))
            ones.append(counts * (bit == 1))
        node, at = np.unique(np.concatenate(keys), return_inverse=True)
        self.leaf = at.reshape(8, -1)
        level = {"context": number[0][node // 256], "decision": node % 256, "zeros": np.bincount(at, np.concatenate(zeros)), "ones": np.bincount(at, np.concatenate(ones))}
        level["log"], level["share"] = _estimate(level["zeros"], level["ones"]), np.ones(len(node))
        self.levels = {depth: level}
        for d in range(depth - 1, top - 1, -1):
            below = self.levels[d + 1]
            shorter, number = np.unique(below["context"] & np.uint64((1 << (8 * d)) - 1), return_inverse=True)
            node, at = np.unique(number * 256 + below["decision"], return_inverse=True)
            below["parent"] = at
            level = {"context": shorter[node // 256], "decision": node % 256, "zeros": np.bincount(at, below["zeros"]), "ones": np.bincount(at, below["ones"])}
            level["log"], level["share"] = _weighted(level["zeros"], level["ones"], np.bincount(at, below["log"]))
            self.levels[d] = level

    def scores(self, above: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """log10 of each string's probability, from what the levels above the top nodes give and leave to them."""
        for d in range(self.top, self.depth + 1):
            level = self.levels[d]
            one = (level["ones"] + 0.5) / (level["zeros"] + level["ones"] + 1)
            if d > self.top:
                above, open_ = above[level["parent"]], open_[level["parent"]]
            above, open_ = above + open_ * level["share"] * one, open_ * (1 - level["share"])
        out = np.zeros(len(self.byte))
        for i in range(8):
            p = above[self.leaf[i]]
            out += np.log10(np.where((self.byte >> (7 - i)) & 1, p, 1 - p))
        return out


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def log_probabilities(strings: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """key, seen and score (log10 of the probability) of strings (key, seen, learned)."""
    strings = strings.withColumn("tail", F.shiftright("key", 8).bitwiseAND(0xFFFF).cast("int"))

    def up(table: pa.Table) -> pa.Table:
        trees = Trees(_unsigned(table["key"]), table["learned"].to_numpy().astype(np.float64), depth, 2)
        top = trees.levels[2]
        return pa.table({"tail": pa.array(top["context"].astype(np.int32)), "decision": pa.array(top["decision"], pa.int32()), "zeros": top["zeros"], "ones": top["ones"], "log": top["log"]})

    roots = scratch.keep(strings.groupBy("tail").applyInArrow(up, "tail int, decision int, zeros double, ones double, log double"), "roots")

    def across(table: pa.Table) -> pa.Table:
        """Of one decision, the two levels above the groups: what they give to each group and leave open."""
        tail = table["tail"].to_numpy()
        zeros, ones, log = (table[c].to_numpy() for c in ("zeros", "ones", "log"))
        byte, at = np.unique(tail & 255, return_inverse=True)
        zeros, ones = np.bincount(at, zeros), np.bincount(at, ones)
        log, share = _weighted(zeros, ones, np.bincount(at, log))
        share_root = _weighted(zeros.sum(keepdims=True), ones.sum(keepdims=True), log.sum(keepdims=True))[1]
        root = share_root * (ones.sum() + 0.5) / (zeros.sum() + ones.sum() + 1)
        above = root + (1 - share_root) * share * (ones + 0.5) / (zeros + ones + 1)
        return pa.table({"tail": table["tail"], "decision": table["decision"], "above": above[at], "open": ((1 - share_root) * (1 - share))[at]})

    tops = scratch.keep(roots.groupBy("decision").applyInArrow(across, "tail int, decision int, above double, open double"), "tops")

    def down(table: pa.Table, top: pa.Table) -> pa.Table:
        trees = Trees(_unsigned(table["key"]), table["learned"].to_numpy().astype(np.float64), depth, 2)
        order = np.argsort(top["decision"].to_numpy())  # as in the top level
        return pa.table({"key": table["key"], "seen": table["seen"], "score": trees.scores(top["above"].to_numpy()[order], top["open"].to_numpy()[order])})

    return strings.groupBy("tail").cogroup(tops.groupBy("tail")).applyInArrow(down, "key long, seen long, score double")


def _head(frame: DataFrame, most: int, value: str) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys, at most so many, with their values.

    Frequencies are counted exactly up to 4096 and in 64 steps for each doubling beyond.  The step that doesn't fit as a whole is
    taken in part, by a hash of the key, so the table is full to within a thousandth of that step whatever the frequencies.
    """
    large = F.lit(4096) + F.floor(F.log2(F.col("seen") / 4096) * 64)
    ranked = frame.select("key", F.col(value).alias("value"), F.when(F.col("seen") < 4096, F.col("seen")).otherwise(large).cast("long").alias("step"), F.pmod(F.xxhash64("key"), F.lit(1024)).cast("int").alias("part"))

    def fitting(column: str, rows: DataFrame, room: int, down: bool) -> tuple[int | None, int]:
        """The first value that doesn't fit, in order of size, and the room that is left."""
        for r in rows.groupBy(column).count().orderBy(F.desc(column) if down else column).collect():  # some thousand rows at most
            if r["count"] > room:
                return r[column], room
            room -= r["count"]
        return None, room

    cut, room = fitting("step", ranked, most, down=True)
    if cut is not None:
        inside = ranked.where(F.col("step") == cut)
        last, _ = fitting("part", inside, room, down=False)
        ranked = ranked.where(F.col("step") > cut).unionByName(inside.where(F.col("part") < last) if last is not None else inside)
    got = ranked.select("key", "value").toArrow()
    keys, values = got["key"].to_numpy().view(np.uint64), got["value"].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted key is there, and its value (any, if not)."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def score(docs: DataFrame, learn_from: Column, *, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each document.

    Documents for which ``learn_from`` (over doc_id) holds are learned from.  ``base_score`` is log10 of the
    text under smoothed word frequencies.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ctw")
    source = own_columns(docs, doc_id=doc_id, text=text)
    counts = scratch.keep(gathered(source.select("text", F.coalesce(learn_from, F.lit(False)).alias("learned")), depth), "counts")
    words = counts.where((F.col("kind") == WORD) & (F.col("learned") > 0)).select("key", "seen", "learned")
    n_train, n_distinct = words.agg(F.coalesce(F.sum("learned"), F.lit(0)), F.count("*")).first()
    strings = scratch.keep(log_probabilities(counts.where(F.col("kind") == STRING).select("key", "seen", "learned"), depth, scratch), "strings")
    scratch.drop("roots", "tops")
    string_keys, string_scores = _head(strings, head, "score")
    word_keys, word_counts = _head(words, head, "learned")
    tables = spark.sparkContext.broadcast((string_keys, string_scores, word_keys, word_counts))  # at most 2 * head * 16 bytes
    whole = n_train + 0.5 * (n_distinct + 1)
    base_of = lambda c: np.log10((c + 0.5) / whole)
    kind = source.schema["doc_id"].dataType.simpleString()
    fields = ["row", "doc_id", "kind", "key", "n", "known", "base", "score"]
    types = [pa.int64(), None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        string_keys, string_scores, word_keys, word_counts = tables.value
        next_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            for chunk in chunks(batch.column(1)):
                n_rows = chunk.n_rows
                starts, ends, first = chunk.words()
                row_of = np.concatenate((np.repeat(np.arange(n_rows), np.diff(first)), np.arange(n_rows)))
                hashed = np.concatenate((chunk.hashes(starts, ends, lower=True), np.full(n_rows, np.uint64(END_WORD % 2**64))))
                values, at = np.unique(hashed, return_inverse=True)
                found, count = _looked_up(word_keys, word_counts, values)
                found, base = found[at], base_of(count)[at]
                totals = [np.bincount(row_of[found], w, n_rows) for w in (None, base[found])]
                n_tokens = np.bincount(row_of, minlength=n_rows)
                rest = [(WORD, row_of[~found], hashed[~found])]
                strings, rows = byte_strings(chunk, depth, starts, ends, first)
                order = np.argsort(strings)
                strings, rows = strings[order], rows[order]
                begins = _runs(strings)
                found, value = _looked_up(string_keys, string_scores, strings[begins])
                sizes = np.diff(np.append(begins, len(strings)))
                found, value = np.repeat(found, sizes), np.repeat(value, sizes)
                scores = np.bincount(rows[found], value[found], n_rows)
                rest.append((STRING, rows[~found], strings[~found]))
                at = pa.array(np.arange(chunk.first_row, chunk.first_row + n_rows))
                numbers = next_row + np.arange(n_rows)
                next_row += n_rows
                columns = [numbers, ids.take(at), np.full(n_rows, -1), np.zeros(n_rows, dtype=np.int64), n_tokens, totals[0].astype(np.int64), totals[1], scores]
                yield pa.RecordBatch.from_arrays([c if t is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], fields)
                for which, own, keys in rest:
                    if len(own):
                        none = pa.nulls(len(own), ids.type)
                        zero = np.zeros(len(own))
                        columns = [numbers[own], none, np.full(len(own), which), keys.view(np.int64), np.ones(len(own), dtype=np.int64), zero.astype(np.int64), zero, zero]
                        yield pa.RecordBatch.from_arrays([c if t is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], fields)

    parts = source.mapInArrow(look_up, f"row long, doc_id {kind}, kind int, key long, n long, known long, base double, score double")
    parts = scratch.keep(parts, "parts")
    rare = parts.where("kind >= 0").groupBy("row", "kind", "key").agg(F.sum("n").alias("n"))
    rare_words = rare.where(F.col("kind") == WORD).join(words.select("key", "learned"), "key", "left").withColumn("learned", F.coalesce("learned", F.lit(0)))
    rare_words = rare_words.select("row", F.when(F.col("learned") > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10((F.col("learned") + 0.5) / F.lit(float(whole)))).alias("base"), F.lit(0.0).alias("score"))
    rare_strings = rare.where(F.col("kind") == STRING).join(strings.select("key", F.col("score").alias("log")), "key")
    rare_strings = rare_strings.select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("n") * F.col("log")).alias("score"))
    more = rare_words.unionByName(rare_strings).groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("score").alias("more_score"))
    result = parts.where("kind = -1").join(more, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias({"base": "base_score", "known": "n_known"}.get(a, a))
    return result.select("doc_id", F.col("n").alias("n_tokens"), plus("known", "more_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"), plus("base", "more_base"), plus("score", "more_score"))
