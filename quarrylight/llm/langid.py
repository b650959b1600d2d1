"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the runs of 2, 3 and 4 bytes of its A-Z lower-cased text in which
everything ASCII but letters is a blank.  Each hashes to one of ``BUCKETS`` embeddings; a linear
softmax over their average gives the languages' probabilities.  Embeddings and softmax are
trained together by stochastic gradient descent in numpy, on at most ``SAMPLE`` documents of each
language (rows with the smallest hash of their id and text, repeated ones once) and ``SAMPLE_IN_ALL`` of all languages, of which the
``LANGUAGES`` with most documents are learned; whole texts are turned to counts by
the executors.  A fifth of the sample is set aside to calibrate: a temperature makes the
probabilities match what is observed.  Each text set aside also gives a text that is no language,
of letters drawn at random.  The rejection threshold is the confidence under which
all but ``ACCEPTED_JUNK`` of those fall, unless more than ``REJECTED_SHARE`` of the texts
themselves would fall there; then it is the largest under which no more do.  Fewer texts than can tell so small
a share give it as twice as far from 1 as the least confident of them.

A prediction reads a text and the model, nothing else.  As the model is linear after the average,
embeddings times softmax weights is one table of ``BUCKETS`` rows that executors look up.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected, and so
is every text if there is nothing to learn from; documents with a null label or text are not
learned from, an empty label is one like others; repeated rows are each predicted; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import own_columns
from .tokens import Chunk, chunks

BUCKETS = 1 << 14
ORDERS = (2, 3, 4)
DIMENSIONS = 16
EPOCHS = 6
LEARNING_RATE = 0.4
#: Documents of each language that are learned from, at most.
SAMPLE = 600
#: One text in so many of the sample is set aside.
ASIDE = 5
#: Documents of all languages that are learned from, at most (about 20 KB each in the task that trains), and languages.
SAMPLE_IN_ALL = 6000
LANGUAGES = 512
REJECTED_SHARE = 0.001
ACCEPTED_JUNK = 0.02
UNKNOWN = "und"

_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
for _c in range(ord("a"), ord("z") + 1):
    _LETTERS[_c] = _LETTERS[_c - 32] = _c


def subwords(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of all runs in the chunk, and each text's first run (one more at the end)."""
    letters = _LETTERS[chunk.data].astype(np.uint32)
    lengths = np.diff(chunk.offsets)
    for order in ORDERS:
        m = len(letters) - order + 1
        if m <= 0:
            yield np.zeros(0, dtype=np.int64), np.zeros(chunk.n_rows + 1, dtype=np.int64)
            continue
        value = letters[:m].copy()
        for j in range(1, order):
            value <<= np.uint32(8)
            value |= letters[j : j + m]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D + 2 * order)
        value ^= value >> np.uint32(12)
        value *= np.uint32(0x297A2D39)
        bucket = (value >> np.uint32(32 - (BUCKETS - 1).bit_length())).astype(np.int64)
        runs = np.maximum(lengths - order + 1, 0)
        inside = np.ones(m, dtype=bool)  # runs over a text's end are left out
        for back in range(1, order):
            edge = chunk.offsets[1:-1] - back
            inside[edge[(edge >= 0) & (edge < m)]] = False
        yield bucket[inside], np.concatenate(([0], np.cumsum(runs)))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, float32: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, chunk: Chunk) -> np.ndarray:
        total = np.zeros((chunk.n_rows, len(self.languages)))
        n = np.zeros(chunk.n_rows)
        for bucket, first in subwords(chunk):
            size = np.diff(first)
            some = size > 0
            if some.any():
                total[some] += np.add.reduceat(self.table[bucket], first[:-1][some], axis=0, dtype=np.float32)
                n += size
        return total / np.maximum(n, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def jumbled(chunk: Chunk) -> Chunk:
    """The chunk with each letter's bytes replaced by letters a to z that are drawn evenly, the same for the same text."""
    data = _LETTERS[chunk.data]
    for low, high in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True):
        at = low + np.flatnonzero(data[low:high] != 0x20)
        data[at] = np.random.default_rng(zlib.crc32(data[low:high].tobytes())).integers(ord("a"), ord("z") + 1, len(at), dtype=np.uint8)
    return Chunk(chunk.first_row, data, chunk.offsets)


def train(samples: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """A model from (language, buckets, counts, buckets and counts of the jumbled text) of each sampled text; those with a jumbled text are set aside."""
    languages = sorted({s[0] for s in samples})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    number = {lang: i for i, lang in enumerate(languages)}
    share = lambda counts: (counts / counts.sum()).astype(np.float32)
    data = [s for s in samples if len(s[1])]
    aside = [i for i, d in enumerate(data) if d[3] is not None]
    learned = np.array([i for i, d in enumerate(data) if d[3] is None], dtype=np.int64)
    steps, step = EPOCHS * max(1, len(learned)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learned):
            label, at, own = number[data[i][0]], data[i][1], share(data[i][2])
            rate = LEARNING_RATE * (1 - step / steps)
            step += 1
            mean = own @ embeddings[at]
            error = -_softmax(mean @ weights + bias)
            error[label] += 1
            pull = weights @ error
            weights += rate * np.outer(mean, error)
            bias += rate * 0.1 * error
            # An embedding's gradient is scaled by its share; scaled up again, so that it learns as fast as the softmax.
            embeddings[at] += (rate * min(len(at), 200)) * own[:, None] * pull[None, :]
    model = Model(languages, (embeddings @ weights).astype(np.float32), bias.astype(np.float64))
    if len(aside):
        logits = np.stack([share(data[i][2]) @ model.table[data[i][1]] + model.bias for i in aside])
        labels = np.array([number[data[i][0]] for i in aside])
        grid = np.geomspace(0.05, 20, 60)
        sure = 1 - 1 / (len(labels) + 1)  # so many texts can't tell a higher probability apart; of equal temperatures the highest
        losses = np.array([-np.log(np.clip(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12, sure)).mean() for t in grid])
        model.temperature = float(grid[np.flatnonzero(losses <= losses.min() + 1e-9)[-1]])
        confidence = np.sort(model.probabilities(logits).max(axis=1))
        junk = np.stack([share(data[i][4]) @ model.table[data[i][3]] + model.bias for i in aside])
        junk = np.sort(model.probabilities(junk).max(axis=1))
        rank = int(REJECTED_SHARE * len(confidence))
        most = confidence[rank] if rank else 2 * confidence[0] - 1
        model.threshold = float(max(0.0, min(np.nextafter(junk[-1 - int(ACCEPTED_JUNK * len(junk))], 2), most)))
    return model


def learn(docs: DataFrame, usable: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, in_all: int = SAMPLE_IN_ALL, most_languages: int = LANGUAGES) -> Model | None:
    """A model from the labelled documents where ``usable`` (over doc_id) holds."""
    rows = own_columns(docs, doc_id=doc_id, text=text, lang=lang).where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("drawn"))
    # A share of each language's different rows that leaves about three times the sample goes into the ranking, however many there are.
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("drawn").alias("different")).orderBy(F.desc("n"), "lang").limit(most_languages).select("lang", "different").collect()
    if not sizes:
        return None
    sample = max(1, min(sample, in_all // len(sizes)))
    sizes = docs.sparkSession.createDataFrame(sizes, "lang string, different long")
    span = 1 << 30
    place = F.pmod("drawn", F.lit(span))
    share = F.least(F.lit(1.0), F.lit(3.0 * sample) / F.greatest("different", F.lit(1))) * span
    near = rows.join(F.broadcast(sizes), "lang").where((place < share) & F.col("text").rlike(r"\p{L}")).select("lang", "drawn", "text")  # at most `most_languages` sizes
    first = Window.partitionBy("lang").orderBy(place, "drawn")
    rows = near.dropDuplicates(["lang", "drawn"]).withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = ([], []), ([], [])
            for chunk in chunks(batch.column(1)):
                aside = [zlib.crc32(chunk.data[a:b].tobytes()) % ASIDE == 0 for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)]
                for which, source in enumerate((chunk, jumbled(chunk))):
                    parts = list(subwords(source))
                    for r in range(chunk.n_rows):
                        if which and not aside[r]:
                            found[1].append(None)
                            counts[1].append(None)
                            continue
                        at, n = np.unique(np.concatenate([b[f[r] : f[r + 1]] for b, f in parts]), return_counts=True)
                        found[which].append(at.astype(np.uint16).tobytes())
                        counts[which].append(n.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in (found[0], counts[0], found[1], counts[1]))], ["lang", *names])

    names = ["buckets", "counts", "jumbled_buckets", "jumbled_counts"]
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = []
        for batch in batches:
            columns = [[None if not x.is_valid else np.frombuffer(x.as_buffer(), dtype=np.float32 if "counts" in n else np.uint16) for x in batch[n]] for n in names]  # views, no copies
            samples.extend(zip(batch["lang"].to_pylist(), *columns, strict=True))
        order = lambda x: (x[0], zlib.crc32(x[1]), zlib.crc32(x[2]), len(x[1]), x[1].tobytes()[:64], x[2].tobytes()[:64])
        model = train(sorted(samples, key=order))
        if model is not None:
            yield pa.RecordBatch.from_pylist([{"languages": model.languages, "table": model.table.tobytes(), "bias": model.bias.tobytes(), "temperature": model.temperature, "threshold": model.threshold}])

    # One task of an executor trains on the whole sample, which is bounded; the driver gets the model alone.
    counted = rows.mapInArrow(count, "lang string, " + ", ".join(f"{n} binary" for n in names)).repartition(1)
    trained = counted.mapInArrow(fit, "languages array<string>, table binary, bias binary, temperature double, threshold double").collect()
    if not trained:
        return None
    got = trained[0]
    table = np.frombuffer(got["table"], dtype=np.float32).reshape(BUCKETS, len(got["languages"]))
    return Model(list(got["languages"]), table, np.frombuffer(got["bias"], dtype=np.float64), got["temperature"], got["threshold"])


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _predictions(model: Model | None, texts: pa.Array, has_letter: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' languages, scores, and whether the predictions are accepted."""
    n = len(texts)
    if model is None:
        return np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.zeros(n, dtype=bool)
    best, score = np.zeros(n, dtype=np.int64), np.zeros(n)
    some = has_letter.to_numpy(zero_copy_only=False).astype(bool)
    for chunk in chunks(texts):
        p = model.probabilities(model.logits(chunk))
        at = slice(chunk.first_row, chunk.first_row + chunk.n_rows)
        best[at], score[at] = p.argmax(axis=1), p.max(axis=1)
    score = np.where(some, np.clip(score, 0, 1), 0.0)
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    return names[np.where(some, best, len(names) - 1)], score, some & (score >= model.threshold)


def identify(docs: DataFrame, model: Model | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted for each document."""
    source = own_columns(docs, doc_id=doc_id, text=text).select("doc_id", "text", _has_letter(F.col("text")).alias("has_letter"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, score, accepted = _predictions(model, batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(score), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    return source.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """The documents whose prediction is accepted, with all their columns; no shuffle."""
    at = docs.columns.index(text)
    unused = "_" * (1 + max(map(len, docs.columns)))
    marked = docs.select("*", _has_letter(docs[f"`{text}`"]).alias(unused))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = _predictions(model, batch.column(at), batch.column(batch.num_columns - 1))[2]
            whole = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
            yield whole.filter(pa.array(stay))

    return marked.mapInArrow(choose, docs.schema)


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
