"""Removal of long word spans that occurred before, over a compacted de Bruijn graph.

The words of a document make a path in a de Bruijn graph whose edges are its windows of ``window``
consecutive words.  Writing every edge of a corpus down costs many times its text, so paths
are compacted where they are read:

* A window's minimizer is the smallest hash among its runs of ``ANCHOR_WORDS`` words (the first, if
  tied).  Equal windows have equal minimizers at equal places.  A maximal run of consecutive
  windows with one minimizer is a piece of path; its key is the minimizer, its content the hash of
  all its words.
* Pieces are counted by key.  A key met once is no repeated edge, and its piece ends there.  A
  key whose pieces all have one content does not branch: each piece is a repeated
  nonbranching path, all of its windows occur in the same documents, and a join brings back
  the first of them to every occurrence.
* A key with several contents branches (or a shared span begins or ends inside the piece).  Only these
  pieces are taken apart into their edges, which are counted and joined in the same way.

The joins give source coordinates: for each piece or edge of a document that a smaller document id
also has, the place where it is first.  Pieces that follow each other in both documents are one path:
anti-joins with predecessors and successors leave the paths' heads and ends, which are joined in order.
The words at each path's source coordinates are fetched as a cryptographic digest and compared with those at
its own.  Then each document is read once more, windows that repeat within it are
found there, and all words covered by a window that is not the first of its kind are removed.
Documents of which a path differs from its source (64-bit hashes that collided) are done again with the
words themselves as keys.

Defined results: a null or empty text has no words; a document with fewer words than a window
keeps all; rows that repeat a document id count as the same place in the order, so they don't
remove each other's words, and a null id comes after all others; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, own_columns
from .tokens import _INVERSE, _MULTIPLIER, Chunk, _power_table, chunks, mix64, ngram_hashes, row_of_word

WINDOW = 20
ANCHOR_WORDS = 6


def _minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the index of its smallest one, the first if tied."""
    m = len(grams) - width + 1
    at = np.arange(len(grams))
    have = 1
    while have < width:
        step = min(have, width - have)
        first, second = at[: len(at) - step], at[step:]
        at = np.where(grams[second] < grams[first], second, first)
        have += step
    return at[:m]


def _span_hashes(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the words from low to before high, for each pair."""
    n = len(hashes)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * _power_table(_MULTIPLIER, n), out=sums[1:])
    return mix64((sums[high] - sums[low]) * _power_table(_INVERSE, n)[low] + (high - low).astype(np.uint64))


def pieces(chunk: Chunk, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of path of a chunk: row, key, content, start (word in its text), windows; once for each text that repeats it."""
    starts, ends, first = chunk.words()
    if len(starts) < window:
        return (np.zeros(0, dtype=np.int64),) * 5
    hashes = chunk.hashes(starts, ends, lower=False)
    grams = ngram_hashes(hashes, ANCHOR_WORDS)
    anchor = _minimizers(grams, window - ANCHOR_WORDS + 1)
    row = row_of_word(first)
    n = len(anchor)
    valid = row[:n] == row[window - 1 :]
    begins = np.empty(n, dtype=bool)
    begins[0] = True
    begins[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (row[1:n] != row[: n - 1])
    begins &= valid
    low = np.flatnonzero(begins)
    if not len(low):
        return (np.zeros(0, dtype=np.int64),) * 5
    count = np.add.reduceat(valid, low, dtype=np.int64)  # windows over a text's end follow its last piece and are not counted
    key = grams[anchor[low]]
    content = _span_hashes(hashes, low, low + count + window - 1) ^ mix64((anchor[low] - low).astype(np.uint64))
    own = row[low]
    once = np.unique(mix64(key ^ mix64(content ^ mix64(own.astype(np.uint64)))), return_index=True)[1]
    low, count, own = low[once], count[once], own[once]
    return own, key[once].view(np.int64), content[once].view(np.int64), low - first[own], count


def _windows(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window of one text's words."""
    one = ngram_hashes(hashes, window)
    two = ngram_hashes(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), window)
    return one, two


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers from each start, as many as its count."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])


def _spans(column: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts and counts packed in a row's list."""
    packed = column[i].values
    if packed is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    packed = packed.to_numpy()
    return packed >> 16, packed & 0xFFFF


def _digest(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, low: int, n: int, stop: int) -> bytes | None:
    """Of n words from word ``low``, joined by one space; None if they run over word ``stop``."""
    if low + n > stop:
        return None
    own = slice(low, low + n)
    return hashlib.blake2b(b" ".join([chunk.data[s:e].tobytes() for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]), digest_size=16).digest()


_PLACE = ["doc_id", "version"]
_SOURCE = ["s_doc", "s_version"]


def _joined(left: DataFrame, right: DataFrame, equal: list[tuple[str, str]], how: str) -> DataFrame:
    """A join on pairs of columns that may be null; the right side's columns have names of their own."""
    condition = F.lit(True)
    for one, two in equal:
        condition = condition & F.col(one).eqNullSafe(F.col(two))
    return left.join(right, condition, how)


def compacted(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Paths (doc_id, version, start, n windows, s_doc, s_version, s_start) of neighbouring pieces with neighbouring sources."""
    line = F.xxhash64(*_PLACE, *_SOURCE, F.col("start") - F.col("s_start")).alias("line")  # a document's pieces from one place of one source
    rows = scratch.keep(found.select(*_PLACE, *_SOURCE, "start", "s_start", (F.col("start") + F.col("n")).alias("stop"), line), "pieces")
    scratch.drop("met", "edges", "firsts")
    before = rows.select(F.col("line").alias("o_line"), F.col("stop").alias("o_stop"))
    after = rows.select(F.col("line").alias("o_line"), F.col("start").alias("o_start"))
    heads = rows.drop("stop").join(before, (F.col("line") == F.col("o_line")) & (F.col("start") == F.col("o_stop")), "left_anti")
    ends = rows.select("line", "stop").join(after, (F.col("line") == F.col("o_line")) & (F.col("stop") == F.col("o_start")), "left_anti")
    heads = heads.withColumn("number", F.row_number().over(Window.partitionBy("line").orderBy("start")))
    ends = ends.withColumn("number", F.row_number().over(Window.partitionBy("line").orderBy("stop")))
    return heads.join(ends, ["line", "number"]).select(*_PLACE, "start", (F.col("stop") - F.col("start")).alias("n"), *_SOURCE, "s_start")


def _exact(texts: DataFrame, doubtful: DataFrame, window: int, kind: str, scratch: Scratch) -> DataFrame:
    """doc_id, version, start of the windows of doubtful documents (d, v) that a smaller id also has, told apart by their words."""

    def windows(batches: Iterator[pa.RecordBatch], with_words: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                starts, ends, first = chunk.words()
                hashes = chunk.hashes(starts, ends, lower=False)
                for r in range(chunk.n_rows):
                    one = ngram_hashes(hashes[first[r] : first[r + 1]], window).view(np.int64)
                    row = pa.array(np.full(len(one), chunk.first_row + r))
                    columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.arange(len(one))), pa.array(one)]
                    names = [*_PLACE, "start", "one"]
                    if with_words:
                        own = [chunk.data[s:e].tobytes().decode() for s, e in zip(starts[first[r] : first[r + 1]].tolist(), ends[first[r] : first[r + 1]].tolist(), strict=True)]
                        columns.append(pa.array([" ".join(own[i : i + window]) for i in range(len(one))], pa.string()))
                        names.append("words")
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, version long, start long, one long"
    own = [("doc_id", "d"), ("version", "v")]
    sought = _joined(texts, doubtful, own, "left_semi").mapInArrow(lambda b: windows(b, False), schema).select(F.col("one").alias("o")).distinct()
    sought = scratch.keep(sought, "sought")
    holders = texts.mapInArrow(lambda b: windows(b, False), schema).join(sought, F.col("one") == F.col("o"), "left_semi").select(F.col("doc_id").alias("d"), F.col("version").alias("v")).distinct()
    worded = _joined(texts, holders, own, "left_semi").mapInArrow(lambda b: windows(b, True), f"{schema}, words string")
    worded = scratch.keep(worded.join(sought, F.col("one") == F.col("o"), "left_semi"), "worded")
    firsts = worded.groupBy("words").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")).alias("first"))
    later = worded.join(firsts, "words").where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    return scratch.keep(_joined(later, doubtful, own, "left_semi").select(*_PLACE, "start"), "exact")


def removed_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for each document."""
    scratch = Scratch(docs.sparkSession, "spans")
    source = own_columns(docs, doc_id=doc_id, text=text)
    kind = source.schema["doc_id"].dataType.simpleString()
    # Coordinates are by document id and a 32-bit hash of the content, as ids may repeat.
    texts = source.select("doc_id", F.hash("text").cast("long").alias("version"), "text")
    short = np.int64(-1) if hash_bits == 64 else np.int64((1 << hash_bits) - 1)  # fewer bits make hashes collide, for tests

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                own, key, content, start, count = pieces(chunk, window)
                at = pa.array(own + chunk.first_row)
                place = (start << 16) | count
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(key & short), pa.array(content & short), pa.array(place)], ["doc_id", "version", "key", "content", "place"])

    found = texts.mapInArrow(read, f"doc_id {kind}, version long, key long, content long, place long")
    place_of = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version", F.shiftright("place", 16).alias("start"))
    paths = found.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"), F.min(place_of).alias("first"))
    paths = scratch.keep(paths.where("n > 1").select("key", (F.col("low") != F.col("high")).alias("branching"), "first"), "paths")
    later = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    sourced = [F.shiftright("place", 16).alias("start"), F.col("place").bitwiseAND(0xFFFF).alias("n"), F.col("first.doc_id").alias("s_doc"), F.col("first.version").alias("s_version"), F.col("first.start").alias("s_start")]
    met = scratch.keep(found.join(paths, "key").where(F.col("branching") | later).select(*_PLACE, "branching", "place", F.when(~F.col("branching"), F.col("first")).alias("first")), "met")

    def take(side: DataFrame, name: str) -> DataFrame:
        side = side.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), F.col("places").alias(name))
        return side

    scratch.drop("paths")

    # Pieces at branches, taken apart into edges.
    branches = take(met.where("branching").groupBy("doc_id", "version").agg(F.collect_list("place").alias("places")), "places")
    apart = texts.join(branches, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))).select("doc_id", "version", "text", "places")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                starts, ends, first = chunk.words()
                hashes = chunk.hashes(starts, ends, lower=False)
                rows, ones, twos, places = [], [], [], []
                for r in range(chunk.n_rows):
                    at = _ranges(*_spans(batch.column(3), chunk.first_row + r))
                    one, two = _windows(hashes[first[r] : first[r + 1]], window)
                    at = np.sort(at)
                    once = np.unique(one[at], return_index=True)[1]  # the first in this text
                    at = at[once]
                    rows.append(np.full(len(at), chunk.first_row + r))
                    ones.append(one[at])
                    twos.append(two[at])
                    places.append((at << 16) | 1)
                take_rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take_rows), batch.column(1).take(take_rows), pa.array(np.concatenate(ones).view(np.int64) & short), pa.array(np.concatenate(twos).view(np.int64) & short), pa.array(np.concatenate(places))], ["doc_id", "version", "one", "two", "place"])

    edges = scratch.keep(apart.mapInArrow(split, f"doc_id {kind}, version long, one long, two long, place long"), "edges")
    scratch.drop()  # nothing but the shuffles so far
    firsts = edges.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(place_of).alias("first")).where("n > 1").select("one", "two", "first")
    firsts = scratch.keep(firsts, "firsts")
    scratch.drop()
    single = edges.join(firsts, ["one", "two"]).where(later).select(*_PLACE, *sourced)
    spans = scratch.keep(compacted(met.where(~F.col("branching")).select(*_PLACE, *sourced).unionByName(single), scratch), "spans")
    scratch.drop("pieces")

    # The words at the source coordinates.
    asked = spans.select(*_SOURCE, "s_start", "n").distinct().groupBy(*_SOURCE).agg(F.collect_list(F.struct("s_start", "n")).alias("asked"))
    asked = _joined(texts.dropDuplicates(_PLACE), asked, [("doc_id", "s_doc"), ("version", "s_version")], "inner").select("doc_id", "version", "text", "asked")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3).to_pylist()
            for chunk in chunks(batch.column(2)):
                starts, ends, first = chunk.words()
                rows = [(chunk.first_row + r, w["s_start"], w["n"], _digest(chunk, starts, ends, first[r] + w["s_start"], w["n"] + window - 1, first[r + 1])) for r in range(chunk.n_rows) for w in wanted[chunk.first_row + r]]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.binary())))], ["w_doc", "w_version", "w_start", "w_n", "digest"])

    words = asked.mapInArrow(fetch, f"w_doc {kind}, w_version long, w_start long, w_n long, digest binary")
    gone = _joined(spans, words, [("s_doc", "w_doc"), ("s_version", "w_version"), ("s_start", "w_start"), ("n", "w_n")], "left")
    gone = gone.groupBy(*_PLACE).agg(F.collect_list(F.struct("start", "n", F.coalesce("digest", F.lit(b"")).alias("digest"))).alias("places"))
    gone = take(scratch.keep(gone, "gone"), "places")
    own = [("doc_id", "d"), ("version", "v")]
    whole = _joined(texts, gone, own, "left").select("doc_id", "version", "text", "places")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, digests, doubtful = [], [], [], []
            for chunk in chunks(batch.column(2)):
                starts, ends, first = chunk.words()
                hashes = chunk.hashes(starts, ends, lower=False)
                for r in range(chunk.n_rows):
                    low, n = first[r], int(first[r + 1] - first[r])
                    cover, doubt = np.zeros(n + 1, dtype=np.int64), False
                    if n >= window:
                        for span in batch.column(3)[chunk.first_row + r].as_py() or ():
                            at, m = span["start"], span["n"]
                            doubt |= span["digest"] is not None and span["digest"] != _digest(chunk, starts, ends, low + at, m + window - 1, low + n)
                            cover[at] += 1
                            cover[min(at + m + window - 1, n)] -= 1
                        one = ngram_hashes(hashes[low : low + n], window)
                        order = np.argsort(one, kind="stable")
                        again = order[1:][one[order[1:]] == one[order[:-1]]]
                        np.add.at(cover, again, 1)
                        np.add.at(cover, again + window, -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    words = [chunk.data[s:e].tobytes() for s, e in zip(starts[low : low + n][keep].tolist(), ends[low : low + n][keep].tolist(), strict=True)]
                    sizes.append(n)
                    removed.append(n - len(words))
                    digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    doubtful.append(doubt)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(doubtful, pa.bool_())], [*_PLACE, *fields, "doubtful"])

    fields = ["n_words", "n_removed", "kept_sha256"]
    schema = f"doc_id {kind}, version long, n_words long, n_removed long, kept_sha256 string, doubtful boolean"
    result = scratch.keep(whole.mapInArrow(clean, schema), "result")
    doubtful = result.where("doubtful").select(F.col("doc_id").alias("d"), F.col("version").alias("v")).distinct()
    if doubtful.limit(1).count():
        single = _exact(texts, doubtful, window, kind, scratch)
        single = single.groupBy(*_PLACE).agg(F.collect_list(F.struct("start", F.lit(1).cast("long").alias("n"), F.lit(None).cast("binary").alias("digest"))).alias("places"))
        again = _joined(_joined(texts, doubtful, own, "left_semi"), take(single, "places"), own, "left").select("doc_id", "version", "text", "places")
        result = scratch.keep(result.where(~F.col("doubtful")).unionByName(again.mapInArrow(clean, schema)), "again")
    scratch.keep_only("result", "again")
    return result.select("doc_id", *fields)
