"""Ranked lexical search: a hybrid of term-at-a-time and document-at-a-time over an inverted index.

``index`` reads every document once and keeps its terms and their counts.  A search joins the terms of its queries
with it, so only postings of asked terms go further, gives each posting its exact whole-number part of the
score, and deals documents into shards and queries into blocks, which meet in a grid of bounded cells.

Within a cell a query's short lists are summed at once, term at a time, into accumulators: sorted documents
with their sums, which from there on are one more iterator with a known bound.  That iterator and the long lists are then
read document at a time, in blocks of ascending documents: a block whose bounds can't pass the k-th best
score so far is skipped in all lists, and in a block that is read only documents of the iterators that are needed to pass it are
candidates; the other lists are looked up for candidates that can still pass.  Each cell gives its k best of each
query, and these are ranked per query.

A term is a run of characters that are ASCII letters or digits or not ASCII, with A-Z lower-cased.
With N documents that have terms and L terms in all, a document of n terms has m = 100 - b + (b * n * N) div L
and a term of weight w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) that occurs tf times adds
w * ((10**9 * tf) div (1000 * tf + 8 * m)); div rounds down.

Defined results: null and empty texts have no terms and are never found, as queries they find nothing; a term that a
query repeats counts once; equal scores rank by ascending document id, null ids last, rows that share an id by an order of
their own; rows that repeat an id or a whole row are found, or ask, each by itself; documents with score 0 are not
found; long texts are read whole; empty tables give no rows; other columns don't reach the job.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, own_columns

LENGTH_PART = 90
POSTINGS_PER_SHARD = 400_000
QUERIES_PER_BLOCK = 1024
#: So many distinct query terms are sent to all executors; more meet the documents' terms in a shuffled join.
BROADCAST_TERMS = 400_000
#: Lists of up to so many postings in a shard are summed beforehand.
SHORT = 256
DOCUMENTS_PER_BLOCK = 256

#: Bytes that are part of terms, A-Z lower-cased; all others part them.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, text) as (row, id, n, terms, counts); a few thousand terms are held at a time."""

    def table(rows, ids, sizes, starts, terms, counts) -> pa.RecordBatch:
        offsets = pa.array(starts, pa.int32())
        words = pa.array(terms, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, words), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))],
            ["row", "id", "n", "terms", "counts"],
        )

    for batch in batches:
        rows, ids, sizes, starts, terms, counts = [], [], [], [0], [], []
        for row, key, text in zip(*batch.columns, strict=True):
            found = Counter((text.as_py() or b"").translate(_TERM_BYTES).split())
            rows.append(row.as_py())
            ids.append(key.as_py())
            sizes.append(found.total())
            terms += found.keys()
            counts += found.values()
            starts.append(len(terms))
            if len(terms) > 200_000:
                yield table(rows, ids, sizes, starts, terms, counts)
                rows, ids, sizes, starts, terms, counts = [], [], [], [0], [], []
        if rows:
            yield table(rows, ids, sizes, starts, terms, counts)


def index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: row (a number of its own), id, n (its terms with repeats), terms and counts (of distinct terms)."""
    rows = own_columns(docs, id=doc_id, text=text).select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.encode("text", "UTF-8").alias("text"))
    return rows.mapInArrow(_terms, "row long, id long, n long, terms array<string>, counts array<long>")


class _Shard:
    """The postings of some documents, numbered by ascending id: a sorted list of documents and parts for each term."""

    def __init__(self, postings: pa.Table):
        rows, terms = postings["row"].to_numpy(), postings["term_id"].to_numpy()
        ids = postings["id"].to_pandas()
        known = ids.notna().to_numpy()
        # Documents in the order in which ties rank: by id, null ids last, then by row.
        unique, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
        order = np.lexsort((unique, ids.fillna(0).to_numpy()[first].astype(np.int64), ~known[first]))
        place = np.empty(len(unique), dtype=np.int64)
        place[order] = np.arange(len(unique))
        self.rows, self.ids, self.known = unique[order], ids.fillna(0).to_numpy()[first][order].astype(np.int64), known[first][order]
        documents = place[inverse]
        by_term = np.lexsort((documents, terms))
        self.documents, self.parts = documents[by_term], postings["part"].to_numpy()[by_term]
        self.terms, starts = np.unique(terms[by_term], return_index=True)
        self.starts = np.append(starts, len(terms))
        self.edges = np.arange(0, len(unique) + DOCUMENTS_PER_BLOCK, DOCUMENTS_PER_BLOCK)
        self.blocks = len(self.edges) - 1
        self._long: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def lists(self, wanted: np.ndarray) -> list[int]:
        """Positions of the lists of those of the wanted terms that occur here."""
        at = np.searchsorted(self.terms, wanted)
        return [int(i) for i, t in zip(at, wanted, strict=True) if i < len(self.terms) and self.terms[i] == t]

    def size(self, i: int) -> int:
        return int(self.starts[i + 1] - self.starts[i])

    def bounded(self, documents: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """An iterator: documents, parts, where each block begins, and each block's largest part."""
        begins = np.searchsorted(documents, self.edges)
        bounds = np.zeros(self.blocks, dtype=np.int64)
        np.maximum.at(bounds, documents // DOCUMENTS_PER_BLOCK, parts)
        return documents, parts, begins, bounds

    def long(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if i not in self._long:
            span = slice(self.starts[i], self.starts[i + 1])
            self._long[i] = self.bounded(self.documents[span], self.parts[span])
        return self._long[i]

    def accumulated(self, lists: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Term at a time: the sums of the short lists, as one iterator."""
        documents = np.concatenate([self.documents[self.starts[i] : self.starts[i + 1]] for i in lists])
        parts = np.concatenate([self.parts[self.starts[i] : self.starts[i + 1]] for i in lists])
        order = np.argsort(documents, kind="stable")
        documents, parts = documents[order], parts[order]
        first = np.flatnonzero(np.append(True, documents[1:] != documents[:-1]))
        return self.bounded(documents[first], np.add.reduceat(parts, first))

    def search(self, wanted: np.ndarray, k: int, short: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents of a query and their scores."""
        none = np.zeros(0, dtype=np.int64)
        lists = self.lists(np.unique(wanted))
        brief = [i for i in lists if self.size(i) <= short]
        readers = [self.long(i) for i in lists if self.size(i) > short]
        best, scores, floor = none, none, 0
        if brief:
            sums = self.accumulated(brief)
            readers.append(sums)
            if len(sums[1]) >= k:  # k documents have at least this; one less, for ties
                floor = max(0, int(np.partition(sums[1], len(sums[1]) - k)[len(sums[1]) - k]) - 1)
        if not readers:
            return none, none
        bounds = np.stack([r[3] for r in readers])
        total = bounds.sum(axis=0)
        for b in np.flatnonzero(total > floor):
            if total[b] <= floor:
                continue
            order = np.argsort(bounds[:, b], kind="stable")  # the weakest first
            reach = np.cumsum(bounds[order, b])
            needed = int(np.searchsorted(reach, floor, side="right"))  # all before it together can't pass
            found = [self._slice(readers[j], b) for j in order[needed:]]
            documents = np.concatenate([d for d, _ in found])
            ahead = np.bincount(documents - self.edges[b], minlength=DOCUMENTS_PER_BLOCK)
            candidates = np.flatnonzero(ahead)
            score = np.zeros(DOCUMENTS_PER_BLOCK, dtype=np.int64)
            for d, p in found:
                score[d - self.edges[b]] += p
            for j in range(needed - 1, -1, -1):
                candidates = candidates[score[candidates] + reach[j] > floor]
                if not len(candidates):
                    break
                d, p = self._slice(readers[order[j]], b)
                at = np.searchsorted(d, candidates + self.edges[b])
                at[at == len(d)] = 0
                hit = (d[at] == candidates + self.edges[b]) if len(d) else np.zeros(len(candidates), dtype=bool)
                score[candidates[hit]] += p[at[hit]]
            candidates = candidates[score[candidates] > floor]
            if len(candidates):
                best, scores = np.append(best, candidates + self.edges[b]), np.append(scores, score[candidates])
                first = np.lexsort((best, -scores))[:k]
                best, scores = best[first], scores[first]
                if len(best) == k:  # later documents have to be better, equal ones rank behind
                    floor = max(floor, int(scores[-1]))
        return best, scores

    @staticmethod
    def _slice(reader: tuple[np.ndarray, ...], b: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(reader[2][b], reader[2][b + 1])
        return reader[0][span], reader[1][span]


def weight(n_documents: Column, df: Column) -> Column:
    return F.floor(F.log((2 * n_documents + 2) / (2 * df + 1)) * 1000).cast("long")


def ranked(
    docs: DataFrame,
    queries: DataFrame,
    *,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    short: int = SHORT,
    postings_per_shard: int = POSTINGS_PER_SHARD,
    queries_per_block: int = QUERIES_PER_BLOCK,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """The k best documents of each query: query_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    indexed = scratch.keep(index(docs, doc_id=doc_id, text=text), "index")
    asked = scratch.keep(index(queries, doc_id=query_id, text=query_text).select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), "terms"), "asked")
    whole = indexed.where(F.col("n") > 0).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    vocabulary = asked.select(F.explode("terms").alias("term")).distinct()
    vocabulary = scratch.keep(vocabulary.select("term", F.monotonically_increasing_id().alias("term_id")), "vocabulary")
    wanted = F.broadcast(vocabulary) if vocabulary.count() <= broadcast_terms else vocabulary
    postings = indexed.select("row", "id", "n", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("row", "id", "n", F.col("p.terms").alias("term"), F.col("p.counts").alias("tf"))
    postings = scratch.keep(postings.join(wanted, "term").select("row", "id", "n", "term_id", "tf"), "postings")
    scratch.drop("index")
    n, all_terms = F.lit(whole["documents"]), F.lit(max(1, whole["terms"]))
    frequent = postings.groupBy("term_id").agg(F.count("*").alias("df"), F.count("*").alias("size")).select("term_id", weight(n.cast("double"), F.col("df").cast("double")).alias("w"), "df")
    frequent = scratch.keep(frequent, "frequent")
    weights = F.broadcast(frequent) if frequent.count() <= broadcast_terms else frequent
    m = F.lit(100 - LENGTH_PART) + F.call_function("div", F.lit(LENGTH_PART) * F.col("n") * n, all_terms)
    part = F.col("w") * F.call_function("div", F.lit(1_000_000_000) * F.col("tf"), 1000 * F.col("tf") + 8 * m)
    across = max(1, -(-(frequent.agg(F.sum("df")).first()[0] or 0) // postings_per_shard))
    down = max(1, -(-asked.count() // queries_per_block))
    parts = postings.join(weights, "term_id").where(F.col("w") > 0).select("row", "id", "term_id", part.alias("part"))
    left = parts.select(F.pmod(F.xxhash64("row"), F.lit(across)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("y"), "row", "id", "term_id", "part")
    numbered = asked.select("query_row", "query_id", F.explode("terms").alias("term")).join(wanted, "term").groupBy("query_row").agg(F.first("query_id").alias("query_id"), F.collect_list("term_id").alias("wanted"))
    right = numbered.select(F.pmod(F.xxhash64("query_row"), F.lit(down)).cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("x"), "query_row", "query_id", "wanted")

    def search(found: pa.Table, queries: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], [], []]
        if found.num_rows and queries.num_rows:
            shard = _Shard(found)
            for query, key, terms in zip(queries["query_row"].to_pylist(), queries["query_id"].to_pylist(), queries["wanted"].to_pylist(), strict=True):
                best, scores = shard.search(np.array(terms, dtype=np.int64), k, short)
                for column, values in zip(columns, ([query] * len(best), [key] * len(best), shard.rows[best].tolist(), [i if known else None for i, known in zip(shard.ids[best].tolist(), shard.known[best], strict=True)], scores.tolist()), strict=True):
                    column += values
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_row", "query_id", "row", "doc_id", "score"])

    best = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(search, "query_row long, query_id long, row long, doc_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
