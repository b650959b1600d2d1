"""Full-text search over an inverted index, ranked by the rarity of words and the length of texts (BM25).

Documents form blocks.  The index is a table of postings, one list for each word of each block (documents by their place in it, and how
often they have the word), laid out by a bucket of the word and sorted by word, a small table of words with their frequencies,
and one of the blocks' documents.  A search for few words reads their buckets only, and in them the parts of files that can hold
them.  The lists of all asked words are brought together by block, and a block scores all queries over its own documents, so neither what a word
and a query have in common nor a document's share of a score is ever a row; a query leaves at most k rows a block.

Scores are whole numbers: k1 = 1.2, b = 0.75, a word's weight is floor(10**6 * ln(1 + (N - df + 0.5) / (df + 0.5))) and its
share (weight * 2200 * tf) div (1000 * tf + 300 + (900 * n * N) div L), for n of L words and N documents that have any.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..scratch import new_folder, written

BUCKETS = 64
#: Parts of a bucket by block, and documents and words that a block has at most (one document's words apart).
STRIPS, ROWS_AT_ONCE, WORDS_AT_ONCE = 8, 1 << 12, 1 << 21
#: Up to so many different words of all queries are named in the scan's filter; more are joined.
FEW_WORDS = 2000
#: Lists of words that so many documents have at most are always read in full.
SHORT = 1000
#: Words of queries, repeated for each of them, that a worker holds at once; more are searched for in several rounds.
ASKED_AT_ONCE = 1 << 19


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, with repeats."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with ROWS_AT_ONCE rows and WORDS_AT_ONCE words at most, or one row."""
    ends = np.cumsum(pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        fits = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + WORDS_AT_ONCE, "right"))
        high = max(low + 1, min(fits, low + ROWS_AT_ONCE))
        yield batch.slice(low, high - low)
        low = high


def _binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of values as bytes; ``starts`` has the runs' beginnings and the end."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


_LISTED = "block long, term string, doc binary, tf binary, id array<long>, n array<long>"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's words once, with the documents that have them (numbers of two bytes) and how often (numbers of as many bytes as the
    block's largest needs), and a row without a word for its documents: made where the rows are, so that occurrences are never shuffled."""
    names = [field.split()[0] for field in _LISTED.split(", ")]
    for part in (part for batch in batches for part in _blocks(batch)):
        n = pc.list_value_length(part.column("words")).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = part.column("words").flatten().dictionary_encode()
        terms, size = coded.dictionary.cast(pa.string()), part.num_rows
        pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * size + np.repeat(np.arange(size), n), return_counts=True)
        starts = np.searchsorted(pairs, np.arange(len(terms) + 1) * size)
        block = part.column("row")[0].as_py()
        lists = [pa.array([block] * len(terms), pa.int64()), terms, _binaries((pairs % size).astype("<u2"), starts), _binaries(tf.astype(np.min_scalar_type(tf.max()).newbyteorder("<")), starts)]
        none = lambda kind, rows: pa.nulls(rows, kind)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*lists, none(longs, len(terms)), none(longs, len(terms))], names)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), none(pa.string(), 1), none(pa.binary(), 1), none(pa.binary(), 1), pa.array([part.column("id").to_pylist()], longs), pa.array([n.tolist()], longs)], names)


class _Asked:
    """Queries that blocks answer: their words as numbers of lists, and the scores so far that the k-th of each can't be under."""

    def __init__(self, query: np.ndarray, term: np.ndarray, ids: pa.Array, weights: np.ndarray, often: np.ndarray, k: int, n_all: int, l_all: int):
        order = np.argsort(query, kind="stable")
        self.ids, self.terms, self.starts = ids, term[order], np.searchsorted(query[order], np.arange(len(ids) + 1))
        self.weights, self.often, self.k, self.n_all, self.l_all = weights, often, k, n_all, l_all

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block, the one of its documents first."""
        tops = np.zeros((len(self.ids), self.k), np.int64)
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if high > low:
                    if held and block[low] != now:
                        yield self._scored(held, tops)
                        held = []
                    now = block[low]
                    held.append(batch.slice(low, high - low))
        if held:
            yield self._scored(held, tops)

    def _scored(self, held: list[pa.RecordBatch], tops: np.ndarray) -> pa.RecordBatch:
        ids, n = held[0].column("id")[0].values, held[0].column("n")[0].values.to_numpy()
        rank = np.empty(len(ids), np.int64)  # by id, missing ones last
        rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        lists = pa.Table.from_batches(held).slice(1)
        t = lists["t"].to_numpy()
        joined = lambda name: b"".join(lists[name].to_pylist())
        doc = np.frombuffer(joined("doc"), "<u2").astype(np.int64)
        many, found_in, scores = [], [], []
        if len(doc):
            raw = joined("tf")
            tf = np.frombuffer(raw, f"<u{len(raw) // len(doc)}").astype(np.int64)
            sizes = pc.binary_length(lists["doc"]).to_numpy().astype(np.int64) // 2
            starts = np.concatenate([[0], np.cumsum(sizes)])
            part = np.repeat(self.weights[t], sizes) * 2200 * tf // (1000 * tf + (300 + 900 * n * self.n_all // self.l_all)[doc])
            best = np.maximum.reduceat(part, starts[:-1])
            at = np.full(len(self.weights), -1)
            at[t] = np.arange(len(t))
            often, starts, score = self.often[t], starts.tolist(), np.zeros(len(ids), np.int64)
            for q in range(len(self.ids)):
                mine = at[self.terms[self.starts[q] : self.starts[q + 1]]]
                mine = mine[mine >= 0]
                found = self._best(mine, doc, part, best, often, starts, score, max(1, int(tops[q, 0])), rank)
                if len(found):
                    tops[q] = np.sort(np.concatenate([tops[q], score[found]]))[-self.k :]
                    many.append(np.full(len(found), q))
                    found_in.append(found)
                    scores.append(score[found])
        flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([self.ids.take(flat(many)), ids.take(flat(found_in)), flat(scores)], ["query_id", "id", "score"])

    def _best(self, mine: np.ndarray, doc: np.ndarray, part: np.ndarray, best: np.ndarray, often: np.ndarray, starts: list[int], score: np.ndarray, floor: int, rank: np.ndarray) -> np.ndarray:
        """The block's k best documents of a query that reach the floor; their scores are left in ``score``.

        Long lists that together can't reach it, the weakest ones first, are looked up only for documents of the others that can still reach it.
        """
        if best[mine].sum() < floor:
            return mine[:0]
        mine = mine[np.argsort(best[mine])]
        long = mine[often[mine]]
        reach = np.cumsum(best[long])
        late = long[: np.searchsorted(reach, floor)].tolist()
        score[:] = 0
        for j in np.setdiff1d(mine, late, assume_unique=True).tolist():
            score[doc[starts[j] : starts[j + 1]]] += part[starts[j] : starts[j + 1]]
        left = int(reach[len(late) - 1]) if late else 0
        found = np.flatnonzero(score >= floor - left)
        for j in reversed(late):
            own = doc[starts[j] : starts[j + 1]]
            place = np.minimum(np.searchsorted(own, found), len(own) - 1)
            hit = own[place] == found
            score[found[hit]] += part[starts[j] + place[hit]]
            left -= int(best[j])
            found = found[score[found] >= floor - left]
        if len(found) > self.k:
            values = score[found]
            found = found[values >= np.partition(values, len(values) - self.k)[len(values) - self.k]]
            found = found[np.lexsort((rank[found], -score[found]))[: self.k]]
        return found


class TextIndex:
    """An index at a folder; ``build`` makes one."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def postings(self) -> DataFrame:
        """bucket, term, block, doc (places of documents in the block) and tf (how often they have the word), both as bytes."""
        return self.spark.read.schema("term string, block long, doc binary, tf binary, bucket int").parquet(f"{self.folder}/postings")

    def documents(self) -> DataFrame:
        """block, and of its documents id and n (how many words each has)."""
        return self.spark.read.schema("block long, id array<long>, n array<long>").parquet(f"{self.folder}/documents")

    def terms(self) -> DataFrame:
        """term and df."""
        return self.spark.read.schema("term string, df long").parquet(f"{self.folder}/terms")

    @classmethod
    def build(cls, frame: DataFrame, *, key: str, text: str, folder: str | None = None, buckets: int = BUCKETS) -> TextIndex:
        """Indexes a table.  Rows without words are not found; rows that share a key are documents each by itself."""
        spark = frame.sparkSession
        folder = folder or new_folder(spark)
        each = frame.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), words(F.col(text)).alias("words"))
        listed = written(each.where(F.size("words") > 0).mapInArrow(_listed, _LISTED))
        listed.where(F.col("term").isNull()).select("block", "id", "n").write.mode("overwrite").parquet(f"{folder}/documents")
        placed = listed.where(F.col("term").isNotNull()).select("term", "block", "doc", "tf", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))
        # A frequent word's postings are several tasks' and files', and nothing is read twice to find ranges.
        strip = F.pmod(F.xxhash64("block"), F.lit(STRIPS))
        placed.repartition("bucket", strip).sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        index = cls(spark, folder, buckets)
        index.postings().groupBy("term").agg(F.sum(F.octet_length("doc") / 2).cast("long").alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")
        return index

    def matching(self, asked: DataFrame) -> DataFrame:
        """The posting lists of the asked words (term, and what else a row has)."""
        distinct = asked.select("term").distinct()
        few = [r["term"] for r in distinct.limit(FEW_WORDS + 1).collect()]
        if len(few) > FEW_WORDS:
            return self.postings().join(asked, "term")
        buckets = {r["b"] for r in distinct.select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()}
        return self.postings().where(F.col("bucket").isin(*buckets) & F.col("term").isin(*few)).join(asked, "term") if few else self.postings().limit(0).join(asked, "term")

    def search(self, queries: DataFrame, *, k: int = 10, query_id: str = "query_id", phrase: str = "phrase", short: int = SHORT) -> DataFrame:
        """The k best documents of each query: query_id, place (from 1), id, score; a word counts once in a query, equal scores go by id.

        A block starts from the scores that its task's earlier blocks have found.  A query whose long lists can't reach the k-th of
        them by themselves looks them up only for documents of its other lists that can still pass it.
        """
        asked = written(queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(words(F.col(phrase)))).alias("term")).distinct())
        rounds = max(1, -(-asked.count() // ASKED_AT_ONCE))
        whole = self.documents().agg(F.coalesce(F.sum(F.size("n")), F.lit(0)), F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(1))).first()
        weight = F.floor(F.log(1 + (F.lit(float(whole[0])) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * 1_000_000)
        known = written(self.terms().join(F.broadcast(asked) if rounds == 1 else asked, "term").select("query_id", "term", "df", weight.alias("weight")))
        parts = [known] if rounds == 1 else [known.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == i) for i in range(rounds)]
        answered = [self._answered(part, k, short, *whole) for part in parts]
        scores = reduce(DataFrame.unionByName, answered if rounds == 1 else map(written, answered))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "place", "id", "score")

    def _answered(self, known: DataFrame, k: int, short: int, n_all: int, l_all: int) -> DataFrame:
        """At most k documents of each query and block, the best ones of all among them: query_id, id, score."""
        schema = StructType([known.schema["query_id"], StructField("id", LongType()), StructField("score", LongType())])
        rows = known.toArrow().combine_chunks()
        if not rows.num_rows:
            return self.spark.createDataFrame([], schema)
        coded = lambda name: pc.dictionary_encode(rows[name].chunk(0), null_encoding="encode")
        query, term = coded("query_id"), coded("term")
        first = np.unique(term.indices.to_numpy(), return_index=True)[1]
        weights, df = (rows[name].to_numpy()[first] for name in ("weight", "df"))
        asked = _Asked(query.indices.to_numpy(), term.indices.to_numpy(), query.dictionary, weights, df > short, k, n_all, l_all)
        numbered = self.spark.createDataFrame(pa.table({"term": term.dictionary.cast(pa.string()), "t": pa.array(np.arange(len(first)), pa.int64())}))
        empty = {name: F.lit(None).cast(kind).alias(name) for name, kind in (("doc", "binary"), ("tf", "binary"), ("id", "array<long>"), ("n", "array<long>"))}
        lists = self.matching(F.broadcast(numbered)).select("block", "t", "doc", "tf", empty["id"], empty["n"])  # ASKED_AT_ONCE words at most, or those of one query
        heads = self.documents().select("block", F.lit(-1).cast("long").alias("t"), empty["doc"], empty["tf"], "id", "n")
        return lists.unionByName(heads).repartition("block").sortWithinPartitions("block", "t").mapInArrow(lambda batches: asked(batches), schema)
