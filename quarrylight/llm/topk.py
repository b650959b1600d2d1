"""Exact top-k search by inner product: columnar branch and bound.

Candidates and queries are dealt into a grid of cells of bounded size.  Within a cell the
candidates lie in vertical layout, one row of numbers per dimension.  For each query the
scores are accumulated a block of dimensions at a time; after each block the Cauchy-Schwarz
product of the masses that remain bounds every score from both sides, candidates whose upper
bound is below the k-th largest lower bound leave, and the survivors are compacted.  What is
left after the last block has exact scores.  The cells' best are then ranked for each query.

Components are integers.  Sums of products are exact in floating point below 2**53; a cell
that could pass it is computed in Python integers (scores are then kept within 64 bits).

Defined results: vectors that are null or hold a null or non-finite component, and rows with a
null id, take no part; vectors of different lengths are compared over their common
dimensions, the missing ones counting as 0; a query's own id is never among its results;
repeated rows are candidates, and queries, each by itself; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import own_columns

DIMENSIONS_PER_BLOCK = 16
CANDIDATES_PER_CELL = 8192
QUERIES_PER_CELL = 1024


def quantized(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as bigint; null if the vector can't take part."""
    values = F.transform(embedding, lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(embedding.isNotNull() & finite, F.transform(values, lambda x: F.floor(x * scale).cast("bigint")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of lists of integers, padded with 0 to the longest."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def search_cell(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its position, and the ids and scores of its k best in the cell (more where the k-th place is tied)."""
    width = min(queries.shape[1], candidates.shape[1])
    queries, candidates = queries[:, :width], candidates[:, :width]
    largest = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(candidates.astype(np.float64)).max(initial=0)) * max(width, 1)
    if largest >= 2.0**53:
        for i, q in enumerate(queries.astype(object)):
            scores = np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in candidates.astype(object).dot(q)], dtype=np.int64) if width else np.zeros(len(ids), dtype=np.int64)
            own = ids != query_ids[i]
            order = np.lexsort((ids[own], -scores[own].astype(object)))[:k]
            yield i, ids[own][order], scores[own][order]
        return
    vertical = np.ascontiguousarray(candidates.T, dtype=np.float64)
    wide = queries.astype(np.float64)
    edges = list(range(0, width, block)) + [width]
    # What remains of each vector's length after each block; a little more, so that rounding can't drop a candidate.
    left = [np.sqrt((vertical[e:] ** 2).sum(axis=0)) * (1 + 1e-9) for e in edges[1:]]
    query_left = [np.sqrt((wide[:, e:] ** 2).sum(axis=1)) for e in edges[1:]]
    for i, q in enumerate(wide):
        alive = np.flatnonzero(ids != query_ids[i])
        scores = np.zeros(len(alive))
        for b, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            part = vertical[low:high] if len(alive) == vertical.shape[1] else vertical[low:high, alive]
            scores = scores + q[low:high] @ part
            if len(alive) > k:
                slack = left[b][alive] * query_left[b][i]
                floor = np.partition(scores - slack, len(alive) - k)[len(alive) - k]
                stay = scores + slack >= floor
                alive, scores = alive[stay], scores[stay]
        order = np.lexsort((ids[alive], -scores))[:k]
        yield i, ids[alive][order], scores[order].astype(np.int64)


def top_k(
    frame: DataFrame,
    is_query: Column,
    *,
    k: int,
    vec_id: str = "vec_id",
    vector: str = "vector",
    block: int = DIMENSIONS_PER_BLOCK,
    candidates_per_cell: int = CANDIDATES_PER_CELL,
    queries_per_cell: int = QUERIES_PER_CELL,
) -> DataFrame:
    """The k best of all rows for each row where ``is_query`` holds: query_id, rank (from 1), vec_id, score.

    ``vector`` is an array of bigint; ``is_query`` is over the column ``vec_id``.
    """
    rows = own_columns(frame, vec_id=vec_id, vector=vector).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    chosen = rows.where(is_query)
    across = max(1, -(-rows.count() // candidates_per_cell))
    down = max(1, -(-chosen.count() // queries_per_cell))
    place = F.xxhash64("row")
    left = chosen.select(F.pmod(place, F.lit(down)).cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("x"), F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    right = rows.select(F.pmod(place, F.lit(across)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("y"), F.col("vec_id").alias("candidate_id"), F.col("vector").alias("candidate"))

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        rows, query_ids, ids, scores = [], [], [], []
        if queries.num_rows and candidates.num_rows:
            own = queries["query_id"].to_numpy()
            numbers = queries["query_row"].to_numpy()
            for i, found, score in search_cell(_matrix(queries["query"]), own, _matrix(candidates["candidate"]), candidates["candidate_id"].to_numpy(), k, block):
                rows.append(np.full(len(found), numbers[i]))
                query_ids.append(np.full(len(found), own[i]))
                ids.append(found)
                scores.append(score)
        gather = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
        return pa.table({"row": gather(rows), "query_id": gather(query_ids), "vec_id": gather(ids), "score": gather(scores)})

    best = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(search, "row long, query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
