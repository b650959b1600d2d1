"""Filtered vector retrieval and context assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Queries whose distances to a cell are held at once.
_ASKED = 256


def _numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have so many components, all finite, and those as a matrix."""
    place = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == width)
    matrix = column.take(pa.array(place)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(place), width)
    whole = np.isfinite(matrix).all(axis=1)
    return place[whole], matrix[whole]


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up one by one as built-in functions do."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _nearest_of(keys: pa.Array, vectors: pa.Array, asked: pa.Array, k: int, max_distance: float, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, queries and distances of the k nearest rows of each query, equal ones by key, but for those too far.

    A matrix product tells which rows can be among them, and their distances are added up as built-in functions do.
    """
    order = np.empty(len(keys), dtype=np.int64)
    order[pc.array_sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for width in {w for w in pc.list_value_length(asked).to_pylist() if w}:
        (rows, a), (queries, q) = _numbers(vectors, width), _numbers(asked, width)
        aa, qq = _inner(a, a), _inner(q, q)
        if metric == "cosine":  # no distance to or from nothing
            rows, a, aa, queries, q, qq = rows[aa > 0], a[aa > 0], aa[aa > 0], queries[qq > 0], q[qq > 0], qq[qq > 0]
        if not len(rows) or not len(queries):
            continue
        norm_a, norm_q = np.sqrt(aa), np.sqrt(qq)
        for at in range(0, len(queries), _ASKED):
            part = slice(at, at + _ASKED)
            about = q[part] @ a.T
            if metric == "cosine":
                about = 1 - about / (norm_q[part, None] * norm_a[None, :])
                slack = np.full((len(about), 1), 1e-9)
            else:
                about = qq[part, None] + aa[None, :] - 2 * about
                slack = 1e-9 * (1 + qq[part, None] + aa.max())
            least = np.partition(about, k - 1, axis=1)[:, k - 1 : k] if k < len(rows) else np.full((len(about), 1), np.inf)
            i, j = np.nonzero(about <= np.minimum(least, max_distance) + slack)
            if metric == "cosine":
                exact = 1 - _inner(q[at + i], a[j]) / (norm_a[j] * norm_q[at + i])
            else:
                exact = np.zeros(len(i))
                for d in range(width):
                    away = a[j, d] - q[at + i, d]
                    exact += away * away
            best = np.lexsort((order[rows[j]], exact, i))
            i, j, exact = i[best], j[best], exact[best]
            first = np.searchsorted(i, i)
            keep = (np.arange(len(i)) - first < k) & (exact <= max_distance)
            found.append((rows[j[keep]], queries[at + i[keep]], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(
    frame: DataFrame,
    queries: DataFrame,
    *,
    k: int = 5,
    max_distance: float = 1.5,
    before: Column | None = None,
    after: Column | None = None,
    metric: str = "l2sq",
    key: str = "id",
    vector: str = "embedding",
    most_queries: int = 1000,
    rows_per_cell: int = 16384,
) -> DataFrame:
    """For each query (query_id, query_vector) its k nearest rows, then without those too far or that ``after`` rejects.

    ``before`` restricts what is searched.  Filters behind the top k don't make it look further, so
    fewer than k rows are normal.  Vectors that are null, hold nulls or non-finite numbers or have another length than the
    query's are not near it, and take no place.  Up to ``most_queries`` queries are sent to all executors, and
    each batch of rows keeps only its k best per query before the shuffle; more are dealt into blocks of about
    so many, and the blocks meet the rows, ``rows_per_cell`` at a time, in a grid.  Pairs are never laid out as rows.
    """
    rows = frame if before is None else frame.where(before)
    asked = queries.select("query_id", "query_vector")
    out = StructType([*rows.schema, asked.schema["query_id"], StructField("distance", DoubleType())])
    few = asked.limit(most_queries + 1).toArrow()
    if few.num_rows <= most_queries:
        given = few.combine_chunks()
        ids, wanted = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (given["query_id"], given["query_vector"]))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                i, q, distance = _nearest_of(batch.column(key), batch.column(vector), wanted, k, max_distance, metric)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in batch.columns), ids.take(pa.array(q)), pa.array(distance)], out.names)

        pairs = rows.mapInArrow(search, out)
    else:
        across, blocks = max(1, -(-rows.count() // rows_per_cell)), -(-asked.count() // most_queries)
        names = {c: f"c{i}" for i, c in enumerate(rows.columns)}
        deal = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        cells = rows.select(deal(across).alias("x"), *(F.col(f"`{c}`").alias(n) for c, n in names.items())).select("*", every(blocks).alias("y"))
        sides = asked.select("query_id", "query_vector", deal(blocks).alias("y")).select("*", every(across).alias("x"))

        def meet(cell: pa.Table, block: pa.Table) -> pa.Table:
            cell, block = cell.combine_chunks(), block.combine_chunks()
            whole = lambda t, c: t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0)
            i, q, distance = _nearest_of(whole(cell, names[key]), whole(cell, names[vector]), whole(block, "query_vector"), k, max_distance, metric)
            return pa.table([*(whole(cell, n).take(pa.array(i)) for n in names.values()), whole(block, "query_id").take(pa.array(q)), pa.array(distance)], out.names)

        pairs = cells.groupBy("x", "y").cogroup(sides.groupBy("x", "y")).applyInArrow(meet, out)
    place = Window.partitionBy("query_id").orderBy("distance", key)
    top = pairs.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
    return top if after is None else top.where(after)


def context(hits: DataFrame, *, title: str = "title", scope: str = "wing", content: str = "content", cut: int = 1500, header: str = "Источник") -> DataFrame:
    """One text per query: for each hit, in order, a header and the content's beginning."""
    place = Window.partitionBy("query_id").orderBy("place")
    rows = hits.withColumn("i", F.row_number().over(place))
    block = F.concat(F.lit(f"\n### {header} "), F.col("i").cast("string"), F.lit(": "), F.coalesce(title, F.lit("(фрагмент)")), F.lit(" ["), F.coalesce(scope, F.lit("?")), F.lit("]\n"), F.left(F.coalesce(content, F.lit("")), F.lit(cut)))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", block.alias("block")))), lambda s: s["block"]), "\n").alias("context"))
