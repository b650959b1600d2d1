"""A metric index: balls around pivots, cut into rings, and the pairs of near vectors that it finds.

Each vector belongs to the ball of its nearest pivot and lies in a ring of it, between two distances from that
pivot.  The triangle inequality bounds how near two vectors of two rings can be, so whole pairs of rings are
left out; a ring is at most a cell of rows (rings that hold more, because of equal distances, are dealt into several), and cells meet as
blocks of numbers, never as pairs of rows.

Cells that follow each other form strips, and a task compares two strips.  There are as many strips as give each core a few pairs of
them, so a row is sent to a number of tasks that the table's size doesn't change; only where a strip would not fit a task's memory are there more.

How much the bounds leave out is a matter of the data: with vectors in clusters nearly everything, with vectors that point in all
directions evenly nothing once ``max_distance`` reaches the radius of the balls; then every cell meets every
other, still in bounded memory.  ``pairs_met`` tells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

ROWS_PER_CELL = 1024
#: Pivots are sent to all tasks, so their number is bounded; larger balls are cut into more rings.
MOST_PIVOTS = 2048
#: Pairs of strips for each core, and how many numbers the vectors of a strip may have: a task holds two strips.
PAIRS_PER_CORE = 4
NUMBERS_PER_STRIP = 2**22
#: Pairs of rows whose differences are held at once.
PAIRS_AT_ONCE = 2**16


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of both; rounding may move them by a little."""
    return np.maximum(0, (left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1)[None, :] - 2 * (left @ right.T))


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of points to one each or to a single one, from their differences."""
    return np.sqrt(((points - to) ** 2).sum(axis=1))


def _least(greatest, apart, low, high, lows, highs):
    """How near vectors of two rings can be whose pivots are that far apart."""
    return greatest(apart - high - highs, low - apart - highs, lows - apart - high)


def _blocks(rows: np.ndarray, ball: np.ndarray, away: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows in order of ball and distance, cut into blocks of at most that many of one ball."""
    rows = rows[np.lexsort((away[rows], ball[rows]))]
    each = np.split(rows, np.flatnonzero(np.diff(ball[rows])) + 1) if len(rows) else []
    return [r[i : i + most] for r in each for i in range(0, len(r), most)]


class BallIndex:
    """``rows`` (id, v, cell, strip, away) and ``cells`` (cell, low, high, n) of a table of vectors of one length, and ``apart``, the
    distances of the pivots."""

    def __init__(self, frame: DataFrame, *, key: str, vector: str, rows_per_cell: int = ROWS_PER_CELL, most_pivots: int = MOST_PIVOTS):
        """Null keys and vectors, vectors with null or non-finite components and those of another length than the first's take no part; a
        row that repeats a vector is known by the smallest key that has it."""
        given_type = frame.select(vector).schema[0].dataType.elementType.simpleString()
        number = "float" if given_type == "float" else "double"  # single numbers are sent as such and reckoned with as double ones
        v = F.transform(F.col(vector), lambda x: x.cast(number))
        whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        # -0.0 is the same number as 0.0
        given = frame.select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0).cast(number)).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(whole)
        first = given.orderBy("id", "v").select(F.size("v").alias("n")).first()
        self.width = first["n"] if first else 0
        distinct = written(given.where(F.size("v") == self.width).groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))
        n = distinct.count()
        wanted = max(1, min(most_pivots, -(-4 * n // rows_per_cell)))
        pivots = np.array([r["v"] for r in distinct.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()], dtype=np.float64).reshape(-1, max(1, self.width))
        width = self.width
        self.pivots, self.rows_per_cell = pivots, rows_per_cell
        self.apart = np.array([_distances(pivots, p) for p in pivots]).reshape(len(pivots), len(pivots))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                    points = _matrix(batch.column(1), width).astype(np.float64)
                    ball = _squares(points, pivots).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball, pa.int32()), pa.array(_distances(points, pivots[ball]))], ["id", "v", "ball", "away"])

        placed = written(distinct.mapInArrow(place, f"id long, v array<{number}>, ball int, away double"))
        balls = placed.groupBy("ball").agg(F.count("*").alias("n"), F.percentile_approx("away", [i / 64 for i in range(1, 64)], 1000).alias("ranks"))
        # Every so many of the 64 quantiles is the inner edge of a ring, so a ring holds about a cell's rows.
        step = F.greatest(F.lit(1), F.floor(F.lit(64 * rows_per_cell) / F.col("n"))).cast("int")
        balls = balls.select("ball", F.array_distinct(F.filter("ranks", lambda _, i: (i + 1) % step == 0)).alias("edges"))
        ringed = placed.join(F.broadcast(balls), "ball").withColumn("ring", F.size(F.filter("edges", lambda e: e < F.col("away")))).drop("edges")  # at most most_pivots rows
        sizes = ringed.groupBy("ball", "ring").agg(F.count("*").alias("n"))  # at most 64 rings a ball
        before = F.coalesce(F.sum("n").over(Window.orderBy("ball", "ring").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes = sizes.select("ball", "ring", F.ceil(F.col("n") / rows_per_cell).cast("int").alias("parts"), before.alias("before"))
        parted = ringed.join(F.broadcast(sizes), ["ball", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        strips = math.ceil((2 * PAIRS_PER_CORE * frame.sparkSession.sparkContext.defaultParallelism) ** 0.5)
        per_strip = max(1, min(-(-n // strips), max(rows_per_cell, NUMBERS_PER_STRIP // max(1, width))))
        strip = F.floor((F.col("before") + F.col("part") * rows_per_cell) / per_strip).cast("int")
        self.rows = written(parted.select("id", "v", F.struct("ball", "ring", "part").alias("cell"), strip.alias("strip"), "away"))
        self.cells = written(self.rows.groupBy("cell").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("n")))

    def _slack(self, radius: float) -> float:
        return 1e-9 * (1 + radius + self.apart.max(initial=0))

    def cell_pairs(self, most: float) -> DataFrame:
        """Pairs of cells (one, two) that can hold vectors at most that far apart, each once, and the pairs of rows in them."""
        radius = np.zeros(len(self.apart))
        for r in self.cells.groupBy("cell.ball").agg(F.max("high").alias("high")).collect():  # one row for each pivot
            radius[r["ball"]] = r["high"]
        slack = self._slack(radius.max(initial=0))
        near = [np.flatnonzero(self.apart[b] - radius[b] - radius <= most + slack) for b in range(len(radius))]
        pairs = [(b, int(o), float(self.apart[b, o])) for b, others in enumerate(near) for o in others if o >= b]
        balls = self.cells.sparkSession.createDataFrame(pairs, "ball int, other int, apart double")
        one = self.cells.select(F.col("cell").alias("one"), F.col("cell.ball").alias("ball"), F.col("low").alias("low_1"), F.col("high").alias("high_1"), F.col("n").alias("n_1"))
        two = self.cells.select(F.col("cell").alias("two"), F.col("cell.ball").alias("other"), F.col("low").alias("low_2"), F.col("high").alias("high_2"), F.col("n").alias("n_2"))
        met = one.join(balls, "ball").join(two, "other").where((F.col("ball") < F.col("other")) | (F.col("one") <= F.col("two")))
        least = _least(F.greatest, *map(F.col, ("apart", "low_1", "high_1", "low_2", "high_2")))
        n = F.when(F.col("one") == F.col("two"), F.col("n_1") * (F.col("n_1") - 1) / 2).otherwise(F.col("n_1") * F.col("n_2")).cast("long")
        return met.where(least <= most + slack).select("one", "two", n.alias("pairs"))

    def pairs_met(self, max_distance: float) -> int:
        """How many pairs of vectors are compared for a squared distance."""
        return self.cell_pairs(max_distance**0.5).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]

    def _sent(self, most: float) -> tuple[DataFrame, float]:
        """For each ball's part of a strip the pairs of strips (one <= two) in which it can meet something, and the bounds' slack."""
        parts = self.rows.groupBy("cell.ball", "strip").agg(F.min("away"), F.max("away")).collect()  # fewer than pivots and strips together
        ball, strip, low, high = (np.array([r[i] for r in parts]) for i in range(4))
        slack, out = self._slack(max((r[3] for r in parts), default=0)), []
        for b, s, lo, hi in parts:
            met = np.unique(strip[_least(lambda *x: np.maximum.reduce(x), self.apart[b][ball], lo, hi, low, high) <= most + slack])
            out.append((b, s, [(min(s, int(t)), max(s, int(t))) for t in met]))
        return self.rows.sparkSession.createDataFrame(out, "ball int, strip int, pairs array<struct<one: int, two: int>>"), slack

    def pairs(self, max_distance: float) -> DataFrame:
        """a < b and their squared distance, if at most ``max_distance``."""
        width, pivots, rows_per_cell, most = self.width, self.pivots, self.rows_per_cell, max_distance**0.5
        sent, slack = self._sent(most)
        rows = self.rows.select("id", "v", F.col("cell.ball").alias("ball"), "strip", "away").join(F.broadcast(sent), ["ball", "strip"])

        def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, two = (k.as_py() for k in key)
            table = pa.Table.from_batches(batches)
            ids, ball, strip, away = (table[c].to_numpy() for c in ("id", "ball", "strip", "away"))
            v = _matrix(table["v"], width)
            left, right = (_blocks(np.flatnonzero(strip == s), ball, away, rows_per_cell) for s in (one, two))
            place = np.zeros(len(ids), dtype=np.int64)
            if one == two and left:
                place[np.concatenate(left)] = np.arange(len(ids))
            balls, lows, highs = (np.array([c[r[at]] for r in right]) for c, at in ((ball, 0), (away, 0), (away, -1)))
            for n, x in enumerate(left):
                apart = _distances(pivots[balls], pivots[ball[x[0]]]) if right else np.zeros(0)
                met = np.flatnonzero(_least(lambda *b: np.maximum.reduce(b), apart, away[x[0]], away[x[-1]], lows, highs) <= most + slack)
                met = met[met >= n] if one == two else met
                others = np.concatenate([right[m] for m in met]) if len(met) else x[:0]
                a = v[x].astype(np.float64)
                bound = max_distance + 1e-9 * (1 + max_distance + (a * a).sum(axis=1).max())
                for y in (others[k : k + rows_per_cell] for k in range(0, len(others), rows_per_cell)):
                    i, j = np.nonzero(_squares(a, v[y].astype(np.float64)) <= bound)
                    i, j = x[i], y[j]
                    good = ids[i] != ids[j]
                    if one == two:  # a block meets itself
                        good &= place[i] < place[j]
                    i, j = i[good], j[good]
                    for k in range(0, len(i), PAIRS_AT_ONCE):
                        p, q = i[k : k + PAIRS_AT_ONCE], j[k : k + PAIRS_AT_ONCE]
                        difference = v[p].astype(np.float64) - v[q]
                        exact = np.zeros(len(p))
                        for d in range(width):  # added up one by one, as built-in functions do
                            exact += difference[:, d] * difference[:, d]
                        p, q, exact = p[exact <= max_distance], q[exact <= max_distance], exact[exact <= max_distance]
                        if len(p):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[p], ids[q])), pa.array(np.maximum(ids[p], ids[q])), pa.array(exact)], ["a", "b", "distance"])

        return rows.select("id", "v", "ball", "strip", "away", F.inline("pairs")).groupBy("one", "two").applyInArrow(compare, "a long, b long, distance double")


def near_pairs(frame: DataFrame, *, key: str = "id", vector: str = "embedding", max_distance: float = 0.5, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Pairs (a, b, squared distance) of different vectors at most ``max_distance`` apart, found by a ball index."""
    return BallIndex(frame, key=key, vector=vector, rows_per_cell=rows_per_cell).pairs(max_distance)
