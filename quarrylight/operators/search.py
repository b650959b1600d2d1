"""Filtered listings: dynamic conjunctive search, top-N, lookups after top-N, local and remote union."""

from __future__ import annotations

import re

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_folded


def newest(frame: DataFrame, by: str, key: str, limit: int) -> DataFrame:
    """The latest rows; missing times last, ties by key."""
    return frame.orderBy(F.desc_nulls_last(by), F.asc_nulls_last(key)).limit(limit)


def search(
    frame: DataFrame,
    *,
    owner: Column | None = None,
    text: str | None = None,
    text_columns: Iterable[str] = ("title", "snippet"),
    tags: Iterable[str] = (),
    tag_column: str = "tags",
    since: object = None,
    until: object = None,
    time_column: str = "updated_at",
    key: str = "id",
    limit: int = 20,
) -> DataFrame:
    """Rows that meet all given conditions, the newest first.

    ``text`` may be in any of the text columns, every tag must be there, both bounds are inclusive.
    """
    conditions = [] if owner is None else [owner]
    if text is not None:
        conditions.append(reduce(lambda a, b: a | b, (like_folded(F.col(c), text) for c in text_columns)))
    conditions += [F.array_contains(tag_column, tag) for tag in tags]
    if since is not None:
        conditions.append(F.col(time_column) >= F.lit(since))
    if until is not None:
        conditions.append(F.col(time_column) <= F.lit(until))
    return newest(reduce(DataFrame.where, conditions, frame), time_column, key, limit)


def by_state(frame: DataFrame, state: str | None, *, state_column: str = "lifecycle", time_column: str = "created_at", key: str = "id", limit: int = 10) -> DataFrame:
    """The newest rows of a state, or of all."""
    return newest(frame if state is None else frame.where(F.col(state_column) == state), time_column, key, limit)


def prefix_after_top(frame: DataFrame, prefix: str, *, key: str = "id", time_column: str = "created_at", newest_rows: int = 100, full_length: int = 36, unique: bool = False) -> DataFrame:
    """Rows of a full key; else, of the newest rows only, those whose key begins so (none, if unique is asked and several do)."""
    if len(prefix) == full_length and not unique:
        return frame.where(F.col(key) == prefix)
    found = newest(frame, time_column, key, newest_rows).where(F.col(key).startswith(prefix))
    if unique:
        only = found.agg(F.count("*").alias("__n"))
        found = found.join(F.broadcast(only), F.col("__n") == 1).drop("__n")  # one row of counts
    return found


def local_then_remote(local: DataFrame, remote: DataFrame, *, key: str, most: int, relimit: bool = False) -> DataFrame:
    """Local rows, and if they are fewer than ``most`` the remote rows whose key isn't local.

    Rows carry ``source_rank`` (0 local, 1 remote).  As each side was limited before, there can be
    up to twice the limit; ``relimit`` cuts the union again.
    """
    full = local.agg((F.count("*") >= most).alias("__full"))
    others = remote.join(local.select(key), key, "left_anti").join(F.broadcast(full), ~F.col("__full")).drop("__full")
    both = local.withColumn("source_rank", F.lit(0)).unionByName(others.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("source_rank", key).limit(most) if relimit else both


def by_shared_words(frame: DataFrame, phrase: str, *, key: str = "id", text: str = "text", most: int = 50) -> DataFrame:
    """Rows that have words of the phrase, in any case, by how many different ones (``score``), then by key; the first ``most``."""
    words = list(dict.fromkeys(re.findall(r"[^\W_]+", phrase.lower())))
    found = F.array_intersect(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, words)))
    rows = frame.withColumn("score", F.size(found)).where(F.col("score") > 0)
    return rows.orderBy(F.desc("score"), key).limit(most)
