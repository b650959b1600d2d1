"""Combining tables: nested relations, fan-out, ordered first-match rules, overrides, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expand(frame: DataFrame, name: str, related: DataFrame, foreign: str, key: str = "id", columns: Sequence[str] | None = None) -> DataFrame:
    """Adds the related row as a struct; null where there is none."""
    side = related.select(F.col(key).alias(f"__{name}"), F.struct(*(columns or related.columns)).alias(name))
    return frame.join(side, F.col(foreign) == F.col(f"__{name}"), "left").drop(f"__{name}")


def inherit(frame: DataFrame, related: DataFrame, foreign: str, key: str, columns: Sequence[str]) -> DataFrame:
    """Where a column is null it takes the related row's value."""
    side = related.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in columns))
    out = frame.join(side, F.col(foreign) == F.col("__key"), "left")
    out = out.withColumns({c: F.coalesce(c, f"__{c}") for c in columns})
    return out.drop("__key", *(f"__{c}" for c in columns))


#: Parts of the rows that each block of channels meets apart, where channels are too many to be sent to all executors.
STRIPS = 64


def fan_out(frame: DataFrame, channels: DataFrame, variants: Sequence[str], most_channels: int = 10_000) -> DataFrame:
    """Every row with every channel and variant.  Up to ``most_channels`` channels are sent to all executors.

    More are dealt into blocks of about that many, and rows into strips; a block meets a strip by an equal key, so each pair meets once, in
    one of many tasks.
    """
    variant = F.explode(F.array(*map(F.lit, variants)))
    if channels.limit(most_channels + 1).count() <= most_channels:
        return frame.crossJoin(F.broadcast(channels)).withColumn("variant", variant)
    blocks, strips = -(-channels.count() // most_channels), STRIPS
    dealt = lambda n: F.pmod(F.xxhash64(F.to_json(F.struct("*"))), F.lit(n)).cast("int")  # noqa: E731  # the same when a task runs again
    rows = frame.withColumn("__strip", dealt(strips)).withColumns({"__block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    sides = channels.withColumn("__block", dealt(blocks)).withColumns({"__strip": F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))})
    return rows.join(sides, ["__strip", "__block"]).drop("__strip", "__block").withColumn("variant", variant)


#: Prefixes of media types and their folders, in the order in which they are tried.
TYPE_FOLDERS = (
    ("image/", "Images"),
    ("video/", "Videos"),
    ("audio/", "Audio"),
    ("application/pdf", "Documents/PDF"),
    ("application/vnd.google-apps.spreadsheet", "Spreadsheets"),
    ("application/vnd.google-apps.document", "Documents"),
    ("application/vnd.google-apps.presentation", "Presentations"),
    ("application/zip", "Archives"),
    ("application/x-rar", "Archives"),
    ("text/", "TextFiles"),
)


def by_type(mime: Column) -> Column:
    """Folder of the first media type prefix that matches, or null."""
    out = F.when(mime.startswith(TYPE_FOLDERS[0][0]), TYPE_FOLDERS[0][1])
    for prefix, folder in TYPE_FOLDERS[1:]:
        out = out.when(mime.startswith(prefix), folder)
    return out


def classify(files: DataFrame, rules: DataFrame, *, key: str = "id", name: str = "name", mime: str = "mime_type", strategy: str = "by_type") -> DataFrame:
    """Adds ``destination`` by the first rule that matches, else by media type (for that strategy), else null.

    ``rules`` has id (their order), name, extension_patterns, mime_patterns and
    destination_folder_name.  Within a rule all extensions (any case) come before all media
    types (exact case).  Patterns end or begin a name, so files are joined with patterns on equal
    suffixes and prefixes of the lengths that patterns have, instead of trying each rule on each file.
    """
    to = F.coalesce(F.nullif("destination_folder_name", F.lit("")), F.col("name")).alias("to")
    one = lambda kind, column: rules.select("id", F.lit(kind).alias("kind"), F.posexplode(column).alias("pos", "pattern"), to)
    patterns = one(0, "extension_patterns").withColumn("pattern", F.lower("pattern")).unionByName(one(1, "mime_patterns"))
    order = F.struct(F.col("id").alias("rule"), "pos", "to")
    best = patterns.groupBy("kind", "pattern").agg(F.min(order).alias("best"), F.length("pattern").alias("length"))
    lengths = best.select("kind", "length").distinct().groupBy("kind").agg(F.collect_list("length").alias("lengths"))
    lengths = {r["kind"]: r["lengths"] for r in lengths.collect()}  # as many as there are pattern lengths
    low = F.lower(F.coalesce(F.col(name), F.lit("")))
    kind_of = F.coalesce(F.col(mime), F.lit(""))
    tests = [F.struct(F.lit(0).alias("kind"), F.when(F.length(low) >= n, F.right(low, F.lit(n))).alias("pattern")) for n in lengths.get(0, [])]
    tests += [F.struct(F.lit(1).alias("kind"), F.when(F.length(kind_of) >= n, F.left(kind_of, F.lit(n))).alias("pattern")) for n in lengths.get(1, [])]
    fallback = by_type(F.col(mime)) if strategy == "by_type" else F.lit(None).cast("string")
    if not tests:
        return files.withColumn("destination", fallback)
    tried = files.select(F.col(key).alias("__key"), F.explode(F.array(*tests)).alias("t")).select("__key", "t.kind", "t.pattern").where("pattern is not null")
    hits = tried.join(best, ["kind", "pattern"])
    first = hits.groupBy("__key").agg(F.min_by(F.col("best.to"), F.struct("best.rule", "kind", "best.pos")).alias("__to"))
    out = files.join(first, F.col(key) == F.col("__key"), "left")
    return out.withColumn("destination", F.coalesce("__to", fallback)).drop("__key", "__to")


def numbered(frame: DataFrame, group: str, order: Sequence[str | Column], line: Column, most: int, more: str = "...и ещё ") -> DataFrame:
    """One text per group: ``i. line`` of the first rows, and how many more there are."""
    ordered = Window.partitionBy(group).orderBy(*order)
    counts = frame.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n"))
    rows = frame.select(F.col(group), line.alias("__line"), F.row_number().over(ordered).alias("__i")).where(F.col("__i") <= most)  # a bounded number of rows per group leaves each task
    rows = rows.join(counts, F.col(group).eqNullSafe(F.col("__group")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__line"))), lambda s: F.concat(s["__i"].cast("string"), F.lit(". "), s["__line"])), "\n")
    rest = F.when(F.max("__n") > most, F.concat(F.lit("\n" + more), (F.max("__n") - most).cast("string"))).otherwise("")
    return rows.groupBy(group).agg(F.concat(text, rest).alias("text"), F.max("__n").alias("n"))


def counted(parents: DataFrame, key: str, children: DataFrame, foreign: str, name: str) -> DataFrame:
    """Parents with their number of children, 0 for none."""
    n = children.groupBy(F.col(foreign).alias("__key")).agg(F.count("*").alias(name))
    return parents.join(n, F.col(key) == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
