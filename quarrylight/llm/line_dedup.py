"""Removal of lines that spread over many sites.

For each line (stripped, by a 64-bit hash and its length) a HyperLogLog sketch of its sites is
built and merged by aggregation, together with its first place in the corpus.  Lines whose
estimate is clearly below the threshold stay and those clearly above it are boilerplate; lines
near the threshold, within the sketch's error, get an exact count of distinct sites.  A
boilerplate line is removed from every document but at its first place (smallest document id,
then smallest position), so that the corpus keeps one copy of what it says.

Defined results: a null text has no lines and stays null; blank lines are never boilerplate; a
null site counts as one site of its own; a null document id comes last in the order of
places; rows that repeat an id are documents of their own, in the order of a hash of their texts,
and rows that repeat id and text are treated alike; other columns are carried along by ``cleaned``
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, own_columns

MIN_SITES = 10
#: 2**12 registers: a relative standard error of 1.6 %; the exact counts cover six of them.
LOG_REGISTERS = 12
NEAR = 0.1


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\v\f\r"))


def spread(lines: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines on at least ``min_sites`` sites: hash, size, first (doc_id, version, position).

    ``lines`` has hash, size, site (not null), doc_id, version, position.
    """
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version", "position")
    merged = lines.groupBy("hash", "size").agg(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sites"), F.min(place).alias("first"), F.count("*").alias("copies"))
    merged = merged.where(F.col("copies") >= min_sites).select("hash", "size", "first", F.hll_sketch_estimate("sites").alias("estimate"))
    likely = scratch.keep(merged.where(F.col("estimate") >= min_sites * (1 - NEAR)), "likely")
    near = likely.where(F.col("estimate") <= min_sites * (1 + NEAR))
    exact = lines.join(near.select("hash", "size"), ["hash", "size"]).select("hash", "size", "site").distinct().groupBy("hash", "size").agg(F.count("*").alias("sites"))
    sure = likely.where(F.col("estimate") > min_sites * (1 + NEAR)).select("hash", "size", "first")
    counted = near.join(exact.where(F.col("sites") >= min_sites), ["hash", "size"], "left_semi").select("hash", "size", "first")
    return scratch.keep(sure.unionByName(counted), "spread")


def boilerplate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, scratch: Scratch | None = None) -> DataFrame:
    """The lines to remove of each document that has some: doc_id, version (hash of its text), positions (from 0)."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    named = own_columns(docs, doc_id=doc_id, text=text, site=site)
    site_name = F.when(F.col("site").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("site").cast("string")))
    # Hashed before the explode, else each line would have its whole text hashed.
    named = named.select("doc_id", F.xxhash64("text").alias("version"), site_name.alias("site"), F.split("text", "\n").alias("lines"))
    lines = named.select("doc_id", "version", "site", F.posexplode("lines").alias("position", "line"))
    lines = lines.select("doc_id", "version", "site", "position", _stripped(F.col("line")).alias("line"))
    lines = lines.where(F.col("line") != "").select("doc_id", "version", "site", "position", F.xxhash64("line").alias("hash"), F.length("line").alias("size"))
    found = spread(lines, scratch, min_sites)
    hits = lines.select("doc_id", "version", "position", "hash", "size").join(found, ["hash", "size"])
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version")) & (F.col("position") == F.col("first.position"))
    return hits.where(~here).groupBy("doc_id", "version").agg(F.collect_set("position").alias("positions"))


def cleaned(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", removed: str | None = None, **options) -> DataFrame:
    """The documents with their columns, boilerplate lines taken out of ``text``.

    ``removed`` names a column for the number of lines taken out, if it is wanted.
    """
    gone = boilerplate(docs, doc_id=doc_id, text=text, **options)
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("positions").alias("__positions"))
    same = docs[f"`{doc_id}`"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs[f"`{text}`"]) == gone["__version"])
    name = "_" * (1 + max((len(c) for c in docs.columns), default=0))  # that no column has
    joined = docs.join(gone, same, "left").withColumn(name, F.when(gone["__positions"].isNotNull(), F.split(docs[f"`{text}`"], "\n")))
    # Places that stay are what the removed ones leave of all, by a set; each is then looked up: linear in the text's lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size(name) - 1), gone["__positions"])
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col(name), i)), "\n")
    rest = F.when(gone["__positions"].isNull(), docs[f"`{text}`"]).otherwise(kept)
    columns = [rest.alias(c) if c == text else docs[f"`{c}`"] for c in docs.columns]
    return joined.select(*columns, *([F.coalesce(F.size(gone["__positions"]), F.lit(0)).cast("long").alias(removed)] if removed else []))
