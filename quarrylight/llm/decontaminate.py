"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A spaced seed is a fixed mask over consecutive tokens: it hashes the tokens at its ones and
ignores those at its zeros, so that an overlap with substituted tokens still has a position
where some mask matches.  The hashes of all positions of all training texts are joined with
those of the benchmark.  Around each hit the two texts are laid on the hit's diagonal and
compared token by token; an overlap counts if some run of ``window`` aligned tokens that
covers the hit has at least ``window - substitutions`` equal tokens.

Tokens are the runs of letters and digits of the lower-cased text, so case, punctuation and
line breaks don't hide an overlap.  Benchmark texts shorter than ``window`` tokens are
compared in full, with substitutions in proportion: they are cut into one piece more than
substitutions are allowed, so that some piece is intact, and the pieces are their seeds.
Those shorter than every mask are compared as a whole through one hash of all their tokens
(no substitutions).  So no overlap is without a seed under the default masks; for another
``window`` or ``substitutions``, the masks have to be chosen to match.

Defined results: a text that is null, empty or without a token overlaps nothing; a null id
takes part like any other; repeated benchmark texts are searched once and reported under
each of their ids; repeated documents are each reported; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import own_columns

#: Ones are compared, zeros ignored.  With these, a run of 13 tokens keeps a matching position
#: under each of the 286 ways to place three substitutions.
MASKS = ("111111", "11011011", "1110000111", "101100111", "11001010011", "1110111", "11110011")
WINDOW = 13
SUBSTITUTIONS = 3
#: Up to so many seed rows (about 40 bytes each) the benchmark's hashes are broadcast.
BROADCAST_SEEDS = 500_000


def _tokens(frame: DataFrame, key: str) -> DataFrame:
    """(key, text) as (key, tokens): an array of a hash for each token."""
    hashed = F.transform(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda t: F.xxhash64(t))
    rows = frame.select(key, hashed.alias("hashed"))
    # Other characters at the ends leave an empty string there.
    none = F.xxhash64(F.lit(""))
    first = F.when(F.get("hashed", F.lit(0)) == none, 2).otherwise(1)
    last = F.size("hashed") - F.when(F.get("hashed", F.size("hashed") - 1) == none, 1).otherwise(0)
    return rows.select(key, F.when(F.col("hashed").isNotNull(), F.slice("hashed", first, F.greatest(F.lit(0), last - first + 1))).alias("tokens"))


def _seed(tokens: Column, position: Column, number: int, mask: str) -> Column:
    """Hash of the mask's ones at a position (from 0) of the tokens; null where it runs over the end."""
    ones = [i for i, bit in enumerate(mask) if bit == "1"]
    value = F.xxhash64(F.lit(number), *(F.get(tokens, position + i) for i in ones))
    return F.when(position + len(mask) <= F.size(tokens), value)


def _seeds(frame: DataFrame, masks: tuple[str, ...], keep: list[str], start: str) -> DataFrame:
    """A row for each position and mask: the kept columns, the position, and the seed's hash as key."""
    shortest = min(map(len, masks))
    # No filter on the size: it would be pushed below the projection and split the text twice.
    places = F.when(F.size("tokens") >= shortest, F.sequence(F.lit(0), F.size("tokens") - shortest))
    frame = frame.select(*dict.fromkeys([*keep, "tokens"]), F.explode(places).alias(start))
    keys = F.array(*(_seed(F.col("tokens"), F.col(start), i, mask) for i, mask in enumerate(masks)))
    return frame.select(*keep, start, F.explode(keys).alias("key")).where(F.col("key").isNotNull())


def _pieces(length: int, number: int) -> list[tuple[int, str]]:
    """So many pieces of a text of ``length`` tokens, as even as they come: start and mask."""
    edges = [length * p // number for p in range(number + 1)]
    return [(low, "1" * (high - low)) for low, high in zip(edges, edges[1:], strict=False)]


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    window: int = WINDOW,
    substitutions: int = SUBSTITUTIONS,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """Verified overlaps: doc_id, item_id, n_equal (equal tokens in the best run) and n_compared (its length).

    One row for each document and benchmark item that overlap.
    """
    items = own_columns(benchmark, item_id=item_id, text=item_text)
    items = _tokens(items.where(F.col("text").rlike(r"[\p{L}\p{N}]")), "item_id")
    items = items.where(F.size("tokens") > 0).withColumn("item_key", F.xxhash64("tokens"))
    named = items.select("item_key", "item_id")
    items = items.select("item_key", F.col("tokens").alias("item_tokens")).dropDuplicates(["item_key"])
    named_docs = own_columns(docs, doc_id=doc_id, text=text)
    documents = _tokens(named_docs, "doc_id")

    shortest = min(map(len, masks))
    size = F.size("item_tokens")
    lengths = sorted(r["length"] for r in items.where(size < max(window, shortest)).select(size.alias("length")).distinct().collect())  # fewer than the window's tokens
    pieces = {n: _pieces(n, n * substitutions // window + 1) for n in lengths if n >= shortest}
    every = masks + tuple(sorted({mask for found in pieces.values() for _, mask in found} - set(masks)))
    sought = _seeds(items.where(size >= max(window, shortest)).select("item_key", F.col("item_tokens").alias("tokens")), masks, ["item_key", "tokens"], "j").select("item_key", "j", "key")
    for n, found in pieces.items():
        seeds = F.array(*(F.struct(F.lit(j).alias("j"), _seed(F.col("item_tokens"), F.lit(j), every.index(mask), mask).alias("key")) for j, mask in found))
        sought = sought.unionByName(items.where(size == n).select("item_key", F.inline(seeds)))
    tiny = items.where(F.size("item_tokens") < shortest).select("item_key", F.size("item_tokens").alias("length"), F.xxhash64("item_tokens").alias("key"))
    n_seeds = sought.limit(broadcast_seeds + 1).count()
    small = n_seeds <= broadcast_seeds
    sought = F.broadcast(sought) if small else sought

    if small:
        hits = _seeds(documents, every, ["doc_id", "tokens"], "i").join(sought, "key").select("doc_id", "tokens", "i", "item_key", "j")
    else:  # the places are shuffled without the tokens, which join again where there is a hit
        versions = named_docs.select(F.struct("doc_id", F.xxhash64("text").alias("version")).alias("row"), "text")
        versions = _tokens(versions, "row").select(F.col("row.doc_id").alias("doc_id"), F.col("row.version").alias("version"), "tokens")
        hits = _seeds(versions, every, ["doc_id", "version"], "i").join(sought, "key").select("doc_id", "version", "i", "item_key", "j").distinct()
        whole = versions.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "tokens")
        hits = hits.join(whole, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))).select("doc_id", "tokens", "i", "item_key", "j")
    # The document's tokens on the hit's diagonal, at most `window` to either side of the hit's
    # start; nothing longer leaves the row.
    reach = window + max(map(len, masks))
    first = F.greatest(F.lit(0), F.col("j") - reach, F.col("j") - F.col("i"))
    hits = hits.select("doc_id", "item_key", "j", first.alias("from_j"), F.slice("tokens", F.col("i") - F.col("j") + first + 1, F.col("j") - first + reach).alias("part"))
    texts = items.where(size >= shortest).select("item_key", "item_tokens")  # each has at least a seed for every six tokens
    laid = hits.join(F.broadcast(texts) if small else texts, "item_key")
    equal = F.zip_with("part", F.slice("item_tokens", F.col("from_j") + 1, F.size("part")), lambda a, b: F.when(a == b, 1).otherwise(0))
    laid = laid.select("doc_id", "item_key", "j", "from_j", equal.alias("equal"), F.least(F.size("item_tokens"), F.lit(window)).alias("length"), F.size("item_tokens").alias("item_size"))
    # Runs of `length` aligned tokens that lie in both texts and cover the hit's first token.
    low = F.greatest(F.lit(0), F.col("j") - F.col("from_j") - F.col("length") + 1)
    usable = F.least(F.size("equal"), F.col("item_size") - F.col("from_j"))
    high = F.least(F.col("j") - F.col("from_j"), usable - F.col("length"))
    runs = F.when(high >= low, F.transform(F.sequence(low, high), lambda s: F.aggregate(F.slice("equal", s + 1, F.col("length")), F.lit(0), lambda a, b: a + b)))
    laid = laid.select("doc_id", "item_key", "length", F.array_max(runs).alias("n_equal"))
    allowed = F.floor(F.col("length") * substitutions / window)
    found = laid.where(F.col("n_equal") >= F.col("length") - allowed).groupBy("doc_id", "item_key").agg(F.max("n_equal").cast("long").alias("n_equal"), F.max("length").cast("long").alias("n_compared"))

    few = tiny.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    for length in (n for n in lengths if n < shortest):  # under the shortest mask's few tokens
        spans = F.when(F.size("tokens") >= length, F.sequence(F.lit(1), F.size("tokens") - length + 1))
        whole = documents.select("doc_id", "tokens", F.explode(spans).alias("i"))
        whole = whole.select("doc_id", F.xxhash64(F.slice("tokens", F.col("i"), length)).alias("key"))
        short = tiny.where(F.col("length") == length).select("item_key", "key")
        whole = whole.join(F.broadcast(short) if few else short, "key").select("doc_id", "item_key").distinct()
        found = found.unionByName(whole.withColumns({"n_equal": F.lit(length).cast("long"), "n_compared": F.lit(length).cast("long")}))
    return found.join(named, "item_key").select("doc_id", "item_id", "n_equal", "n_compared")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that overlap no benchmark item, with all their columns.

    Documents whose id is null stay only if no document with a null id overlaps.
    """
    found = overlaps(docs, benchmark, doc_id=doc_id, **options).select(F.col("doc_id").alias("__overlaps")).distinct()
    return docs.join(found, docs[f"`{doc_id}`"].eqNullSafe(found["__overlaps"]), "left_anti")
