"""Temporal triples, tag overlap and recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .logstore import DELETE, PUT, LogStore

TRIPLES = "subject string, predicate string, object string, valid_from timestamp_ntz, source string"


def facts(triples: DataFrame, entity: str, *, as_of: object = None, direction: str = "both") -> DataFrame:
    """Triples (subject, predicate, object, valid_from) of an entity that hold at a time; undated ones always hold."""
    out, in_ = F.col("subject") == entity, F.col("object") == entity
    found = triples.where({"out": out, "in": in_, "both": out | in_}[direction])
    return found if as_of is None else found.where(F.col("valid_from").isNull() | (F.col("valid_from") <= F.lit(as_of)))


def triple_id(subject: str = "subject", predicate: str = "predicate", object_: str = "object", valid_from: str = "valid_from") -> Column:
    """A triple's id, the same whenever the same triple is added: a hash of its parts and the second from which it holds."""
    return F.sha2(F.concat_ws("\x1f", subject, predicate, object_, F.coalesce(F.date_format(valid_from, "yyyy-MM-dd HH:mm:ss"), F.lit(""))), 256)


def add_triples(store: LogStore, triples: DataFrame, batch: int) -> bool:
    """Appends triples (subject, predicate, object, valid_from, source, seq) to a store keyed by id; one that is there already only gets the later source.

    The id is kept as text or, in a store with a binary key, as its bytes, which take half the room.
    """
    return store.append(triples.withColumns({"id": _kept_id(store), "op": F.lit(PUT)}), batch)


def delete_triples(store: LogStore, triples: DataFrame, batch: int) -> bool:
    """Appends deletes of triples (subject, predicate, object, valid_from, seq)."""
    return store.append(triples.withColumns({"id": _kept_id(store), "op": F.lit(DELETE)}), batch)


def stored_triples(store: LogStore) -> DataFrame:
    """The triples of a store as of its last batch, with their ids as text."""
    return store.read().withColumn("id", F.lower(F.hex("id")) if store.key_type == "binary" else F.col("id"))


def _kept_id(store: LogStore) -> Column:
    return F.unhex(triple_id()) if store.key_type == "binary" else triple_id()


def graph_stats(triples: DataFrame) -> DataFrame:
    """Triples, entities and predicates, and triples per predicate: metric, name, n."""
    total = triples.agg(F.count("*").alias("n")).select(F.lit("triples").alias("metric"), F.lit("").alias("name"), "n")
    nodes = triples.select(F.explode(F.array("subject", "object")).alias("e")).distinct().agg(F.count("*").alias("n")).select(F.lit("entities").alias("metric"), F.lit("").alias("name"), "n")
    each = triples.groupBy("predicate").agg(F.count("*").alias("n")).select(F.lit("predicate").alias("metric"), F.col("predicate").alias("name"), "n")
    return total.unionByName(nodes).unionByName(each)


def tag_pairs(tagged: DataFrame, *, key: str = "id", tag: str = "tag") -> DataFrame:
    """How many objects have both tags of a pair: a, b, n.  Made within each object's own tag set."""
    tags = tagged.where(F.col(tag).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(tag)).alias("tags"))
    first = tags.select("tags", F.posexplode("tags").alias("i", "a"))
    return first.select("a", F.explode(F.slice("tags", F.col("i") + 2, F.size("tags"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


#: Tags of an object up to which its subsets are listed (2**n - 1 of them).
SUBSET_TAGS = 6


#: Weighed tags that are sent to all executors; more are joined by shuffle.
MOST_WEIGHTS = 10_000


def _shuffled(frame: DataFrame) -> DataFrame:
    """A side of a join that is shuffled: an estimate from a file's size knows nothing of the rows that exploding makes."""
    return frame.hint("merge")


def _weighed(frame: DataFrame, key: str, tags: str, weights: DataFrame | None, keep: list[str]) -> DataFrame:
    """Objects with their weighed tags, sorted: key, kept columns, tags, weights."""
    each = frame.select(F.col(key).alias("key"), *keep, F.explode(F.array_distinct(tags)).alias("tag")).where(F.col("tag").isNotNull())
    if weights is None:
        each = each.withColumn("weight", F.lit(1.0))
    else:
        few = weights.limit(MOST_WEIGHTS + 1).count() <= MOST_WEIGHTS
        each = each.join((F.broadcast if few else _shuffled)(weights.where("weight > 0")), "tag")
    found = each.groupBy("key", *keep).agg(F.array_sort(F.collect_list(F.struct("tag", "weight"))).alias("t"))
    return found.select("key", *keep, F.col("t.tag").alias("tags"), F.col("t.weight").alias("weights"))


def related(items: DataFrame, candidates: DataFrame, *, key: str = "id", tags: str = "tags", weights: DataFrame | None = None, penalty: Column | None = None, most: int = 6) -> DataFrame:
    """For each item the candidates that share most tags: key, other, score, rank.

    score = sum of the shared tags' weights (positive; 1 if none are given) less the candidate's penalty.
    Keys are unique.  For each set of tags only the ``most + 1`` candidates with the smallest penalty that have all of it can
    be among an item's best by sharing just that set.  So each item looks up the subsets of its tags, and no tag is
    expanded into all its pairs; objects with more than ``SUBSET_TAGS`` tags are joined tag by tag.
    """
    left = _weighed(items, key, tags, weights, [])
    right = _weighed(candidates.withColumn("__penalty", penalty if penalty is not None else F.lit(0.0)), key, tags, weights, ["__penalty"]).withColumnRenamed("__penalty", "penalty")
    few, many = F.size("tags") <= SUBSET_TAGS, F.size("tags") > SUBSET_TAGS
    numbers = F.sequence(F.lit(1), F.expr("shiftleft(1, size(tags)) - 1"))
    subsets = F.explode(F.transform(numbers, lambda m: F.filter("tags", lambda t, i: F.getbit(m, i) == 1)))
    value = F.aggregate(F.filter(F.arrays_zip("tags", "weights"), lambda x: F.array_contains("subset", x["tags"])), F.lit(0.0).cast("double"), lambda a, x: a + x["weights"])
    place = Window.partitionBy("subset").orderBy("penalty", "other")
    best = right.where(few).select(F.col("key").alias("other"), "penalty", subsets.alias("subset")).withColumn("place", F.row_number().over(place)).where(F.col("place") <= most + 1)
    asked = left.where(few).select(F.col("key").alias("id"), "tags", "weights", subsets.alias("subset")).select("id", "subset", value.alias("value"))
    scored = asked.join(_shuffled(best), "subset").where(F.col("id") != F.col("other")).groupBy("id", "other", "penalty").agg(F.max("value").alias("value"))

    def by_tag(left: DataFrame, right: DataFrame) -> DataFrame:
        one = left.select(F.col("key").alias("id"), F.inline(F.arrays_zip(F.col("tags").alias("tag"), F.col("weights").alias("weight"))))
        two = right.select(F.col("key").alias("other"), "penalty", F.explode("tags").alias("tag"))
        return one.join(_shuffled(two), "tag").where(F.col("id") != F.col("other")).groupBy("id", "other", "penalty").agg(F.sum("weight").alias("value"))

    scored = scored.unionByName(by_tag(left.where(few), right.where(many))).unionByName(by_tag(left.where(many), right))
    scored = scored.select("id", "other", (F.col("value") - F.col("penalty")).alias("score"))
    rank = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)
