"""Mixing sources to target weights on a low-discrepancy schedule.

Each source gets a target number of words: its weight's share of the total, at most ``repeats``
times its own size, what is cut off going to the others by weight.  Its documents, shuffled by a
hash, form a stream that begins anew after its end, and what the target takes of the stream is cut
into blocks of equal numbers of words: of ``block`` words at most, and ``LEAST_BLOCKS`` of them at least.
Slot s of the schedule draws the point frac(s * golden ratio) and takes the source in whose stretch of
the cumulative numbers of blocks it falls, so every stretch of the schedule has all sources near
their weights.  The slots of a source are ranked, and the slot of rank r is joined with the
source's block r.  Slots are drawn until every source has reached its target; those that fall to a
source that is through stay empty.

Ranks of slots and places of documents come from sums over bounded buckets and sums of those,
never from one window over a source.  One window runs over the list of sources.

``mixture`` is the mixed set itself, in the order of the slots: the passages of documents that each slot
takes, with their texts.  ``mix`` has what it takes of each document.

Defined results: sources are ordered by code point, null last, and weigh 5, 2, 1, repeating;
a null text has size 0; rows of size 0, and whole sources of size 0, are taken 0 times and have
no slot; rows that repeat a document id are each in the stream with their own share; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, own_columns
from .tokens import chunks

GOLDEN = 0.6180339887498949
WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 1024
LEAST_BLOCKS = 16
#: Documents of a source and slots of the schedule are numbered within buckets of about so many rows.
BUCKET_ROWS = 4096


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text) as doc_id, source, size, content (a hash of the text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(chunk.words()[2]) for chunk in chunks(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), batch.column(3)], ["doc_id", "source", "size", "content"])

    doc_type, source_type = (docs.schema[c].dataType.simpleString() for c in ("doc_id", "source"))
    hashed = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("content"))
    return hashed.mapInArrow(count, f"doc_id {doc_type}, source {source_type}, size long, content long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size and target of each source of ``sizes`` (source, source_size).

    Sources are filled to a common level of words per weight.  In order of the level at which
    each is full, the first that isn't full at the level left by those before ends the search.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"total": F.sum("source_size").over(Window.partitionBy()).cast("double"), "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "open": F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    rows = rows.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    rows = rows.withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    level = F.first("level", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("level", level).select("source", "source_size", "weight", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def _running(frame: DataFrame, keys: list[str], bucket: str, order: list, amount: Column, name: str, scratch: Scratch) -> DataFrame:
    """Adds to each row the sum of ``amount`` over the rows before it in its keys, by bucket and then by order."""
    frame = scratch.keep(frame.withColumn("__amount", amount), f"{name}-rows")
    sums = frame.groupBy(*keys, bucket).agg(F.sum("__amount").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = scratch.keep(sums.select(*keys, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base")), f"{name}-sums")
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = frame.withColumn("__inner", F.coalesce(F.sum("__amount").over(inner), F.lit(0)))
    rows = rows.join(sums, [*keys, bucket])
    return rows.withColumn(name, F.col("__base") + F.col("__inner")).drop("__amount", "__base", "__inner")


def _points(slot: Column) -> Column:
    """frac(slot * GOLDEN), in two parts so that large numbers of slots keep their digits."""
    low, high = slot % (1 << 20), F.floor(slot / (1 << 20))
    return (low * F.lit(GOLDEN) % 1.0 + high * F.lit(GOLDEN * (1 << 20) % 1.0) % 1.0) % 1.0


def schedule(plan: DataFrame, scratch: Scratch) -> DataFrame:
    """slot, number (of the source that it takes) and rank of the slots that the sources of ``plan`` (number, slots) need.

    A first stretch is an eighth longer than all needs together; each further one, for sources that still lack slots, doubles the schedule.
    """
    spark = plan.sparkSession
    every = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    shares = plan.where("slots > 0").select("number", "slots", F.coalesce(F.sum("slots").over(every), F.lit(0)).alias("from"), F.sum("slots").over(Window.partitionBy()).alias("all"))
    shares = scratch.keep(shares.select("number", "slots", (F.col("from") / F.col("all")).alias("low"), ((F.col("from") + F.col("slots")) / F.col("all")).alias("high")), "shares")
    total, n_sources = shares.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    n_cells = max(4096, n_sources)
    cell = lambda c: F.least(F.lit(n_cells - 1), F.floor(F.col(c) * n_cells))
    open_, low, high, drawn = shares, 0, total + total // 8 + 64, []
    while open_.limit(1).count():
        if len(drawn) == 6:  # 36 times the slots that are needed; a sequence of low discrepancy is through long before
            raise ValueError("the schedule doesn't reach all sources")
        cells = open_.select("number", "low", "high", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
        slots = spark.range(low, high).select(F.col("id").alias("slot"), _points(F.col("id")).alias("point"))
        slots = slots.withColumn("cell", cell("point")).join(cells, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
        drawn.append(scratch.keep(slots.select("slot", "number"), f"drawn-{len(drawn)}"))
        so_far = drawn[0]
        for more in drawn[1:]:
            so_far = so_far.unionByName(more)
        made = so_far.groupBy("number").agg(F.count("*").alias("made"))
        open_ = scratch.keep(shares.join(made, "number", "left").where(F.coalesce("made", F.lit(0)) < F.col("slots")).select("number", "slots", "low", "high"), f"open-{len(drawn)}")
        low, high = high, 2 * high
    if not drawn:
        return spark.createDataFrame([], "slot long, number int, rank long")
    slots = so_far.withColumn("bucket", F.floor(F.col("slot") / BUCKET_ROWS))
    ranked = _running(slots, ["number"], "bucket", ["slot"], F.lit(1), "rank", scratch)
    return ranked.join(shares.select("number", "slots"), "number").where(F.col("rank") < F.col("slots")).select("slot", "number", "rank")


@dataclass
class _Mix:
    stream: DataFrame  # number, doc_id, content, size, start (place of its first word in the source's stream)
    plan: DataFrame  # number, source, source_size, target, words, slots
    empty: DataFrame  # number, doc_id, size of documents without words
    passages: DataFrame  # slot, place (of its first word in the endless stream), number, doc_id, content, start, size, low, high (words of the document)
    scratch: Scratch


def _mixed(docs: DataFrame, weights: tuple[int, ...], repeats: int, block: int) -> _Mix:
    """The mix of documents (doc_id, source, text)."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.keep(word_counts(docs), "sized")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    plan = targets(sums.select("source", "source_size"), weights, repeats).join(sums.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumn("number", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    plan = plan.withColumn("words", F.floor("target"))
    slots = F.least("words", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("words") / block)))
    plan = scratch.keep(plan.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(0)), "plan")
    slots = scratch.keep(schedule(plan.select("number", "slots"), scratch), "slots")
    scratch.keep_only("sized", "plan", "slots")

    # Documents in their source's stream.
    stream = sized.join(plan.select(F.col("source").alias("s"), "number", "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    empty = stream.where("size = 0").select("number", "doc_id", "size")
    shuffled = F.xxhash64(F.lit(17), "doc_id", "content")
    bucket = F.pmod(F.shiftrightunsigned(shuffled, 8), F.ceil(F.col("rows") / BUCKET_ROWS))
    stream = stream.where("size > 0").withColumns({"shuffled": shuffled, "bucket": bucket})
    stream = _running(stream, ["number"], "bucket", ["shuffled", "doc_id", "size"], F.col("size"), "start", scratch)
    stream = scratch.keep(stream.select("number", "doc_id", "content", "size", "start"), "stream")
    scratch.keep_only("sized", "plan", "slots", "stream")

    # Their parts in the blocks: for each round of the stream the words from `at` to before `to` of block `rank`.
    needs = plan.where("slots > 0").select("number", "source_size", "words", "slots")
    parts = stream.join(needs, "number").where(F.col("start") < F.col("words"))
    parts = parts.withColumn("round", F.explode(F.sequence(F.lit(0), F.floor((F.col("words") - 1 - F.col("start")) / F.col("source_size")))))
    parts = parts.withColumn("first", F.col("round") * F.col("source_size") + F.col("start"))
    parts = parts.withColumn("last", F.least(F.col("first") + F.col("size"), F.col("words")) - 1)
    blocks = F.col("slots") / F.col("words")
    # One block more to either side, against rounding; those without a word of the document go.
    near = F.sequence(F.greatest(F.lit(0), F.floor(F.col("first") * blocks) - 1), F.least(F.col("slots") - 1, F.floor(F.col("last") * blocks) + 1))
    parts = parts.withColumn("rank", F.explode(near))
    edge = lambda r: F.when(r < F.col("slots"), F.floor(r * (F.col("words") / F.col("slots")))).otherwise(F.col("words"))
    parts = parts.withColumns({"at": F.greatest("first", edge(F.col("rank"))), "to": F.least(F.col("last") + 1, edge(F.col("rank") + 1))}).where("at < to")
    parts = parts.select("number", "rank", "doc_id", "content", "start", "size", F.col("at").alias("place"), (F.col("at") - F.col("first")).alias("low"), (F.col("to") - F.col("first")).alias("high"))
    passages = parts.join(slots.hint("merge"), ["number", "rank"])  # never broadcast: sorted columns make its file small for its rows
    passages = scratch.keep(passages.select("slot", "place", "number", "doc_id", "content", "start", "size", "low", "high"), "passages")
    scratch.keep_only("passages", "plan", "stream", "sized")
    return _Mix(stream, plan, empty, passages, scratch)


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken (words of it in the mix, repeats counted), first_slot (where the mix first has it)."""
    found = _mixed(own_columns(docs, doc_id=doc_id, source=source, text=text), weights, repeats, block)
    none, nowhere = F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("slot")
    rows = found.passages.select("number", "doc_id", "start", "size", (F.col("high") - F.col("low")).alias("taken"), "slot")
    rows = rows.unionByName(found.stream.select("number", "doc_id", "start", "size", none, nowhere))
    rows = rows.groupBy("number", "doc_id", "start", "size").agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot")).drop("start")
    rows = rows.unionByName(found.empty.select("number", "doc_id", "size", none, nowhere.alias("first_slot")))
    return rows.join(found.plan.select("number", "source_size", "target"), "number").select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mixture(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK_WORDS) -> DataFrame:
    """The mixed set, in order: doc_id, size, source_size, target, taken (words of the passage), slot, place (order within
    the slot), text (of the passage).

    A document's passages that follow each other make up its text again, white space included.
    """
    named = own_columns(docs, doc_id=doc_id, source=source, text=text)
    found = _mixed(named, weights, repeats, block)
    texts = named.select("doc_id", F.xxhash64("text").alias("content"), "text").where(F.col("text").isNotNull()).dropDuplicates(["doc_id", "content"])
    texts = texts.select(F.col("doc_id").alias("d"), F.col("content").alias("c"), "text")
    spans = found.passages.groupBy("number", "doc_id", "content", "start", "size").agg(F.collect_list(F.struct("slot", "place", "low", "high")).alias("spans"))
    rows = spans.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c"))).select("number", "doc_id", "size", "spans", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(3).to_pylist()
            for chunk in chunks(batch.column(4)):
                starts, _, first = chunk.words()
                out, at = [], []
                for r in range(chunk.n_rows):
                    begins = starts[first[r] : first[r + 1]].copy()
                    begins[:1] = chunk.offsets[r]
                    begins = np.append(begins, chunk.offsets[r + 1])  # a word's white space goes with it
                    for s in spans[chunk.first_row + r]:
                        out.append((s["slot"], s["place"], s["high"] - s["low"], chunk.data[begins[s["low"]] : begins[s["high"]]].tobytes().decode()))
                        at.append(chunk.first_row + r)
                rows = pa.array(at, pa.int64())
                columns = [batch.column(c).take(rows) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)), pa.array([o[3] for o in out], pa.string())], ["number", "doc_id", "size", "slot", "place", "taken", "text"])

    rows = rows.mapInArrow(cut, f"number int, doc_id {kind}, size long, slot long, place long, taken long, text string")
    rows = rows.join(F.broadcast(found.plan.select("number", "source_size", "target")) if found.plan.limit(10_001).count() <= 10_000 else found.plan.select("number", "source_size", "target"), "number")
    return rows.select("doc_id", "size", "source_size", "target", "taken", "slot", "place", "text").repartitionByRange("slot").sortWithinPartitions("slot", "place")
