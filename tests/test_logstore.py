"""The log-structured table against a plain replay."""

import random

import pytest

from pyspark.sql import functions as F

from quarrylight.operators import graph, logstore
from quarrylight.operators.logstore import DELETE, PATCH, PUT, LogStore
from shuffles import shuffled

SCHEMA = "k long, a string, b long, op string, given array<string>, seq long"


def store_of(spark, folder, buckets=4):
    return LogStore(spark, str(folder), "k", "long", "a string, b long", buckets=buckets)


def replayed(batches):
    table = {}
    for _, rows in sorted(batches.items()):
        for k, a, b, op, given, _ in sorted(rows, key=lambda r: r[5]):
            if op == PUT:
                table[k] = {"a": a, "b": b}
            elif op == DELETE:
                table.pop(k, None)
            elif op == PATCH and k in table:
                values = {"a": a, "b": b}
                table[k] |= {c: values[c] for c in (given if given is not None else [c for c in values if values[c] is not None])}
    return sorted((repr(k), v["a"], v["b"]) for k, v in table.items())


def content(store):
    return sorted((repr(r["k"]), r["a"], r["b"]) for r in store.read().collect())


def a_batch(rng, n):
    rows = []
    for seq in range(n):
        op = rng.choice([PUT, PUT, PATCH, PATCH, DELETE, "other"])
        given = rng.choice([None, ["a"], ["b"], ["a", "b"], []]) if op == PATCH else None
        rows.append((rng.choice([None, *range(12)]), rng.choice(["x", "y", "z", "", None]), rng.choice([1, 2, None]), op, given, seq))
    return rows


def comparable(rows):
    return [(k, "" if a is None else a, -1 if b is None else b) for k, a, b in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_compacted_and_not_are_as_replayed(spark, tmp_path, seed):
    rng, batches = random.Random(seed), {}
    plain, compacted = store_of(spark, tmp_path / "plain"), store_of(spark, tmp_path / "compacted")
    assert content(plain) == [] and plain.compact() == 0
    for n in range(4):
        batches[n] = a_batch(rng, 25)
        frame = spark.createDataFrame(batches[n], SCHEMA)
        for store in (plain, compacted):
            assert store.append(frame, n)
        if n in (1, 2):
            assert compacted.compact() > 0
    want = replayed(batches)
    for store in (plain, compacted):
        assert sorted(comparable(content(store))) == sorted(comparable(want))
    compacted.vacuum()
    assert sorted(comparable(content(compacted))) == sorted(comparable(want))
    assert not compacted.append(spark.createDataFrame(batches[0], SCHEMA), 0)


def test_a_batch_counts_once_and_only_when_it_is_whole(spark, tmp_path, monkeypatch):
    store = store_of(spark, tmp_path)
    rows = lambda a: spark.createDataFrame([(1, a, 1, PUT, None, 0)], SCHEMA)
    assert store.append(rows("first"), 5)
    assert not store.append(rows("second"), 5)
    assert content(store) == [("1", "first", 1)]
    write = LogStore._write

    def breaks(self, frame, path):
        write(self, frame, path)
        raise RuntimeError("lost")

    monkeypatch.setattr(LogStore, "_write", breaks)
    for broken in (lambda: store.append(rows("third"), 6), store.compact):
        with pytest.raises(RuntimeError):
            broken()
    monkeypatch.setattr(LogStore, "_write", write)
    assert content(store) == [("1", "first", 1)]
    assert store.append(rows("fourth"), 6) and store.compact() == 1
    assert content(store) == [("1", "fourth", 1)]
    with pytest.raises(ValueError):
        store.append(rows("late"), 4)


def test_compaction_leaves_other_buckets_and_empties_deleted_ones(spark, tmp_path):
    store = store_of(spark, tmp_path, buckets=8)
    store.append(spark.createDataFrame([(k, "x", k, PUT, None, 0) for k in range(40)], SCHEMA), 0)
    assert store.compact() == 8
    store.append(spark.createDataFrame([(3, None, None, DELETE, None, 0)], SCHEMA), 1)
    assert store.compact() == 1
    _, bases = store._manifest()
    assert sorted(bases.values()) == [0] * 7 + [1]
    store.append(spark.createDataFrame([(k, None, None, DELETE, None, 0) for k in range(40)], SCHEMA), 2)
    assert store.compact() == 8 and content(store) == []
    store.vacuum()
    assert content(store) == []


def test_only_rows_that_meet_others_are_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logstore, "ROWS_PER_FILE", 0)
    store = store_of(spark, tmp_path)
    text = F.concat(*(F.sha2((F.col("id") * 40 + i).cast("string"), 256) for i in range(16)))
    rows = spark.range(4000).select(F.col("id").alias("k"), text.alias("a"), F.col("id").alias("b"), F.lit(PUT).alias("op"), F.lit(0).alias("seq"))
    size = 4000 * 16 * 64

    def run():
        for n in range(4):
            store.append(rows.where(F.col("k") % 4 == n), n)
            if n == 1:
                store.compact()
        assert store.read().count() == store.read().agg(F.sum(F.length("a") / 1024)).first()[0] == 4000

    assert shuffled(spark, run)[1] < size / 10  # not some times the size
    store.append(rows.where("k < 4").withColumn("op", F.lit(DELETE)), 4)
    assert shuffled(spark, store.compact)[1] < size / 10
    assert store.read().count() == 3996


@pytest.mark.parametrize("most_bits", [1, 8, 27])
def test_the_filter_decides_nothing(spark, tmp_path, monkeypatch, most_bits):
    """Few bits let rows of keys that have no others through."""
    monkeypatch.setattr(logstore, "MOST_BITS", most_bits)
    monkeypatch.setattr(logstore, "ROWS_PER_FILE", 0)
    store, rng, batches = store_of(spark, tmp_path), random.Random(9), {}
    for n in range(3):
        batches[n] = [(rng.choice([None, *range(400)]), *r[1:]) for r in a_batch(rng, 150)]
        store.append(spark.createDataFrame(batches[n], SCHEMA), n)
        if n == 1:
            store.compact()
    assert sorted(comparable(content(store))) == sorted(comparable(replayed(batches)))


def test_triples_with_ids_as_text_and_as_bytes(spark, tmp_path):
    schema = "subject string, predicate string, object string, valid_from timestamp_ntz, source string, seq long"
    added = spark.createDataFrame([("a", "r", "b", None, "s", 0), ("a", "r", "c", None, "t", 1), ("a", "r", "b", None, "u", 2)], schema)
    found = []
    for kind in ("string", "binary"):
        store = LogStore(spark, str(tmp_path / kind), "id", kind, graph.TRIPLES, buckets=2)
        assert graph.add_triples(store, added, 0) and graph.delete_triples(store, added.where("object = 'c'"), 1)
        found.append([tuple(r) for r in graph.stored_triples(store).collect()])
    want = added.where("seq = 2").select(graph.triple_id(), "subject", "predicate", "object", "valid_from", "source").collect()
    assert found == [[tuple(r) for r in want]] * 2
