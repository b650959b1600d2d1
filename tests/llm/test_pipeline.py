"""Each stage on what the stage before kept, against plain versions."""

import math

import pytest
from brute import boilerplate_free, overlap, words
from pyspark.sql import functions as F
from test_minhash import brute_force
from test_mixing import brute_targets

import corpus_pipeline
from quarrylight.llm import langid

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "", None, None, 0), (9003, "12 34", "en", "src2", 5), (None, "the and of in the thing", "en", "src3", 23)], docs.schema)
    docs = docs.union(odd)
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    return out


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=repr)


def test_language(spark, stages):
    docs = spark.createDataFrame(stages[0], "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.learn(docs, langid.bucket_of(F.col("doc_id"), 4) != 2)
    assert ids(stages[1]) == ids(langid.identify(docs, model).where("accepted").collect())
    assert {9001, 9002, 9003}.isdisjoint(ids(stages[1])) and len(stages[1]) >= 0.97 * len(stages[0])


def test_lines(stages):
    want = boilerplate_free([(r["doc_id"], r["source"], r["text"]) for r in stages[1] if r["doc_id"] is not None], 10)
    got = {r["doc_id"]: r["text"] for r in stages[2] if r["doc_id"] is not None}
    before = {r["doc_id"]: r["text"] for r in stages[1]}
    assert got == {d: t for d, t in want.items() if t.strip() or t == before[d]}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_near_copies(stages):
    groups = brute_force([(r["doc_id"], r["text"]) for r in stages[2] if r["doc_id"] is not None], 5)
    assert ids(stages[3]) == sorted([d for d, (_, c) in groups.items() if d == c] + [None], key=repr)


def test_benchmark(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(stages[4]) == ids(r for r in stages[3] if all(overlap(r["text"], i) is None for i in items))


def test_mix(stages):
    source = {r["doc_id"]: r["source"] for r in stages[4]}
    sizes = {}
    for r in stages[4]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    targets, taken, by_doc = brute_targets(sizes), dict.fromkeys(sizes, 0), {}
    for r in stages[5]:
        assert 0 < r["taken"] == len(words(r["text"]))
        taken[source[r["doc_id"]]] += r["taken"]
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["taken"]
    size = {r["doc_id"]: len(words(r["text"])) for r in stages[4]}
    assert all(n <= 3 * size[d] for d, n in by_doc.items())
    for s in sizes:
        assert taken[s] == pytest.approx(math.floor(targets[s] + 1e-9), abs=1)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_clashing_columns_and_empty_tables(spark):
    """Extra columns keep their names and values; stages take tables without rows."""
    extra = ["n_removed", "__positions", "__id", "__gone", "__overlaps", "has_letter", "hash", "key", "bands", "position", "size", "number", "taken", "tokens", "content", "version"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").withColumns({c: F.lit(f"mine {c}") for c in extra})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select(*extra).collect()} == {tuple(f"mine {c}" for c in extra)}
        assert stage(spark, docs.limit(0), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SF).columns == ["doc_id", "size", "source_size", "target", "taken", "slot", "place", "text"]
    assert last(spark, docs.limit(0), SF).count() == 0
