"""The inverted text index against a plain version of its score."""

import math
import random
import re
from collections import Counter

import pytest

from shuffles import shuffled

from quarrylight.operators import textindex

DOCS, QUERIES = "id long, text string, bucket string", "query_id long, phrase string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(docs, queries, k=10):
    each = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_all, l_all = len(each), sum(c.total() for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for q, phrase in queries:
        scores = []
        for place, (i, c) in enumerate(each):
            s = sum(math.floor(math.log(1 + (n_all - df[t] + 0.5) / (df[t] + 0.5)) * 10**6) * 2200 * c[t] // (1000 * c[t] + 300 + 900 * c.total() * n_all // l_all) for t in set(words(phrase)) & set(c))
            if s > 0:
                scores.append((-s, i is None, i or 0, place))
        out += [(q, p, None if null else i, -s) for p, (s, null, i, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(2)
    vocabulary = [f"w{i}" for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    docs = [(i, " ".join(draw.choices(vocabulary, weights, k=draw.randrange(1, 50)))) for i in range(500)]
    docs += [(600, None), (601, ""), (602, "., !"), (None, "rare W3 w3"), (5, "rare w3 w3"), (5, "rare w3 w3"), (603, "Ж ж Straße")]
    queries = [(q, "; ".join(draw.choices(vocabulary, k=draw.randrange(1, 9)))) for q in range(30)] + [(100, "RARE w0 w3 w3"), (101, None), (102, "nowhere"), (103, "ж straße w1"), (104, "")]
    return docs, queries


@pytest.fixture(scope="module")
def index(spark, corpus):
    return textindex.TextIndex.build(spark.createDataFrame([(*d, "theirs") for d in corpus[0]], DOCS), key="id", text="text", buckets=16)


@pytest.mark.parametrize(("k", "short", "few"), [(10, 1000, 2000), (10, 0, 2000), (10, 60, 2000), (2, 60, 2000), (3, 20, 5)])
def test_same_as_plain(spark, corpus, index, monkeypatch, k, short, few):
    monkeypatch.setattr(textindex, "FEW_WORDS", few)
    got = index.search(spark.createDataFrame(corpus[1], QUERIES), k=k, short=short)
    assert sorted((tuple(r) for r in got.select("query_id", "place", "id", "score").collect()), key=repr) == plain(*corpus, k)


def test_only_the_words_buckets_are_read(spark, index):
    asked = spark.createDataFrame([(1, "rare"), (1, "w7")], "query_id long, term string")
    found = index.matching(asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*In\(term", plan)
    found.collect()
    read = {r["bucket"] for r in found.select("bucket").distinct().collect()}
    assert len(read) <= 2 < index.postings().select("bucket").distinct().count()


def test_no_rows(spark, corpus, index):
    empty = textindex.TextIndex.build(spark.createDataFrame([], DOCS), key="id", text="text")
    assert empty.search(spark.createDataFrame(corpus[1], QUERIES)).collect() == []
    assert index.search(spark.createDataFrame([], QUERIES)).collect() == []


def test_occurrences_are_counted_where_they_are(spark, monkeypatch):
    plans = []
    keep = textindex.written
    monkeypatch.setattr(textindex, "written", lambda frame: plans.append(frame._jdf.queryExecution().executedPlan().toString()) or keep(frame))
    docs = spark.createDataFrame([(1, "a b a a", ""), (2, None, ""), (3, "b", "")], DOCS)
    index = textindex.TextIndex.build(docs, key="id", text="text")
    assert "Exchange" not in plans[0] and "MapInArrow" in plans[0]
    assert {(r["term"], r["df"]) for r in index.terms().collect()} == {("a", 1), ("b", 2)}


def test_words_in_common_are_not_rows(spark):
    common = [f"w{i}" for i in range(6)]
    docs = [(i, " ".join(common[i % 3 :] + [f"own{i}"] * (i % 5))) for i in range(2000)]
    queries = [(q, " ".join(common) + f" own{q}") for q in range(100)]
    index = textindex.TextIndex.build(spark.createDataFrame([(*d, "") for d in docs], DOCS), key="id", text="text")
    found = []
    rows = shuffled(spark, lambda: found.extend(index.search(spark.createDataFrame(queries, QUERIES), short=50).collect()))[0]
    assert sorted((tuple(r) for r in found), key=repr) == plain(docs, queries)
    assert rows < 20_000  # 200,000 pairs of a query and a document have words in common


def test_rounds(spark, corpus, index, monkeypatch):
    monkeypatch.setattr(textindex, "ASKED_AT_ONCE", 20)
    queries = corpus[1][:6] + corpus[1][30:]
    got = index.search(spark.createDataFrame(queries, QUERIES), short=60)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(corpus[0], queries)


def test_words_that_a_document_repeats(spark):
    docs = [(1, "a b " * 300), (2, "a " * 70_000 + "b"), (3, "a b"), (4, "c")]
    queries = [(1, "a b"), (2, "c a")]
    index = textindex.TextIndex.build(spark.createDataFrame([(*d, "") for d in docs], DOCS).coalesce(1), key="id", text="text")
    assert sorted((tuple(r) for r in index.search(spark.createDataFrame(queries, QUERIES)).collect()), key=repr) == plain(docs, queries)
