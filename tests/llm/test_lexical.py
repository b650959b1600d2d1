"""Ranked lexical search against a plain version of the score."""

import collections
import math
import random
import re

import numpy as np
import pytest

from quarrylight.llm import lexical

DOCS, QUERIES = "doc_id long, text string, row string, n long", "item_id long, text string, term string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(docs, queries, k=10):
    each = [(d, collections.Counter(terms(t))) for d, t in docs]
    each = [(d, c) for d, c in each if c]
    n_all, l_all = len(each), sum(c.total() for _, c in each)
    df = collections.Counter(t for _, c in each for t in c)
    out = []
    for item, text in queries:
        scores = []
        for place, (d, c) in enumerate(each):
            m = 10 + (90 * c.total() * n_all) // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) & set(c))
            if score > 0:
                scores.append((-score, d is None, d or 0, place))
        out += [(item, i, None if null else d, -s) for i, (s, null, d, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, queries, **options):
    d = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, "y") for i, t in queries], QUERIES)
    return sorted((tuple(r) for r in lexical.ranked(d, q, **options).select("query_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n=300):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["ÉA", "été", "ß", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(draw.randrange(10 * n), " ".join(draw.choices(vocabulary, weights, k=draw.randrange(1, 60)))) for _ in range(n)]
    queries = [(i, ", ".join(draw.choices(vocabulary, k=draw.randrange(1, 25)))) for i in range(40)]
    return docs, queries


@pytest.mark.parametrize("options", [{}, {"short": 0}, {"short": 40}, {"short": 10**6}, {"postings_per_shard": 500, "queries_per_block": 7}, {"broadcast_terms": 0}, {"k": 3, "short": 25}])
def test_same_as_plain(spark, options):
    docs, queries = corpus(1)
    assert found(spark, docs, queries, **options) == plain(docs, queries, options.get("k", 10))


def test_nulls_ties_repeats(spark):
    docs = [(1, None), (2, ""), (3, " .,- "), (None, "alpha beta"), (9, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (5, "ALPHA Beta"), (6, "gamma " * 50), (7, "beta"), (8, "delta")]
    queries = [(1, "alpha beta alpha"), (2, None), (3, ""), (4, "nowhere"), (None, "gamma delta"), (1, "alpha beta alpha"), (5, "Ä alpha")]
    assert found(spark, docs, queries) == plain(docs, queries)
    assert found(spark, docs, queries, k=2) == plain(docs, queries, 2)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []


def test_long_text(spark):
    docs = [(1, " ".join(f"t{i}" for i in range(200_000)) + " needle"), (2, "needle in a text"), (3, "other words"), (4, "more words")]
    queries = [(1, "needle t199999")]
    assert found(spark, docs, queries) == plain(docs, queries)


def test_blocks_are_skipped(monkeypatch):
    """Long lists are not read where their bounds can't pass what was found."""
    import pyarrow as pa

    draw = np.random.default_rng(0)
    n = 256 * 40
    rows = np.concatenate([np.arange(n), np.arange(n), draw.choice(n, 100, replace=False)])
    ids = np.concatenate([np.zeros(n), np.ones(n), np.full(100, 2)]).astype(np.int64)
    part = np.concatenate([draw.integers(1, 5, n), draw.integers(1, 5, n), draw.integers(1000, 2000, 100)])
    shard = lexical._Shard(pa.table({"row": rows, "id": rows, "term_id": ids, "part": part}))
    read = []
    real = lexical._Shard._slice
    monkeypatch.setattr(lexical._Shard, "_slice", staticmethod(lambda reader, b: read.append(b) or real(reader, b)))
    best, scores = shard.search(np.array([0, 1, 2]), 10, 256)
    total = np.bincount(rows, part, minlength=n).astype(np.int64)
    order = np.lexsort((np.arange(n), -total))[:10]
    assert shard.rows[best].tolist() == order.tolist() and scores.tolist() == total[order].tolist()
    assert len(set(read)) <= 20  # of 40 blocks
