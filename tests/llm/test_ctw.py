import math
from collections import Counter

import numpy as np
import pytest
from brute import words
from pyspark.sql import functions as F

from quarrylight.llm import ctw

LOWER = {c: c + 32 for c in range(65, 91)}


def stream(text, depth):
    return b"\xff" * depth + b" ".join(w.translate(LOWER).encode() for w in words(text)) + b"\xff"


class Brute:
    """Context trees written down by definition."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.kids = depth, Counter(), {}
        for t in texts:
            s = stream(t, depth)
            for i in range(depth, len(s)):
                for d in range(depth + 1):
                    for k in range(8):
                        self.counts[s[i - d : i], (1 << k) | (s[i] >> (8 - k)), (s[i] >> (7 - k)) & 1] += 1
                    if d:
                        self.kids.setdefault(s[i - d + 1 : i], set()).add(s[i - d : i])
        self.known = {}

    def own(self, context, q):
        a, b = self.counts[context, q, 0], self.counts[context, q, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def log(self, context, q):
        if (context, q) not in self.known:
            value = self.own(context, q)
            if len(context) < self.depth:
                below = sum(self.log(c, q) for c in self.kids.get(context, ()))
                value = np.logaddexp(value, below) - math.log(2)
            self.known[context, q] = value
        return self.known[context, q]

    def one(self, past, q, d=0):
        context = past[len(past) - d :]
        a, b = self.counts[context, q, 0], self.counts[context, q, 1]
        own = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return own
        share = math.exp(self.own(context, q) - math.log(2) - self.log(context, q))
        return share * own + (1 - share) * self.one(past, q, d + 1)

    def byte(self, past, x):
        p = 1.0
        for k in range(8):
            one = self.one(past, (1 << k) | (x >> (8 - k)))
            p *= one if (x >> (7 - k)) & 1 else 1 - one
        return p

    def score(self, text):
        s = stream(text, self.depth)
        return sum(math.log10(self.byte(s[i - self.depth : i], s[i])) for i in range(self.depth, len(s)))


TEXTS = ["The cat sat on the mat", "the cat  SAT on the hat\n", "a dog", "", None, "été à la plage été", "the the the the", "cat", "The cat sat on the mat"]


@pytest.mark.parametrize(("depth", "head"), [(2, 1 << 20), (5, 1 << 20), (5, 3), (3, 0)])
def test_scores_equal_the_definition(spark, depth, head):
    docs = [(i, t, 0.0) for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame([(*d,) for d in docs], "doc_id long, text string, score double").repartition(3)
    got = {r["doc_id"]: r for r in ctw.score(frame, F.col("doc_id") % 3 != 1, depth=depth, head=head).collect()}
    train = [t for i, t, _ in docs if i % 3 != 1]
    model = Brute(train, depth)
    counts = Counter(w.translate(LOWER) for t in train for w in words(t))
    counts[None] = len(train)
    n, v = sum(counts.values()), len(counts)
    for i, t, _ in docs:
        tokens = [w.translate(LOWER) for w in words(t)] + [None]
        r = got[i]
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(tokens), n, sum(counts[w] > 0 for w in tokens))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel=1e-9)
        assert r["score"] == pytest.approx(model.score(t), rel=1e-9)


def test_probabilities_sum_to_one():
    model = Brute(["the cat sat", "the hat"], 3)
    for past in (b"\xff\xff\xff", b"the", b"zzz"):
        assert sum(model.byte(past, x) for x in range(256)) == pytest.approx(1)


def test_defined_cases(spark):
    frame = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, "x " * 40_000)], "doc_id long, text string")
    got = ctw.score(frame, F.col("doc_id") == 1).collect()
    assert len(got) == 4 and {r["train_tokens"] for r in got} == {6}
    assert len({r["score"] for r in got if r["n_tokens"] == 3}) == 1
    nothing = ctw.score(frame, F.lit(False)).collect()
    assert {r["train_tokens"] for r in nothing} == {0} and all(r["score"] == pytest.approx(-8 * math.log10(2) * (4 if r["n_tokens"] == 3 else 80_000)) for r in nothing)
    assert ctw.score(frame.limit(0), F.lit(True)).count() == 0


def test_held_out_text_takes_few_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ctw.score(docs, F.col("doc_id") % 5 != 1).join(docs.select("doc_id", F.octet_length("text").alias("bytes")), "doc_id").where(F.col("doc_id") % 5 == 1)
    r = got.agg(F.sum("score").alias("score"), F.sum("bytes").alias("bytes")).first()
    assert -r["score"] * math.log2(10) / r["bytes"] < 3  # bits a byte


@pytest.mark.parametrize("frequencies", [[5_000] * 20, list(range(5_000, 5_020)), [10**9] * 20 + [7] * 30, [1] * 3_000, [1] * 5])
def test_the_broadcast_table_is_filled(spark, frequencies):
    frame = spark.createDataFrame([(i, f, float(i)) for i, f in enumerate(frequencies)], "key long, seen long, score double")
    for most in (10, 1000):
        keys, values = ctw._head(frame, most, "score")
        assert min(most, len(frequencies)) - 1 - len(frequencies) // 200 <= len(keys) <= most
        assert keys.tolist() == values.astype(int).tolist() == sorted(keys.tolist())
        worst = min(frequencies[k] for k in keys)
        assert sum(f > 1.02 * worst for f in frequencies) <= len(keys)
