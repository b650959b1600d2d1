import hashlib
import random

from brute import without_repeats

from quarrylight.llm.substring_dedup import removed_spans


def want(docs, window):
    return sorted((d, n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for d, (n, kept) in without_repeats(docs, window).items())


def fixture(seed, n=120):
    rng = random.Random(seed)
    passages = [rng.choices(["a", "b", "The", "ç"] + [f"w{i}" for i in range(50)], k=k) for k in (8, 25, 60, 200)] + [["The"] * 70]
    docs = []
    for d in rng.sample(range(1000), n):
        text = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            low = rng.randint(0, len(p) // 2)
            text += p[low : low + rng.randint(1, len(p))] if rng.random() < 0.7 else rng.choices(["x", "y", f"z{d}"], k=rng.randint(1, 50))
        docs.append((d, "".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in text)))
    return docs


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs = fixture(seed) + [(5000, None), (5001, ""), (5002, " \n ")]
        frame = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, key string").repartition(5)
        for window in (20, 8):
            assert sorted(map(tuple, removed_spans(frame, window=window).collect())) == want(docs, window)


def test_defined_cases(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(1, passage), (2, passage + " tail"), (2, "other " + passage), (None, passage), (3, passage), (3, passage)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in removed_spans(frame).collect()), key=repr)
    assert got == sorted([(1, 30, 0), (2, 31, 30), (2, 31, 30), (None, 30, 30), (3, 30, 30), (3, 30, 30)], key=repr)
    same = removed_spans(spark.createDataFrame([(7, passage), (7, passage)], "doc_id long, text string"))
    assert [r["n_removed"] for r in same.collect()] == [0, 0]
    assert removed_spans(frame.limit(0)).count() == 0


def test_colliding_hashes_are_told_apart_by_words(spark):
    docs = fixture(3, 60) + [(5000, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for bits in (2, 12):
        assert sorted(map(tuple, removed_spans(frame, window=8, hash_bits=bits).collect())) == want(docs, 8)


def test_text_longer_than_a_chunk(spark):
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(100_000)]  # over 512 KB
    docs = [(1, " ".join(words[:60_000])), (2, " ".join(words)), (3, " ".join(words[70_000:70_100] + ["x"] + words[:30]))]
    assert len(docs[1][1]) > 1 << 19
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, removed_spans(frame).collect())) == want(docs, 20)
