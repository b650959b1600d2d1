import math
import random

import pytest

from quarrylight.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
        open_ -= full


def check(spark, docs, monkeypatch=None):
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string, size string")
    out = mixing.mix(frame)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "first_slot"]
    got = out.collect()
    assert len(got) == len(docs)
    sizes = {}
    for _, s, t, _ in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes) if docs else {}
    source = {d: s for d, s, _, _ in docs}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        assert (r["first_slot"] is None) == (r["taken"] == 0)
    for s in sizes:
        assert taken[s] == pytest.approx(math.floor(want[s] + 1e-9), abs=1)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, mixing.mix(frame).collect()), key=repr)
    return got


def test_targets_and_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rng = random.Random(1)
    names = ["a", "B", "é", None, "hot", "tiny"]
    docs = [(i, rng.choice(names[:4] + ["hot"] * 4), "w " * rng.choice([0, 1, 30, 400, 3000]), "x") for i in range(300)]
    docs += [(1000, "tiny", "just four words here", "x"), (1001, "tiny", None, "x")]
    check(spark, docs)


def test_small_cases(spark):
    check(spark, [(1, "a", "one two three", "x")])
    check(spark, [(1, "a", "one two three", "x"), (2, "b", "", "x"), (3, None, None, "x")])
    check(spark, [(1, "a", None, "x"), (2, "b", "", "x")])
    check(spark, [(1, "a", "w " * 5000, "x"), (2, "b", "w " * 3, "x"), (3, "c", "w", "x")])
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def mixed_docs(n=200):
    rng = random.Random(4)
    return [(i, rng.choice(["a", "b", "c", None]), " ".join(f"w{i}.{j}" for j in range(rng.choice([1, 30, 400, 3000]))), "x") for i in range(n)]


def brute_mix(docs, targets, block):
    """The passages of each slot, word by word: source -> its words in order, dealt to slots of the schedule one after the other."""
    sizes = {s: sum(len(t.split()) for _, x, t, _ in docs if x == s) for s in targets}
    need = {s: min(math.floor(w), max(mixing.LEAST_BLOCKS, math.ceil(math.floor(w) / block))) for s, w in targets.items()}
    names = sorted(x for x in targets if x is not None) + ([None] if None in targets else [])
    slots, s, total, rank = {}, 0, sum(need.values()), dict.fromkeys(names, 0)
    while any(rank[x] < need[x] for x in names):
        point, low = s * mixing.GOLDEN % 1.0, 0
        for x in names:
            if low / total <= point < (low + need[x]) / total and rank[x] < need[x]:
                slots[s] = (x, rank[x])
                rank[x] += 1
            low += need[x]
        s += 1
    return slots, need, sizes


def test_slots_take_the_schedules_blocks(spark):
    docs = mixed_docs()
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string, size string")
    out = mixing.mixture(frame, block=100)
    got = out.collect()
    slots, need, sizes = brute_mix(docs, brute_targets({s: sum(len(t.split()) for _, x, t, _ in docs if x == s) for s in ("a", "b", "c", None)}), 100)
    source, text = {d: s for d, s, _, _ in docs}, {d: t for d, _, t, _ in docs}
    order = sorted(got, key=lambda r: (r["slot"], r["place"]))
    assert {r["slot"] for r in got} == set(slots)
    words, stream = {}, {s: [] for s in sizes}
    for r in order:
        assert source[r["doc_id"]] == slots[r["slot"]][0] and r["taken"] == len(r["text"].split())
        words[r["slot"]] = words.get(r["slot"], 0) + r["taken"]
        stream[source[r["doc_id"]]] += r["text"].split()
    for slot, (s, rank) in slots.items():  # equal blocks, each in its slot
        target = sum(r["taken"] for r in got if source[r["doc_id"]] == s)
        assert words[slot] in (target // need[s], target // need[s] + 1)
    for s, n in sizes.items():  # a source's slots in order go through its stream again and again
        whole = sorted(w for d, t in text.items() if source[d] == s for w in t.split())
        assert all(stream[s][i] == stream[s][i - n] for i in range(n, len(stream[s])))
        if len(stream[s]) >= n:
            assert sorted(stream[s][:n]) == whole


def test_another_sequence_gives_another_mix(spark, monkeypatch):
    frame = spark.createDataFrame(mixed_docs(), "doc_id long, source string, text string, size string")
    one = sorted(map(tuple, mixing.mix(frame).collect()), key=repr)
    monkeypatch.setattr(mixing, "GOLDEN", 2**0.5 - 1)
    two = sorted(map(tuple, mixing.mix(frame).collect()), key=repr)
    assert one != two and [r[:5] for r in one] == [r[:5] for r in two]
    monkeypatch.setattr(mixing, "GOLDEN", 0.0)  # all slots fall to the first source
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([(1, "a", "w " * 10, "x"), (2, "b", "w " * 10, "x")], "doc_id long, source string, text string, size string"))


def test_text_longer_than_a_chunk(spark):
    docs = [(1, "a", "word " * 120_000, "x"), (2, "b", "other " * 50_000, "x"), (3, "a", "x", "x")]  # over 512 KB
    check(spark, docs)


def test_every_stretch_is_near_the_weights():
    """The points' counts in any stretch of the weights stay within a few of its length."""
    points = [(i * mixing.GOLDEN) % 1.0 for i in range(20_000)]
    for low, high in ((0.0, 0.1), (0.33, 0.4), (0.9, 1.0), (0.5, 0.501)):
        count = 0
        for n, p in enumerate(points, 1):
            count += low <= p < high
            assert abs(count - n * (high - low)) < 6
