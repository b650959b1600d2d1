import random

from brute import overlap

from quarrylight.llm import decontaminate as dc


def fixture():
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(60)] + ["the", "of", "and"] * 8
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([14, 30, 59, 20, 10, 7, 4, 2, 30])]
    items += [(100, items[1][1].upper() + "!"), (101, None), (102, ""), (103, "...")]
    docs = []
    for d in range(80):
        text = rng.choices(vocabulary, k=rng.randint(0, 60))
        if d % 2:
            part = items[rng.randrange(9)][1].split()
            part = [rng.choice(vocabulary) if rng.random() < 0.15 * (d % 3) else w.title() + rng.choice(["", ",", "\n"]) for w in part]
            at = rng.randint(0, len(text))
            text[at:at] = part
        docs.append((d, " ".join(text)))
    return docs + [(900, None), (901, ""), (902, "?!")], items


def test_pairs_equal_brute_force(spark, rows):
    docs, items = fixture()
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, tokens string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, key int")
    want = sorted((d, i, n) for d, t in docs for i, s in items if (n := overlap(t, s)) is not None)
    assert len(want) > 30
    assert rows(dc.overlaps(frame, bench), "doc_id", "item_id", "n_equal") == sorted(want, key=repr)
    assert rows(dc.overlaps(frame, bench, broadcast_seeds=0), "doc_id", "item_id", "n_equal") == sorted(want, key=repr)  # the shuffled way
    left = {r["doc_id"] for r in dc.decontaminate(frame, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _, _ in want}


def test_substitutions_are_found_where_the_masks_promise(spark):
    """Any two substitutions in a run of 13."""
    item = " ".join(f"w{i}" for i in range(13))
    docs = []
    for a in range(13):
        for b in range(a + 1, 13):
            words = item.split()
            words[a], words[b] = "x", "y"
            docs.append((len(docs), "before " + " ".join(words) + " after"))
    found = dc.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert found.count() == len(docs) and {r["n_equal"] for r in found.collect()} == {11}


def test_defined_cases(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "a b c d e f g h")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (None, "a b c d e f g h")], "item_id long, text string")
    assert dc.overlaps(docs, bench).count() == 4
    assert dc.decontaminate(docs, bench).count() == 0
    assert dc.overlaps(docs, bench.limit(0)).count() == 0 == dc.overlaps(docs.limit(0), bench).count()
    assert dc.decontaminate(docs, bench.limit(0)).count() == 3
