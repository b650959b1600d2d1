"""Overlaps against a comparison of every diagonal, without seeds."""

import itertools
import random

import pytest
from brute import tokens

from quarrylight.llm import decontaminate as dc


def compared(doc, item, window=dc.WINDOW, substitutions=dc.SUBSTITUTIONS, whole=6):
    """Equal tokens of the best run of a document and an item on any diagonal, or None."""
    d, t = tokens(doc), tokens(item)
    n = min(len(t), window)
    allowed = n * substitutions // window if len(t) >= whole else 0
    best = max((sum(d[i + p] == t[j + p] for p in range(n)) for i in range(len(d) - n + 1) for j in range(len(t) - n + 1)), default=-1)
    return best if t and best >= n - allowed else None


def substituted(lengths):
    """An item of each length, and a document for every way to place its allowed substitutions."""
    items, docs = [], []
    for n in lengths:
        words = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        for places in itertools.combinations(range(n), n * dc.SUBSTITUTIONS // dc.WINDOW):
            docs.append((len(docs), "before " + " ".join("y" if i in places else w for i, w in enumerate(words)) + " after", n))
    return docs, items


@pytest.mark.parametrize("broadcast_seeds", [dc.BROADCAST_SEEDS, 0])
def test_every_placement_of_the_allowed_substitutions_is_found(spark, rows, broadcast_seeds):
    docs, items = substituted(range(6, 14))
    found = dc.overlaps(spark.createDataFrame(docs, "doc_id long, text string, n int"), spark.createDataFrame(items, "item_id long, text string"), broadcast_seeds=broadcast_seeds)
    want = [(d, n, n - n * dc.SUBSTITUTIONS // dc.WINDOW, n) for d, _, n in docs]
    assert rows(found, "doc_id", "item_id", "n_equal", "n_compared") == sorted(want, key=repr)


def test_random_edits_equal_the_comparison_of_every_diagonal(spark, rows):
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 16, 20])))) for i in range(60)]
    docs = []
    for d in range(400):
        text = rng.choices(vocabulary, k=rng.randint(0, 15))
        part = [rng.choice(vocabulary) if rng.random() < 0.25 else w for w in rng.choice(items)[1].split()]
        at = rng.randint(0, len(text))
        text[at:at] = part
        docs.append((d, " ".join(text)))
    want = [(d, i, n) for d, t in docs for i, s in items if (n := compared(t, s)) is not None]
    assert len(want) > 150
    found = dc.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(found, "doc_id", "item_id", "n_equal") == sorted(want, key=repr)
