import random

import pytest

from quarrylight.llm import token_counts as tc

tokenizers = pytest.importorskip("tokenizers")


def unigram(vocabulary):
    """The tokenizers library's own unigram model over the same pieces, with byte fallback."""
    fallback = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    return tokenizers.Tokenizer(tokenizers.models.Unigram(fallback + vocabulary, unk_id=0, byte_fallback=True))


def expected(model, text):
    return len(model.encode(tc.BLANK + text.replace(" ", tc.BLANK), add_special_tokens=False).ids) if text else 0


@pytest.fixture(scope="module")
def vocabulary():
    return tc.read_vocabulary()


def test_counts_equal_the_tokenizer_library(vocabulary, spark):
    model, counter = unigram(vocabulary), tc.Counter(vocabulary)
    assert counter.units is not None
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    odd = ["a", " ", "   lead", "x  y   z", "line\nbreak\n\n", "tab\there", "日本語 テキスト", "emoji 🙂🙂 ok", "▁ literal", "\n", "ß" * 50, "zzzzzzzzzzzzzzzzzzzz", "1234567890 " * 20]
    for text in docs + odd:
        assert counter.count(text)[0] == expected(model, text), text[:80]


def test_ties_go_to_the_earlier_begin():
    """ab|c and a|bc score alike: the last piece that begins earlier is bc."""
    counter = tc.Counter([("a", -1.0), ("b", -9.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), (tc.BLANK, 0.0), ("abc", -3.0)])
    assert counter.solve("abc") == (1, -3.0)  # one piece of the same score as two begins earliest


def test_random_vocabularies_with_ties_equal_the_library():
    rng = random.Random(5)
    for _ in range(40):
        pieces = {"".join(rng.choices("abc▁", k=rng.randint(1, 4))) for _ in range(12)}
        vocabulary = [(p, float(-rng.randint(1, 4))) for p in sorted(pieces)]
        model, counter = unigram(vocabulary), tc.Counter(vocabulary)
        fallback_min = -max(-s for _, s in vocabulary)
        assert counter.unknown == fallback_min - tc.UNKNOWN_PENALTY
        for _ in range(20):
            text = "".join(rng.choices("abcd ", k=rng.randint(1, 12)))
            assert counter.count(text)[0] == expected(model, text), (vocabulary, text)


def test_defined_cases(spark, vocabulary, rows):
    docs = spark.createDataFrame([(1, "the end", "x"), (2, None, "x"), (3, "", "x"), (None, "the", "x"), (1, "the end", "x"), (5, "word " * 30_000, "y")], "doc_id long, text string, n_tokens string")
    got = rows(tc.count_tokens(docs, vocabulary), "doc_id", "n_tokens")
    counter = tc.Counter(vocabulary)
    assert got == sorted([(1, counter.count("the end")[0])] * 2 + [(2, 0), (3, 0), (None, counter.count("the")[0]), (5, counter.count("word " * 30_000)[0])], key=repr)
    assert tc.count_tokens(docs.limit(0), vocabulary).count() == 0


def whole_paths(counter, text):
    """Plain dynamic programming with a value for every position."""
    best = [(0.0, 0)] + [None] * len(text)
    scores = {piece: value for piece, (_, value) in counter.automaton.items()}
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - counter.longest), end):
            value = scores.get(text[begin:end])
            if value is not None and (best[end] is None or best[begin][0] + value > best[end][0]):
                best[end] = best[begin][0] + value, best[begin][1] + 1
        if text[end - 1] not in counter.single:
            passed = best[end - 1][0] + counter.unknown
            if best[end] is None or passed > best[end][0]:
                best[end] = passed, best[end - 1][1] + len(text[end - 1].encode())
    return best[-1][1], best[-1][0]


def test_units_longer_than_the_window(vocabulary):
    rng = random.Random(9)
    counter = tc.Counter(vocabulary)
    for n in (1, counter.longest - 1, counter.longest, counter.longest + 1, 5000):
        text = "".join(rng.choices("abcdefghijklmnoprstuцщ🙂\n", k=n))
        assert counter.solve(text) == whole_paths(counter, text)


def test_bytes_that_are_remembered_are_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 200_000)
    rng = random.Random(3)
    counter, fresh = tc.Counter(vocabulary), tc.Counter(vocabulary)
    texts = ["".join(rng.choices("abcdef", k=rng.choice((5, 400, 3000)))) for _ in range(600)]
    for text in texts + texts[:50]:
        assert counter.count(text) == fresh.solve(tc.BLANK + text)
        assert counter.held == sum(150 + 4 * len(u) for u in counter.known) <= 200_000
        assert all(150 + 4 * len(u) <= 2000 for u in counter.known)
    assert counter.known
