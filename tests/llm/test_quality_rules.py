"""Quality rules against a plain version of their definitions."""

import re

import pytest
from pyspark.sql import functions as F

from quarrylight.llm import quality_rules as rules

SCHEMA = "doc_id long, text string, n_words string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    bare = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r'[.,;:!?"()]', "", text.lower()))
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        text.count("!"),
        sum(w in set(rules.STOP_WORDS) for w in bare),
        len(lines),
        len(lines) - len(set(lines)),
        sum(x.rstrip(" ").endswith(("...", "…")) for x in lines),
        len(covered),
    )


def verdict(m):
    m = dict(zip(rules.MEASURES, m, strict=True))
    ratio = lambda r: 1000 * m[r.of] if r.per is None else (1000 * m[r.of], m[r.per])
    broken = []
    for r in rules.RULES:
        of, per = ratio(r) if m[r.per] else (0, 1)
        if (r.least is not None and of < r.least * per) or (r.most is not None and of > r.most * per):
            broken.append(r.name)
    failed = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
    return failed, broken, not failed and not broken


TEXTS = [
    None,
    "",
    " \t\r\n\v\f ",
    "one",
    "the quick brown fox and the lazy dog of the house are in it",
    "a b c d e a b c d e",
    "x x x x x x x x x x x",
    "the of and\x00the é ß \U0001f600\U0001f600 zu der die das und ist",
    "same line here\nsame line here\nsame line here\n \nother line of the text",
    "breaks off...\nbreaks off too… \nthe end of it. and then so on it is\n\n",
    "<a> & <b> | # $ % * !!! the and of to in that have is it for",
    "The, of! AND? (to) \"in\" that; have: is it, for. More words of the kind",
    "a b c d e f a b c d e g b c d e f a",
]


def test_measures_and_verdicts(spark):
    frame = spark.createDataFrame([(i, t, "theirs") for i, t in enumerate(TEXTS)] + [(0, None, "again"), (None, "a null id", None)], SCHEMA)
    got = rules.judged(frame, prefix="m_").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = plain(r["text"])
        assert tuple(r[f"m_{n}"] for n in rules.MEASURES) == want, r["text"]
        assert (r["m_base_failed"], r["m_broken"], r["m_kept"]) == verdict(want)
    assert {r["n_words"] for r in got} == {"theirs", "again", None}  # a column that clashes stays


def test_long_text_and_repeats(spark):
    text = " ".join(f"w{i % 90_000}" for i in range(100_000)) + " the"
    r = rules.judged(spark.createDataFrame([(1, text, "")], SCHEMA), prefix="m_").first()
    assert r["m_n_words"] == 100_001
    assert r["m_n_repeat_words"] == 20_000  # 10,000 words stand twice


def test_no_rows(spark):
    assert rules.judged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filtered_keeps_columns_and_clean_texts(spark):
    clean, noise = "the house of the man and the dog is in the town with a tree", "&&& ### $$$ *** %%% ||| <<< >>> &&& ### $$$ ***"
    frame = spark.createDataFrame([(1, clean, "x"), (2, noise, "y"), (3, None, "z")], SCHEMA)
    assert [tuple(r) for r in rules.filtered(frame).collect()] == [(1, clean, "x")]


def test_a_table_of_ones_own(spark):
    frame = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", ""), (2, "a b c d e f g h i j", "")], SCHEMA)
    table = (rules.Rule("long words", "word_chars", "n_words", least=2_000),)
    assert {r["doc_id"]: r["broken"] for r in rules.judged(frame, rules=table).collect()} == {1: [], 2: ["long words"]}
    assert {r["kept"] for r in rules.judged(frame, rules=()).collect()} == {True}


def test_no_python_in_the_plan(spark):
    plan = rules.judged(spark.createDataFrame([(1, "a", "b")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    import random

    draw = random.Random(seed)
    texts = ["".join(draw.choice(["a ", "b ", "c ", "the ", "\n", "x...\n", "!", "#", " "]) for _ in range(draw.randrange(120))) for _ in range(60)]
    frame = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    got = rules.judged(frame).orderBy(F.col("doc_id")).collect()
    assert [tuple(r[n] for n in rules.MEASURES) for r in got] == [plain(t) for t in texts]
