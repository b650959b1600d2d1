import random

from brute import boilerplate_free

from quarrylight.llm import line_dedup


def test_equals_brute_force(spark):
    rng = random.Random(3)
    common = [(f"line {i}", s) for i, s in enumerate([2, 9, 10, 11, 12, 40, 300])]
    docs = []
    for d in range(900):
        lines = [f"own {d} {j}" for j in range(rng.randint(0, 3))]
        for text, sites in common:
            if rng.random() < 0.3:
                lines.insert(rng.randint(0, len(lines)), rng.choice(["", " ", "\t"]) + text)
        site = rng.randrange(300)
        lines = [line for line in lines if not line.strip().startswith("line") or site < next(s for t, s in common if t == line.strip())]
        docs.append((d, None if site == 7 else f"s{site}", "\n".join(lines) + rng.choice(["", "\n", "\n\n", "\r\n"])))
    docs += [(2000, "s1", None), (2001, "s1", ""), (2002, None, "line 6")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, hash int")
    for min_sites in (10, 11, 2):
        want = boilerplate_free(docs, min_sites)
        got = {r["doc_id"]: r["text"] for r in line_dedup.cleaned(frame, min_sites=min_sites).collect()}
        assert got == want


def test_defined_cases(spark):
    docs = [(None, "s0", "x\ny"), *[(i, f"s{i}", "x\nown") for i in range(1, 12)], (1, "s1", "x\nown"), (1, "s1", "more\nlines\nx\n")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    out = line_dedup.cleaned(frame, removed="gone")
    assert out.columns == ["doc_id", "source", "text", "gone"]
    # Of the texts under id 1 one keeps the line, the one whose hash is smaller; its copy does as well.
    kept = {r["text"] for r in out.where("doc_id = 1").collect()}
    ones = [("x\nown", 0), ("more\nlines\n", 1)] if "x\nown" in kept else [("own", 1), ("more\nlines\nx\n", 0)]
    ones = [(1, *ones[0]), (1, *ones[0]), (1, *ones[1])]
    got = sorted(((r["doc_id"], r["text"], r["gone"]) for r in out.collect()), key=repr)
    assert got == sorted([(None, "y", 1), *ones, *[(i, "", 2) for i in range(2, 12)]], key=repr)
    assert line_dedup.cleaned(frame.limit(0)).count() == 0


def test_long_text_in_linear_time(spark):
    """A text of 200,000 lines, all of which go: ten times the lines take far less than a hundred times as long."""
    import time

    took = []
    for n in (100, 20_000, 200_000):
        docs = [(d, f"s{d}", "\n".join(f"shared {i}" for i in range(50))) for d in range(11)] + [(99, "s99", "\n".join(f"shared {i % 50}" for i in range(n)) + "\nown")]
        frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
        began = time.perf_counter()
        got = {r["doc_id"]: (r["gone"], r["text"][-9:]) for r in line_dedup.cleaned(frame, removed="gone").collect()}
        took.append(time.perf_counter() - began)
        assert got == {0: (0, "shared 49"), 99: (n, "own")} | {d: (50, "") for d in range(1, 11)}
    assert took[2] < 12 * took[1]
