import random
import re
from itertools import combinations

import pytest

from quarrylight.llm import minhash


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute_force(docs, n, percent=80):
    """doc_id -> smallest id reachable over all pairs that reach the threshold."""
    sets = {d: shingles(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def edited(rng, words, rate):
    out = []
    for w in words:
        r = rng.random()
        if r < rate / 3:
            continue
        out.append(f"w{rng.randint(0, 10**6)}" if r < rate else w)
        if r > 1 - rate / 4:
            out.append(rng.choice(words))
    return out


def family(seed, copies, rates=(0.0, 0.01, 0.03, 0.05, 0.08, 0.12)):
    rng = random.Random(seed)
    base = [f"v{rng.randint(0, 400)}" for _ in range(120)]
    texts = [" ".join(edited(rng, base, rng.choice(rates))) for _ in range(copies)]
    chained = base  # each a little further from the last, so that groups hang together by chains
    for _ in range(copies // 4):
        chained = edited(rng, chained, 0.02)
        texts.append(" ".join(chained))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("small", [1, 4, 32])
def test_groups_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    texts = family(3, 120) + family(4, 60) + ["", None, "one two", "One  TWO", "one two three", "   "]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame, shingle_words=4).collect()}
    assert got == brute_force(docs, 4)


def test_prefixes_of_similar_pairs_meet():
    """The bound behind the second round, against all pairs of a group, for hubs far and near."""
    np = minhash.np
    rng = random.Random(9)
    sets = [np.sort(np.array([hash(s) & (2**63 - 1) for s in shingles(t, 4)], dtype=np.uint64)) for t in family(11, 90)]
    f = minhash._share(80)
    for hub in (sets[0], sets[17], np.sort(np.array(rng.sample(range(2**40), 80), dtype=np.uint64))):
        rows = []
        for own in sets:
            both = len(np.intersect1d(own, hub))
            linked = 100 * both >= 80 * (len(own) + len(hub) - both)
            d = minhash._difference(own, hub)
            rows.append((own, linked, len(d), d[: minhash._prefix_length(len(d), len(own), len(hub), linked, 80)]))
        for (x, lx, dx, px), (y, ly, dy, py) in combinations(rows, 2):
            both = len(np.intersect1d(x, y))
            if 100 * both < 80 * (len(x) + len(y) - both) or (lx and ly) or not dx or not dy:
                continue
            needed = max(1, int(np.ceil((dx + dy - f * (len(x) + len(y))) / 2 - 1e-9)))
            assert set(px[: max(0, dx - needed + 1)].tolist()) & set(py[: max(0, dy - needed + 1)].tolist())


def shared_edits(seed, members):
    """Copies of one text of 40 words with one to three words replaced by one shared word; none reaches the threshold with most others."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(40)]
    texts = []
    for _ in range(members):
        own = list(base)
        for at in rng.sample(range(40), rng.randint(1, 3)):
            own[at] = "other"
        texts.append(" ".join(own) + (f" z{rng.randint(0, members)}" if rng.random() < 0.3 else ""))
    return texts


def test_large_family_with_shared_edits(spark):
    docs = list(enumerate(shared_edits(5, 2000)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame).collect()}
    assert got == brute_force(docs, 5)


@pytest.mark.parametrize("divisions", [0, 1, 8])
def test_families_are_divided_without_loss(spark, monkeypatch, divisions):
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "PART", 5)
    monkeypatch.setattr(minhash, "DIVISIONS", divisions)
    docs = list(enumerate(shared_edits(6, 150) + family(8, 60)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame).collect()}
    assert got == brute_force(docs, 5)


def differing_families(members, seed=7):
    """A family's rows: sets that lack a half of the hub's 60 elements each, of which no two are similar, but for the last two."""
    rng = random.Random(seed)
    rows = [("f", d, 30, d, False, 30, rng.sample(range(60), 30)) for d in range(members)]
    return rows[:-1] + [("f", members - 1, 31, members - 1, False, 31, [*rows[-2][6], 99])]


def test_a_family_is_not_multiplied(spark, monkeypatch):
    """700 members that share most elements: every division would repeat them for each element of a prefix."""
    made = []
    keep = minhash.Scratch.keep

    def counted(self, frame, name):
        out = keep(self, frame, name)
        made.append(out.count())
        return out

    monkeypatch.setattr(minhash.Scratch, "keep", counted)
    kind = "family string, doc_id long, n long, component long, linked boolean, length long, difference array<long>"
    families = spark.createDataFrame(differing_families(700), kind)
    links = {tuple(sorted(r)) for table in minhash.family_links(families, 80, minhash.Scratch(spark, "families")) for r in table.collect()}
    assert links == {(698, 699)}
    assert max(made) <= 700


@pytest.mark.parametrize("dense", [0, 10**9])
def test_overlaps_and_forests(monkeypatch, dense):
    np, pa = minhash.np, minhash.pa
    monkeypatch.setattr(minhash, "_DENSE", dense)
    monkeypatch.setattr(minhash, "_COLUMNS", 7)
    monkeypatch.setattr(minhash, "_MEETINGS", 50)
    rng = random.Random(dense)
    one, two = ([rng.sample(range(60), rng.randint(0, 30)) for _ in range(n)] for n in (40, 25))
    a, b = (pa.array(x, pa.list_(pa.int64())) for x in (one, two))
    assert minhash._overlaps(a, b).tolist() == [[len(set(x) & set(y)) for y in two] for x in one]
    assert minhash._overlaps(a, None).tolist() == [[len(set(x) & set(y)) for y in one] for x in one]
    chain = np.zeros((5, 5), dtype=bool)
    chain[0, 1] = chain[1, 2] = chain[0, 2] = chain[3, 4] = True
    assert len(minhash._forest(chain, same=True)) == 3
    assert len(minhash._forest(np.ones((4, 6), dtype=bool), same=False)) == 9


def test_text_longer_than_a_chunk(spark):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10**7)}" for _ in range(90_000)]  # over 512 KB
    near = [w if rng.random() > 0.01 else "x" for w in words]
    docs = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:80_000])), (4, "other words of a short text here")]
    assert len(docs[0][1]) > 1 << 19
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame).collect()}
    assert got == brute_force(docs, 5)


def test_defined_cases(spark, rows):
    docs = spark.createDataFrame([(7, "a b c d e f", 1), (7, "p q r s t u", 2), (9, "p q r s t u", 3), (3, "a b c d e f", 4), (None, "a b c d e f", 5), (11, None, 6), (12, "x", 7), (13, "x", 8)], "doc_id long, text string, n_shingles int")
    got = rows(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted([(7, 2, 3, False), (7, 2, 3, False), (9, 2, 3, False), (3, 2, 3, True), (None, 2, None, None), (11, 0, 11, True), (12, 1, 12, True), (13, 1, 12, False)], key=repr)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in minhash.deduplicated(docs).collect()) == [0, 3, 11, 12]
