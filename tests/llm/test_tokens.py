import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from quarrylight.llm import tokens

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbZ \t\n\x0b\x0c\r\x1cé ж🙂."), max_size=20)), max_size=12)


@given(TEXTS, st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, limit):
    column = pa.array(["x", *texts], pa.string()).slice(1)
    found, seen = [], {}
    for chunk in tokens.chunks(column, limit):
        starts, ends, first = chunk.words()
        for lower in (False, True):
            hashes = chunk.hashes(starts, ends, lower)
            for s, e, h in zip(starts, ends, hashes.tolist(), strict=True):
                word = chunk.data[s:e].tobytes()
                word = word.lower() if lower else word
                assert seen.setdefault(word, h) == h  # equal words hash alike in any place
        for r in range(chunk.n_rows):
            found.append([chunk.data[s:e].tobytes().decode() for s, e in zip(starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]], strict=True)])
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_runs_of_words():
    hashes = tokens.mix64(np.arange(10, dtype=np.uint64))
    grams = tokens.ngram_hashes(np.concatenate((hashes, hashes)), 4)
    assert len(grams) == 17 and (grams[:7] == grams[10:]).all() and len(set(grams.tolist())) == 10
    assert len(tokens.ngram_hashes(hashes, 11)) == 0


def test_a_text_longer_than_a_chunk_stays_whole():
    big = "word " * 300_000
    chunks = list(tokens.chunks(pa.array(["a", big, "b"])))
    assert [c.n_rows for c in chunks] == [1, 1, 1] and len(chunks[1].words()[0]) == 300_000
    hashes = chunks[1].hashes(*chunks[1].words()[:2], lower=False)
    assert (hashes == hashes[0]).all()
