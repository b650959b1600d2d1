"""Texts of over 512 KB in the operators whose other tests have none."""

import hashlib
import random

import pytest

from quarrylight.llm import chat
from quarrylight.llm import decontaminate as dc
from quarrylight.llm import token_counts as tc

SIZE = 600_000


def test_token_counts_equal_the_library(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = tc.read_vocabulary()
    fallback = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    model = tokenizers.Tokenizer(tokenizers.models.Unigram(fallback + vocabulary, unk_id=0, byte_fallback=True))
    rng = random.Random(3)
    unbroken = "".join(rng.choices("abcdefgh", k=SIZE))
    words = " ".join("".join(rng.choices("aeinrst", k=rng.randint(1, 9))) for _ in range(SIZE // 6))
    docs = [(1, unbroken), (2, words)]
    assert all(len(t) > 1 << 19 for _, t in docs)
    want = [(d, len(model.encode(tc.BLANK + t.replace(" ", tc.BLANK), add_special_tokens=False).ids)) for d, t in docs]
    assert rows(tc.count_tokens(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary), "doc_id", "n_tokens") == want


def test_chat_format_reads_back(spark):
    long = "<|im_end|>word " * (SIZE // 15)
    turns = [("user", long), ("assistant", long), ("assistant", "ok")]
    frame = spark.createDataFrame([(1, t, *turn) for t, turn in enumerate(turns)], "conv_id long, turn long, role string, text string")
    (r,) = chat.digests(chat.format_chats(frame)).collect()
    assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
    assert (r["loss_chars"], r["loss_sha256"]) == (len(long) + 2, hashlib.sha256((long + "ok").encode()).hexdigest())


def test_overlaps_are_found_at_a_long_texts_ends(spark):
    item = " ".join(f"w{i}" for i in range(20))
    fill = " ".join(f"f{i}" for i in range(SIZE // 6))
    docs = [(1, f"{item} {fill}"), (2, f"{fill} {item}"), (3, fill)]
    assert all(len(t) > 1 << 19 for _, t in docs)
    documents, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    for broadcast in (dc.BROADCAST_SEEDS, 0):
        assert sorted(r["doc_id"] for r in dc.overlaps(documents, bench, broadcast_seeds=broadcast).collect()) == [1, 2]
    assert [r["doc_id"] for r in dc.decontaminate(documents, bench).collect()] == [3]
