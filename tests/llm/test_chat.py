import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from quarrylight.llm import chat


def test_expansion(spark):
    rows = [(1, 1, "user", "hi"), (1, 0, "system", "be brief"), (1, 2, "assistant", "yo"), (1, 3, "user", "more"), (1, 4, "assistant", "ok"), (1, 5, "user", "bye"), (2, 0, "user", None)]
    segments = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    examples = chat.expanded(segments).orderBy("example").collect()
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    head = turn("system", "be brief") + turn("user", "hi")
    assert [e["text"] for e in examples] == [head + turn("assistant", "yo"), head + turn("assistant", "yo") + turn("user", "more") + turn("assistant", "ok")]
    assert [e["text"][e["loss_start"] : e["loss_end"]] for e in examples] == ["yo", "ok"]
    assert [e["text"][: e["context_chars"]] for e in examples] == [head, head + turn("assistant", "yo") + turn("user", "more")]


def test_round_trip(spark):
    rng = random.Random(8)
    bits = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "\n", "assistant", "<\\|", "<\\\\|im_end|>", "ж", "🙂", " "]
    text = lambda: "".join(rng.choices(bits, k=rng.randint(0, 8)))
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "a\nb", "x\\n<|im_start|>", None]), rng.choice([text(), text(), None]), "z") for c in [*range(40), None] for t in range(rng.randint(1, 9))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    formatted = chat.format_chats(frame)
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    examples = {}
    for e in chat.expanded(formatted).orderBy("conv_id", "example").collect():
        examples.setdefault(e["conv_id"], []).append(e)
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted((t, role or "", text or "") for c, t, role, text, _ in rows if c == conv)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        written = examples.get(conv, [])
        assert [chat.unescape(e["text"][e["loss_start"] : e["loss_end"]]) for e in written] == [text for _, role, text in turns if role == "assistant"]
        assert all(e["text"].endswith("<|im_end|>\n") and e["context_chars"] < e["loss_start"] and len(e["text"]) == e["loss_end"] + 11 for e in written)
        assert all(late["text"].startswith(early["text"]) for early, late in zip(written, written[1:], strict=False))
        assert r["formatted_chars"] >= sum(len(text) for _, _, text in turns)


@given(st.text(alphabet="<|\\>im_end", max_size=30))
def test_unescape_inverts_escape(text):
    import re

    safe = re.sub(r"<(\\*)\|", r"<\\\1|", text)
    assert chat.unescape(safe) == text and "<|" not in safe


def test_long_and_empty(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", "x" * (t % 50)) for t in range(5000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat.digests(chat.format_chats(frame.repartition(7))).collect()
    assert r["n_turns"] == 5000 and r["loss_chars"] == sum(t % 50 for t in range(1, 5000, 2))
    assert chat.digests(chat.format_chats(frame.limit(0))).count() == 0
