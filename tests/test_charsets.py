"""Encodings of text files."""

import random

import pytest

from quarrylight.sources.charsets import CYRILLIC, decoded, detected
from quarrylight.sources.files import PARSERS, found_files, parsed

RUSSIAN = """утром мы пошли на рынок и купили свежий хлеб молоко яблоки потом долго сидели у реки смотрели как рыбаки тянут сети
завтра будет дождь поэтому возьми зонт старый дом стоит за лесом там живёт добрый кузнец дети играют во дворе собака спит под столом
книга лежит на полке открой окно пожалуйста сегодня очень жарко поезд приходит в полдень встреча начнётся позже все уже знают""".split()
LATIN = """le garçon a mangé une pomme à côté de la forêt où l'été était très chaud die Bäume stehen schön über dem Fluß größer als früher
mañana por la mañana el niño irá al colegio también está aquí""".split()


def text_of(rng, words, n):
    chosen = [rng.choice(words) for _ in range(n)]
    if rng.random() < 0.2:
        return " ".join(chosen).upper()
    return ". ".join(" ".join(chosen[i : i + 7]).capitalize() for i in range(0, n, 7)) + ".\n"


@pytest.mark.parametrize("encoding", [*CYRILLIC, "utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "utf-32-le", "utf-32-be"])
@pytest.mark.parametrize("words", [3, 8, 40, 2000])
def test_russian(encoding, words):
    rng = random.Random(f"{encoding}{words}")
    texts = [text_of(rng, RUSSIAN, words) for _ in range(10 if words > 100 else 100)]
    right = sum(decoded(t.encode(encoding)) == t for t in texts)
    assert right >= (0.95 if words < 8 else 1) * len(texts)


@pytest.mark.parametrize("encoding", ["cp1252", "utf-8", "utf-16", "utf-16-le", "utf-32-be"])
@pytest.mark.parametrize("words", [3, 8, 40, 2000])
def test_accents(encoding, words):
    rng = random.Random(f"{encoding}{words}")
    texts = [t for t in (text_of(rng, LATIN, words) for _ in range(100)) if encoding != "cp1252" or t.encode("cp1252", "ignore").decode("cp1252") == t]
    assert len(texts) > 50
    assert sum(decoded(t.encode(encoding)) == t for t in texts) >= 0.97 * len(texts)


def test_edges():
    assert [detected(c) for c in (b"", b"plain", b"\xff", b"\xff a", b"\x00", b"\x00\x00")] == ["utf-8", "utf-8", "cp1251", "cp1252", "utf-8", "utf-8"]
    broken = ("начало " * 50).encode() + b"\xff" + ("конец " * 50).encode()
    assert detected(broken) == "utf-8" and decoded(broken).count("�") == 1
    assert decoded(("слово " * 50).encode()[:-2]).startswith("слово слово")
    late = b"an ascii preface of some length " * 50_000 + "потом долго сидели у реки".encode("koi8-r")
    assert decoded(late).endswith("потом долго сидели у реки")


@pytest.mark.parametrize("odd", ["öö", "èê", "îâ", "ñòî"])
def test_accents_beside_each_other_in_ascii(odd):
    text = "some plain words before it and " * 4 + f"{odd}, and some words behind it"
    assert decoded(text.encode("cp1252")) == text


@pytest.mark.parametrize("odd", ["éè", "èè", "ééê", "éè èè"])
def test_repeated_words_of_accents_only(odd):
    text = "some treê plain étreoi words stand here\n" + f"{odd} " * 80 + "and there"
    assert decoded(text.encode("cp1252")) == text
    preface = "a preface of plain words in ASCII, " * 40
    assert decoded(preface.encode() + ("потом долго сидели у реки " * 20).encode("koi8-r")).endswith("сидели у реки ")


def test_files(spark, tmp_path):
    texts = {f"{e}.txt": "Завтра будет дождь, поэтому возьми зонт." for e in (*CYRILLIC, "utf-8", "utf-16", "utf-16-be")}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode(name.removesuffix(".txt")))
    rows = parsed(found_files(spark, str(tmp_path), PARSERS)).collect()
    assert {r["relative_path"]: r["text"] for r in rows} == texts
