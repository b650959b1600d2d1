"""What encoding a text file is in: byte marks, rules of well-formed bytes, then how well the letters read."""

from __future__ import annotations

import functools
import re

import numpy as np

# Marks at the beginning of files, longer ones first.
MARKS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
# Cyrillic encodings to choose from, the first of those that read equally well; and the one of accented letters.
CYRILLIC = ("cp1251", "koi8-r", "cp866")
LATIN = "cp1252"
# Pairs of letters that are usual in Russian words.
PAIRS = frozenset(
    "ак ал ам ан ар ас ат бо бы ва ве ви во вс вы га ги го да де до ду ед ей ел ем ен ер ес ет же за зн ив ие ий ил им ин ис ит их ка ки ко кр ла ле ли ло лу ль ля ма ме ми мо мы на не ни но ну ны об ов ог од ое ой ок ол ом он ор ос от па пе пи по пр ра ре ри ро ру са се си ск сл со ст сь ся та те ти то тр ту ты ть ув уд ук ум ут хо ча че чт ше ши ые ый ых эт ют ят ая ию ии".split()
)
_ASCII = re.compile(rb"[A-Za-z]")
_BLANK = re.compile(rb"\s")
_LETTERS = bytes(i for i in range(256) if not bytes([i]).isalpha())
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_BESIDE = frozenset("«»—–…№„“”\xa0")
#: Bytes at the beginning that are searched for zeros, and bytes that are weighed at a time.
HEAD, BLOCK = 1 << 13, 1 << 20


def _decodes(content: bytes, name: str) -> bool:
    try:
        content.decode(name)
    except UnicodeDecodeError:
        return False
    return True


def _wide(content: bytes) -> str | None:
    """UTF-16 or UTF-32 without a mark, by where the zero bytes of blanks, line ends and ASCII letters lie."""
    head = content[:HEAD]
    zeros = [head[i::4].count(0) for i in range(4)]
    quarter = len(head) / 4
    if len(content) % 4 == 0 and quarter:
        for name, high, low in (("utf-32-le", zeros[2:], zeros[0]), ("utf-32-be", zeros[:2], zeros[3])):
            if min(high) > 0.9 * quarter and low < 0.5 * quarter and _decodes(content, name):
                return name
    first, second = zeros[0] + zeros[2], zeros[1] + zeros[3]
    if len(content) % 2 == 0 and first != second:
        name = "utf-16-le" if second > first else "utf-16-be"
        return name if _decodes(content, name) else None
    return None


def _weight(a: str, b: str) -> int:
    """1 for a usual pair of Russian letters, -2 for one that nobody writes (a small letter before a capital, letters of two alphabets
    beside each other, a sign of a table or a letter of another language), 0 for others."""
    russian = lambda c: "а" <= c <= "я" or c == "ё"
    odd = lambda c: not (c < "\x80" or c in _BESIDE or russian(c))
    x, y = a.lower(), b.lower()
    if a < "\x80" and b < "\x80":
        return 0
    if odd(x) or odd(y):
        return -2
    if russian(x) and russian(y):
        return -2 if a == x and b != y else int(x + y in PAIRS)
    return -2 if x.isalpha() and y.isalpha() else 0


@functools.cache
def _weights(name: str) -> np.ndarray:
    """The weight of each pair of bytes in an encoding."""
    letters = [bytes([i]).decode(name, errors="replace") for i in range(256)]
    return np.array([_weight(a, b) for a in letters for b in letters], np.int8)


def _weighed(content: bytes) -> tuple[int, int, dict[str, int]]:
    """Bytes above ASCII, how many of them stand beside another one, and the sum of all pairs' weights in each Cyrillic encoding."""
    high = beside = 0
    sums = dict.fromkeys(CYRILLIC, 0)
    for at in range(0, len(content), BLOCK):
        block = np.frombuffer(content[max(0, at - 1) : at + BLOCK], np.uint8)
        above = block > 127
        both = above[1:] & above[:-1]
        high += int(above[min(at, 1) :].sum())
        beside += int((np.append(both, False) | np.append(False, both)).sum())
        pairs = block[:-1].astype(np.uint16) << 8 | block[1:]
        for name in CYRILLIC:
            sums[name] += int(_weights(name)[pairs].sum(dtype=np.int64))
    return high, beside, sums


def _different(content: bytes) -> bytes:
    """Each different word with bytes above ASCII once: a word that is repeated shows no more than it does once."""
    found: set[bytes] = set()
    at = 0
    while at < len(content):
        blank = _BLANK.search(content, at + BLOCK)
        end = blank.end() if blank else len(content)
        found.update(w for w in content[at:end].split() if not w.isascii())
        at = end
    return b" ".join(sorted(found))


def detected(content: bytes) -> str:
    """The encoding's name: UTF-8 (also of ASCII and of nothing), UTF-16 and UTF-32 with or without a mark, windows-1251, KOI8-R, CP866 or windows-1252.

    A mark decides, then zero bytes, then UTF-8's rules over the whole content: it is UTF-8 if it is well-formed or if nine tenths of its
    bytes above ASCII are in well-formed characters (so a damaged place doesn't change the rest).  Otherwise it is windows-1252 where there are ASCII letters and
    bytes above ASCII mostly stand alone, as accented letters do, or its different words don't read well in any Cyrillic encoding (where there are over
    twenty ASCII letters for each byte above in these words, a pair or two that read well may be chance); else it is the one of these that reads best.
    """
    for mark, name in MARKS:
        if content.startswith(mark):
            return name
    if (wide := _wide(content)) is not None:
        return wide
    if _decodes(content, "utf-8"):
        return "utf-8"
    high, beside, sums = _weighed(content)
    if 10 * (len(content) - len(_UTF8.sub(b"", content))) >= 9 * high:
        return "utf-8"
    latin = _ASCII.search(content) is not None
    if latin and 2 * beside < high:
        return LATIN
    best = max(CYRILLIC, key=sums.__getitem__)
    if not latin:
        return best
    high, _, sums = _weighed(_different(content))
    best = max(CYRILLIC, key=sums.__getitem__)
    rare = len(content.translate(None, _LETTERS)) > 20 * high
    return LATIN if sums[best] <= (2 if rare else 0) else best


def decoded(content: bytes) -> str:
    """The text; what can't be decoded is replaced."""
    return content.decode(detected(content), errors="replace")
