"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter

from quarrylight.llm import decontaminate as dc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def tokens(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def overlap(doc, item, masks=dc.MASKS, window=dc.WINDOW, substitutions=dc.SUBSTITUTIONS):
    """Equal tokens of the best run of a document and an item over a matching mask, or None."""
    d, t = tokens(doc), tokens(item)
    if not t or not d:
        return None
    if len(t) < min(map(len, masks)):
        return len(t) if any(d[i : i + len(t)] == t for i in range(len(d) - len(t) + 1)) else None
    length, best, places = min(len(t), window), None, {}
    for i, x in enumerate(d):
        places.setdefault(x, []).append(i)
    shared = Counter(i - j for j, x in enumerate(t) for i in places.get(x, ()))
    for diagonal in (g for g, n in shared.items() if n >= min(m.count("1") for m in masks)):  # others can't hit
        equal = {j: d[j + diagonal] == t[j] for j in range(max(0, -diagonal), min(len(t), len(d) - diagonal))}
        for j in equal:
            if any(all(bit == "0" or equal.get(j + p, False) for p, bit in enumerate(m)) and j + len(m) - 1 in equal for m in masks):
                for s in range(max(0, j - length + 1), j + 1):
                    if s in equal and s + length - 1 in equal:
                        n = sum(equal[s + x] for x in range(length))
                        if n >= length - length * substitutions // window:
                            best = max(best or 0, n)
    return best


def without_repeats(docs, window=20):
    """doc_id -> (n_words, kept words) for documents in the order of their ids."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[d] = (len(w), [x for x, g in zip(w, gone, strict=True) if not g])
    return out


def boilerplate_free(docs, min_sites):
    """doc_id -> text, for (doc_id, source, text)."""
    sites, first = {}, {}
    for d, s, text in sorted(docs, key=lambda r: r[0]):
        for i, line in enumerate((text or "").split("\n")):
            bare = line.strip(" \t\n\v\f\r")
            if bare:
                sites.setdefault(bare, set()).add(s)
                first.setdefault(bare, (d, i))
    out = {}
    for d, _, text in docs:
        if text is None:
            out[d] = None
            continue
        bare = [line.strip(" \t\n\v\f\r") for line in text.split("\n")]
        out[d] = "\n".join(line for i, line in enumerate(text.split("\n")) if len(sites.get(bare[i], ())) < min_sites or first[bare[i]] == (d, i))
    return out
