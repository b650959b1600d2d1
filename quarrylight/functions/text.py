"""Scalar text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All Unicode white space, and the four separators that count as such in text stripping.
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANK = r"(?U)[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def fold_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, UPPER, LOWER)


def like_folded(text: Column, needle: str) -> Column:
    """Substring test in which A-Z match a-z and ``%`` and ``_`` of the needle are wildcards."""
    pattern = "%" + needle.translate(str.maketrans(UPPER, LOWER)).replace("#", "##") + "%"
    return F.like(fold_ascii(text), F.lit(pattern), F.lit("#"))


def first_line_title(text: Column, fallback: str, cap: int = 80) -> Column:
    """The stripped first line, at most ``cap`` characters and then three dots; the fallback if it is empty."""
    line = strip(F.regexp_extract(F.coalesce(text, F.lit("")), rf"\A{BLANK}*([^\n]*)", 1))
    capped = F.when(F.length(line) > cap, F.concat(F.left(line, F.lit(cap)), F.lit("..."))).otherwise(line)
    return F.when(line == "", F.lit(fallback)).otherwise(capped)


def preview(text: Column, cap: int, marker: str = "…", one_line: bool = False) -> Column:
    """The first ``cap`` characters; the marker follows if they fill the cap, even if nothing was cut."""
    cut = F.left(F.coalesce(text, F.lit("")), F.lit(cap))
    shown = F.replace(cut, F.lit("\n"), F.lit(" ")) if one_line else cut
    return F.when(F.length(cut) == cap, F.concat(shown, F.lit(marker))).otherwise(shown)


def cut(text: Column, cap: int, keep: int | None = None, marker: str = "") -> Column:
    """Texts over ``cap`` characters are cut to ``keep`` (the cap, if not given) and marked."""
    return F.when(F.length(text) > cap, F.concat(F.left(text, F.lit(keep or cap)), F.lit(marker))).otherwise(text)


def relevance(distance: Column) -> Column:
    """100 at distance 0 down to 0 at 2 and beyond, truncated to whole numbers; a missing distance counts as 0."""
    return F.greatest(F.lit(0), F.lit(100) - (F.coalesce(distance, F.lit(0.0)) * 50).cast("int"))


def scoped_query(text: Column, prefix: str = "wing:") -> tuple[Column, Column]:
    """Scope and rest of ``wing:name rest``; a text without the prefix has a null scope."""
    bare = strip(text)
    scoped = bare.startswith(prefix)
    scope = F.when(scoped, F.regexp_extract(bare, rf"(?U)^{prefix}(\S*)", 1))
    rest = F.when(scoped, strip(F.regexp_replace(bare, rf"(?U)^{prefix}\S*", ""))).otherwise(bare)
    return scope, rest


def normal_email(text: Column) -> Column:
    """Stripped and lower-cased; null without an at sign."""
    email = F.lower(strip(text))
    return F.when(email.contains("@"), email)


def signature_holds(total: Column, invoice: Column, password: str, signature: Column) -> Column:
    return F.md5(F.concat_ws(":", total, invoice, F.lit(password)).cast("binary")) == F.lower(signature)


def html_escape(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def or_default(value: Column, *others: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in (value, *others[:-1])), others[-1])


def sentences(text: Column) -> Column:
    """Parts that end with . ! ? or an ellipsis before white space; stripped, without empty ones."""
    parts = F.split(text, rf"(?<=[.!?…]){BLANK}+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def chunks(text: Column, target: int = 2000, overlap: int = 200) -> Column:
    """Pieces of about ``target`` characters, each beginning with the last ``overlap`` of the one before.

    Paragraphs (apart by a blank line) are filled up greedily, those over the target sentence by
    sentence.  A unit goes into the current piece unless that and two more characters pass the
    target; a sentence is never cut.  Without room for an overlap (a piece no longer than it) none is taken.
    """
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    unit = lambda sep: lambda body: F.struct(F.lit(sep).alias("sep"), body.alias("body"))
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > target, F.transform(sentences(p), unit(" "))).otherwise(F.array(unit("\n\n")(p)))))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, u: Column) -> Column:
        now, body, sep = state["open"], u["body"], u["sep"]
        full = (F.length(now) + F.length(body) + 2 > target) & (now != "")
        tail = F.when(F.length(now) > overlap, F.right(now, F.lit(overlap))).otherwise("")
        grown = F.when(now == "", body).otherwise(strip(F.concat(now, sep, body)))
        return F.struct(
            F.when(full, F.array_append(state["done"], strip(now))).otherwise(state["done"]).alias("done"),
            F.when(full, strip(F.concat(tail, sep, body))).otherwise(grown).alias("open"),
        )

    end = lambda s: F.when(strip(s["open"]) != "", F.array_append(s["done"], strip(s["open"]))).otherwise(s["done"])
    whole = strip(text)
    short = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array(whole))
    return F.when(text.isNull(), F.array().cast("array<string>")).when(F.length(text) <= target, short).otherwise(F.aggregate(units, empty, add, end))


def query_parameter(url: Column, name: str) -> Column:
    """The first value of a parameter in a URL's query string, decoded; empty without an equals sign, null where it isn't there.

    A plus sign is a blank, bytes are UTF-8; what isn't decodable stays as it is written.
    """
    given = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")
    decoded = lambda part: F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))
    found = F.filter(given, lambda pair: (pair != "") & (decoded(F.substring_index(pair, "=", 1)) == name))
    return decoded(F.regexp_extract(F.get(found, F.lit(0)), r"^[^=]*=?(?s:(.*))$", 1))
