"""Near-duplicate groups by circulant MinHash and exact verification.

Signature: the shingle hashes are put through a first permutation of the 2**32 universe; a
second permutation, circularly shifted by 0, 1, 2, ..., gives all coordinates as minima.
Coordinates are cut into bands, and documents that agree on a band are candidates.  A pair
counts only if the Jaccard similarity of the full shingle sets, counted exactly, reaches the
threshold.

No bucket is expanded into all its pairs.  Documents with equal sets are one node from the
start.  In a first round each bucket's members are compared with its hub, the member whose
buckets are largest (in a group of copies of one text, that text), or for large buckets with the
best hub of its hub's buckets.  Groups of what was verified
are then found, and only members that are still in different groups give pairs in the second
round.  Buckets of up to ``SMALL`` members give those pairs directly.  The members of larger
ones, a family around a hub, are known by their sets' differences from the hub, with which links
are counted exactly: for sets x and y with differences X and Y from one hub,
|x ^ y| = |X| + |Y| - 2 |X & Y|.  A family's members are dealt into blocks that meet, and of a
meeting only a spanning forest of its links leaves, so what is shuffled is rows times blocks and no pair is
ever a row.  A family that would give more than ``PART`` squared pairs is divided first: a similar pair shares
an element among the first few of each
difference in any fixed order (a prefix filter); what the hub lacks comes first, which in edited
copies is mostly what no other copy has.  Members that share such an element are a smaller
family.  If it is still too large, all its members
are compared with a pivot, the one nearest to the hub, differences are taken from the pivot
(X ^ P, without the edits that all share), and the family is divided again; members linked to a
pivot count as one group from then on.  A division repeats a member for each element of its prefix, so it is
for families whose pairs would cost more.
After ``DIVISIONS`` steps what is left gives its pairs, whatever its size.
So every pair that shares a bucket is verified, or known to be connected, or ruled out by an
exact bound.  Before texts are fetched for pairs of small buckets, pairs
are left out whose set sizes rule the threshold out, and those whose signatures agree on
so few coordinates that a similar pair would do so less than once in a million.

With 32 bands of 4 a pair at 0.8 shares no bucket with probability 5e-8.

Defined results: a shingle is that many consecutive words; a text with fewer words is one
shingle; without words (null, empty) the set is empty and the document is linked with nothing.
Documents are identified by ``doc_id``: rows that repeat an id are one document with several
texts, linked if any of them is, and each row is returned.  Rows with a null id are linked with
nothing and have a null component.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import Scratch, own_columns
from .tokens import chunks, mix64, ngram_hashes

BANDS, ROWS_PER_BAND = 32, 4
#: Members up to which a bucket gives its pairs of different groups directly.
SMALL = 32
#: A family of which no more pairs than this number's square count gives them in blocks that meet; one that exceeds it is divided.
PART = 32768
#: Members of a block, and elements in the differences of one.
BLOCK, _ELEMENTS = 1024, 1 << 20
#: Pairs of holders from which on an element is a column of a product, columns of a product, and pairs of holders counted at once.
_DENSE, _COLUMNS, _MEETINGS = 4096, 1024, 1 << 22
#: Times that a family is divided before it gives its pairs.
DIVISIONS = 8
_SHINGLES_AT_ONCE = 1024


def _permuted(x: np.ndarray, one: int, two: int) -> np.ndarray:
    """A permutation of 32-bit integers (odd factors ``one`` and ``two``), in place."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(one)
    np.right_shift(x, np.uint32(15), out=t)
    x ^= t
    x *= np.uint32(two)
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t
    return x


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Minima of the circularly shifted second permutation over the set under the first."""
    first = _permuted((shingles >> np.uint64(32)).astype(np.uint32), 0x21F0AAAD, 0xD35A2D97)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(first), _SHINGLES_AT_ONCE):
        part = first[None, at : at + _SHINGLES_AT_ONCE] - shifts
        np.minimum(out, _permuted(part, 0x7FEB352D, 0x846CA68B).min(axis=1), out=out)
    return out


def shingle_sets(column: pa.Array, words: int, lower: bool) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the column."""
    for chunk in chunks(column):
        starts, ends, first = chunk.words()
        hashes = chunk.hashes(starts, ends, lower)
        grams = ngram_hashes(hashes, words)
        for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if high - low >= words:
                own = np.sort(grams[low : high - words + 1])
                keep = np.empty(len(own), dtype=bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield own[keep]
            elif high > low:  # the whole sequence, unlike any shingle of full length
                yield ngram_hashes(hashes[low:high], high - low) ^ np.uint64(high - low)
            else:
                yield np.zeros(0, dtype=np.uint64)


def sketches(docs: DataFrame, words: int, lower: bool, bands: int, rows: int) -> DataFrame:
    """For each (doc_id, text): n_shingles, set_hash (of the whole set), low (the coordinates' low bytes), bands (keys)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            sizes, hashes, low, keys, ends = [], [], [], [], [0]
            for own in shingle_sets(batch.column(1), words, lower):
                sizes.append(len(own))
                hashes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                if len(own):
                    values = signature(own, bands * rows)
                    low.append((values & np.uint32(0xFF)).astype(np.uint8).tobytes())
                    keys.append(values.reshape(bands, rows))
                else:
                    low.append(None)
                ends.append(ends[-1] + (bands if len(own) else 0))
            if keys:
                wide = np.stack(keys).astype(np.uint64)
                key = np.broadcast_to(offset, wide.shape[:2]).copy()
                for r in range(rows):
                    key = mix64(key ^ wide[:, :, r])
                flat = key.reshape(-1).view(np.int64)
            else:
                flat = np.zeros(0, dtype=np.int64)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(low, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "set_hash", "low", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sketch, f"doc_id {kind}, n_shingles long, set_hash binary, low binary, bands array<long>")


def _least_agreement(coordinates: int, threshold: float) -> int:
    """Coordinates on which a pair at the threshold agrees, but for once in about a million (five standard deviations)."""
    return int(np.floor(coordinates * threshold - 5 * np.sqrt(coordinates * threshold * (1 - threshold))))


def _share(percent: int) -> float:
    """A pair reaches the threshold if its symmetric difference is at most this share of its sizes' sum."""
    return (100 - percent) / (100 + percent)


def _difference(own: np.ndarray, hub: np.ndarray) -> np.ndarray:
    """Elements of one set only: those that the hub lacks, then those that only the hub has, each by value."""
    return np.concatenate((np.setdiff1d(own, hub, assume_unique=True), np.setdiff1d(hub, own, assume_unique=True)))


def _recentred(own: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """The difference from a pivot, from both differences from a hub: elements that the pivot's lacks first, in their order."""
    return np.concatenate((own[~np.isin(own, pivot)], pivot[~np.isin(pivot, own)]))


def _linked(difference: int, sizes: int, percent: int) -> bool:
    """Whether sets with so large a difference and sum of sizes reach the threshold."""
    return difference < sizes and 100 * (sizes - difference) >= percent * (sizes + difference)


def _prefix_length(size: int, n: int, n_hub: int, linked: bool, percent: int) -> int:
    """How many first elements of a difference of so many a similar pair in different groups may need.

    Of a pair in different groups one is not linked to the hub, so its difference is over
    ``f * (its size + hub's size)``; with that, the needed overlap is at least half of what a
    linked one has in its difference.
    """
    f = _share(percent)
    if linked:
        length = size - int(np.ceil((size + f * (n_hub - n)) / 2 - 1e-9)) + 1
    else:
        length = int(f * n * (1 + 100 / percent) + 1e-9) + 1
    return max(0, min(size, length))


def compared(pairs: DataFrame, texts: DataFrame, percent: int, words: int, lower: bool) -> DataFrame:
    """For pairs (a, b, large): linked (the full sets reach the threshold) and, if large, the size n of a's set, its
    difference from b's, and the length of the prefix."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    whole = pairs.join(left, "a").join(right, "b").select("a", "b", "large", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, sizes, lengths, differences = [], [], [], []
            for large, x, y in zip(batch.column(2).to_pylist(), shingle_sets(batch.column(3), words, lower), shingle_sets(batch.column(4), words, lower), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                difference = _difference(x, y) if large else None
                sizes.append(len(x))
                lengths.append(_prefix_length(len(difference), len(x), len(y), linked[-1], percent) if large else None)
                differences.append(difference.view(np.int64) if large else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64()), pa.array(differences, pa.list_(pa.int64()))], ["a", "b", "large", "linked", "n", "length", "difference"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(check, f"a {kind}, b {kind}, large boolean, linked boolean, n long, length long, difference array<long>")


def _around_pivots(members: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Members (family, doc_id, n, component, difference) but their family's pivot, compared with it: linked, pivot,
    and difference, length and component anew."""
    own = ["family", "doc_id", "n", "component", "difference"]
    pivots = members.groupBy("family").agg(F.min(F.struct(F.size("difference").alias("d"), "doc_id", "n", "component", "difference")).alias("p"))
    pivots = scratch.keep(pivots.select("family", "p.*").drop("d").toDF("family", *(f"pivot_{c}" for c in own[1:])), name)
    wide = members.join(pivots, "family").where(F.col("doc_id") != F.col("pivot_doc_id")).select(*own, *(f"pivot_{c}" for c in own[1:]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, lengths, differences = [], [], []
            n, pivot_n = (batch.column(c).to_pylist() for c in ("n", "pivot_n"))
            for i in range(batch.num_rows):
                difference = _recentred(*(batch.column(c)[i].values.to_numpy() for c in ("difference", "pivot_difference")))
                linked.append(_linked(len(difference), n[i] + pivot_n[i], percent))
                lengths.append(_prefix_length(len(difference), n[i], pivot_n[i], linked[-1], percent))
                differences.append(difference)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("family", "doc_id", "n", "component", "pivot_doc_id", "pivot_component")), pa.array(linked, pa.bool_()), pa.array(lengths, pa.int64()), pa.array(differences, pa.list_(pa.int64()))], ["family", "doc_id", "n", "old", "pivot", "new", "linked", "length", "difference"])

    kind = members.schema["doc_id"].dataType.simpleString()
    found = wide.mapInArrow(compare, f"family string, doc_id {kind}, n long, old {kind}, pivot {kind}, new {kind}, linked boolean, length long, difference array<long>")
    return found.select("family", "doc_id", "n", "linked", "length", "difference", "pivot", F.when(F.col("linked"), F.col("new")).otherwise(F.col("old")).alias("component"))


def _overlaps(a: pa.Array, b: pa.Array | None) -> np.ndarray:
    """How many elements each set of ``a`` shares with each of ``b`` (or of ``a`` itself).

    Elements that many sets hold are columns of a matrix product, of others each pair of holders is counted by itself.
    """
    rows_of = lambda x: np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy()))
    held = a.flatten().to_numpy() if b is None else np.concatenate((a.flatten().to_numpy(), b.flatten().to_numpy()))
    split = len(a.flatten())
    _, code = np.unique(held, return_inverse=True)
    n = int(code.max(initial=-1)) + 1
    sides = []
    for codes, rows in ((code[:split], rows_of(a)), (code, rows_of(a)) if b is None else (code[split:], rows_of(b))):
        order = np.argsort(codes, kind="stable")
        sides.append((codes[order], rows[order], np.bincount(codes, minlength=n)))
    (code_a, row_a, count_a), (code_b, row_b, count_b) = sides
    across = len(a) if b is None else len(b)
    both = count_a * count_b
    wide = both > max(_DENSE, len(a) * across // 64)
    shared = np.zeros((len(a), across), dtype=np.int32)
    columns = np.flatnonzero(wide)
    for at in range(0, len(columns), _COLUMNS):
        place = np.full(n, -1)
        place[columns[at : at + _COLUMNS]] = np.arange(len(columns[at : at + _COLUMNS]))
        grids = []
        for codes, rows, height in ((code_a, row_a, len(a)), (code_b, row_b, across)):
            here = place[codes] >= 0
            grid = np.zeros((height, _COLUMNS), dtype=np.float32)
            grid[rows[here], place[codes[here]]] = 1
            grids.append(grid)
        shared += (grids[0] @ grids[1].T).astype(np.int32)
    some = np.flatnonzero(~wide[code_a] & (count_b[code_a] > 0))
    start_b = np.concatenate(([0], np.cumsum(count_b)))
    ends = np.cumsum(count_b[code_a[some]])
    low = 0
    while low < len(some):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _MEETINGS, "right")))
        part = some[low:high]
        times = count_b[code_a[part]]
        other = np.repeat(start_b[code_a[part]] - np.cumsum(times) + times, times) + np.arange(times.sum())
        shared += np.bincount(np.repeat(row_a[part], times) * across + row_b[other], minlength=shared.size).reshape(shared.shape).astype(np.int32)
        low = high
    return shared


def _forest(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Of the links of a matrix so many that what it ties together stays tied."""
    height, width = linked.shape
    if same:
        linked = linked | linked.T
    new_a, new_b, found = linked.any(axis=1), np.ones(width, dtype=bool), []
    for root in np.flatnonzero(new_a).tolist():
        if not new_a[root]:
            continue
        new_a[root] = False
        if same:
            new_b[root] = False
        ahead = [(root, True)]
        while ahead:
            at, is_row = ahead.pop()
            met = np.flatnonzero(linked[at] & new_b if is_row else linked[:, at] & new_a).tolist()
            (new_b if is_row else new_a)[met] = False
            if same:
                new_a[met] = False
            found += [(at, x) if is_row else (x, at) for x in met]
            ahead += [(x, same or not is_row) for x in met]
    return found


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that tie the similar members of different components of each family together.

    Members (family, doc_id, n, component, linked, difference) are dealt into blocks, those that aren't linked to the hub apart
    from those that are, and blocks of which one is of the former meet.  Of a meeting only a spanning forest of its links leaves, so
    pairs are never laid out as rows.
    """
    blocks = lambda of: F.greatest(F.ceil(F.count_if(of) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(of, F.size("difference"))), F.lit(0)) / _ELEMENTS)).cast("int")
    counts = members.groupBy("family").agg(blocks(~F.col("linked")).alias("alone"), blocks(F.col("linked")).alias("tied"), F.min("component").alias("x"), F.max("component").alias("y"))
    dealt = members.join(counts.where("x <> y and alone > 0").select("family", "alone", "tied"), "family")
    block = F.when(F.col("linked"), F.col("alone") + F.pmod(F.xxhash64("doc_id"), "tied")).otherwise(F.pmod(F.xxhash64("doc_id"), "alone")).cast("int")
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("linked"), F.col("alone")).otherwise(F.col("alone") + F.col("tied")) - 1)))
    dealt = dealt.select("family", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "doc_id", "n", "component", "linked", "difference")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, two = table["block"].to_numpy(), table["two"][0].as_py()
        same = table["one"][0].as_py() == two
        component = table["component"].combine_chunks().dictionary_encode().indices.to_numpy()
        n, tied = table["n"].to_numpy(), table["linked"].to_numpy()
        ids, difference = table["doc_id"].combine_chunks(), table["difference"].combine_chunks()
        a = np.arange(len(block)) if same else np.flatnonzero(block != two)
        b = a if same else np.flatnonzero(block == two)
        if not len(a) or not len(b):
            return pa.table([ids[:0], ids[:0]], ["a", "b"])
        of = [difference.take(pa.array(x)) for x in (a, b)]
        size = [np.diff(x.offsets.to_numpy()) for x in of]
        sizes = n[a][:, None] + n[b][None, :]
        apart = size[0][:, None] + size[1][None, :] - 2 * _overlaps(of[0], None if same else of[1])
        linked = (component[a][:, None] != component[b][None, :]) & ~(tied[a][:, None] & tied[b][None, :]) & (apart < sizes) & (100 * (sizes - apart) >= percent * (sizes + apart))
        found = np.array(_forest(linked, same), dtype=np.int64).reshape(-1, 2)
        return pa.table([ids.take(pa.array(a[found[:, 0]])), ids.take(pa.array(b[found[:, 1]]))], ["a", "b"])

    kind = members.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("family", "one", "two").applyInArrow(compare, f"a {kind}, b {kind}")


def family_links(families: DataFrame, percent: int, scratch: Scratch) -> list[DataFrame]:
    """Tables of links (a, b) that tie all similar members of different components of a family together.

    ``families`` has family, doc_id, n, component, linked (to the hub), length (of the prefix) and difference (from the hub).
    """
    links: list[DataFrame] = []
    own = ["family", "doc_id", "n", "component", "linked", "difference"]
    few = F.col("size") * F.col("alone") <= PART * PART
    for turn in range(DIVISIONS + 1):
        sizes = scratch.keep(families.groupBy("family").agg(F.count("*").alias("size"), F.count_if(~F.col("linked")).alias("alone")), f"sizes-{turn}")
        large = sizes.where(~few).select("family")
        last = turn == DIVISIONS or not large.limit(1).count()
        direct = families if last else families.join(sizes.where(few).select("family"), "family", "left_semi")
        links.append(scratch.keep(_block_links(direct.select(*own), percent), f"family-links-{turn}"))
        if last:
            break
        families = families.join(large, "family", "left_semi")
        parts = families.select("family", "doc_id", "component", "linked", F.explode(F.slice("difference", 1, F.col("length").cast("int"))).alias("element"))
        parts = scratch.keep(parts, f"parts-{turn}")
        groups = parts.groupBy("family", "element").agg(F.count("*").alias("size"), F.count_if(~F.col("linked")).alias("alone"), F.min("component").alias("x"), F.max("component").alias("y"), F.bit_xor(F.xxhash64("doc_id")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("two"))
        groups = groups.where("x <> y").groupBy("family", "size", "alone", "one", "two").agg(F.min("element").alias("element"))  # elements with the same members once
        groups = scratch.keep(groups.select("family", "element", "size", "alone", F.md5(F.concat_ws(" ", "family", "element").cast("binary")).alias("part")), f"groups-{turn}")
        placed = parts.select("family", "doc_id", "element").join(groups, ["family", "element"]).select("family", "doc_id", "size", "alone", "part")
        members = placed.join(families.select(*own), ["family", "doc_id"])
        members = scratch.keep(members.select(F.col("part").alias("family"), "size", "alone", *own[1:]), f"members-{turn}")
        links.append(scratch.keep(_block_links(members.where(few).select(*own), percent), f"part-links-{turn}"))
        families = scratch.keep(_around_pivots(members.where(~few), percent, scratch, f"pivots-{turn}"), f"divided-{turn}")
        links.append(families.where("linked").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")))
        scratch.drop(*(f"{t}-{turn}" for t in ("sizes", "parts", "groups", "members")))
    return links


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 5, percent: int = 80, lower: bool = True, bands: int = BANDS, rows: int = ROWS_PER_BAND) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links), kept (whether that is the document itself)."""
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = own_columns(docs, doc_id=doc_id, text=text)
    every = scratch.keep(sketches(texts, shingle_words, lower, bands, rows), "sketches")
    named = every.where(F.col("doc_id").isNotNull() & F.col("set_hash").isNotNull())

    # Equal sets are one node, named by the smallest id.
    groups = named.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.count("*").alias("size")).where("size > 1").select("set_hash", "node")
    groups = scratch.keep(groups, "groups")
    placed = every.select("doc_id", "n_shingles", "set_hash").join(groups, "set_hash", "left")
    placed = scratch.keep(placed.select("doc_id", "n_shingles", "set_hash", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")), "placed")
    nodes = named.join(placed.where(F.col("doc_id") != F.col("node")).select("doc_id", "set_hash").distinct(), ["doc_id", "set_hash"], "left_anti")
    nodes = nodes.select("doc_id", "n_shingles", "low", "bands")
    # An id with several sets ties their nodes together.
    several = placed.where(F.col("set_hash").isNotNull()).groupBy("doc_id").agg(F.min("set_hash").alias("x"), F.max("set_hash").alias("y")).where("x <> y").select("doc_id")
    edges = scratch.keep(placed.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct(), "edges-0")

    nodes = scratch.keep(nodes, "nodes")
    scratch.drop("sketches")
    members = nodes.select(F.explode("bands").alias("key"), "doc_id", "n_shingles")
    low = nodes.select("doc_id", "low")
    least = _least_agreement(bands * rows, percent / 100)

    def agreeing(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) those whose signatures agree often enough."""
        wide = pairs.join(low.select(F.col("doc_id").alias("a"), F.col("low").alias("low_a")), "a").join(low.select(F.col("doc_id").alias("b"), F.col("low").alias("low_b")), "b")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("low_a", "low_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

        kind = low.schema["doc_id"].dataType.simpleString()
        return wide.select("a", "b", "low_a", "low_b").mapInArrow(compare, f"a {kind}, b {kind}").distinct()

    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent

    # Round 1: each bucket's members with its hub.
    sizes = scratch.keep(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = scratch.keep(members.join(sizes, "key"), "shared")
    popular = shared.groupBy("doc_id").agg((-F.sum("size")).alias("rank"))
    hubs = shared.join(popular, "doc_id").groupBy("key").agg(F.min(F.struct("rank", "doc_id", "n_shingles")).alias("hub"))
    hubs = scratch.keep(hubs.select("key", "hub"), "local-hubs")
    # A large bucket's members are compared with the best hub that its own hub meets, so that a group has few of them.
    best = shared.where(F.col("size") > SMALL).join(hubs, "key").groupBy("doc_id").agg(F.min("hub").alias("best"))
    hubs = hubs.join(best, F.col("hub.doc_id") == F.col("doc_id"), "left").join(sizes, "key").select("key", F.when(F.col("size") > SMALL, F.coalesce("best", "hub")).otherwise(F.col("hub")).alias("hub"))
    hubs = scratch.keep(hubs.select("key", F.col("hub.doc_id").alias("b"), F.col("hub.n_shingles").alias("n_b")), "hubs")
    star = shared.join(hubs, "key").where(F.col("doc_id") != F.col("b")).select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), "b", "n_b", (F.col("size") > SMALL).alias("large"))
    star = scratch.keep(star.groupBy("a", "b", "n_a", "n_b").agg(F.max("large").alias("large")), "star")
    near = agreeing(star.where(~F.col("large") & fits).select("a", "b")).withColumn("large", F.lit(False))
    tried = scratch.keep(near.unionByName(star.where("large").select("a", "b", "large")), "tried-1")
    met = scratch.keep(compared(tried, texts, percent, shingle_words, lower), "met-1")
    edges = edges.unionByName(met.where("linked").select("a", "b"))
    labels = components(edges, scratch, "components-1")

    # Round 2: pairs of different groups, in large buckets' families and in small buckets that still hold several.
    component = F.coalesce("component", "doc_id").alias("component")
    named_labels = labels.withColumnRenamed("node", "doc_id")
    families = met.where("large").select(F.col("b").cast("string").alias("family"), F.col("b").alias("hub"), F.col("a").alias("doc_id"), "n", "length", "difference", "linked")
    families = scratch.keep(families.join(named_labels, "doc_id", "left").select("family", "hub", "doc_id", "n", "length", "difference", "linked", component), "families")
    more = family_links(families.drop("hub"), percent, scratch) if families.limit(1).count() else []
    in_families = families.select("doc_id", "hub").unionByName(families.select(F.col("hub").alias("doc_id"), "hub")).groupBy("doc_id").agg(F.collect_set("hub").alias("hubs"))
    owned = shared.where(F.col("size") <= SMALL).join(named_labels, "doc_id", "left").join(in_families, "doc_id", "left").select("key", "doc_id", "n_shingles", "hubs", component)
    owned = scratch.keep(owned, "owned")
    mixed = scratch.keep(owned.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key"), "mixed")
    one, two = (owned.join(mixed, "key").select("key", F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("component").alias(f"c_{x}"), F.col("hubs").alias(f"hubs_{x}")) for x in "ab")
    known = F.coalesce(F.arrays_overlap("hubs_a", "hubs_b"), F.lit(False))  # their family has settled it
    cross = one.join(two, "key").where((F.col("c_a") < F.col("c_b")) & fits & ~known).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    done = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    cross = scratch.keep(agreeing(cross).join(done, ["a", "b"], "left_anti").withColumn("large", F.lit(False)), "tried-2")
    if cross.limit(1).count():
        more.append(scratch.keep(compared(cross, texts, percent, shingle_words, lower).where("linked").select("a", "b"), "edges-2"))
    for links in more:
        edges = edges.unionByName(links)
    if any(links.limit(1).count() for links in more):
        labels = components(edges, scratch, "components-2")

    result = placed.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    result = scratch.keep(result.withColumn("kept", F.col("doc_id") == F.col("component_id")), "result")
    scratch.keep_only("result")
    return result


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents without near copies of one with a smaller id, with all their columns; those with a null id stay."""
    gone = near_duplicates(docs, doc_id=doc_id, **options).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[f"`{doc_id}`"] == gone["__gone"], "left_anti")
