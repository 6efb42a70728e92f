"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint has 64 bits; bit k is set if it is set in more than
half of the shingles' hashes. Documents whose fingerprints differ in at most
``max_bits`` bits are linked, groups are the connected components.

Search: if two fingerprints differ in at most ``max_bits`` bits, then one of
their two halves differs in at most ``max_bits // 2``. So the distinct
fingerprints are put in two binary tries, one for each order of the halves. A
trie is joined with itself: pairs of nodes are traversed together from the
root, each step adds the bit in which the two branches differ, and a pair is
dropped as soon as it exceeds the budget (``max_bits // 2`` in the leading half,
``max_bits`` in all). A sorted array of fingerprints is the trie: a node is a
range. Spark deals out pairs of nodes at a depth that keeps a node at about
``NODE_ROWS`` fingerprints; each pair is one group. A group returns a spanning
forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmark.llm.common import stored, whole_text
from weirmark.llm.hashing import xxh64_slices

SEED = 42
MAX_BITS = 3
SHINGLE = 3
#: Fingerprints under one trie node that a task holds.
NODE_ROWS = 65_536
#: Bytes of text that are hashed at once.
PART = 1 << 19
#: Node pairs that the traversal expands at once.
CHUNK = 1 << 18
MAX_ROUNDS = 60


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle (repeats included) of the A-Z lower-cased words, and their number by text."""
    # for bytes, lower() and split() know only ASCII letters and ASCII white space
    tidy = [b" ".join(text.lower().split()) for text in texts]
    data = b" ".join(t for t in tidy if t)
    words = np.array([t.count(b" ") + 1 if t else 0 for t in tidy])
    if not data:
        return np.empty(0, np.uint64), words
    ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))
    starts = np.append(0, ends[:-1] + 1)
    width = np.repeat(np.minimum(words, shingle), words)  # a text of fewer words is one shingle
    first = np.repeat(np.cumsum(words) - words, words)
    index = np.arange(len(ends))
    begins = np.flatnonzero(index + width <= first + np.repeat(words, words))
    slices = starts[begins], ends[begins + width[begins] - 1] - starts[begins]
    return xxh64_slices(data, *slices, SEED), np.where(words > 0, np.maximum(1, words - shingle + 1), 0)


def fold(hashes: np.ndarray) -> int:
    """The fingerprint of a text's hashes; zero if there are none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # so many fit a byte
        part = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(part, axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def text_prints(texts: list[bytes], shingle: int) -> np.ndarray:
    """The fingerprint of each text, as a signed long; about ``PART`` bytes are hashed at once."""
    sizes = np.cumsum([len(t) for t in texts]) // PART
    out: list[int] = []
    for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
        hashes, counts = shingle_hashes([texts[i] for i in part], shingle)
        out += [fold(x) for x in np.split(hashes, np.cumsum(counts)[:-1])] if len(part) else []
    return np.array(out, "<u8").view("<i8")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id") -> DataFrame:
    """``key`` and ``fingerprint`` (a signed long) of every row; null text is empty. The key stays in Arrow."""

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            prints = text_prints([t or b"" for t in batch.column(1).to_pylist()], shingle)
            yield pa.record_batch([batch.column(0), pa.array(prints)], [key, "fingerprint"])

    slim = docs.select(key, whole_text(F.col("text")).cast("binary").alias("text"))
    return slim.mapInArrow(batches, T.StructType([docs.schema[key], T.StructField("fingerprint", T.LongType())]))


# ---------------------------------------------------------------- trie join


def _halves(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the 1-branch of each node begins."""
    shift = np.uint64(63 - depth)
    border = ((keys[lo] >> shift) | np.uint64(1)) << shift
    return np.clip(np.searchsorted(keys, border), lo, hi)


def trie_links(
    keys: np.ndarray, a: tuple[int, int], b: tuple[int, int], depth: int, lead: int, total: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs under nodes ``a`` and ``b`` (ranges of sorted ``keys``, both at ``depth``).

    ``lead``: budget within the first 32 bits; ``total``: within all 64.
    """
    used = int(np.bitwise_count((keys[a[0]] ^ keys[b[0]]) >> np.uint64(64 - depth))) if depth else 0
    if used > lead:
        return
    frontier = [(depth, *(np.array([x], np.int64) for x in (*a, *b, used)))]
    while frontier:
        depth, alo, ahi, blo, bhi, used = frontier.pop()
        if len(alo) > CHUNK:
            half = len(alo) // 2
            frontier.append((depth, alo[half:], ahi[half:], blo[half:], bhi[half:], used[half:]))
            frontier.append((depth, alo[:half], ahi[:half], blo[:half], bhi[:half], used[:half]))
            continue
        small = ((ahi - alo) * (bhi - blo) <= 16) | (depth == 64)
        if small.any():  # a few leaves: compare them at once
            x0, nx, y0, ny = alo[small], (ahi - alo)[small], blo[small], (bhi - blo)[small]
            count = nx * ny
            pair = np.repeat(np.arange(len(count)), count)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            x, y = x0[pair] + place // ny[pair], y0[pair] + place % ny[pair]
            near = (x != y) & (np.bitwise_count(keys[x] ^ keys[y]) <= total)
            if near.any():
                yield x[near], y[near]
            large = ~small
            alo, ahi, blo, bhi, used = alo[large], ahi[large], blo[large], bhi[large], used[large]
        if not len(alo):
            continue
        amid, bmid, same = _halves(keys, alo, ahi, depth), _halves(keys, blo, bhi, depth), alo == blo
        children = (
            (alo, amid, blo, bmid, used, None),
            (amid, ahi, bmid, bhi, used, None),
            (alo, amid, bmid, bhi, used + 1, None),
            (amid, ahi, blo, bmid, used + 1, ~same),  # a node with itself: the mirror image
        )
        budget = lead if depth < 32 else total
        parts = []
        for a0, a1, b0, b1, errors, also in children:
            keep = (a1 > a0) & (b1 > b0) & (errors <= budget)
            keep = keep if also is None else keep & also
            parts.append([z[keep] for z in (a0, a1, b0, b1, errors)])
        frontier.append((depth + 1, *(np.concatenate(z) for z in zip(*parts))))


class Forest:
    """Union of index pairs; the root of a tree is its smallest index."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            rx, ry = self.root[x], self.root[y]
            apart = rx != ry
            if not apart.any():
                return
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            np.minimum.at(self.root, np.maximum(rx, ry), np.minimum(rx, ry))
            while (flat := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = flat


def _rotated(key: np.ndarray, by: int) -> np.ndarray:
    return key if not by else (key << np.uint64(by)) | (key >> np.uint64(64 - by))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, rows: int | None = None) -> DataFrame:
    """Links ``a, b`` between fingerprints at most ``max_bits`` apart: a spanning forest of each group.

    ``distinct``: one row per fingerprint. ``rows``: their number, if known.
    """
    lead = max_bits // 2
    rows = distinct.count() if rows is None else rows
    depth = max(0, min(16, ceil(log2(max(1, rows) / NODE_ROWS))))
    flips = [sum(1 << bit for bit in bits) for n in range(lead + 1) for bits in combinations(range(depth), n)]

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        by, keys = int(frame["turn"].iloc[0]), np.unique(frame["key"].to_numpy().astype("<i8").view("<u8"))
        forest = Forest(len(keys))
        if depth and frame["low"].iloc[0] != frame["high"].iloc[0]:
            cut = int(np.searchsorted(keys, np.uint64(int(frame["high"].iloc[0]) << (64 - depth))))
            nodes = (0, cut), (cut, len(keys))
        else:
            nodes = (0, len(keys)), (0, len(keys))
        if all(hi > lo for lo, hi in nodes):
            for x, y in trie_links(keys, *nodes, depth, lead, max_bits):
                forest.add(x, y)
        tied = np.flatnonzero(forest.root != np.arange(len(keys)))
        back = _rotated(keys, (64 - by) % 64).view("<i8")
        return pd.DataFrame({"a": back[tied], "b": back[forest.root[tied]]})

    key = F.col("fingerprint")
    turned = F.shiftleft(key, 32).bitwiseOR(F.shiftrightunsigned(key, 32))
    node = F.shiftrightunsigned(F.col("key"), 64 - depth) if depth else F.lit(0).cast("long")
    turns = [F.struct(F.lit(t).alias("turn"), k.alias("key")) for t, k in ((0, key), (32, turned))]
    dealt = (
        distinct.select(F.inline(F.array(*turns)))
        .withColumn("node", node)
        .withColumn("flip", F.explode(F.array(*(F.lit(f).cast("long") for f in flips))))
        .withColumn("other", F.col("node").bitwiseXOR(F.col("flip")))
        .select("turn", "key", F.least("node", "other").alias("low"), F.greatest("node", "other").alias("high"))
    )
    return dealt.groupBy("turn", "low", "high").applyInPandas(join, "a long, b long")


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of the component, for every node with a link.

    Alternating stars (Kiveris et al. 2014): each round points every node at the
    smallest neighbour seen from it. Minima are combined before they are
    shuffled; each round is a written table.
    """

    def star(links: DataFrame, larger: bool) -> DataFrame:
        both = links.union(links.select(F.col("b"), F.col("a"))) if larger else links
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        if larger:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            out = out.union(least.select("a", F.col("m").alias("b")))
        return out.where("a > b").distinct()

    def mark(links: DataFrame) -> tuple:
        row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    links = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    before = mark(links)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        links = stored(star(star(links, larger=True), larger=False), "links")
        now = mark(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b"), F.col("b")).distinct()
    )


def grouped(prints: DataFrame, key: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """``key, fingerprint, component_id`` for rows ``key, fingerprint``.

    Equal rows are one trie leaf, so a large group of copies costs one row. ``component_id`` is
    the smallest key of the component (null only if all its keys are null).
    """
    distinct = stored(prints.groupBy("fingerprint").agg(F.min(key).alias("least")), "fingerprints")
    tied = components(links(distinct, max_bits))
    named = distinct.join(tied.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(smallest, "root").select("fingerprint", "component_id")
    return prints.select(key, "fingerprint").join(found, "fingerprint")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    Null and empty texts have fingerprint zero and are linked like any other;
    rows that share a doc_id each get a row; an empty table gives none. Other
    columns of ``docs`` are not read.
    """
    prints = stored(fingerprints(docs, shingle), "prints")
    return grouped(prints, max_bits=max_bits).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` of each group of near copies: that of the smallest doc_id (null last).

    Groups are those of :func:`simhash_groups`. Rows of equal or null doc_id are told apart by a number given when the
    table is stored; texts without a word have fingerprint zero and are linked like any other.
    """
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = grouped(stored(fingerprints(rows, shingle, "_row"), "prints"), "_row", max_bits)
    ranked = rows.select("doc_id", "_row").join(found.select("_row", "component_id"), "_row")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    first = ranked.groupBy("component_id").agg(F.min(order).alias("first")).select("first._row")
    return rows.join(first, "_row", "left_semi").drop("_row")
