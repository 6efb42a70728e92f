"""Which tokens of two tokenizers share bytes, text by text and summed over the corpus.

Equal texts have equal alignments, so documents are first brought together by their full
text; each distinct text is encoded and aligned once, and what it adds to a pair's count
is weighted by the number of its copies. Measures go back to documents by the
SHA-256 of the text.

Within a text, both tokenizers cut before a blank that follows a character which is no white space
(the byte-level one splits there before merging; no piece of the other holds a blank after
another character). What lies between two such places, a chunk, is aligned by itself,
and a worker remembers the chunks it met lately.

Counts of pairs follow the corpus. The frequent pairs, a bounded number, are broadcast to the texts' links;
links of rarer ones meet their counts in a shuffled join.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmark.llm.common import ByteCache, heaviest, per_worker, slices_of, stored

BLANK = "▁"
#: Bytes of chunks that a worker remembers, what one takes besides its links and text, and text at once.
REMEMBERED, ENTRY, PART = 160 << 20, 400, 1 << 20
#: Pairs that are broadcast with their counts, at most (about 20 MB).
FREQUENT = 1 << 18
#: A pair of ids as one number: A's id times ``SHIFT`` plus B's.
SHIFT = 1 << 32
#: Before a blank that follows something else than white space, both tokenizers cut.
_CUTS = re.compile(rf"(?<=[^\s{BLANK}]) ")
_UNSAFE = re.compile(rf"[\s{BLANK}] ")

MEASURES = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = T.StructType(
    [T.StructField("key", T.BinaryType()), T.StructField("copies", T.LongType())]
    + [T.StructField(name, T.LongType()) for name in MEASURES]
    + [
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("times", T.ArrayType(T.IntegerType())),
        T.StructField("groups", T.StringType()),
    ]
)


class Aligned(NamedTuple):
    """A chunk or text: tokens of A; the pair of each link in eight bytes; the groups spelled out, each with its end mark.

    Where a side's bytes are not those of the text, there is nothing.
    """

    n_a: int
    pairs: bytes
    groups: str

    @property
    def n_groups(self) -> int:
        return self.groups.count("|")

    @property
    def n_links(self) -> int:
        return len(self.pairs) // 8

    @property
    def n_b(self) -> int:
        """Each end of a token closes a link, and an end of both sides closes only one."""
        return self.n_links + self.n_groups - self.n_a


NOTHING = Aligned(0, b"", "")


def _byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Byte-level tokenizer A (its text with a blank in front) and SentencePiece model B (which adds that blank)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        sign = _byte_of_sign()
        self.bytes_a = {i: bytes(sign[c] for c in token) for token, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_b = {}
        for i in range(self.b.get_piece_size()):
            name = self.b.id_to_piece(i)
            if BLANK in name.lstrip(BLANK):
                raise ValueError(f"piece {i} holds a blank after another character")
            self.bytes_b[i] = bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace(BLANK, " ").encode()
        width_a, width_b = max(self.bytes_a) + 1, max(self.bytes_b) + 1
        self.length_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(width_a)])
        self.length_b = np.array([len(self.bytes_b[i]) for i in range(width_b)])
        self.opens_a = np.array([self.bytes_a.get(i, b"").startswith(b" ") for i in range(width_a)])
        self.opens_b = np.array([self.b.id_to_piece(i).startswith(BLANK) for i in range(width_b)])
        self.tokens_a = np.array([self.bytes_a.get(i, b"") for i in range(width_a)], object)
        self.tokens_b = np.array([self.bytes_b[i] for i in range(width_b)], object)
        # an id as it is written inside a side of a group, and at its end
        self.spelled_a = np.array([[f"{i}," for i in range(width_a)], [f"{i}|" for i in range(width_a)]], object)
        self.spelled_b = np.array([[f"{i}," for i in range(width_b)], [f"{i};" for i in range(width_b)]], object)
        self.blank = self.b.encode("a ")[len(self.b.encode("a")) :]
        self.cache = ByteCache(REMEMBERED)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks of a text that is not empty, without the blank before each."""
        return _CUTS.split(text) if _UNSAFE.search(" " + text) else text.split(" ")

    def _ids_a(self, chunks: list[str]) -> list[list[int]]:
        return [one.ids for one in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]

    def _ids_b(self, chunks: list[str]) -> list[list[int]]:
        return [self.b.encode(c) if c else self.blank for c in chunks]

    def _encoded(self, chunks: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Both sides' ids of all chunks, and how many each chunk has.

        Chunks without a blank inside, and no white space at the end, are encoded as one text, where a blank begins each.
        """
        easy = [bool(c) and " " not in c and BLANK not in c and not c[-1].isspace() for c in chunks]
        plain = [*compress(chunks, easy)]
        other = [c for c, x in zip(chunks, easy) if not x]
        whole_a = np.array(self.a.encode(" " + " ".join(plain), add_special_tokens=False).ids if plain else [], np.int64)
        whole_b = np.array(self.b.encode(" ".join(plain)) if plain else [], np.int64)
        sides = []
        for whole, opens, single in ((whole_a, self.opens_a, self._ids_a), (whole_b, self.opens_b, self._ids_b)):
            begins = np.flatnonzero(opens[whole])
            if len(begins) == len(plain):
                many, flat = np.diff(np.append(begins, len(whole))), whole
            else:
                found = single(plain)
                many, flat = np.array([len(i) for i in found], np.int64), np.array([*chain.from_iterable(found)], np.int64)
            rest = single(other)
            many = np.concatenate([many, np.array([len(i) for i in rest], np.int64)])
            sides.append((np.concatenate([flat, np.array([*chain.from_iterable(rest)], np.int64)]), many))
        chunks[:] = plain + other
        return sides[0], sides[1]

    def _changed(self, chunks: list[str], ids: np.ndarray, many: np.ndarray, table: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which chunks' tokens do not give back a blank and the chunk."""
        data = [b" " + c.encode() for c in chunks]
        tokens = table[ids].tolist()
        cuts = np.append(0, np.cumsum(many))
        sizes = np.append(0, np.cumsum(length[ids]))[cuts]
        right = np.cumsum([0, *map(len, data)])
        if np.array_equal(sizes, right) and b"".join(tokens) == b"".join(data):
            return np.zeros(len(chunks), bool)
        return np.array([b"".join(tokens[i:j]) != d for i, j, d in zip(cuts[:-1].tolist(), cuts[1:].tolist(), data)])

    def learn(self, chunks: list[str]) -> dict[str, Aligned]:
        """The alignment of each chunk, of all at once.

        Between two neighbouring ends of tokens, of either side, lies the shared part of one link.
        """
        chunks = list(chunks)
        (a, many_a), (b, many_b) = self._encoded(chunks)
        bad = self._changed(chunks, a, many_a, self.tokens_a, self.length_a)
        bad |= self._changed(chunks, b, many_b, self.tokens_b, self.length_b)
        out = dict.fromkeys([c for c, x in zip(chunks, bad.tolist()) if x], NOTHING)
        a, b = a[np.repeat(~bad, many_a)], b[np.repeat(~bad, many_b)]
        many_a, many_b = many_a[~bad], many_b[~bad]
        chunks = [c for c, x in zip(chunks, bad.tolist()) if not x]
        if not chunks:
            return out
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.union1d(ends_a, ends_b)
        pairs = a[np.searchsorted(ends_a, ends)] * SHIFT + b[np.searchsorted(ends_b, ends)]
        closing = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(closing, ends_a), np.searchsorted(closing, ends_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = np.concatenate(
            [
                self.spelled_a[np.append(np.diff(group_a) > 0, True).astype(np.int8), a],
                self.spelled_b[np.append(np.diff(group_b) > 0, True).astype(np.int8), b],
            ]
        )[order].tolist()
        cut_a, cut_b = np.cumsum(many_a), np.cumsum(many_b)
        cut_words = [0, *(cut_a + cut_b).tolist()]
        cut_links = [0, *(8 * (1 + np.searchsorted(ends, ends_a[cut_a - 1]))).tolist()]
        data = pairs.astype("<i8").tobytes()
        for c, n, i, j, k, m in zip(chunks, many_a.tolist(), cut_links, cut_links[1:], cut_words, cut_words[1:]):
            out[c] = Aligned(n, data[i:j], "".join(words[k:m]))
        return out

    def texts(self, texts: list[str]) -> Iterator[Aligned]:
        """The alignment of each text; of an empty one, or one whose bytes a tokenizer changes, nothing."""
        split = [self.chunks(text) if text else [] for text in texts]
        now, unknown = self.cache.find(set().union(*split))
        new = self.learn(unknown) if unknown else {}
        now |= new
        self.cache.add(new, sum(ENTRY + 2 * len(chunk) + len(found.pairs) + len(found.groups) for chunk, found in new.items()))
        for chunks in split:
            n_a, pairs, groups = zip(*map(now.__getitem__, chunks)) if chunks else ((0,), (), ())
            yield NOTHING if 0 in n_a else Aligned(sum(n_a), b"".join(pairs), "".join(groups))


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """A row for each distinct text that is not empty, aligned once.

    ``key`` (SHA-256 of the text), ``copies`` (rows that have it), ``n_a, n_b, n_groups, n_links``,
    ``groups_sha256``, ``pairs`` and ``times`` (different pairs of linked ids, A's times 2^32 plus B's, and how many
    links each has in the text), ``groups`` (ids of each group, only if they are to be kept).
    The map side counts copies before the shuffle, so that a text with a third of all rows is no hot group.
    """

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = per_worker(("alignment", path_a, path_b), lambda: Aligner(path_a, path_b))
        for batch in tables:
            texts = batch.column("text").to_pylist()
            for a, b in slices_of([len(t) for t in texts], PART):
                part = batch.slice(a, b - a)
                columns: list[list] = [[] for _ in range(5)]
                pairs, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                spelled = []
                for found in aligner.texts(texts[a:b]):
                    some, n = np.unique(np.frombuffer(found.pairs, "<i8"), return_counts=True)
                    pairs.append(some)
                    times.append(n)
                    groups = found.groups[:-1]
                    digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                    for column, value in zip(columns, (found.n_a, found.n_b, found.n_groups, found.n_links, digest)):
                        column.append(value)
                    spelled.append(groups if keep_groups else None)
                cuts = pa.array(np.cumsum([len(p) for p in pairs]), pa.int32())
                yield pa.record_batch(
                    [
                        part.column("key"),
                        part.column("copies"),
                        *[pa.array(c, pa.int64()) for c in columns[:4]],
                        pa.array(columns[4], pa.string()),
                        pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(pairs))),
                        pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(times).astype(np.int32))),
                        pa.array(spelled, pa.string()),
                    ],
                    ALIGNED.names,
                )

    distinct = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    keyed = distinct.select(text_key(F.col("text")).alias("key"), "copies", "text")
    return stored(keyed.mapInArrow(batches, ALIGNED), "aligned")


def _links(aligned: DataFrame) -> DataFrame:
    """``key, copies, pair, times``: a row for each text and different pair in it."""
    return aligned.select("key", "copies", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, a, b, count, best``: links of the whole corpus by pair of ids; ``best``: no pair with this B id has more."""
    counts = stored(_links(aligned).groupBy("pair").agg(F.sum(F.col("copies") * F.col("times")).alias("count")), "pairs")
    named = counts.select("pair", F.expr(f"pair div {SHIFT}").alias("a"), F.expr(f"pair % {SHIFT}").alias("b"), "count")
    top = named.groupBy("b").agg(F.max("count").alias("top"))  # a row for each entry of B's vocabulary at most
    return named.join(F.broadcast(top), "b").select("pair", "a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def text_measures(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``key, n_best, count_sum`` of each aligned text with links."""
    counts = stored(counts.select("pair", "count", "best"), "pair-counts")
    head, tail = heaviest(counts, "count", frequent)
    links = _links(aligned)
    sums = [
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    ]
    found = links.join(F.broadcast(head), "pair").groupBy("key").agg(*sums)
    if tail is not None:
        rare = links.join(F.broadcast(head.select("pair")), "pair", "left_anti").join(tail, "pair")
        found = found.unionByName(rare.groupBy("key").agg(*sums))
        found = found.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found


def document_alignment(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT) -> DataFrame:
    """Per document: ``n_a, n_b`` tokens, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    Null and empty texts, and texts that a tokenizer's tokens do not give back byte for byte, have zeros and
    an empty ``groups_sha256``, and add to no count. Each row of a repeated document counts. Null ids stay. An
    empty table gives no rows; other columns are not read.
    """
    aligned = aligned_texts(docs, path_a, path_b)
    sums = text_measures(aligned, pair_counts(aligned), frequent)
    measured = aligned.select("key", *MEASURES, "groups_sha256").join(sums, "key", "left")
    numbers = [F.coalesce(name, F.lit(0)).alias(name) for name in (*MEASURES, "n_best", "count_sum")]
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    return keyed.join(measured, "key", "left").select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
