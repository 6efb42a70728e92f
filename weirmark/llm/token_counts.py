"""Token counts of whole texts by a two-tier look-up of pre-tokens, without a shuffle of pre-tokens.

A pre-token is what stands between blanks, with the blanks in front of it. No piece of a
SentencePiece vocabulary of this kind holds a blank after another character, so merging never
crosses the place before a blank run, and a text's tokens are those of its pre-tokens. (Whether
that holds is read off the vocabulary; where it does not, whole texts are encoded.)

First tier: the frequent pre-tokens with their token counts, broadcast as one byte string and two
arrays. They are found in a pass over all texts in which each task keeps a bounded lossy counter
(Manku and Motwani 2002) and hands on its heaviest entries only. Second tier: each worker
encodes the other pre-tokens and remembers them in a cache of bounded bytes. The tiers
decide how fast a text is counted and never what the count is.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmark.llm.common import ByteCache, heaviest, per_worker, slices_of, stored, whole_text

LIMIT = 4096
BLANK = "▁"
#: Rows of the broadcast table at most, and bytes of a pre-token in it: 4 MB with its numbers.
FREQUENT, WIDEST = 1 << 16, 64
#: Entries that a task counts at once, and hands on, at most.
COUNTED, HANDED = 1 << 17, 1 << 13
#: Bytes of pre-tokens that a worker remembers.
REMEMBERED = 96 << 20
#: Bytes of text split at once.
PART = 1 << 20
#: What a cache entry takes besides its text.
ENTRY = 150
_RUNS = re.compile(r" *[^ ]+| +")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of ``text``, without the first blank of each; one of blanks alone may end the list.

    The blank that the library puts in front is the first pre-token's. The library reads
    a ``BLANK`` in the text as a blank. An empty text has none.
    """
    if not text:
        return []
    text = text.replace(BLANK, " ")
    if "  " in text or text[0] == " ":
        return [run[1:] for run in _RUNS.findall(" " + text)]
    return text.split(" ")


class TokenCounter:
    """Numbers of tokens as the SentencePiece library gives them."""

    def __init__(self, model_file: str, frequent: tuple[bytes, np.ndarray, np.ndarray] | None = None):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model_file)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any(BLANK in name.lstrip(BLANK) for name in names) and self._number("a b") == self._number(
            "a"
        ) + self._number("b")
        self.opens = np.array([name.startswith(BLANK) for name in names])
        self.cache = ByteCache(REMEMBERED)
        self.first: dict[str, int] = {}
        if frequent is not None:
            words, ends, numbers = frequent
            cuts = [0, *ends.tolist()]
            self.first = {words[a:b].decode(): n for a, b, n in zip(cuts, cuts[1:], numbers.tolist())}
        # a blank at the end of a text, after something else
        self.first[""] = self._number("a ") - self._number("a")

    def _number(self, text: str) -> int:
        return len(self.model.encode(text))

    def numbers(self, words: list[str]) -> list[int]:
        """Tokens of each of these texts."""
        return [len(ids) for ids in self.model.encode(words, num_threads=1)] if words else []

    def pre_token_numbers(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token. Those without blanks are encoded as one text: a token that begins with a blank
        begins a pre-token."""
        plain = [word for word in words if word and " " not in word]
        ids = np.array(self.model.encode(" ".join(plain)), np.int64)
        begins = np.flatnonzero(self.opens[ids]) if plain else ids
        if len(begins) != len(plain):
            return self.numbers(words)
        many = iter(np.diff(np.append(begins, len(ids))).tolist())
        return [next(many) if word and " " not in word else self._number(word) for word in words]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if not self.splits:
            return self.numbers(texts)
        split = [pre_tokens(text) for text in texts]
        seen = set().union(*split)
        held = seen & self.first.keys()
        now, unknown = self.cache.find(seen - held)
        new = dict(zip(unknown, self.pre_token_numbers(unknown)))
        now |= new
        self.cache.add(new, ENTRY * len(new) + sum(map(len, new)))
        now.update((word, self.first[word]) for word in held)
        return [sum(map(now.__getitem__, words)) for words in split]


def frequent_pre_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` and ``n``: pre-tokens of up to ``WIDEST`` bytes that are frequent, and how often they were counted.

    Every text is read. A task keeps up to ``COUNTED`` entries; when there are more, it drops the
    rare ones, so ``n`` may be too small and a pre-token may be missing. Rows: ``FREQUENT`` at most.
    """

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[str] = Counter()
        for batch in tables:
            texts = batch.column(0).to_pylist()
            for a, b in slices_of([len(t) for t in texts], PART):
                for one in texts[a:b]:
                    counted.update([w for w in pre_tokens(one) if len(w) <= WIDEST])
                least = 1
                while len(counted) > COUNTED:
                    counted = Counter({w: n for w, n in counted.items() if n > least})
                    least *= 2
        top = [(w, n) for w, n in counted.most_common(HANDED) if len(w.encode()) <= WIDEST]
        words, numbers = zip(*top) if top else ((), ())
        yield pa.record_batch([pa.array(words, pa.string()), pa.array(numbers, pa.int64())], ["word", "n"])

    slim = docs.select(F.col(text).cast("string").alias("text")).where("text <> ''")
    some = slim.mapInArrow(batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return heaviest(stored(some, "pre-tokens"), "n", FREQUENT)[0]


def packed_numbers(words: DataFrame, model_file: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A small table of pre-tokens as one byte string, where each ends, and its number of tokens."""

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(model_file)
        for batch in tables:
            found = batch.column(0).to_pylist()
            numbers = [counter.first[w] if w in counter.first else n for w, n in zip(found, counter.pre_token_numbers(found))]
            yield pa.record_batch([batch.column(0), pa.array(numbers, pa.int32())], ["word", "tokens"])

    rows = words.select("word").mapInArrow(batches, "word string, tokens int").toArrow()
    texts = [w.encode() for w in rows.column("word").to_pylist()]
    ends = np.cumsum([len(w) for w in texts], dtype=np.int64).astype(np.uint32)
    return b"".join(texts), ends, np.array(rows.column("tokens").to_pylist(), np.uint16)


def token_counts(docs: DataFrame, model_file: str, text: str = "text", output: str = "n_tokens") -> DataFrame:
    """``docs`` with ``output``: how many tokens the model makes of the whole ``text``, without begin or end.

    A null or empty text has none. Rows are counted each for itself, so repeated rows and ties
    need no rule; an empty table gives no rows. All columns are handed through as Arrow and
    keep their values; one that has the name ``output`` is replaced.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(packed_numbers(frequent_pre_tokens(docs, text), model_file))
    docs, name = docs.drop(output), uuid.uuid4().hex
    shape = T.StructType([*docs.schema.fields, T.StructField(output, T.LongType())])
    place = docs.columns.index(text)

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: TokenCounter = per_worker(("token counts", name), lambda: TokenCounter(model_file, frequent.value))
        for batch in tables:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            numbers: list[int] = []
            for a, b in slices_of([len(t) for t in texts], PART):
                numbers += counter.count(texts[a:b])
            yield pa.record_batch([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, output])

    return docs.mapInArrow(batches, shape)


def document_counts(docs: DataFrame, model_file: str, limit: int = LIMIT) -> DataFrame:
    """Per document: bytes, tokens, and whether there are more than ``limit`` tokens."""
    counted = token_counts(docs.select("doc_id", "text"), model_file)
    return counted.select(
        "doc_id",
        F.octet_length(whole_text(F.col("text"))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
