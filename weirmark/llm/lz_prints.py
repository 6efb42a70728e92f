"""Fingerprints of documents by their Lempel-Ziv phrases.

A text is parsed from left to right into the shortest phrases not seen before in it, as
Lempel-Ziv 78 compressors do. Texts that would compress well together share many
phrases, so the likeness of two texts is the Jaccard index of their phrase sets (Raff
and Nicholas 2017). A fingerprint keeps the ``KEPT`` smallest hashes of the set, from
which the index is estimated; a shorter text keeps all, and is compared exactly.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirmark.llm.common import stored, whole_text
from weirmark.llm.hashing import xxh64_slices

KEPT = 64
SEED = 7


def _parse(text: str, at: int, stop: int, phrase: str, seen: set[str], ends: list[int]) -> str:
    """Parse ``text`` from ``at`` to ``stop``, going on with a ``phrase`` begun before; the one left open there.

    New phrases go into ``seen`` and their ends into ``ends``.
    """
    add, note = seen.add, ends.append
    for char in text[at:stop]:
        phrase += char
        at += 1
        if phrase not in seen:
            add(phrase)
            note(at)
            phrase = ""
    return phrase


def phrase_ends(text: str, ends: list[int] | None = None) -> list[int]:
    """Where the phrases of ``text`` end; ``ends``: those of its beginning, if known.

    What is left at the end of the text is a phrase seen before, and adds nothing.
    """
    ends = [] if ends is None else ends
    seen = {text[a:b] for a, b in zip([0, *ends], ends)}
    _parse(text, ends[-1] if ends else 0, len(text), "", seen, ends)
    return ends


def phrase_hashes(text: str, ends: list[int], first: int = 0) -> np.ndarray:
    """32-bit hashes of the phrases of ``text`` from the number ``first`` on."""
    if first >= len(ends):
        return np.empty(0, "<u4")
    begin = ends[first - 1] if first else 0
    data, places = text[begin:].encode(), np.array([begin, *ends[first:]]) - begin
    if len(data) != len(text) - begin:  # from code points to bytes
        heads = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        places = np.append(np.flatnonzero(heads), len(data))[places]
    return (xxh64_slices(data, places[:-1], np.diff(places), SEED) >> np.uint64(32)).astype("<u4")


def smallest(hashes: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The ``kept`` smallest of the distinct hashes, ascending."""
    few = hashes if len(hashes) <= 4 * kept else np.partition(hashes, 2 * kept)[: 2 * kept]
    found = np.unique(few)[:kept]
    # equal hashes among the few can leave too little
    return found if len(found) == kept or len(few) == len(hashes) else np.unique(hashes)[:kept]


def signature(text: str, ends: list[int], kept: int = KEPT) -> np.ndarray:
    """The smallest 32-bit hashes of the phrases, ascending."""
    return smallest(phrase_hashes(text, ends), kept)


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated Jaccard index, 0 to 1; two empty sets are alike."""
    union = np.union1d(a, b)[:kept]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union)) if len(union) else 1.0


def _text(values: np.ndarray) -> str:
    return base64.b64encode(values.tobytes()).decode()


class _Parsed:
    """A text's phrases, and where its parse stands at the cut that the edited text shares with it."""

    def __init__(self, doc_id, text: str, kept: int):
        self.doc_id, self.text, self.kept = doc_id, text, kept
        self.cut = len(text) - len(text) // 2
        seen, self.ends = set(), []
        self.open = _parse(text, 0, self.cut, "", seen, self.ends)
        self.seen, self.same = seen.copy(), len(self.ends)
        _parse(text, self.cut, len(text), self.open, seen, self.ends)
        self.hashes = phrase_hashes(text, self.ends)
        self.signature = smallest(self.hashes, kept)

    def row(self, following: _Parsed) -> tuple:
        """The result for this document, given the next one; asked for once, as the parse goes on from the cut."""
        edited = self.text[: self.cut] + following.text[: len(self.text) // 2]
        ends = self.ends[: self.same]
        _parse(edited, self.cut, len(edited), self.open, self.seen, ends)
        # phrases up to the cut are the text's own
        other = smallest(np.append(self.hashes[: self.same], phrase_hashes(edited, ends, self.same)), self.kept)
        return (
            self.doc_id,
            len(self.text),
            hashlib.sha256(edited.encode()).hexdigest(),
            _text(self.signature),
            _text(other),
            likeness(self.signature, other, self.kept),
            likeness(self.signature, following.signature, self.kept),
        )


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edited_likeness(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """Each document's fingerprint, its edited text's, and its likeness to that and to the next document.

    The order is descending doc_id (null last, ties by text); after the last comes the
    first, so a lone document follows itself. Null texts are empty; two empty
    texts are alike (1). Other columns are not read; an empty table gives no rows.

    Documents are dealt out by ranges of doc_id, so that a task sees most of
    them beside their successors. The last of a range waits for the head of the next one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def result(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_COLUMNS)

    def along(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, before = TaskContext.get().partitionId(), None

        def border(what: str, text: _Parsed) -> pd.DataFrame:
            return result([(text.doc_id,) + (None,) * 6]).assign(place=place, border=what, text=text.text)

        for frame in frames:
            rows, head = [], None
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                now = _Parsed(None if pd.isna(doc_id) else doc_id, text, kept)
                if before is not None:
                    rows.append(before.row(now))
                else:
                    head = border("head", now)
                before = now
            if head is not None:
                yield head
            if rows:
                yield result(rows).assign(place=place, border=None, text=None)
        if before is not None:
            yield border("tail", before)

    def across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = zip(frame["doc_id"], frame["text"], frame["next_text"])
            rows = [_Parsed(None if pd.isna(i) else i, t, kept).row(_Parsed(None, n, kept)) for i, t, n in pairs]
            if rows:
                yield result(rows)

    shape = (
        "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )
    slim = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    dealt = slim.repartitionByRange(order).sortWithinPartitions(order, "text")
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))  # as text, which pandas leaves as it is
    done = stored(dealt.mapInPandas(along, f"{shape}, place long, border string, text string"), "phrases")
    heads = done.where("border = 'head'").select("place", F.col("text").alias("next_text"))
    ordered = Window.orderBy("place")  # a row for each range that has documents
    ring = heads.select("place").select(
        "place", F.coalesce(F.lead("place").over(ordered), F.min("place").over(Window.partitionBy())).alias("next_place")
    )
    tails = done.where("border = 'tail'").select("doc_id", "text", "place").join(ring, "place")
    last = tails.join(heads.withColumnRenamed("place", "next_place"), "next_place").select("doc_id", "text", "next_text")
    found = done.where("border IS NULL").select(*_COLUMNS).union(last.mapInPandas(across, shape))
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))
