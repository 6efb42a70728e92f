"""Removal of passages that repeat anywhere: pruned prefix doubling over all byte positions.

Prefix doubling ranks the strings that start at each position by pairs of ranks at
growing offsets: 1, 2, 4, ... bytes, until a rank is unique or the length is past
the threshold. Here a rank is a 64-bit name mixed from the pair of names of its
halves, so a task names its own positions, and only the search for names that
occur again needs a shuffle. To rank every position would move many times the
input, so positions drop out in three steps:

1. Of each threshold-long window only the leftmost position with the smallest
   name of ``GRAM`` bytes is ranked (equal windows choose the same place). All
   consecutive windows that chose one position are a run.
2. Runs are ranked by the pair (name of the chosen position, name of all bytes of the
   run). If the first is unique, no window of the run repeats. If both occur again,
   all of them do. If the runs of a position's name all agree, they are settled.
3. Only the windows of the runs left over (at the ends of repeats) are ranked at
   full length, one of several equal runs standing for the rest.

Names are sorted in buckets, whose number follows the input; a task holds one
bucket. A block of documents sends a name once, and for one position name at
most two runs, so a passage in a third of all documents costs a few rows per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmark.llm.common import fresh_folder, stored, whole_text

LENGTH = 200
#: Bytes of a block of documents (a longer document is a block by itself).
BLOCK = 1 << 21
#: Windows named at once.
CHUNK = 1 << 17
#: Input bytes for each bucket of names.
BUCKET = 1 << 24
UNIQUE, SETTLED, STANDS, OPEN = range(4)
#: Other columns travel as JSON; by default that cuts times to milliseconds.
MICROSECONDS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _pair(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    x = a * _C1
    x ^= x >> np.uint64(32)
    x += b
    x *= _C2
    x ^= x >> np.uint64(29)
    return x


def _names(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Names of the strings of ``gram`` and of ``length`` bytes at each position, and ``gram``."""
    name, size = _pair(data.astype(np.uint64), _C1), 1
    gram = 1 << max(0, (length // 2).bit_length() - 1)
    short = name
    while size < length:
        step = min(size, length - size)  # the last pair overlaps
        name = _pair(name[:-step], name[step:])
        size += step
        short = name if size == gram else short
    return short, name, gram


def _smallest(name: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` positions the leftmost one with the smallest name."""
    bits = np.uint64(CHUNK.bit_length() + 12)
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (name & ~low) | np.arange(len(name), dtype=np.uint64)
    size = 1
    while size < width:
        step = min(size, width - size)
        key = np.minimum(key[:-step], key[step:])
        size += step
    return (key & low).astype(np.int64)


def _runs(data: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of windows: its offset, their names, and first, last, position's name, bytes' name of its runs."""
    begins = np.append(0, ends[:-1])
    valid = np.zeros(len(data) + 1, np.int32)
    fits = ends - begins >= length
    np.add.at(valid, begins[fits], 1)
    np.add.at(valid, (ends - length + 1)[fits], -1)
    valid = np.cumsum(valid[:-1]) > 0
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        good = valid[at : at + len(part) - length + 1]
        if not good.any():
            continue
        short, full, gram = _names(part, length)
        place = _smallest(short, length - gram + 1)
        change = np.flatnonzero((place[1:] != place[:-1]) | (good[1:] != good[:-1])) + 1
        first, last = np.append(0, change), np.append(change - 1, len(place) - 1)
        first, last = first[good[first]], last[good[first]]
        chosen = place[first]
        shape = ((last - first) << 20 | (chosen - first)).astype(np.uint64)
        whole = _pair(_pair(full[first], full[last]), shape)
        yield at, full, first, last, short[chosen], whole


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order by ``keys`` (first one first), and where a new group begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new


class _Sent:
    """What a block sends in step 2: distinct pairs, at most the two outer ones of a position's name."""

    def __init__(self, near: np.ndarray, whole: np.ndarray, buckets: int):
        order, new = _groups(near, whole)
        self.of_run = np.empty(len(near), np.int64)  # pair of each run
        self.of_run[order] = np.cumsum(new) - 1
        first = order[new]
        self.first_run = first  # the run that stands for the pair in this block
        self.near, self.whole = near[first], whole[first]
        self.count = np.diff(np.append(np.flatnonzero(new), len(order)))
        outer = np.ones(len(first), bool)
        if len(first) > 2:
            outer[1:-1] = (self.near[1:-1] != self.near[:-2]) | (self.near[1:-1] != self.near[2:])
        bucket = (self.near >> np.uint64(20)) % np.uint64(buckets)
        self.sent = np.flatnonzero(outer)
        self.sent = self.sent[np.argsort(bucket[self.sent], kind="stable")]
        self.bucket = bucket[self.sent].astype(np.int64)

    def verdicts(self, answer: np.ndarray) -> np.ndarray:
        """By pair, from the answers to the pairs sent."""
        out = np.where(self.count > 1, STANDS, OPEN).astype(np.uint8)
        out[self.sent] = answer
        return out


def _cut(bucket: np.ndarray) -> list[tuple[int, slice]]:
    found, begin = np.unique(bucket, return_index=True)
    return [(int(b), slice(i, j)) for b, i, j in zip(found, begin, np.append(begin[1:], len(bucket)))]


def _concat(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


class _Block:
    """A block's runs, and how they were settled."""

    def __init__(self, data: bytes, ends: list[int], length: int, buckets: int):
        self.length, self.buckets = length, buckets
        self.data, self.ends = np.frombuffer(data, np.uint8), np.asarray(ends, np.int64)
        self.chunks = []
        for at, _, first, last, near, whole in _runs(self.data, self.ends, length):
            self.chunks.append((at, first + at, last + at, near, whole))
        self.first, self.last = (_concat([c[k] for c in self.chunks], np.int64) for k in (1, 2))
        self.pairs = _Sent(*(_concat([c[k] for c in self.chunks], np.uint64) for k in (3, 4)), buckets)

    def open_windows(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Verdict by run; the starts of windows to be ranked at full length; their names."""
        answer = np.frombuffer(b"".join(answers[b] for b, _ in _cut(self.pairs.bucket)), np.uint8)
        pair = self.pairs.verdicts(answer)
        verdict = pair[self.pairs.of_run]
        speaks = np.zeros(len(verdict), bool)
        speaks[self.pairs.first_run] = pair >= STANDS
        span = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(span, self.first[speaks], 1)
        np.add.at(span, self.last[speaks] + 1, -1)
        starts = np.flatnonzero(np.cumsum(span[:-1]) > 0)
        names = []
        for at in range(0, len(self.data), CHUNK):
            here = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + CHUNK)] - at
            if len(here):
                names.append(_names(self.data[at : at + here[-1] + self.length], self.length)[1][here])
        return verdict, starts, _concat(names, np.uint64)

    def distinct(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names in order of buckets, which occur twice here, index of each name, buckets."""
        values, index, count = np.unique(names, return_inverse=True, return_counts=True)
        bucket = ((values >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return values[order], count[order] > 1, back[index], bucket[order]

    def removed(self, answers: dict[int, bytes], bits: dict[int, bytes]) -> np.ndarray:
        """Bytes covered by a repeated window."""
        verdict, starts, names = self.open_windows(answers)
        values, _, index, bucket = self.distinct(names)
        again = [
            np.unpackbits(np.frombuffer(bits[b], np.uint8), count=s.stop - s.start, bitorder="little")
            for b, s in _cut(bucket)
        ]
        starts = starts[_concat(again, np.uint8)[index].astype(bool)] if len(starts) else starts
        cover = np.zeros(len(self.data) + self.length + 1, np.int32)
        done = (verdict == SETTLED) | (verdict == STANDS)
        np.add.at(cover, self.first[done], 1)
        np.add.at(cover, self.last[done] + self.length, -1)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + self.length, -1)
        return np.cumsum(cover[: len(self.data)]) > 0


# ---------------------------------------------------------------- on Spark


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents packed into blocks: ``block, ends, rest`` (the other columns as JSON) and ``data``."""
    rest = F.to_json(F.struct(*(c for c in docs.columns if c != "text")), MICROSECONDS)
    slim = docs.select(rest.alias("rest"), whole_text(F.col("text")).cast("binary").alias("text"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, count, texts, others, size = TaskContext.get().partitionId() << 33, 0, [], [], 0

        def block() -> pd.DataFrame:
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            return pd.DataFrame({"block": [head + count], "ends": [ends], "rest": [others], "data": [b"".join(texts)]})

        for frame in frames:
            for other, text in zip(frame["rest"], frame["text"]):
                if texts and size + len(text) > BLOCK:
                    yield block()
                    count, texts, others, size = count + 1, [], [], 0
                texts.append(bytes(text))
                others.append(other)
                size += len(text)
        if texts:
            yield block()

    return slim.mapInPandas(pack, "block long, ends array<long>, rest array<string>, data binary")


def _rank_runs(frame: pd.DataFrame) -> pd.DataFrame:
    """Step 2 in one bucket: a verdict for each pair sent."""
    parts = [np.frombuffer(x, np.uint64) for x in frame["names"]]
    sizes = [len(p) // 3 for p in parts]
    near, whole, count = (_concat([p.reshape(3, -1)[k] for p in parts], np.uint64) for k in range(3))
    order, new = _groups(near, whole)
    kind = np.cumsum(new) - 1  # pair of each, in sorting order
    total = np.bincount(kind, weights=count[order].astype(float))
    names = near[order][new]  # a position's name, by pair
    fresh = np.append(True, names[1:] != names[:-1]) if len(names) else np.empty(0, bool)
    klass = np.cumsum(fresh) - 1
    single = (np.bincount(klass) == 1)[klass]
    verdict = np.where(total > 1, SETTLED, np.where(single, UNIQUE, OPEN)).astype(np.uint8)[kind]
    stands = new & (total > 1)[kind] & ~single[kind]
    verdict[stands] = STANDS
    out = np.empty(len(order), np.uint8)
    out[order] = verdict
    answers = [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "answer": answers})


def _rank_windows(frame: pd.DataFrame) -> pd.DataFrame:
    """Step 3 in one bucket: a bit for each name sent, set if it occurs again."""
    parts = [np.frombuffer(x, np.uint64) for x in frame["names"]]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p), bitorder="little") for x, p in zip(frame["twice"], parts)]
    names, sizes = _concat(parts, np.uint64), [len(p) for p in parts]
    order = np.argsort(names)
    ranked = names[order]
    again = np.zeros(len(names), bool)
    if len(names):
        equal = ranked[1:] == ranked[:-1]
        again[order[1:]] |= equal
        again[order[:-1]] |= equal
    again |= _concat(twice, np.uint8).astype(bool)
    answers = [np.packbits(x, bitorder="little").tobytes() for x in np.split(again, np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "answer": answers})


def repeated_bytes_removed(docs: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """``docs`` with ``text`` replaced by ``kept`` (the bytes left), ``n_bytes, n_removed, n_spans``.

    ``as_text``: ``kept`` is a string, without the parts of characters that a cut left over.

    A byte goes if a ``length``-byte string that covers it also starts elsewhere, in the same or
    another row; strings are judged on the input and never cross documents. A null text is empty.
    Rows that repeat a doc_id count as documents of their own; the other columns,
    null or not, are handed through, but those of the four names are replaced; an empty table
    gives no rows.
    """
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    spark = docs.sparkSession
    rest = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET))

    # Bucketed by block, so that only the answers move to the texts later on.
    name = "repeat_blocks_" + fresh_folder(spark, "t").rsplit("-", 1)[1]
    places = max(8, min(1 << 16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    _blocks(docs).write.option("path", fresh_folder(spark, "repeat-blocks")).bucketBy(places, "block").saveAsTable(name)
    blocks = spark.table(name)

    def send_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, ends, data in zip(frame["block"], frame["ends"], frame["data"]):
                pairs = _Block(data, ends, length, buckets).pairs
                fields = pairs.near[pairs.sent], pairs.whole[pairs.sent], pairs.count[pairs.sent].astype(np.uint64)
                cut = _cut(pairs.bucket)
                names = [np.concatenate([x[s] for x in fields]).tobytes() for _, s in cut]
                if cut:
                    yield pd.DataFrame({"block": [block] * len(cut), "bucket": [b for b, _ in cut], "names": names})

    def answers_of(frame: pd.DataFrame) -> dict[int, bytes]:
        return {int(b): bytes(a) for b, a in zip(frame["bucket"], frame["answer"])}

    def send_windows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sent = [pd.DataFrame({"block": [], "bucket": [], "names": [], "twice": []}, dtype=object)]
        for block, ends, data in zip(left["block"], left["ends"], left["data"]):
            work = _Block(data, ends, length, buckets)
            values, twice, _, bucket = work.distinct(work.open_windows(answers_of(right))[2])
            cut = _cut(bucket)
            sent.append(
                pd.DataFrame(
                    {
                        "block": [block] * len(cut),
                        "bucket": [b for b, _ in cut],
                        "names": [values[s].tobytes() for _, s in cut],
                        "twice": [np.packbits(twice[s], bitorder="little").tobytes() for _, s in cut],
                    },
                    dtype=object,
                )
            )
        return pd.concat(sent)

    def cut_out(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        answers, bits = (answers_of(right[right["step"] == step]) for step in (2, 3))
        for ends, others, data in zip(left["ends"], left["rest"], left["data"]):
            gone = _Block(data, ends, length, buckets).removed(answers, bits)
            begin = 0
            for end, other in zip(ends, others):
                lost = gone[begin:end]
                spans = int(np.count_nonzero(lost[1:] & ~lost[:-1]) + lost[:1].sum())
                kept = np.frombuffer(data, np.uint8)[begin:end][~lost].tobytes()
                kept = kept.decode("utf-8", "ignore") if as_text else kept
                rows.append((other, end - begin, int(lost.sum()), spans, kept))
                begin = end
        return pd.DataFrame(rows, columns=["rest", "n_bytes", "n_removed", "n_spans", "kept"], dtype=object)

    answer = "block long, bucket long, answer binary"
    runs = blocks.select("block", "ends", "data").mapInPandas(send_runs, "block long, bucket long, names binary")
    settled = stored(runs.groupBy("bucket").applyInPandas(_rank_runs, answer), "repeat-runs")
    windows = (
        blocks.select("block", "ends", "data")
        .groupBy("block")
        .cogroup(settled.groupBy("block"))
        .applyInPandas(send_windows, "block long, bucket long, names binary, twice binary")
    )
    ranked = stored(windows.groupBy("bucket").applyInPandas(_rank_windows, answer), "repeat-windows")
    both = settled.withColumn("step", F.lit(2)).union(ranked.withColumn("step", F.lit(3)))
    out = (
        blocks.groupBy("block")
        .cogroup(both.groupBy("block"))
        .applyInPandas(cut_out, f"rest string, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
    )
    return out.select(F.from_json("rest", rest, MICROSECONDS).alias("rest"), "kept", "n_bytes", "n_removed", "n_spans").select(
        "rest.*", "kept", "n_bytes", "n_removed", "n_spans"
    )
