"""Language-model scores of whole texts by a class-based log-bilinear model.

Every word belongs to one of ``CLASSES`` classes: the most frequent words have one each, all
others share classes by their last two bytes. The model predicts a token's class from
the two classes before it (Mnih and Hinton 2007): the context vectors, each times a
matrix of its place, add up to a predicted vector, and its product with each class's vector,
plus a bias, is the class's logit. Within a class words follow their add-one
relative frequencies, so the token probabilities add up to one.

The counts cover the whole training text and are made by Spark. The number of class
triples is bounded by ``CLASSES`` alone; from their counts numpy fits the model by
noise-contrastive estimation (Gutmann and Hyvärinen 2010; Mnih and Teh 2012). Each task
scores batches of documents by matrix products over the contexts that occur.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmark.llm.common import id_remainder, stored, whole_text

#: Classes of one word each (the first is the end of a text), and shared ones.
SINGLES, SHARED = 96, 32
CLASSES = SINGLES + SHARED
#: Class before the first word; a context only.
START = CLASSES
#: Words whose counts every task holds; the counts of rarer ones come by a join.
HEAD = 50_000
#: Different words that a task counts before it passes them on.
COUNTED = 300_000
FOLDS, HELD_FOLD = 7, 2
WIDTH, NOISE, STEPS, BATCH, RATE = 32, 10, 1500, 512, 0.02
END = ""


def split_words(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased (bytes know only ASCII letters and white space)."""
    return text.lower().split()


def shared_class(word: bytes) -> int:
    return SINGLES + zlib.crc32(word[-2:]) % SHARED


_SHARED_SQL = f"{SINGLES} + crc32(substr(CAST(word AS BINARY), greatest(octet_length(word) - 1, 1), 2)) % {SHARED}"


class Model(NamedTuple):
    context: np.ndarray  # a vector for each class and START
    near: np.ndarray  # matrix of the class just before
    far: np.ndarray  # of the one before that
    target: np.ndarray
    bias: np.ndarray

    def log10(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of all classes, for each context."""
        logits = (self.context[near] @ self.near + self.context[far] @ self.far) @ self.target.T + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        return (logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))) / np.log(10)


def fit(counts: np.ndarray, seed: int = 1) -> Model:
    """Noise-contrastive fit to ``counts[far, near, class]``.

    Contexts are drawn by their frequency; for a context, the true class is
    weighed by its counts and the ``NOISE`` draws from the class frequencies by their expectation.
    """
    rng = np.random.default_rng(seed)
    flat = counts.reshape(-1, CLASSES)
    total = flat.sum(axis=1)
    noise = (flat.sum(axis=0) + 1.0) / (total.sum() + CLASSES)
    shapes = [(CLASSES + 1, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (CLASSES, WIDTH)]
    values = [rng.normal(0, 0.1, s) for s in shapes] + [np.log(noise)]
    values[1] += np.eye(WIDTH)
    values[2] += np.eye(WIDTH)
    if not total.sum():
        return Model(*values)
    used = np.flatnonzero(total)
    reach = np.cumsum(total[used]) / total.sum()
    shift = np.log(NOISE * noise)
    first, second = ([np.zeros_like(v) for v in values] for _ in range(2))
    for step in range(1, STEPS + 1):
        context, near_m, far_m, target, bias = values
        rows = used[np.minimum(np.searchsorted(reach, rng.random(BATCH)), len(used) - 1)]
        far, near = rows // (CLASSES + 1), rows % (CLASSES + 1)
        vn, vf = context[near], context[far]
        guess = vn @ near_m + vf @ far_m
        real = 1 / (1 + np.exp(shift - guess @ target.T - bias))  # odds that it is no noise
        seen = flat[rows] / total[rows, None]
        slope = (seen * (1 - real) - NOISE * noise * real) / BATCH
        back = slope @ target
        grad_context = np.zeros_like(context)
        np.add.at(grad_context, near, back @ near_m.T)
        np.add.at(grad_context, far, back @ far_m.T)
        grads = [grad_context, vn.T @ back, vf.T @ back, slope.T @ guess, slope.sum(axis=0)]
        rate = RATE * (1 - step / (STEPS + 1))
        for k, grad in enumerate(grads):  # Adam
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            values[k] = values[k] + rate * (first[k] / (1 - 0.9**step)) / (
                np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8
            )
    return Model(*values)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over ``text`` (binary); the end of each text counts as ``END``."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode() for w in found], "c": list(found.values())})

        for frame in frames:
            for text in frame["text"]:
                found.update(split_words(bytes(text)))
                found[b""] += 1
            if len(found) > COUNTED:
                yield rows()
                found.clear()
        if found:
            yield rows()

    counted = texts.select("text").mapInPandas(count, "word string, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


class _Vocabulary:
    """Class and count of the frequent words."""

    def __init__(self, words: list[str], counts: list[int]):
        self.place = {w.encode(): k for k, w in enumerate(words)}
        self.weight = np.log10(np.array(counts, float) + 1)
        self.classes = np.array([k if k < SINGLES else shared_class(w.encode()) for k, w in enumerate(words)])

    def places(self, words: list[bytes]) -> np.ndarray:
        find = self.place.get
        return np.fromiter((find(w, -1) for w in words), np.int64, len(words))

    def classes_of(self, words: list[bytes], places: np.ndarray) -> np.ndarray:
        out = self.classes[places]
        for i in np.flatnonzero(places < 0).tolist():
            out[i] = shared_class(words[i])
        return out


def _tokens(vocabulary: _Vocabulary, texts: list[bytes]) -> tuple:
    """Of a batch: words with ends, their number by text, places, classes, the two classes before."""
    words, sizes = [], []
    for text in texts:
        some = split_words(text)
        words += some
        words.append(b"")
        sizes.append(len(some) + 1)
    places = vocabulary.places(words)
    classes = vocabulary.classes_of(words, places)
    lengths = np.array(sizes, np.int64)
    first = np.cumsum(lengths) - lengths
    near, far = np.roll(classes, 1), np.roll(classes, 2)
    near[first] = far[first] = START
    second = first[lengths > 1] + 1
    far[second] = START
    return words, lengths, places, classes, near, far


def class_counts(texts: DataFrame, head: Broadcast) -> np.ndarray:
    """How often each class follows each two classes; of bounded size."""
    size = (CLASSES + 1) ** 2 * CLASSES

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, cells = _Vocabulary(*head.value), np.zeros(size, np.int64)
        for frame in frames:
            texts = [bytes(t) for t in frame["text"]]
            for at in range(0, len(texts), 512):
                _, _, _, classes, near, far = _tokens(vocabulary, texts[at : at + 512])
                cells += np.bincount((far * (CLASSES + 1) + near) * CLASSES + classes, minlength=size)
        cell = np.flatnonzero(cells)
        yield pd.DataFrame({"cell": cell, "n": cells[cell]})

    found = texts.select("text").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    frame = found.toPandas()  # at most ``size`` rows
    out = np.zeros(size, np.int64)
    out[frame["cell"].to_numpy(np.int64)] = frame["n"].to_numpy(np.int64)
    return out.reshape(CLASSES + 1, CLASSES + 1, CLASSES)


def language_scores(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from documents whose ``crc32(doc_id as text) mod FOLDS`` is not ``HELD_FOLD`` (a null id counts
    as empty text) and scores all. A null or empty text is one token, its end. Without
    training documents the model is untrained, but still normalised. Rows that
    repeat a doc_id are documents of their own; other columns are not read; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), FOLDS) == HELD_FOLD).alias("held_out"),
        whole_text(F.col("text")).cast("binary").alias("text"),
    )
    train = slim.where("NOT held_out")
    counts = stored(word_counts(train), "word-counts")
    n_train, n_words = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    top = counts.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(HEAD - 1).collect()
    ends = counts.where(F.col("word") == END).collect()
    words = [END] + [r["word"] for r in top]
    known = [sum(r["c"] for r in ends)] + [r["c"] for r in top]
    rare = counts.where(~F.col("word").isin(words[:SINGLES])).groupBy(F.expr(_SHARED_SQL).alias("class"))
    room = np.ones(CLASSES)  # what shares a class: its tokens, its words and one for all unseen ones
    for row in rare.agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        room[int(row["class"])] += row["c"] + row["v"]
    head = spark.sparkContext.broadcast((words, known))  # at most HEAD words
    model = tuple(fit(class_counts(train, head)))

    def score(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, net, log_room = _Vocabulary(*head.value), Model(*model), np.log10(room)
        key = TaskContext.get().partitionId() << 33
        for batch in tables:
            kind = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words, lengths, places, classes, near, far = _tokens(vocabulary, part.column("text").to_pylist())
                contexts, index = np.unique(far * (CLASSES + 1) + near, return_inverse=True)
                by_class = net.log10(contexts // (CLASSES + 1), contexts % (CLASSES + 1))[index, classes]
                weight = np.where(places >= 0, vocabulary.weight[places], 0.0)
                inside = np.where(classes >= SINGLES, weight - log_room[classes], 0.0)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                sums = [np.bincount(owner, x, len(lengths)) for x in (weight, by_class + inside, places >= 0)]
                n = len(lengths)
                numbers = sums[0], sums[1], sums[2].astype(np.int64)
                whole = [np.arange(key, key + n), pa.nulls(n, pa.string()), lengths, part.column("doc_id"), part.column("held_out"), *numbers]
                yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in whole], shape.names)
                rare = Counter((key + int(owner[i]), words[i]) for i in np.flatnonzero(places < 0).tolist())
                if rare:
                    keys, some = zip(*rare)
                    known = [pa.array(keys, pa.int64()), pa.array([w.decode() for w in some], pa.string()), pa.array(rare.values(), pa.int64())]
                    empty = [pa.nulls(len(rare), t) for t in (kind, pa.bool_(), pa.float64(), pa.float64(), pa.int64())]
                    yield pa.record_batch([*known, *empty], shape.names)
                key += n

    fields = {"key": "long", "word": "string", "n": "long", "doc_id": None, "held_out": "boolean", "base": "double", "model": "double", "known": "long"}
    shape = T.StructType()
    for name, kind in fields.items():
        shape.add(docs.schema[name] if kind is None else T.StructField(name, T.DataType.fromDDL(kind)))
    scored = stored(slim.mapInArrow(score, shape), "token-scores")
    # Rare words only, so no key is hot; unseen ones weigh log10(0 + 1) = 0.
    found = scored.where("word IS NOT NULL").select("key", "word", "n").join(counts, "word")
    tail = found.groupBy("key").agg(F.sum(F.expr("n * log10(c + 1)")).alias("tail"), F.sum("n").alias("more"))
    whole = scored.where("word IS NULL").join(tail, "key", "left").na.fill(0, ["tail", "more"])
    return whole.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.col("more")).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail") - F.col("n") * F.lit(float(np.log10(n_train + n_words + 1)))).alias("base_score"),
        (F.col("model") + F.col("tail")).alias("score"),
    )
