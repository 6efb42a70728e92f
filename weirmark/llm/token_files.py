"""Token ids in binary files of independent zstandard frames.

A file holds the ids of consecutive documents as little-endian unsigned 32-bit integers:

    frame ... frame | document table | seek table

- A frame is a zstandard frame of whole documents, about ``FRAME_IDS`` ids of them.
- The document table is a skippable frame: doc_id (signed 64 bits, ``NO_ID`` for
  null), number of ids and number of the frame (unsigned 32 bits) of each document.
- The seek table is a skippable frame of the public seekable format: for each frame its
  compressed and its plain size and the low 32 bits of the XXH64 of the plain bytes.

So a reader finds the frames of the documents it wants, reads and decompresses
only these, and checks them. Any zstandard tool decompresses the whole file.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import chain
from struct import pack

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirmark.llm.common import ByteCache, fresh_folder, per_worker, stored, whole_text

#: Appended to each document.
END_ID = 1
FRAME_IDS = 1 << 16
#: Bytes of pieces of text and their ids that a worker remembers, and what one takes besides these.
REMEMBERED, ENTRY = 160 << 20, 170
#: Documents encoded together.
TOGETHER = 512
NO_ID = -(1 << 63)

# Fixed values of the public zstandard formats.
SEEK_MAGIC, SEEK_END, TABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
SEEK_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
#: Marks after a word, which the tokenizer always separates from letters.
MARKS = ".,;:!?*%&$#|"
TABLE_ENTRY = np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("frame", "<u4")])


def _skippable(magic: int, body: bytes) -> bytes:
    return np.array([magic, len(body)], "<u4").tobytes() + body


class TokenFileWriter:
    """Writes one file; ``add`` documents in order, then ``close``."""

    def __init__(self, path: str, frame_ids: int = FRAME_IDS):
        place, name = fs.FileSystem.from_uri(path)
        place.create_dir(os.path.dirname(name), recursive=True)
        self.sink, self.frame_ids = place.open_output_stream(name, compression=None), frame_ids
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.frames: list[tuple] = []
        self.table: list[tuple] = []
        self.open: list[bytes] = []
        self.size = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.table.append((NO_ID if doc_id is None else doc_id, len(ids) // 4, len(self.frames)))
        self.open.append(ids)
        self.size += len(ids)
        self.tokens += len(ids) // 4
        if self.size >= 4 * self.frame_ids:
            self._frame()

    def _frame(self) -> None:
        plain = b"".join(self.open)
        packed = self.pack(plain)
        self.sink.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.open, self.size = [], 0

    def close(self) -> None:
        if self.open:
            self._frame()
        self.sink.write(_skippable(TABLE_MAGIC, np.array(self.table, TABLE_ENTRY).tobytes()))
        end = np.array([len(self.frames)], "<u4").tobytes() + b"\x80" + np.array([SEEK_END], "<u4").tobytes()
        self.sink.write(_skippable(SEEK_MAGIC, np.array(self.frames, SEEK_ENTRY).tobytes() + end))
        self.sink.close()


class TokenFileReader:
    """Reads single documents, or all of them, of one file."""

    def __init__(self, path: str):
        place, name = fs.FileSystem.from_uri(path)
        self.source = place.open_input_file(name)
        size = self.source.size()
        count = int(np.frombuffer(self._bytes(size - 9, 4), "<u4")[0])
        if np.frombuffer(self._bytes(size - 4, 4), "<u4")[0] != SEEK_END:
            raise ValueError(f"{path} has no seek table")
        seek = size - 9 - 12 * count
        self.frames = np.frombuffer(self._bytes(seek, 12 * count), SEEK_ENTRY)
        self.places = np.append(0, np.cumsum(self.frames["packed"], dtype=np.int64))
        begin = int(self.places[-1]) + 8
        self.table = np.frombuffer(self._bytes(begin, seek - 8 - begin), TABLE_ENTRY)
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _bytes(self, at: int, size: int) -> bytes:
        return self.source.read_at(size, at)

    def frame(self, k: int) -> bytes:
        packed, plain, check = (int(x) for x in self.frames[k])
        data = self.unpack(self._bytes(int(self.places[k]), packed), max_output_size=plain)
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, places: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """``(place, ids)`` of the documents at these places of the table, in file order."""
        wanted = np.arange(len(self.table)) if places is None else np.unique(np.fromiter(places, np.int64))
        ends = np.cumsum(self.table["n"], dtype=np.int64) * 4
        before = np.append(0, np.cumsum(self.frames["plain"], dtype=np.int64))
        now, data = -1, b""
        for place in wanted.tolist():
            k = int(self.table["frame"][place])
            if k != now:
                now, data = k, self.frame(k)
            end = int(ends[place] - before[k])
            yield place, data[end - 4 * int(self.table["n"][place]) : end]

    def close(self) -> None:
        self.source.close()


class _Encoder:
    """Ids of whole texts.

    The tokenizer drops white space and never joins characters across it, so a text's ids
    are those of its pieces between blanks and line ends; each piece is encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode, self.model = whole.encode_batch_fast, whole.model.tokenize
        self.known = ByteCache(REMEMBERED)

    def ids(self, texts: list[str]) -> list[bytes]:
        pieces = [text.replace("\n", " ").split(" ") for text in texts]
        found, unknown = self.known.find(set().union(*pieces))
        parts = [self._parts(piece) for piece in unknown]
        words, rest = self.known.find(set(chain.from_iterable(parts)))
        # nothing is left to normalise or to split in lower-case ASCII letters
        plain = [word for word in rest if word.isascii() and word.isalpha()]
        other = [word for word in rest if not (word.isascii() and word.isalpha())]
        ids = [[token.id for token in self.model(word)] for word in plain]
        ids += [one.ids for one in self.encode(other, add_special_tokens=False)]
        new = {word: pack(f"<{len(some)}I", *some) for word, some in zip(chain(plain, other), ids)}
        words |= new
        new |= {piece: words[word] + words[marks] for piece, (word, marks) in zip(unknown, parts)}
        found |= new
        self.known.add(new, ENTRY * len(new) + sum(map(len, new)) + sum(map(len, new.values())))
        return [b"".join(map(found.__getitem__, some)) for some in pieces]

    @staticmethod
    def _parts(piece: str) -> tuple[str, str]:
        """A word and the marks after it; ASCII in lower case."""
        word, marks = piece, ""
        if not piece.isalpha():
            word = piece.rstrip(MARKS)
            if word.isalpha():
                marks = piece[len(word) :]
            else:
                word = piece
        return (word.lower() if word.isascii() and "<|" not in word else word), marks


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` into files under ``folder``, in ascending doc_id order (null first, ties by text).

    Returns a row for each file: ``shard`` (files in order), ``path``, ``n_docs``,
    ``n_tokens`` and ``start`` (ids in the files before). A null text is empty, so a
    document has at least the end id; an empty table gives no file. Other columns
    are not read. A file of a failed task is never listed.
    """
    end = np.array([end_id], "<u4").tobytes()

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, encoder, writer = TaskContext.get(), None, None
        for frame in frames:
            if writer is None and len(frame):
                path = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.ids.zst"
                encoder = per_worker(("tokens", tokenizer), lambda: _Encoder(tokenizer))
                writer = TokenFileWriter(path)
            texts, ids = frame["text"].tolist(), frame["doc_id"].tolist()
            for at in range(0, len(texts), TOGETHER):
                for doc_id, found in zip(ids[at : at + TOGETHER], encoder.ids(texts[at : at + TOGETHER])):
                    writer.add(None if doc_id is None else int(doc_id), found + end)
        if writer is not None:
            writer.close()
            row = [task.partitionId(), path, len(writer.table), writer.tokens]
            yield pd.DataFrame([row], columns=["shard", "path", "n_docs", "n_tokens"])

    slim = docs.select(F.col("doc_id").cast("long"), whole_text(F.col("text")).alias("text"))
    dealt = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))  # as text, which pandas leaves as it is
    files = stored(dealt.mapInPandas(write, "shard long, path string, n_docs long, n_tokens long"), "token-files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """Every document of the listed files: ``doc_id, start, n_tokens, ids`` (little-endian bytes), ``shard``."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, path, start in zip(frame["shard"], frame["path"], frame["start"]):
                reader, rows, size = TokenFileReader(path), [], 0
                for place, ids in reader.documents():
                    doc_id, n = int(reader.table["doc_id"][place]), len(ids) // 4
                    rows.append((None if doc_id == NO_ID else str(doc_id), start, n, ids, shard))
                    start, size = start + n, size + len(ids)
                    if size > 1 << 24:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)
                reader.close()

    def _rows(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids", "shard"])

    shape = "doc_id string, start long, n_tokens long, ids binary, shard long"
    places = max(1, files.count())
    return files.select("shard", "path", "start").repartition(places, "shard").mapInPandas(read, shape).withColumn("doc_id", F.col("doc_id").cast("long"))


def read_documents(files: list[str], wanted: set[int]) -> dict[int, np.ndarray]:
    """Ids of single documents, by doc_id; only their frames are decompressed."""
    out = {}
    for path in files:
        reader = TokenFileReader(path)
        places = np.flatnonzero(np.isin(reader.table["doc_id"], list(wanted)))
        for place, ids in reader.documents(places.tolist()):
            out[int(reader.table["doc_id"][place])] = np.frombuffer(ids, "<u4")
        reader.close()
    return out


def token_digests(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to files, read them back: ``doc_id, start, n_tokens, ids_crc32, shard``."""
    files = write_token_files(docs, tokenizer, folder or fresh_folder(spark, "ids"))
    return read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "shard")
