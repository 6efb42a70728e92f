"""SentencePiece encoding with the N best segmentations, and decoding.

The pieces of a text form a lattice; a segmentation is a path, its score the sum of its pieces'
scores in the vocabulary. A forward Viterbi pass gives the best score from the start to
each place. A search from the end back to the start uses these scores as its
heuristic; they are exact, so A* meets complete paths in order of their scores
(Nagata 1994), and the first N it completes are the N best.

No piece of these vocabularies holds a blank after another character, or a line end, so
every path passes the places before blanks and around line ends. The lattice is
searched between two such places, a chunk (a word with the blanks before it) at
a time, and the forward scores of many chunks are computed together. The N best paths of a text combine those of its chunks: of all chunks only the
N - 1 with the smallest loss from best to second best can take part.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmark.llm.common import ByteCache, per_worker, slices_of, whole_text

N_BEST = 3
BLANK = "▁"
#: Stands for a BLANK that the text itself holds; no piece has it, so it is encoded by bytes.
FOREIGN = "\0"
#: Added to the lowest score for a character without a piece, as SentencePiece does.
UNKNOWN_PENALTY = -10.0
#: Bytes of chunks that a worker remembers, and what one takes besides its text and ids.
REMEMBERED, ENTRY = 96 << 20, 400
#: Bytes of text encoded at once.
PART = 1 << 19
#: Chunks: a blank begins one, and so do a line end and what follows it.
_CHUNKS = re.compile(r" *[^ \n]+| +|\n")
#: Longest chunk that is searched together with others, and how many at once.
WIDEST, TOGETHER = 48, 4096
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Pieces are looked up by so many leading bits of their hash.
BITS = 20


class Path(NamedTuple):
    score: float
    ids: tuple[int, ...]


class Pieces:
    """A vocabulary: piece to (id, score), and the ids of single bytes."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        self.piece: dict[str, tuple[int, float]] = {}
        self.byte = {}
        self.text: dict[int, bytes] = {}
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
                self.text[i] = bytes([int(name[3:5], 16)])
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                if BLANK in name.lstrip(BLANK) or "\n" in name:
                    raise ValueError(f"piece {i} holds a line end, or a blank after another character")
                self.piece[name] = i, model.get_score(i)
                self.text[i] = name.replace(BLANK, " ").encode()
        self.unknown = min((score for _, score in self.piece.values()), default=0.0) + UNKNOWN_PENALTY
        # each beginning of a piece; with the piece's ids and score if it is one itself
        self.trie: dict[str, tuple] = {name[:k]: () for name in self.piece for k in range(1, len(name))}
        self.trie |= {name: ((i,), score) for name, (i, score) in self.piece.items()}
        self.longest = max(map(len, self.piece), default=1)
        names = list(self.piece)
        hashes = np.array([self._hash(name) for name in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([self.piece[names[k]][0] for k in order], np.int64)
        self.scores = np.array([self.piece[names[k]][1] for k in order])
        # by leading bits: the first hash that has them (-1: none); so many hashes share them at most
        lead = (self.hashes >> np.uint64(64 - BITS)).astype(np.int64)
        some, begin, count_ = np.unique(lead, return_index=True, return_counts=True)
        self.begin = np.full(1 << BITS, -1, np.int32)
        self.begin[some] = begin
        self.crowd = int(count_.max(initial=0))

    @staticmethod
    def _hash(name: str) -> np.uint64:
        value = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in name:
                value = (value + np.uint64(ord(c) + 1)) * _FACTOR
                value ^= value >> np.uint64(29)
        return value

    def lattice(self, chunk: str) -> list[list[tuple[float, int, float, tuple[int, ...]]]]:
        """For each place the pieces that end there, best first: best score up to there by way of
        the piece, where it starts, its own score and ids."""
        shown = chunk.replace(BLANK, FOREIGN).replace(" ", BLANK)
        size, find = len(shown), self.trie.get
        ends: list[list] = [[] for _ in range(size + 1)]
        ahead = 0.0
        for start in range(size):
            if start:
                ends[start].sort(key=lambda edge: -edge[0])
                ahead = ends[start][0][0]
            for end in range(start + 1, size + 1):
                node = find(shown[start:end])
                if node:
                    ends[end].append((ahead + node[1], start, node[1], node[0]))
                elif end == start + 1:
                    data = tuple(self.byte[b] for b in chunk[start].encode())
                    if shown[start] not in self.piece:
                        ends[end].append((ahead + self.unknown, start, self.unknown, data))
                if node is None:
                    break
        ends[size].sort(key=lambda edge: -edge[0])
        return ends

    def forward(self, chunks: list[str]) -> list[tuple[float, float, bytes]]:
        """Of each chunk the best score, the loss to the second best and the best ids.

        Forward scores of the two best paths to each place, for all chunks at once.
        Among equal ones the longest last piece wins, as in :meth:`lattice`.
        """
        rows, width = len(chunks), max(map(len, chunks))
        shown = [c.replace(BLANK, FOREIGN).replace(" ", BLANK) for c in chunks]
        text = np.frombuffer("".join(x.ljust(width, FOREIGN) for x in shown).encode("utf-32-le"), "<u4")
        text = np.ascontiguousarray(text.reshape(rows, width).T).astype(np.uint64) + np.uint64(1)  # by place
        sizes = np.array([len(c) for c in chunks])
        hits = []  # by length: where each start's pieces begin in the next two, their rows, their places in the table
        value = np.zeros((width, rows), np.uint64)
        for length in range(1, min(self.longest, width) + 1):
            value = (value[: width - length + 1] + text[length - 1 :]) * _FACTOR
            value ^= value >> np.uint64(29)
            cell, at = self._found(value.ravel())
            start = cell // rows
            hits.append((np.searchsorted(start, np.arange(width - length + 2)).tolist(), cell - start * rows, at))
        first, second = (np.full((width + 1, rows), -np.inf) for _ in range(2))
        first[0] = 0
        step, piece = np.ones((width + 1, rows), np.int64), np.full((width + 1, rows), -1)
        for end in range(1, width + 1):
            a, b, by, chosen = first[end], second[end], step[end], piece[end]
            for length in range(min(end, len(hits)), 1, -1):
                cuts, lines, places = hits[length - 1]
                i, j = cuts[end - length], cuts[end - length + 1]
                if i == j:
                    continue
                line, hit = lines[i:j], places[i:j]
                score = self.scores[hit]
                x, y, was = first[end - length, line] + score, second[end - length, line] + score, a[line]
                better = x > was
                b[line] = np.where(better, np.maximum(was, y), np.maximum(b[line], x))
                line = line[better]
                a[line], by[line], chosen[line] = x[better], length, hit[better]
            # a single character, which every place has, as a piece or by its bytes
            cuts, lines, places = hits[0]
            line, hit = lines[cuts[end - 1] : cuts[end]], places[cuts[end - 1] : cuts[end]]
            score, single = np.full(rows, self.unknown), np.full(rows, -1)
            score[line], single[line] = self.scores[hit], hit
            x, y = first[end - 1] + score, second[end - 1] + score
            better = x > a
            b[:] = np.where(better, np.maximum(a, y), np.maximum(b, x))
            a[better], by[better], chosen[better] = x[better], 1, single[better]
        line = np.arange(rows)
        place, found = sizes.copy(), []
        while place.any():
            found.append(np.where(place > 0, piece[place, line], -2))
            place = np.maximum(place - np.where(place > 0, step[place, line], 0), 0)
        table = np.stack(found[::-1], axis=1)
        used = table != -2
        ids = np.where(table >= 0, self.ids[table], 0).astype("<u4")
        best, loss = first[sizes, line], first[sizes, line] - second[sizes, line]
        data, cuts = ids[used].tobytes(), [0, *(4 * np.cumsum(used.sum(axis=1))).tolist()]
        parts = [data[i:j] for i, j in zip(cuts, cuts[1:])]
        for k in np.flatnonzero((table == -1).any(axis=1)).tolist():  # characters without a piece
            parts[k] = np.array(self.best(chunks[k], 1)[0].ids, "<u4").tobytes()
        return list(zip(best.tolist(), loss.tolist(), parts))

    def _found(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are a piece's, in order, and its place in the table."""
        begin = self.begin[value >> np.uint64(64 - BITS)]
        cell = np.flatnonzero(begin >= 0)
        at, wanted = begin[cell].astype(np.int64), value[cell]
        place = np.full(len(cell), -1)
        for _ in range(self.crowd):
            same = self.hashes[at] == wanted
            place[same] = at[same]
            at = np.minimum(at + 1, len(self.hashes) - 1)
        return cell[place >= 0], place[place >= 0]

    def best(self, chunk: str, n: int) -> list[Path]:
        """The n best paths through a chunk's lattice, best first; fewer if there are no more."""
        ranked = self.lattice(chunk)
        # An entry extends a suffix by the edge of a rank at its place; first out is the one
        # with the best whole path. The best edges that follow need no agenda.
        turn, paths = count(), []
        agenda = [(-ranked[-1][0][0], next(turn), len(chunk), 0, 0.0, None)]
        while agenda and len(paths) < n:
            _, _, place, rank, behind, path = heapq.heappop(agenda)
            while place:
                choices = ranked[place]
                if rank + 1 < len(choices):
                    whole = behind + choices[rank + 1][0]
                    heapq.heappush(agenda, (-whole, next(turn), place, rank + 1, behind, path))
                _, start, score, piece = choices[rank]
                place, rank, behind, path = start, 0, behind + score, (piece, path)
            ids: list[int] = []
            while path is not None:
                ids += path[0]
                path = path[1]
            paths.append(Path(behind, tuple(ids)))
        return paths

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank added in front goes. Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.text.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


class Encoder:
    """Remembers of each chunk the best score, the loss to the second best, and the best ids."""

    def __init__(self, pieces: Pieces, n: int = N_BEST):
        self.pieces, self.n = pieces, n
        self.known = ByteCache(REMEMBERED)
        self.now: dict = {}

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text; those of all these texts are at hand until the next call."""
        split = [_CHUNKS.findall(" " + text) if text else [] for text in texts]
        self.now, new = self.known.find(set().union(*split))
        new.sort(key=len)
        wide = next((k for k, chunk in enumerate(new) if len(chunk) > WIDEST), len(new))
        learnt = {}
        for chunk in new[wide:]:
            paths = self.pieces.best(chunk, 2)
            loss = paths[0].score - paths[1].score if len(paths) > 1 else np.inf
            learnt[chunk] = paths[0].score, loss, np.array(paths[0].ids, "<u4").tobytes()
        for at in range(0, wide, TOGETHER):
            some = new[at : min(at + TOGETHER, wide)]
            learnt.update(zip(some, self.pieces.forward(some)))
        self.now |= learnt
        self.known.add(learnt, sum(ENTRY + len(chunk) + len(found[2]) for chunk, found in learnt.items()))
        return split

    def encode(self, chunks: list[str]) -> list[tuple[float, bytes]]:
        """The N best segmentations of a text's chunks: score and ids (little-endian, unsigned 32 bits), best first."""
        if not chunks:
            return [(0.0, b"")]
        scores, losses, ids = zip(*map(self.now.__getitem__, chunks))
        top, loss = float(sum(scores)), np.array(losses)
        order = np.argsort(loss, kind="stable")[: self.n - 1]
        plans: list[tuple[float, tuple[tuple[int, bytes], ...]]] = [(0.0, ())]  # loss, changed chunks
        for k in order[np.isfinite(loss[order])].tolist():
            paths = self.pieces.best(chunks[k], self.n)
            plans = [
                (lost + paths[0].score - path.score, changed + (((k, path.ids),) if r else ()))
                for lost, changed in plans
                for r, path in enumerate(paths)
            ]
            plans = sorted(plans, key=lambda plan: plan[0])[: self.n]
        best, out = b"".join(ids), []
        places = {k: sum(map(len, ids[:k])) for _, changed in plans for k, _ in changed}
        for lost, changed in plans:
            parts, done = [], 0
            for k, other in sorted(changed):
                parts += best[done : places[k]], np.array(other, "<u4").tobytes()
                done = places[k] + len(ids[k])
            out.append((top - lost, b"".join(parts) + best[done:] if parts else best))
        return out


def encoded(docs: DataFrame, model_file: str, n: int = N_BEST) -> DataFrame:
    """``docs`` with ``ids`` (best segmentation, little-endian unsigned 32-bit integers), ``scores`` (of the N
    best, best first), ``others`` (ids of the second best on) and ``decoded`` (text of ``ids``).

    A blank is put in front, as SentencePiece does; nothing else is normalised, so
    ``decoded`` equals the text. Null and empty texts have no ids, one path and score 0.
    Rows are encoded each for itself; all columns are handed through, but those of the four
    names are replaced; an empty table gives no rows.
    """
    docs = docs.drop("ids", "scores", "others", "decoded")
    doubles, parts = pa.list_(pa.float64()), pa.list_(pa.binary())
    shape = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("ids", T.BinaryType()),
            T.StructField("scores", T.ArrayType(T.DoubleType())),
            T.StructField("others", T.ArrayType(T.BinaryType())),
            T.StructField("decoded", T.StringType()),
        ]
    )
    place = docs.columns.index("text")

    def encode(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("pieces", model_file, n), lambda: Encoder(Pieces(model_file), n))
        pieces = encoder.pieces
        for batch in tables:
            sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_pylist()
            for a, b in slices_of(sizes, PART):
                texts = [t or "" for t in batch.column(place).slice(a, b - a).to_pylist()]
                found = [encoder.encode(chunks) for chunks in encoder.learn(texts)]
                best = [paths[0][1] for paths in found]
                added = [
                    pa.array(best, pa.binary()),
                    pa.array([[s for s, _ in paths] for paths in found], doubles),
                    pa.array([[i for _, i in paths[1:]] for paths in found], parts),
                    pa.array([pieces.decode(np.frombuffer(i, "<u4")) for i in best], pa.string()),
                ]
                yield pa.record_batch([*batch.slice(a, b - a).columns, *added], shape.names)

    return docs.mapInArrow(encode, shape)


def decoded(rows: DataFrame, model_file: str) -> DataFrame:
    """``rows`` with ``decoded``: the text of ``ids`` (null: null)."""
    rows = rows.drop("decoded")
    shape = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    place = rows.columns.index("ids")

    def decode(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_file)
        for batch in tables:
            texts = [None if i is None else pieces.decode(np.frombuffer(i, "<u4")) for i in batch.column(place).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], shape.names)

    return rows.mapInArrow(decode, shape)


def segmentation_digests(docs: DataFrame, model_file: str, n: int = N_BEST) -> DataFrame:
    """Per document: sizes, scores, checksums of the ids, and whether decoding gave the text back."""
    slim = docs.select("doc_id", F.col("text"))
    out = encoded(slim, model_file, n)
    return out.select(
        "doc_id",
        F.length(whole_text(F.col("text"))).cast("long").alias("n_chars"),
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.size("scores").cast("long").alias("n_paths"),
        F.col("scores")[0].alias("score"),
        F.expr("scores[size(scores) - 1]").alias("last_score"),
        F.crc32("ids").alias("ids_crc32"),
        F.expr("aggregate(transform(others, x -> crc32(x)), 0L, (a, x) -> (a * 31 + x) % 4294967291)").alias("others_digest"),
        (F.col("decoded") == whole_text(F.col("text"))).alias("round_trip"),
    )
