"""Hard negatives by a vertical scan of the vectors (BOND, de Vries et al. 2002).

Vectors are dealt into blocks by a hash of their id. A block holds its vectors dimension by dimension,
with the least and the largest component of each. For an anchor a block's dimensions are read in
descending order of the anchor's own components. After every few dimensions, what is still
unread can add to a score at least and at most a known sum; so each candidate has bounds,
and those that cannot be among the wanted ones leave the candidate bitmap. The scores of
what is left after the last dimension are exact.

Two scans: the first finds each anchor's positives, the rows of its label with the highest scores. The second finds,
for the window of scores that each positive opens, the highest rows of other labels in it.
Anchors meet every block, in sections of bounded size; a task holds one block and one section.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirmark.llm.common import stored

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of its positive's.
LEAST, MOST = 50, 95
SCALE, TURNED, CLASSES, ANCHORS = 256, 7, 10, 50
#: Rows of a block and anchors of a section at most, on average; both bound what a task holds.
BLOCK_ROWS, SECTION = 1 << 15, 1 << 13
#: Blocks that a small table is dealt into all the same, so that tasks share the work.
BLOCKS = 12
#: Dimensions read between two looks at the bounds.
STRIDE = 8


def quantised(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, label, q``: rows that take part, with whole components ``floor(256 * x)``.

    Rows with a null id, label, vector or component, or a component that is not finite, do not.
    Every seventh id has the next label.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    turned = F.when(F.col("vec_id") % TURNED == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite).select(
        F.col("vec_id").cast("long"),
        turned.cast("int").alias("label"),
        F.transform(x, lambda v: F.floor(SCALE * v.cast("double")).cast("long")).alias("q"),
    )


class Block:
    """Vectors by dimension; shorter ones end in zeros."""

    def __init__(self, rows: pa.Table):
        self.id = rows.column("vec_id").to_numpy()
        self.label = rows.column("label").to_numpy()
        self.row = rows.column("row").to_numpy()
        lists = rows.column("q").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        self.width = int(sizes.max(initial=0))
        self.largest = int(np.abs(flat).max(initial=0))
        self.columns = np.zeros((self.width, len(sizes)), np.int64)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.columns[place, np.repeat(np.arange(len(sizes)), sizes)] = flat
        self.low = self.columns.min(axis=1, initial=0)
        self.high = self.columns.max(axis=1, initial=0)

    def scan(self, anchor: np.ndarray, inside: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the candidates that ``keep(least, most)`` leaves to the end.

        ``inside`` is the bitmap at the start; ``keep`` gets the bounds of the candidates' scores.
        """
        size = min(self.width, len(anchor))
        order = np.argsort(-np.abs(anchor[:size]), kind="stable")
        factor = anchor[order]
        ends = factor * self.low[order], factor * self.high[order]
        # what dimensions from the k-th on can add, at least and at most
        unread_low = np.append(np.cumsum(np.minimum(*ends)[::-1])[::-1], 0)
        unread_high = np.append(np.cumsum(np.maximum(*ends)[::-1])[::-1], 0)
        at = np.flatnonzero(inside)
        whole = len(at) == inside.size
        score = np.zeros(len(at), np.int64)
        for k, d in enumerate(order.tolist()):
            if k % STRIDE == 0 and k:
                left = keep(score + unread_low[k], score + unread_high[k])
                if not left.all():
                    at, score, whole = at[left], score[left], False
            if not len(at):
                break
            score += factor[k] * (self.columns[d] if whole else self.columns[d, at])
        left = keep(score, score)
        return at[left], score[left]


def _best(values: np.ndarray, n: int) -> int | None:
    """The n-th largest value; None if there are fewer."""
    return None if len(values) < n else int(np.partition(values, len(values) - n)[len(values) - n])


def _first(block: Block, at: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """The n first of some places: by score descending, ties by id, then by row."""
    return np.lexsort((block.row[at], block.id[at], -score))[:n]


def _check(block: Block, anchors: pa.Table) -> None:
    most = np.abs(anchors.column("q").combine_chunks().flatten().to_numpy()).max(initial=0)
    if int(most) * block.largest * max(1, block.width) >= 2**63:
        raise OverflowError("a score does not fit 64 bits")


def _anchors(table: pa.Table) -> Iterator[tuple[int, int, int, np.ndarray, int]]:
    lists = table.column("q").combine_chunks()
    cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    for k, (i, label, row) in enumerate(zip(*(table.column(c).to_pylist() for c in ("vec_id", "label", "row")))):
        yield i, label, row, flat[cuts[k] : cuts[k + 1]], k


def _positives(_, rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """Of each anchor the first rows of its label in one block."""
    found: list[tuple] = []
    if rows.num_rows and anchors.num_rows:
        block = Block(rows)
        _check(block, anchors)

        def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
            border = _best(least, POSITIVES)
            return np.ones(len(most), bool) if border is None else most >= border

        for i, label, row, vector, _ in _anchors(anchors):
            at, score = block.scan(vector, (block.label == label) & (block.id != i), keep)
            for k in _first(block, at, score, POSITIVES).tolist():
                found.append((i, row, int(block.id[at[k]]), int(block.row[at[k]]), int(score[k])))
    return _table(found, ("anchor_id", "anchor_row", "positive_id", "positive_row", "positive_score"))


def _negatives(_, rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """Of each anchor and window the first rows of other labels in one block."""
    found: list[tuple] = []
    if rows.num_rows and anchors.num_rows:
        block = Block(rows)
        _check(block, anchors)
        scores = anchors.column("scores").to_pylist()
        for i, label, row, vector, which in _anchors(anchors):
            # whole scores between LEAST and MOST hundredths; a negative positive has no window
            windows = [(-(-LEAST * s // 100), MOST * s // 100, s) for s in sorted({*scores[which]}, reverse=True) if s >= 0]

            def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
                out = np.zeros(len(most), bool)
                for low, high, _ in windows:
                    inside = (least >= low) & (most <= high)
                    border = _best(least[inside], NEGATIVES)
                    can = (most >= low) & (least <= high)
                    out |= can if border is None else can & (most >= border)
                return out

            at, score = block.scan(vector, block.label != label, keep)
            for low, high, positive in windows:
                inside = np.flatnonzero((score >= low) & (score <= high))
                for k in inside[_first(block, at[inside], score[inside], NEGATIVES)].tolist():
                    found.append((i, row, positive, int(block.id[at[k]]), int(block.row[at[k]]), int(score[k])))
    return _table(found, ("anchor_id", "anchor_row", "positive_score", "negative_id", "negative_row", "negative_score"))


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], list(names))


def _ranked(df: DataFrame, keys: list[str], score: str, ties: list[str], n: int) -> DataFrame:
    """The n first rows of each key; a block has handed on n at most, so a key has few."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are rows whose id is divisible by 50; a pair of anchor and positive without a fitting negative has no row.
    Rows that are equal in id, label and components are one row. Rows that share an id but differ
    take part each for itself, in order of label and components where scores tie, and
    none of them is a positive of another. Vectors of different lengths are compared as if the shorter
    one ended in zeros. An empty table gives no rows, other columns are not read. A score beyond 64 bits raises.
    """
    slim = quantised(embeddings, vector)
    total = slim.count()
    blocks = max(1, min(total // 64, BLOCKS), -(-total // BLOCK_ROWS))
    dealt = slim.distinct().withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    # rows of one id are few, and all in one block
    order = Window.partitionBy("block", "vec_id").orderBy("label", "q")
    rows = stored(dealt.withColumn("row", F.row_number().over(order).cast("int")).select("block", "vec_id", "label", "row", "q"), "vectors")
    chosen = rows.where(F.col("vec_id") % ANCHORS == 0)
    # named anew, as both sides of a meeting come from one table
    anchors = chosen.select(*[F.col(c).alias(c) for c in ("vec_id", "label", "row", "q")])
    sections = max(1, -(-anchors.count() // SECTION))
    section = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sections)).cast("int")
    every_block, every_section = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, sections))
    # a block goes to each section, and a section to each block
    vectors = rows.withColumn("section", every_section).groupBy("block", "section")

    def scanned(meeting: DataFrame, scan, shape: str) -> DataFrame:
        side = meeting.withColumn("section", section).withColumn("block", every_block).groupBy("block", "section")
        return vectors.cogroup(side).applyInArrow(scan, shape)

    near = scanned(anchors, _positives, "anchor_id long, anchor_row long, positive_id long, positive_row long, positive_score long")
    key = ["anchor_id", "anchor_row"]
    positives = stored(_ranked(near, key, "positive_score", ["positive_id", "positive_row"], POSITIVES).drop("rank"), "positives")
    opened = positives.groupBy(*key).agg(F.collect_set("positive_score").alias("scores"))  # five at most
    windows = anchors.join(opened, (F.col("vec_id") == F.col("anchor_id")) & (F.col("row") == F.col("anchor_row"))).drop(*key)
    hard = scanned(windows, _negatives, "anchor_id long, anchor_row long, positive_score long, negative_id long, negative_row long, negative_score long")
    window = [*key, "positive_score"]
    fitting = _ranked(hard, window, "negative_score", ["negative_id", "negative_row"], NEGATIVES)
    return positives.join(fitting, window).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"
    )
