"""Vertical scan against every inner product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirmark.llm import hard_negatives as hard

SHAPE = "vec_id long, embedding array<float>, label int, q string, rank string, section string"


def brute(rows):
    """Rows that take part, judged one by one in plain Python."""
    base = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not np.isfinite(np.float32(x)) for x in vector):
            continue
        q = tuple(int(np.floor(256 * float(np.float32(x)))) for x in vector)
        base.setdefault((i, (label + 1) % 10 if i % 7 == 0 else label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, q in base:
        if i % 50:
            continue
        others = [(-dot(q, r), j, k, r) for j, k, r in base if j != i and k == label]
        wrong = sorted((-dot(q, r), j, k, r) for j, k, r in base if k != label)
        for s, j, *_ in sorted(others)[:5]:
            fits = [(-t, k) for t, k, *_ in wrong if 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, n + 1, k, -s, t) for n, (t, k) in enumerate(fits[:3])]
    return sorted(out)


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SHAPE).repartition(5)
    return sorted(tuple(r) for r in hard.hard_negatives(df).collect())


def vectors(n, width, seed, low=-1.0):
    rng = np.random.default_rng(seed)
    kinds = rng.normal(size=(4, width))
    return [(i, [float(x) for x in np.clip(kinds[i % 4] + rng.normal(size=width), low, 3)], int(rng.integers(0, 5))) for i in range(n)]


@pytest.mark.parametrize("width, low", [(20, -1.0), (3, 0.0), (1, -2.0)])
def test_matches_brute_force(spark, width, low):
    rows = vectors(700, width, width, low)
    found = run(spark, rows)
    assert found == brute(rows) and found


def test_many_blocks_and_sections(spark, monkeypatch):
    monkeypatch.setattr(hard, "BLOCK_ROWS", 30)
    monkeypatch.setattr(hard, "SECTION", 3)
    rows = vectors(500, 12, 1)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    """Nulls, components that are not finite, ties, repeated and shared ids, zero scores, lengths, negative scores."""
    same = [0.5, 0.25, -0.125]
    rows = [(i, same, i % 3) for i in range(120)]  # all scores tie
    rows += rows[:60]  # repeated rows count once
    rows += [(100, [0.0, 0.0, 0.0], 1), (150, [], 2), (200, [-1.0, -1.0, -1.0], 1), (250, [0.5], 2), (None, same, 1)]
    rows += [(300, None, 1), (301, [1.0, None, 1.0], 1), (302, [float("nan"), 1.0, 1.0], 1), (303, [float("inf"), 1.0, 1.0], 1), (350, same, None)]
    rows += [(50, [0.25, 0.25, 0.25], 2), (9007199254740993, [0.4, 0.2, -0.1], 0)]
    found = run(spark, rows)
    assert found == brute(rows) and any(r[3] == 9007199254740993 for r in found)
    assert run(spark, []) == []


def test_a_third_of_all_rows_alike(spark):
    rows = [(i, [0.5, -0.25] if i % 3 == 0 else [((i * 37) % 101) / 100, ((i * 53) % 97) / 97], i % 2 if i % 3 else 1) for i in range(900)]
    assert run(spark, rows) == brute(rows)


def test_scan_leaves_out_what_cannot_win():
    """The bounds shrink the candidates before the last dimension, and the result stays exact."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    q = rng.integers(-5, 6, (400, 40))
    q[:20, :4] += 200
    table = pa.table({"vec_id": np.arange(400), "label": np.ones(400, np.int32), "row": np.ones(400, np.int32), "q": pa.array(q.tolist(), pa.list_(pa.int64()))})
    block, anchor, sizes = hard.Block(table), np.append(np.full(4, 200), np.ones(36, np.int64)), []

    def keep(least, most):
        sizes.append(len(most))
        return most >= hard._best(least, 5)

    at, score = block.scan(anchor, np.ones(400, bool), keep)
    exact = q @ anchor
    assert sizes[-1] < 40 and set(np.argsort(-exact, kind="stable")[:5]) <= set(at.tolist())
    assert (score == exact[at]).all()


def test_too_large_scores_raise(spark):
    df = spark.createDataFrame([(i, [1e15, 1.0], 1) for i in range(0, 200, 50)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        hard.hard_negatives(df).select(F.sum("rank")).collect()
