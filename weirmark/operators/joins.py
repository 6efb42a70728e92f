"""Equi-joins of a large side with a dimension of unknown size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Narrow dimension rows (a few hundred bytes): well under 100 MB per executor.
BROADCAST_ROWS = 200_000
SALTS = 32


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; reads at most one more."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    facts: DataFrame,
    dimension: DataFrame,
    on: list[str],
    how: str = "inner",
    small: bool | None = None,
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    tasks: int = 1,
) -> DataFrame:
    """Join ``facts`` with ``dimension`` without moving a hot key to one task.

    A dimension of checked size is broadcast. Otherwise both sides are
    shuffled on the key plus a salt: each fact row gets one salt from its own
    contents (stable when a lost task is run again), each dimension row is
    repeated for every salt. ``small`` skips the size check if it is known. ``tasks`` above 1
    deals the joined rows to that many tasks, for a dimension with many rows of a key.
    """
    if small is None:
        small = at_most(dimension, max_rows)
    if small:
        if tasks > 1:
            facts = facts.repartition(tasks, *facts.columns)
        return facts.join(F.broadcast(dimension), on, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)))
    copies = dimension.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    if tasks > 1:
        salted, copies = (side.repartition(tasks, *on, "_salt") for side in (salted, copies))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
