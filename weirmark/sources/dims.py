"""Dimension tables: protocol names, routers, rules."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmark import schema

PROTOCOLS_CSV = Path(__file__).with_name("protocols.csv")


def read_protocols(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Protocol names from a CSV file with a header.

    Without a path the packaged file is shipped as rows, so that executors
    need no access to the driver's disk.
    """
    if path is None:
        lines = [line for line in PROTOCOLS_CSV.read_text().splitlines() if line[0] != "#"]
        rows = [line.split(",", 2) for line in lines[1:]]
        return spark.createDataFrame(
            [(int(proto), name, text) for proto, name, text in rows], schema.PROTOCOLS
        )
    return spark.read.csv(path, schema=schema.PROTOCOLS, header=True, comment="#")


def read_dimension(spark: SparkSession, path: str, layout: T.StructType) -> DataFrame:
    """Rules or routers as a parquet folder; read anew by every caller, which
    is how a changed rule reaches the next micro-batch or evaluation."""
    return spark.read.schema(layout).parquet(path)


def latest_by_id(df: DataFrame, version: str, key: str = "id") -> DataFrame:
    """Last version of each row.

    An aggregate rather than a ranked window: it combines before the shuffle,
    so one id with very many versions stays cheap.
    """
    values = [c for c in df.columns if c != key]
    order = F.struct(F.col(version), *[F.col(c) for c in values if c != version])
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*values), order).alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in values])
        .select(*df.columns)
    )
