"""Totals of closed windows: minutes, ten minutes and days, each stream fed by the one before.

Every level waits for its watermark and appends a window once, to files that Spark's
own sink log makes exactly-once. State is bounded by the open windows of a level, and the
upper levels read one row per prefix and window instead of flows. Rows later than the watermark
are in no window; :func:`late_partials` finds what they add up to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirmark import schema
from weirmark.functions.timeslot import DAY, MINUTE, TEN_MINUTES
from weirmark.operators.rollup import SUMS

LATENESS = "10 minutes"
LEVELS = {"1m": MINUTE, "10m": TEN_MINUTES, "1d": DAY}


@dataclass(frozen=True)
class Level:
    """Where one level's closed windows and its stream's progress lie."""

    root: str
    name: str

    @property
    def rows(self) -> str:
        return f"{self.root}/closed_{self.name}"

    @property
    def progress(self) -> str:
        return f"{self.root}/progress_{self.name}"


def _closed(rows: DataFrame, seconds: int, *sums: Column) -> DataFrame:
    out = rows.groupBy("prefix", F.window("time_received", f"{seconds} seconds")).agg(*sums)
    return out.select("prefix", F.col("window.start").alias("time_received"), *SUMS)


def closed_minutes(tagged: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Totals per prefix and minute of a stream of tagged flows.

    A partition adds up its own rows first, so a prefix with much traffic reaches the state as
    one row per partition and minute.
    """
    # flows without a prefix move the watermark, too; a plain explode would filter them out before it
    timed = tagged.withWatermark("time_received", lateness)
    rows = timed.select("time_received", F.explode_outer("prefixes").alias("prefix"), "total_bytes", "total_packets")
    rows = rows.filter("prefix IS NOT NULL")
    return _closed(
        rows,
        MINUTE,
        F.try_sum("total_bytes").alias("bytes"),
        F.try_sum("total_packets").alias("packets"),
        F.count("*").alias("flows"),
    )


def coarser(windows: DataFrame, seconds: int) -> DataFrame:
    """Totals per prefix and ``seconds`` from a stream of closed smaller windows.

    The level below appends windows in the order of time, so there is nothing to wait for.
    A sum beyond 64 bits is NULL and counts in no larger window.
    """
    return _closed(windows.withWatermark("time_received", "0 seconds"), seconds, *[F.try_sum(c).alias(c) for c in SUMS])


def start_level(closed: DataFrame, level: Level, **trigger) -> StreamingQuery:
    return (
        closed.writeStream.format("parquet")
        .outputMode("append")
        .option("path", level.rows)
        .option("checkpointLocation", level.progress)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )


def start_cascade(tagged: DataFrame, root: str, lateness: str = LATENESS, **trigger) -> list[StreamingQuery]:
    """Start a stream for each level.

    With ``availableNow`` each level ends before the next one starts; otherwise all run side by side.
    """
    spark, started, below = tagged.sparkSession, [], None
    for name, seconds in LEVELS.items():
        level = Level(root, name)
        if below is None:
            rows = closed_minutes(tagged, lateness)
        else:
            _create(spark, below.rows)
            rows = coarser(spark.readStream.schema(schema.PREFIX_TOTALS).parquet(below.rows), seconds)
        started.append(start_level(rows, level, **trigger))
        if trigger.get("availableNow"):
            started[-1].awaitTermination()
        below = level
    return started


def _create(spark: SparkSession, folder: str) -> None:
    """A stream wants its folder there before the first window has closed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def read_closed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Closed windows of a level, each once."""
    return spark.read.schema(schema.PREFIX_TOTALS).parquet(Level(root, name).rows)


def late_partials(totals: DataFrame, closed: DataFrame, upto: Column) -> DataFrame:
    """What came too late for the minutes that start before ``upto``: totals over all stored flows less the closed ones.

    Added to ``closed`` as partials they give the totals of all flows. ``totals`` are merged
    totals of the same minutes; keys without late flows have no row.
    """
    counted = closed.select("prefix", "time_received", *[F.col(c).alias(f"_{c}") for c in SUMS])
    both = totals.filter(F.col("time_received") < upto).join(counted, ["prefix", "time_received"], "left")
    late = both.filter("flows > coalesce(_flows, 0)")
    return late.select("prefix", "time_received", *[F.expr(f"try_subtract({c}, coalesce(_{c}, 0L))").alias(c) for c in SUMS])
