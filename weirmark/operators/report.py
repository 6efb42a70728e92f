"""Time series and summaries for dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirmark.functions.timeslot import MINUTE, slot_start, time_range, to_epoch, utc_date
from weirmark.operators.detect import Moment

# measure of the rollup and bits or packets per unit
RATES = {"bps": ("bytes", 8), "pps": ("packets", 1)}


def rate_series(
    rollup: DataFrame,
    series: str,
    rate: str = "bps",
    step: int = MINUTE,
    start: Moment = None,
    end: Moment = None,
    prefix: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Mean rate per series and step of ``step`` seconds.

    ``series`` is ``prefix`` on prefix totals or ``proto`` on class profiles
    (the latter usually for one ``prefix``).
    """
    measure, unit = RATES[rate]
    rollup = time_range(
        rollup,
        None if start is None else to_epoch(start),
        None if end is None else to_epoch(end),
    )
    if prefix is not None:
        rollup = rollup.filter(F.col("prefix") == prefix)
    # whole numbers are summed first, so the result does not depend on order
    out = (
        rollup.groupBy(F.expr(slot_start("time_received", step)).alias("time"), series)
        .agg(F.try_sum(measure).alias("_sum"))
        .select("time", series, F.expr(f"CAST(_sum AS DOUBLE) * {unit} / {step}").alias(rate))
    )
    return out.orderBy(series, "time") if ordered else out


def series_to_columns(
    series_rows: DataFrame, series: str, rate: str, names: list[str]
) -> DataFrame:
    """One column for each of the series ``names``; for all series see :func:`series_points`."""
    return series_rows.groupBy("time").pivot(series, names).agg(F.sum(rate))


def series_points(series_rows: DataFrame, series: str, rate: str = "bps") -> DataFrame:
    """One row per series with its ``points`` (time and rate, in order).

    A row holds a point per step, so the time range and step of
    :func:`rate_series` bound it, however many series there are.
    """
    point = F.struct("time", rate)
    return series_rows.groupBy(series).agg(F.array_sort(F.collect_list(point)).alias("points"))


def value_histogram(rows: DataFrame, keys: list[str], value: str, time: str = "time") -> DataFrame:
    """How often each value occurs per key and UTC day (``n``), and when it was last seen (``at``).

    Histograms of a day can be stored, and those of any days added up by :func:`merge_histograms`.
    A key whose values are all NULL keeps a row with ``n`` 0.
    """
    day = F.expr(utc_date(time)).alias("day")
    return rows.groupBy(*keys, day, value).agg(F.count(value).alias("n"), F.max(time).alias("at"))


def merge_histograms(histograms: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One histogram per key from those of several days."""
    return histograms.groupBy(*keys, value).agg(F.sum("n").alias("n"), F.max("at").alias("at"))


def histogram_summary(histogram: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """Minimum, maximum, exact quantile (``quantile``), mean and last value per key of a merged histogram.

    The quantile lies between the values of two neighbouring ranks, which running
    counts find; no list of values is built, so a span of any length will do.
    """
    line = Window.partitionBy(*keys)
    x = F.col(value)
    ranked = histogram.withColumns(
        {
            "_upto": F.sum("n").over(line.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)),
            "_at": (F.sum("n").over(line) - 1) * F.lit(share),
        }
    )
    holds = "CASE WHEN _upto - n <= {0} AND {0} < _upto THEN " + f"`{value}` END"
    out = ranked.groupBy(*keys).agg(
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.max(F.expr(holds.format("floor(_at)"))).alias("_low"),
        F.max(F.expr(holds.format("ceil(_at)"))).alias("_high"),
        F.max("_at").alias("_at"),
        (F.sum(x * F.col("n")) / F.sum("n")).alias("mean"),
        F.max_by(x, F.when(x.isNotNull(), F.col("at"))).alias("last"),
    )
    between = "CASE WHEN floor(_at) = ceil(_at) THEN _low ELSE (ceil(_at) - _at) * _low + (_at - floor(_at)) * _high END"
    return out.select(*keys, "min", "max", F.expr(between).alias("quantile"), "mean", "last")


def series_summary(
    series_rows: DataFrame, series: str, rate: str = "bps", ordered: bool = True
) -> DataFrame:
    """Minimum, maximum, 95th percentile, mean and last value per series."""
    # one shuffle for the histograms of the days, their sum and the ranks
    days = value_histogram(series_rows.repartition(series), [series], rate)
    merged = merge_histograms(days, [series], rate)
    out = histogram_summary(merged, [series], rate).withColumnRenamed("quantile", "p95")
    return out.orderBy(F.desc("max")) if ordered else out
