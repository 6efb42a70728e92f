"""Time slots in UTC, whatever the session time zone is.

Slots are computed on epoch seconds, so ``date`` partitions and minute buckets
never depend on a cluster setting. Expressions are SQL text.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame

MINUTE = 60
TEN_MINUTES = 600
HOUR = 3600
DAY = 86400


def from_nanos(ns: str) -> str:
    """Nanoseconds since the epoch to a (microsecond) timestamp."""
    return f"timestamp_micros({ns} div 1000)"


def epoch_slot(ts: str, step: int) -> str:
    """Number of whole steps of ``step`` seconds since the epoch."""
    return f"CAST(floor(unix_seconds({ts}) / {step}) AS BIGINT)"


def slot_start(ts: str, step: int) -> str:
    """Start of the slot of ``step`` seconds that holds ``ts``."""
    return f"timestamp_seconds(unix_seconds({ts}) - pmod(unix_seconds({ts}), {step}))"


def utc_date(ts: str) -> str:
    return f"date_from_unix_date(CAST(floor(unix_seconds({ts}) / {DAY}) AS INT))"


def at(seconds: int) -> str:
    """Timestamp of epoch seconds."""
    return f"timestamp_seconds({seconds}L)"


def to_epoch(moment: datetime | int | None) -> int:
    """Seconds since the epoch; now by default, a naive datetime is UTC."""
    if moment is None:
        moment = datetime.now(tz=timezone.utc)
    if isinstance(moment, int):
        return moment
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return int(moment.timestamp())


def to_minute(moment: datetime | int | None) -> int:
    """Epoch seconds of the minute that holds ``moment``."""
    seconds = to_epoch(moment)
    return seconds - seconds % MINUTE


def time_range(
    df: DataFrame,
    start: int | None,
    end: int | None,
    ts: str = "time_received",
    date: str = "date",
) -> DataFrame:
    """Rows with ``start <= ts <= end`` (epoch seconds, both ends included).

    A table partitioned by date also gets the date bounds, which prune its
    folders; Catalyst does not derive them from the timestamp.
    """
    for bound, op in ((start, ">="), (end, "<=")):
        if bound is None:
            continue
        df = df.filter(f"{ts} {op} {at(bound)}")
        if date in df.columns:
            df = df.filter(f"{date} {op} date_from_unix_date({bound // DAY})")
    return df
