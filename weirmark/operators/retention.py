"""Retention: how long each table keeps its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmark.functions.timeslot import DAY, HOUR, to_epoch
from weirmark.operators.detect import Moment

# fixed values: seconds each table keeps
KEEP = {
    "raw": 30 * DAY,
    "raw_out_of_range": 30 * DAY,
    "prefixes_total_1m": 30 * DAY,
    "prefixes_src_profile_10m": 7 * DAY,
    "prefixes_proto_profile_1m": 30 * DAY,
    "prefixes_proto_profile_1d": 30 * DAY,
    "threshold_alerts": HOUR,
    "advanced_ddos_alerts": HOUR,
}


def retain(df: DataFrame, ts: str, keep: int, now: Moment = None, by_day: bool = True) -> DataFrame:
    """Rows younger than ``keep`` seconds.

    ``by_day`` compares whole UTC days, as tables partitioned by date do.
    """
    limit = to_epoch(now) - keep
    if by_day:
        # the whole day of a row must start later than the limit
        limit = (limit // DAY + 1) * DAY - 1
    if "date" in df.columns:
        df = df.filter(F.expr(f"date >= date_from_unix_date({limit // DAY})"))
    return df.filter(F.expr(f"{ts} > timestamp_seconds({limit}L)"))
