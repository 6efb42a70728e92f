"""Alert evaluation with state: each prefix keeps its last four hours of minutes, so no rollup is read twice.

The stream is one of rollup partials (what ingest appends), a few rows per prefix and
batch, so a prefix with much traffic is no heavy key. Minutes close when the watermark has passed
them; a timer per prefix then judges every minute closed since the last time, also
quiet ones in which an alert can still hold. What a closed minute sees (the window
of the static rules, the moments of the z-score) is handed to the same SQL judges as elsewhere.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate
from math import sqrt
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from weirmark.functions.timeslot import MINUTE, epoch_slot
from weirmark.operators import alerts, detect
from weirmark.streaming.pipeline import Dimensions, stream_id
from weirmark.sources.tables import Store

# executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNITS = ("bps", "pps")
SCALES = (8 / 60, 1 / 60)
STATS = ("short_avg", "peak", "long_avg", "long_stddev")
#: A window as it leaves the worker: the minutes of the static window as three arrays of whole numbers.
COLUMNS = {"prefix": "string", "_t": "long"} | {c: "array<long>" for c in ("_m", "_b", "_p")} | {"samples": "long"}
COLUMNS |= {f"{s}_{u}": "double" for u in UNITS for s in STATS}
#: Late partials are waited for this long.
LATENESS = "10 minutes"
LARGEST = 2**63 - 1
#: Stands for a sum beyond 64 bits, which counts in no total.
UNKNOWN = -1
# by value, as executors need no copy of the library
MINUTE_S, SHORT, LONG, MIN_SAMPLES = MINUTE, detect.SHORT_MINUTES, detect.LONG_MINUTES, detect.MIN_SAMPLES


def _moments(n: int, total: int, squares: int, scale: float) -> tuple[float | None, float | None]:
    """Mean and standard deviation of ``n`` whole numbers, times ``scale``, from their sums; exact up to the last step."""
    if not n:
        return None, None
    return total * scale / n, sqrt(n * squares - total * total) / n * scale


def window_rows(prefix: str, times: Iterable[int], minutes: dict[int, tuple], reach: int) -> Iterator[tuple]:
    """What the evaluations of the minutes ``times`` see, in the order of ``COLUMNS``; none where no alert can hold.

    Sums run over the minutes once, so a window is a difference of two of them, however long it is.
    """
    slots = sorted(minutes)
    seen = [np.array(slots, np.int64)]
    lines = []
    for k in range(len(UNITS)):
        seen.append(np.array([UNKNOWN if minutes[m][k] is None else minutes[m][k] for m in slots], np.int64))
        known = [m for m in slots if minutes[m][k] is not None]
        values = [minutes[m][k] for m in known]
        lines.append((known, values, [0, *accumulate(values)], [0, *accumulate(v * v for v in values)]))
    for t in times:
        upto = bisect_right(slots, t)
        if not upto or slots[upto - 1] < t - SHORT:
            continue
        since = bisect_left(slots, t - reach) if slots[upto - 1] >= t - 1 else upto
        row: list[Any] = [prefix, t, *[x[since:upto] for x in seen], 0]
        for k, (known, values, sums, squares) in enumerate(lines):
            a, b, c = bisect_left(known, t - LONG), bisect_left(known, t - SHORT), bisect_right(known, t)
            if not k:
                row[-1] = b - a
            short, _ = _moments(c - b, sums[c] - sums[b], squares[c] - squares[b], SCALES[k])
            row += [short, max(values[b:c]) * SCALES[k] if b < c else None]
            row += _moments(b - a, sums[b] - sums[a], squares[b] - squares[a], SCALES[k])
        yield tuple(row)


def window_row(prefix: str, t: int, minutes: dict[int, tuple], reach: int) -> dict[str, Any] | None:
    """What the evaluation of minute ``t`` sees, by name; None if no alert can hold then."""
    for row in window_rows(prefix, [t], minutes, reach):
        named = dict(zip(COLUMNS, row))
        known = [[None if v == UNKNOWN else int(v) for v in named.pop(c)] for c in ("_m", "_b", "_p")]
        seen = [{"_t": m, "bps": None if b is None else b * 8 / 60, "pps": None if p is None else p / 60} for m, b, p in zip(*known)]
        return named | {"_seen": seen}
    return None


def _due(minutes: dict[int, tuple], judged: int | None) -> int | None:
    """The next minute to judge; None if no minute can raise an alert any more."""
    ahead = [m for m in minutes if judged is None or m + SHORT > judged]
    if not ahead:
        return None
    return min(ahead) if judged is None else max(judged + 1, min(ahead))


class MinuteWindows(StatefulProcessor):
    """Keeps the minutes of one prefix and the last minute that was judged."""

    def __init__(self, reach: int):
        self.reach = reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "m array<bigint>, b array<bigint>, p array<bigint>, judged bigint")

    def _load(self) -> tuple[dict[int, tuple], int | None]:
        kept = self.ring.get()
        if kept is None:
            return {}, None
        m, b, p, judged = kept
        return dict(zip(m, zip(b, p))), judged

    def _save(self, minutes: dict[int, tuple], judged: int | None) -> None:
        m = sorted(minutes)
        self.ring.update((m, [minutes[x][0] for x in m], [minutes[x][1] for x in m], judged))

    def _wake(self, before: int | None, due: int | None) -> None:
        """One timer, at the end of the minute ``due``; ``before``: the one it was set to and has not yet fired for."""
        if before == due:
            return
        if before is not None:
            self.handle.deleteTimer((before + 1) * MINUTE_S * 1000)
        if due is not None:
            self.handle.registerTimer((due + 1) * MINUTE_S * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        minutes, judged = self._load()
        before = _due(minutes, judged)
        for frame in rows:
            for m, *values in zip(*(frame[c].tolist() for c in ("slot", "bytes", "packets"))):
                old = minutes.get(m, (None, None))
                new = tuple(a if v == UNKNOWN else (a or 0) + v for a, v in zip(old, values))
                minutes[m] = tuple(None if v is not None and v > LARGEST else v for v in new)
        self._save(minutes, judged)
        self._wake(before, _due(minutes, judged))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        minutes, judged = self._load()
        closed = timerValues.getCurrentWatermarkInMs() // (MINUTE_S * 1000) - 1
        first = min(minutes) if judged is None else judged + 1
        # a jump of the watermark passes quiet hours at once
        times = sorted(t for t in {m + k for m in minutes for k in range(SHORT + 1)} if first <= t <= closed)
        rows = window_rows(key[0], times, minutes, self.reach)
        # no static rule fires without a minute in its window, no z-score with few samples
        out = [row for row in rows if len(row[2]) or row[5] >= MIN_SAMPLES]
        # a minute that is still open sees no further back than this
        oldest = closed + 1 - max(self.reach, LONG)
        minutes = {m: v for m, v in minutes.items() if m >= oldest}
        self._save(minutes, closed)
        self._wake(None, _due(minutes, closed))  # the timer that fired is gone
        return iter([pd.DataFrame(out, columns=list(COLUMNS))] if out else [])


def minute_windows(partials: DataFrame, lateness: str = LATENESS, max_duration: int = detect.MAX_DURATION) -> DataFrame:
    """What each closed minute of each prefix sees, from a stream of rollup partials.

    Partials of minutes that the watermark has passed are dropped.
    """
    rows = partials.withWatermark("time_received", lateness).select(
        "time_received", "prefix", F.expr(epoch_slot("time_received", MINUTE)).alias("slot"),
        *[F.coalesce(c, F.lit(UNKNOWN)).alias(c) for c in ("bytes", "packets")],  # sums are whole and never null in the worker
    )
    windows = rows.groupBy("prefix").transformWithStateInPandas(
        statefulProcessor=MinuteWindows(max_duration), outputStructType=", ".join(f"{c} {kind}" for c, kind in COLUMNS.items()),
        outputMode="append", timeMode="eventTime",
    )
    seen = (
        "transform(arrays_zip(_m, _b, _p), x -> struct(x._m AS _t,"
        f" CAST(nullif(x._b, {UNKNOWN}L) AS DOUBLE) * 8 / 60 AS bps, nullif(x._p, {UNKNOWN}L) / 60 AS pps))"
    )
    return windows.withColumn("_seen", F.expr(seen)).drop("_m", "_b", "_p")


def judged_log(windows: DataFrame, rules: DataFrame, max_duration: int = detect.MAX_DURATION) -> DataFrame:
    """Rows for the alert log from windows of closed minutes."""
    return alerts.log_of(lambda named: detect.judge_windows(windows, named, max_duration), rules)


def start_stateful_evaluation(
    partials: DataFrame, store: Store, dims: Dimensions, checkpoint: str,
    lateness: str = LATENESS, max_duration: int = detect.MAX_DURATION, **trigger,
) -> StreamingQuery:
    """Judge minutes as they close and append to the alert log; a repeated batch replaces its rows.

    Needs a state store with timers: ``spark.sql.streaming.stateStore.providerClass`` must name the RocksDB one.
    """

    def judge(batch: DataFrame, number: int) -> None:
        rows = judged_log(batch.persist(), dims.rules(), max_duration)
        store.append("threshold_alerts", rows, f"{stream_id(store.spark, checkpoint)}.{number}")
        batch.unpersist()

    return (
        minute_windows(partials, lateness, max_duration)
        .writeStream.foreachBatch(judge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )
