"""The four detectors, each for one moment or for every minute of a span.

All of them read rollups, never flows. A merged rollup has one row per prefix
(and class) and minute, so no prefix can hold more rows than there are minutes,
however much traffic it draws.

The span forms ("grid") evaluate what the single form would say at each minute.
They cut the time line into chunks, repeat the rows a chunk's first minutes
look back to, and run sliding windows per (prefix, chunk): one shuffle, and
parallelism that grows with the span as well as with the number of prefixes.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirmark.functions import codes
from weirmark.functions.timeslot import DAY, MINUTE, at, epoch_slot, time_range, to_epoch, to_minute
from weirmark.operators.joins import BROADCAST_ROWS, lookup_join
from weirmark.operators.prefix import rule_prefixes
from weirmark.operators.rollup import SUMS, merge_partials

Moment = datetime | int | None

MAX_DURATION = 60  # minutes a static rule may look back
SHORT_MINUTES = 5
LONG_MINUTES = 240
MIN_SAMPLES = 30
MIN_BPS = 1_000_000
BURST_MINUTES = 5
BASELINE_DAYS = 7
CHUNK_MINUTES = 1440

#: Rules whose alerts one task makes, so that no task's share grows with their number.
RULES_A_TASK = 1000

_BPS = "CAST(bytes AS DOUBLE) * 8 / 60"
_PPS = "packets / 60"
_FPS = "flows / 60"


# --- shared parts ---


class _Rules:
    """Rules of one type, one row per prefix, with their checked size."""

    def __init__(self, rules: DataFrame, kind: str, *columns: str):
        chosen = rules.filter(F.col("type") == kind)
        self.rows = rule_prefixes(chosen, "id", *columns)
        self.prefixes = self.rows.select("prefix").distinct()
        longest = F.max("duration") if "duration" in columns else F.lit(None)
        count, longest = self.rows.agg(F.count("*"), longest).first()
        self.small = count <= BROADCAST_ROWS
        self.tasks = count // RULES_A_TASK + 1
        # longest duration of all rules, where all of them were seen
        self.longest = longest if self.small else None

    def only_ruled(self, rollup: DataFrame) -> DataFrame:
        """Rollup rows whose prefix some rule names; done before any shuffle."""
        return lookup_join(rollup, self.prefixes, ["prefix"], "left_semi", small=self.small)

    def join(self, df: DataFrame, on: tuple[str, ...] = ("prefix",)) -> DataFrame:
        """Every row with each rule of its prefix; rows of a prefix with many rules are dealt to many tasks."""
        return lookup_join(df, self.rows, [*on], small=self.small, tasks=self.tasks)

    def split_repeated(self) -> tuple[DataFrame, DataFrame]:
        """Rows whose id is their own within the prefix, and the others."""
        same = F.count(F.lit(1)).over(Window.partitionBy("id", "prefix"))
        counted = self.rows.withColumn("_same", same)
        return counted.filter("_same = 1").drop("_same"), counted.filter("_same > 1").drop("_same")


def _minute(ts: str = "time_received") -> Column:
    return F.expr(epoch_slot(ts, MINUTE))


def _bounds(start: Moment, end: Moment) -> tuple[int | None, int | None]:
    return (
        None if start is None else to_minute(start),
        None if end is None else to_minute(end),
    )


def _read(rollup: DataFrame, start: int | None, end: int | None, lookback: int) -> DataFrame:
    return time_range(rollup, None if start is None else start - lookback * MINUTE, end)


def _chunked(rollup: DataFrame, keys: list[str], lookback: int, chunk: int) -> DataFrame:
    """Merged minutes per key and chunk, with the rows the chunk looks back to.

    Partitioned by (keys, chunk); the merge and all later windows reuse that.
    """
    last = f"CAST(floor((_m + {lookback}) / {chunk}) AS BIGINT)"
    own = f"CAST(floor(_m / {chunk}) AS BIGINT)"
    return (
        rollup.withColumn("_m", _minute())
        .withColumn("_chunk", F.explode(F.expr(f"sequence({own}, {last})")))
        .repartition(*keys, "_chunk")
        .groupBy(*keys, "_chunk", "_m")
        .agg(*[F.try_sum(c).alias(c) for c in SUMS])
    )


def _with_silent_minutes(minutes: DataFrame, keys: list[str], follow: int, chunk: int) -> DataFrame:
    """Add up to ``follow`` empty rows after each row, until the next one.

    An alert can hold in a minute without traffic; later than ``follow``
    minutes after the last row it cannot. Empty rows have NULL sums.
    """
    w = Window.partitionBy(*keys, "_chunk").orderBy("_m")
    upto = (
        f"least(_m + {follow}, coalesce(_next - 1, _m + {follow}), (_chunk + 1) * {chunk} - 1)"
    )
    return (
        minutes.withColumn("_next", F.lead("_m").over(w))
        .withColumn("_t", F.explode(F.expr(f"sequence(_m, greatest(_m, {upto}))")))
        .select(
            *keys,
            "_chunk",
            "_t",
            F.expr("_t <> _m").alias("_silent"),
            *[F.expr(f"CASE WHEN _t = _m THEN {c} END").alias(c) for c in SUMS],
        )
    )


def _own_minutes(df: DataFrame, start: int | None, end: int | None, chunk: int) -> DataFrame:
    """Rows the chunk itself evaluates, with their time."""
    df = df.filter(f"floor(_t / {chunk}) = _chunk")
    if start is not None:
        df = df.filter(F.col("_t") >= start // MINUTE)
    if end is not None:
        df = df.filter(F.col("_t") <= end // MINUTE)
    return df.withColumn("eval_time", F.expr(f"timestamp_seconds(_t * {MINUTE})"))


# --- static thresholds ---


def never_firing(rules: DataFrame, max_duration: int = MAX_DURATION, fires: bool = False) -> DataFrame:
    """Threshold rules that look back further than ``max_duration`` lets them, and so never fire; or the others.

    A window of ``max_duration`` minutes holds that many rows and the running minute.
    """
    if fires:
        return rules.filter(f"type = 'threshold' AND duration <= {max_duration + 1}")
    return rules.filter(f"type = 'threshold' AND duration > {max_duration + 1}")


_STATIC = ["id", "prefix", "bandwidth_alert", "peak_bps", "packet_alert", "peak_pps"]


def all_over(value: str, limit: str) -> str:
    """Whether the last ``duration`` entries of ``_seen``, the minutes of a window, all reach a limit."""
    return (
        f"({limit} IS NOT NULL AND size(_seen) >= duration AND "
        f"forall(slice(_seen, -CAST(duration AS INT), CAST(duration AS INT)),"
        f" x -> x.{value} >= {limit}))"
    )


def _judge_static(df: DataFrame) -> DataFrame:
    """Flags from ``_seen``: the minutes of the window, oldest first."""
    # slice() wants a window at least as long as the rule's duration
    enough = df.filter("size(_seen) >= duration")
    return enough.withColumns(
        {
            "bandwidth_alert": F.expr(all_over("bps", "bandwidth_threshold")),
            "packet_alert": F.expr(all_over("pps", "packet_threshold")),
            "peak_bps": F.expr("array_max(transform(_seen, x -> x.bps))"),
            "peak_pps": F.expr("array_max(transform(_seen, x -> x.pps))"),
        }
    ).filter("bandwidth_alert OR packet_alert")


_SEEN = f"struct(_t, {_BPS} AS bps, {_PPS} AS pps)"


def _static_rules(rules: DataFrame, max_duration: int) -> tuple[_Rules, int]:
    """Rules that can fire, and how many minutes they look back at most."""
    # a rule without a duration never fires
    ruled = _Rules(
        rules.filter("duration IS NOT NULL"),
        "threshold",
        "bandwidth_threshold",
        "packet_threshold",
        "duration",
    )
    return ruled, max_duration if ruled.longest is None else min(max_duration, ruled.longest)


def static_threshold_alerts(
    totals: DataFrame, rules: DataFrame, as_of: Moment = None, max_duration: int = MAX_DURATION
) -> DataFrame:
    """Rules whose last ``duration`` minutes with traffic all reach a limit.

    The window is inclusive at both ends, so ``duration`` minutes span up to
    ``duration + 1`` slots, the running minute among them.
    """
    now = to_minute(as_of)
    ruled, reach = _static_rules(rules, max_duration)
    minutes = merge_partials(
        ruled.only_ruled(time_range(totals, now - reach * MINUTE, now)),
        ["prefix", "time_received"],
    ).withColumn("_t", _minute())
    # at most reach + 1 minutes in a group
    windows = (
        ruled.join(minutes)
        .filter(f"_t >= {now // MINUTE} - duration")
        .groupBy("id", "prefix", "bandwidth_threshold", "packet_threshold", "duration")
        .agg(F.array_sort(F.collect_list(F.expr(_SEEN))).alias("_seen"))
    )
    return _judge_static(windows).select(*_STATIC)


def static_threshold_grid(
    totals: DataFrame,
    rules: DataFrame,
    start: Moment = None,
    end: Moment = None,
    max_duration: int = MAX_DURATION,
    chunk: int = CHUNK_MINUTES,
    in_force: tuple[str, str] | None = None,
) -> DataFrame:
    """:func:`static_threshold_alerts` at every minute of a span.

    ``duration`` rows must lie in ``duration + 1`` slots, so a window misses
    one minute at most, and an alert can outlive the last row by one minute.
    ``in_force`` names a rule's first minute and the first one after it: minutes
    that no evaluation in between looks at are left out.
    """
    low, high = _bounds(start, end)
    ruled, reach = _static_rules(never_firing(rules, max_duration, fires=True), max_duration)
    minutes = _chunked(
        ruled.only_ruled(_read(totals, low, high, reach + 1)), ["prefix"], reach + 1, chunk
    )
    own, repeated = ruled.split_repeated()
    lowest = _own_minutes(_lowest(minutes, own, max_duration, chunk), low, high, chunk)
    ruled.rows = own
    found = _over_lowest(lowest, ruled)
    if in_force:
        found = found.filter(f"_t >= {in_force[0]} AND _t < {in_force[1]}")
    found = found.select("eval_time", *_STATIC)
    if repeated.isEmpty():
        return found
    judged = _judge_streaks(minutes, repeated, ruled.small, reach, max_duration, chunk, in_force)
    return found.unionByName(_own_minutes(judged, low, high, chunk).select("eval_time", *_STATIC))


def _durations(rules: DataFrame) -> DataFrame:
    """One row per prefix with the durations of its rules, of which there are as many as minutes to look back to."""
    return rules.groupBy("prefix").agg(F.array_sort(F.collect_set("duration")).alias("_durations"))


def _by_duration(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Each row once for every duration that a rule of its prefix has, however many rules have it."""
    return lookup_join(df, _durations(rules), ["prefix"]).withColumn("duration", F.explode("_durations")).drop("_durations")


def _lowest(minutes: DataFrame, rules: DataFrame, max_duration: int, chunk: int) -> DataFrame:
    """What the window of each minute ``_t`` holds, by prefix and duration: no limit of any rule takes part.

    ``low_*`` is the smallest value of its last ``duration`` rows, so a limit up to it is reached by all of them;
    minutes with fewer rows in their window are left out. ``peak_*`` is the largest value.
    """
    timed = _by_duration(_with_silent_minutes(minutes, ["prefix"], 1, chunk), rules).withColumns(
        # an unknown sum reaches no limit
        {u: F.expr(value) for u, value in (("bps", _BPS), ("pps", _PPS))}
        | {f"_{u}": F.expr(f"CASE WHEN NOT _silent THEN coalesce({value}, double('-Infinity')) END") for u, value in (("bps", _BPS), ("pps", _PPS))}
    )
    # minutes are stretched by duration until all windows have one width: ``near`` looks back to
    # duration - 1 minutes ago, ``far`` a minute further
    step = f"(({_SCALE} + duration - 1) div duration)"
    line = Window.partitionBy("prefix", "duration", "_chunk").orderBy(F.expr(f"(_t - _chunk * {chunk}) * {step}"))
    sums = {}
    for name, frame in (("near", line.rangeBetween(1 - _SCALE, 0)), ("far", line.rangeBetween(-_SCALE - max_duration - 1, 0))):
        sums[f"_n_{name}"] = F.sum(F.expr("IF(_silent, 0, 1)")).over(frame)
        for u in ("bps", "pps"):
            sums[f"_low_{u}_{name}"] = F.min(f"_{u}").over(frame)
            sums[f"_peak_{u}_{name}"] = F.max(u).over(frame)
    far = f"duration <= {max_duration}"  # else max_duration cuts the window
    chosen = {"known_bps": F.lit(True), "known_pps": F.lit(True)}
    for u in ("bps", "pps"):
        chosen[f"low_{u}"] = F.expr(f"CASE WHEN _n_near = duration THEN _low_{u}_near ELSE _low_{u}_far END")
        chosen[f"peak_{u}"] = F.expr(f"IF({far}, _peak_{u}_far, _peak_{u}_near)")
    found = timed.withColumns(sums).filter(f"_n_near = duration OR {far} AND _n_far = duration").withColumns(chosen)
    return found.select("prefix", "duration", "_chunk", "_t", *chosen)


def _over_lowest(lowest: DataFrame, ruled: _Rules) -> DataFrame:
    """Each rule's alerts, by its limits, from what the windows of its duration hold."""
    test = "({limit} IS NOT NULL AND low_{u} >= {limit} AND known_{u})"
    return (
        ruled.join(lowest, ("prefix", "duration"))
        .withColumns(
            {
                "bandwidth_alert": F.expr(test.format(limit="bandwidth_threshold", u="bps")),
                "packet_alert": F.expr(test.format(limit="packet_threshold", u="pps")),
            }
        )
        .filter("bandwidth_alert OR packet_alert")
    )


def _judge_streaks(
    minutes: DataFrame, rules: DataFrame, small: bool, reach: int, max_duration: int, chunk: int,
    in_force: tuple[str, str] | None,
) -> DataFrame:
    """Alerts of rules that share id and prefix: their minutes are judged in one line."""
    ruled_minutes = lookup_join(minutes, rules, ["prefix"], small=small)
    if in_force:
        ruled_minutes = ruled_minutes.filter(f"_m >= {in_force[0]} - {reach + 1} AND _m < {in_force[1]}")
    flagged = ruled_minutes.selectExpr(
        "id", "prefix", "duration", "_chunk", "_m",
        f"{_BPS} AS bps", f"{_PPS} AS pps",
        f"coalesce({_BPS} >= bandwidth_threshold, false) AS over_bps",
        f"coalesce({_PPS} >= packet_threshold, false) AS over_pps",
    ).repartition("id", "prefix", "_chunk")
    alerts = _with_streaks(flagged, ["over_bps", "over_pps"]).withColumns(
        {
            # the window has a slot more than the rule's rows, unless max_duration cuts it
            f"{flag}{late}": F.expr(f"{over} AND {test}")
            for flag, over in (("bandwidth_alert", "over_bps"), ("packet_alert", "over_pps"))
            for late, test in (
                ("", f"({over}_run + IF(duration <= {max_duration}, {over}_before, 0) >= duration)"),
                ("_late", f"{over}_run >= duration AND duration <= {max_duration} AND _quiet"),
            )
        }
    )
    # the row's own minute and, where the rule still fires then, the quiet one after it
    moments = alerts.withColumn(
        "_at",
        F.explode(
            F.expr(
                "filter(array(struct(_m AS t, bandwidth_alert AS b, packet_alert AS p, true AS own),"
                " struct(_m + 1 AS t, bandwidth_alert_late AS b, packet_alert_late AS p, false AS own)),"
                " x -> x.own OR x.b OR x.p)"
            )
        ),
    ).selectExpr(
        "id", "prefix", "duration", "_chunk", "_at.t AS _t", "_at.b AS bandwidth_alert", "_at.p AS packet_alert",
        "IF(_at.own, bps, NULL) AS bps", "IF(_at.own, pps, NULL) AS pps",
    )
    return _with_peaks(moments, max_duration, chunk).filter("bandwidth_alert OR packet_alert")


_STREAM = ["id", "prefix", "_chunk"]


def _with_streaks(flagged: DataFrame, flags: list[str]) -> DataFrame:
    """Runs of neighbouring minutes over a limit, by gaps and islands.

    For each flag ``<flag>_run`` is the length of the run that the row's minute ends (0 off a run), and
    ``<flag>_before`` that of the run before it if one missing minute alone parts them, else 0. ``_quiet``:
    the next minute has no row. All windows share one order and grow by a row at a time.
    """
    w = Window.partitionBy(*_STREAM).orderBy("_m")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    df = flagged.withColumns(
        {
            "_gap": F.col("_m") - F.lag("_m").over(w),
            "_quiet": F.coalesce(F.lead("_m").over(w) > F.col("_m") + 1, F.lit(True)),
            **{f"_last_{flag}": F.coalesce(F.lag(flag).over(w), F.lit(False)) for flag in flags},
        }
    )
    begins = {flag: f"NOT (coalesce(_gap = 1, false) AND _last_{flag} AND {flag})" for flag in flags}
    df = df.withColumns(
        {f"_from_{flag}": F.max(F.expr(f"CASE WHEN {begins[flag]} THEN _m END")).over(so_far) for flag in flags}
    ).withColumns({f"{flag}_run": F.expr(f"IF({flag}, _m - _from_{flag} + 1, 0)") for flag in flags})
    df = df.withColumns(
        {f"_ended_{flag}": F.expr(f"IF({flag} AND coalesce(_gap = 2, false), 1, 0)") * F.coalesce(F.lag(f"{flag}_run").over(w), F.lit(0)) for flag in flags}
    )
    return df.withColumns(
        {
            # carried from the row that began the run
            f"{flag}_before": F.last(F.expr(f"CASE WHEN {begins[flag]} THEN _ended_{flag} END"), ignorenulls=True).over(so_far)
            for flag in flags
        }
    )


#: Span of a window in scaled minutes; far above the square of the longest look-back in minutes.
_SCALE = 1 << 40


def _with_peaks(moments: DataFrame, max_duration: int, chunk: int) -> DataFrame:
    """``peak_bps`` and ``peak_pps`` of each alert's own window; rows that lie in no such window go.

    Windows differ by rule in length, so minutes are stretched by rule until all windows span ``_SCALE``.
    """
    reach = f"least(duration, {max_duration})"
    ahead = Window.partitionBy(*_STREAM).orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, 0)
    near = moments.withColumn(
        "_next", F.min(F.expr("CASE WHEN bandwidth_alert OR packet_alert THEN _t END")).over(ahead)
    ).filter(f"_t >= _next - {reach}")
    window = (
        Window.partitionBy(*_STREAM)
        .orderBy(F.expr(f"(_t - _chunk * {chunk}) * ({_SCALE} div {reach})"))
        .rangeBetween(-_SCALE, 0)
    )
    return near.withColumns({f"peak_{u}": F.max(u).over(window) for u in ("bps", "pps")})


# --- z-score of five minutes against four hours ---

_ZSCORE = _STATIC
_MOMENTS = {"bps": "bytes", "pps": "packets"}


def _judge_zscore(stats: DataFrame, ruled: _Rules) -> DataFrame:
    def zscore(unit: str) -> str:
        return (
            f"CASE WHEN long_stddev_{unit} > 0"
            f" THEN (short_avg_{unit} - long_avg_{unit}) / long_stddev_{unit} ELSE 0D END"
        )

    def alert(unit: str, target: str) -> str:
        return (
            f"coalesce(zscore_target = '{target}' AND {unit}_zscore"
            f" >= {codes.zscore_limit('zscore_sensitivity')}, false)"
        )

    # the bandwidth floor also applies to rules on packets
    steady = stats.filter(f"samples >= {MIN_SAMPLES} AND long_avg_bps >= {MIN_BPS}").withColumns(
        {"bps_zscore": F.expr(zscore("bps")), "pps_zscore": F.expr(zscore("pps"))}
    )
    return (
        ruled.join(steady)
        .withColumns(
            {
                "bandwidth_alert": F.expr(alert("bps", "bits")),
                "packet_alert": F.expr(alert("pps", "packets")),
            }
        )
        .filter("bandwidth_alert OR packet_alert")
    )


def _zscore_rules(rules: DataFrame) -> _Rules:
    return _Rules(rules, "zscore", "zscore_sensitivity", "zscore_target")


def dynamic_threshold_alerts(totals: DataFrame, rules: DataFrame, as_of: Moment = None) -> DataFrame:
    """Prefixes whose last five minutes stand out from the four hours before."""
    now = to_minute(as_of)
    ruled = _zscore_rules(rules)
    minutes = merge_partials(
        ruled.only_ruled(time_range(totals, now - LONG_MINUTES * MINUTE, now)),
        ["prefix", "time_received"],
    )
    short = f"time_received >= {at(now - SHORT_MINUTES * MINUTE)}"
    aggregates = ["count(*) FILTER (WHERE NOT {s}) AS samples"]
    for unit, value in (("bps", _BPS), ("pps", _PPS)):
        aggregates += [
            f"avg({value}) FILTER (WHERE {{s}}) AS short_avg_{unit}",
            f"max({value}) FILTER (WHERE {{s}}) AS peak_{unit}",
            f"avg({value}) FILTER (WHERE NOT {{s}}) AS long_avg_{unit}",
            f"stddev_pop({value}) FILTER (WHERE NOT {{s}}) AS long_stddev_{unit}",
        ]
    stats = minutes.groupBy("prefix").agg(*[F.expr(a.format(s=f"({short})")) for a in aggregates])
    return _judge_zscore(stats, ruled).select(*_ZSCORE)


def dynamic_threshold_grid(
    totals: DataFrame,
    rules: DataFrame,
    start: Moment = None,
    end: Moment = None,
    chunk: int = CHUNK_MINUTES,
) -> DataFrame:
    """:func:`dynamic_threshold_alerts` at every minute of a span."""
    low, high = _bounds(start, end)
    ruled = _zscore_rules(rules)
    minutes = _chunked(
        ruled.only_ruled(_read(totals, low, high, LONG_MINUTES)), ["prefix"], LONG_MINUTES, chunk
    )
    line = Window.partitionBy("prefix", "_chunk").orderBy("_t")
    short = line.rangeBetween(-SHORT_MINUTES, 0)
    # sums from the chunk's begin; a window's own are the difference of those at its two ends
    upto = {
        "_now": line.rangeBetween(Window.unboundedPreceding, 0),
        "_short": line.rangeBetween(Window.unboundedPreceding, -SHORT_MINUTES - 1),
        "_long": line.rangeBetween(Window.unboundedPreceding, -LONG_MINUTES - 1),
    }
    timed = _with_silent_minutes(minutes, ["prefix"], SHORT_MINUTES, chunk)
    largest = Window.partitionBy("prefix", "_chunk")
    timed = timed.withColumns({f"_scale_{c}": F.max(c).over(largest) for c in _MOMENTS.values()}).withColumns(
        {
            "_bps": F.expr(_BPS),
            "_pps": F.expr(_PPS),
            # squares of 49 bits and their sums fit a decimal; a stream of larger values gives up 14 bits
            **{
                f"_x_{u}": F.expr(f"CAST({c} div IF(_scale_{c} < {1 << 49}, 1, {1 << 14}) AS DECIMAL(19, 0))")
                for u, c in _MOMENTS.items()
            },
        }
    )
    sums = {}
    for end, frame in upto.items():
        for u in _MOMENTS:
            sums[f"n{end}_{u}"] = F.count(f"_x_{u}").over(frame)
            sums[f"x{end}_{u}"] = F.coalesce(F.sum(f"_x_{u}").over(frame), F.lit(0))
            if end != "_now":
                square = F.expr(f"CAST(_x_{u} * _x_{u} AS DECIMAL(30, 0))")
                sums[f"xx{end}_{u}"] = F.coalesce(F.sum(square).over(frame), F.lit(0))
    sums |= {f"peak_{u}": F.max(f"_{u}").over(short) for u in _MOMENTS}
    windowed = {"samples": F.expr("n_short_bps - n_long_bps")}
    for u, c in _MOMENTS.items():
        unit = f"{'8 / 60' if u == 'bps' else '1 / 60'} * IF(_scale_{c} < {1 << 49}, 1, {1 << 14})"
        n, x = f"(n_short_{u} - n_long_{u})", f"(x_short_{u} - x_long_{u})"
        spread = f"({n} * (xx_short_{u} - xx_long_{u}) - CAST({x} AS DECIMAL(19, 0)) * CAST({x} AS DECIMAL(19, 0)))"
        windowed[f"short_avg_{u}"] = F.expr(
            f"try_divide(CAST(x_now_{u} - x_short_{u} AS DOUBLE), n_now_{u} - n_short_{u}) * {unit}"
        )
        windowed[f"long_avg_{u}"] = F.expr(f"try_divide(CAST({x} AS DOUBLE), {n}) * {unit}")
        windowed[f"long_stddev_{u}"] = F.expr(f"try_divide(sqrt(CAST({spread} AS DOUBLE)), {n}) * {unit}")
    stats = _own_minutes(timed.withColumns(sums).withColumns(windowed), low, high, chunk)
    return _judge_zscore(stats, ruled).select("eval_time", *_ZSCORE)


def judge_windows(windows: DataFrame, rules: DataFrame, max_duration: int = MAX_DURATION) -> tuple[DataFrame, DataFrame]:
    """Static and z-score alerts from what each minute ``_t`` of a prefix sees.

    ``_seen``: minutes of the static window, oldest first, empty where no static rule can fire; ``samples`` and the
    averages, peaks and deviations of :func:`dynamic_threshold_grid`.
    """
    ruled, _ = _static_rules(never_firing(rules, max_duration, fires=True), max_duration)
    timed = windows.withColumn("eval_time", F.expr(f"timestamp_seconds(_t * {MINUTE})"))
    seen = timed.filter("size(_seen) > 0").select("eval_time", "prefix", "_t", "_seen")
    # the window of each duration is looked through once, not for every rule
    windowed = _by_duration(seen, ruled.rows).withColumn("_seen", F.expr("filter(_seen, x -> x._t >= _t - duration)"))
    last = windowed.filter("size(_seen) >= duration").withColumn(
        "_last", F.expr("slice(_seen, -CAST(duration AS INT), CAST(duration AS INT))")
    )
    lowest = last.selectExpr(
        "eval_time", "prefix", "duration",
        *[f"array_min(transform(_last, x -> x.{u})) AS low_{u}" for u in ("bps", "pps")],
        # an unknown sum leaves it open
        *[f"IF(exists(_last, x -> x.{u} IS NULL), NULL, true) AS known_{u}" for u in ("bps", "pps")],
        *[f"array_max(transform(_seen, x -> x.{u})) AS peak_{u}" for u in ("bps", "pps")],
    )
    static = _over_lowest(lowest, ruled)
    stats = timed.drop("_seen")
    return static.select("eval_time", *_STATIC), _judge_zscore(stats, _zscore_rules(rules)).select("eval_time", *_ZSCORE)


# --- traffic classes against a baseline ---

_RATES = {"bps": ("bytes", _BPS), "pps": ("packets", _PPS), "fps": ("flows", _FPS)}
_DDOS = [
    "id",
    "time_received",
    "prefix",
    "proto",
    *[f"current_{u}" for u in _RATES],
    *[f"recommend_{u}" for u in _RATES],
    *[f"{u}_alert" for u in _RATES],
]
_BURST = [
    *_DDOS[:7],
    *[f"baseline_{u}" for u in _RATES],
    *[f"threshold_{u}" for u in _RATES],
    *_DDOS[10:],
]


def _judge_rates(df: DataFrame, limit: str) -> DataFrame:
    """Flags for current rates at or above ``limit``; rows with any flag."""
    flags = {f"{u}_alert": F.expr(f"current_{u} >= {limit}_{u}") for u in _RATES}
    return df.withColumns(flags).filter("bps_alert OR pps_alert OR fps_alert")


def _current_rates(profile: DataFrame) -> DataFrame:
    return profile.withColumns(
        {f"current_{u}": F.expr(value) for u, (_, value) in _RATES.items()}
    )


def _ddos(
    profile: DataFrame, baseline: DataFrame, rules: DataFrame,
    low: int | None, high: int | None, sensitivity: str,
) -> DataFrame:
    ruled = _Rules(rules, "advanced_ddos")
    factor = codes.baseline_factor(sensitivity)
    week = BASELINE_DAYS * DAY
    day = f"unix_seconds(time_received) - pmod(unix_seconds(time_received), {DAY})"
    current = _current_rates(
        merge_partials(
            ruled.only_ruled(time_range(profile, low, high)), ["prefix", "time_received", "proto"]
        )
    ).withColumn("_day", F.expr(day))
    days = (
        None if low is None else low // DAY * DAY - week,
        None if high is None else high // DAY * DAY - week,
    )
    # one row per prefix, class and day; a left key has 1,440 minutes at most,
    # so a plain join is even and adaptive execution may still broadcast it
    expected = ruled.only_ruled(time_range(baseline, *days)).selectExpr(
        "prefix",
        "proto",
        f"unix_seconds(time_received) + {week} AS _day",
        *[
            f"{value.replace(measure, f'p95_{measure}')} * {factor}D AS recommend_{u}"
            for u, (measure, value) in _RATES.items()
        ],
    )
    judged = _judge_rates(current.join(expected, ["prefix", "proto", "_day"]), "recommend")
    return ruled.join(judged)


def ddos_alerts(
    profile: DataFrame,
    baseline: DataFrame,
    rules: DataFrame,
    as_of: Moment = None,
    sensitivity: str = "high",
) -> DataFrame:
    """Classes at or above the 95th percentile of the same weekday a week ago,
    times the sensitivity's factor."""
    now = to_minute(as_of)
    return _ddos(profile, baseline, rules, now, now, sensitivity).select(*_DDOS)


def ddos_grid(
    profile: DataFrame,
    baseline: DataFrame,
    rules: DataFrame,
    start: Moment = None,
    end: Moment = None,
    sensitivity: str = "high",
) -> DataFrame:
    """:func:`ddos_alerts` at every minute of a span (``time_received``)."""
    return _ddos(profile, baseline, rules, *_bounds(start, end), sensitivity).select(*_DDOS)


def _judge_burst(df: DataFrame, ruled: _Rules, sensitivity: str) -> DataFrame:
    factor = codes.baseline_factor(sensitivity)
    loud = df.filter(f"baseline_bps >= {MIN_BPS}").withColumns(
        {f"threshold_{u}": F.expr(f"baseline_{u} * {factor}D") for u in _RATES}
    )
    return ruled.join(_judge_rates(_current_rates(loud), "threshold"))


def _averages(over=None) -> dict[str, Column]:
    out = {}
    for u, (measure, _) in _RATES.items():
        mean = F.avg(measure)
        mean = mean if over is None else mean.over(over)
        out[f"baseline_{u}"] = mean * 8 / 60 if u == "bps" else mean / 60
    return out


def burst_alerts(
    profile: DataFrame, rules: DataFrame, as_of: Moment = None, sensitivity: str = "high"
) -> DataFrame:
    """Classes that jump above the mean of the five minutes before."""
    now = to_minute(as_of)
    ruled = _Rules(rules, "advanced_ddos")
    keys = ["prefix", "proto"]
    minutes = merge_partials(
        ruled.only_ruled(time_range(profile, now - BURST_MINUTES * MINUTE, now)),
        [*keys, "time_received"],
    )
    current = f"time_received = {at(now)}"
    recent = (
        minutes.filter(f"NOT {current}")
        .groupBy(*keys)
        .agg(*[c.alias(name) for name, c in _averages().items()])
    )
    # both sides have one row per prefix and class
    return _judge_burst(minutes.filter(current).join(recent, keys), ruled, sensitivity).select(
        *_BURST
    )


def burst_grid(
    profile: DataFrame,
    rules: DataFrame,
    start: Moment = None,
    end: Moment = None,
    sensitivity: str = "high",
    chunk: int = CHUNK_MINUTES,
) -> DataFrame:
    """:func:`burst_alerts` at every minute of a span (``time_received``)."""
    low, high = _bounds(start, end)
    ruled = _Rules(rules, "advanced_ddos")
    keys = ["prefix", "proto"]
    minutes = _chunked(
        ruled.only_ruled(_read(profile, low, high, BURST_MINUTES)), keys, BURST_MINUTES, chunk
    ).withColumnRenamed("_m", "_t")
    before = (
        Window.partitionBy(*keys, "_chunk").orderBy("_t").rangeBetween(-BURST_MINUTES, -1)
    )
    windows = _own_minutes(minutes.withColumns(_averages(before)), low, high, chunk)
    return _judge_burst(
        windows.withColumnRenamed("eval_time", "time_received"), ruled, sensitivity
    ).select(*_BURST)
