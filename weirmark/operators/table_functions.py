"""The four detectors as SQL table functions: ``SELECT * FROM static_threshold_alerts_at(TIMESTAMP '...')``.

The functions read rollups, baselines and rules by the names of tables or views; arguments are constants of the
call, so the bounds that follow from ``as_of`` reach the scan (also on a ``date`` partition column, where there is
one). Results equal those of the functions in ``operators.detect`` for one moment.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from weirmark.functions import codes
from weirmark.functions.timeslot import DAY, MINUTE, slot_start, utc_date
from weirmark.operators import detect

_ALERT = "id STRING, prefix STRING, bandwidth_alert BOOLEAN, peak_bps DOUBLE, packet_alert BOOLEAN, peak_pps DOUBLE"
_UNITS = {"bps": "bytes", "pps": "packets", "fps": "flows"}
_RATE = {"bps": "CAST({} AS DOUBLE) * 8 / 60", "pps": "{} / 60", "fps": "{} / 60"}


def _rates(columns: str) -> str:
    names = "id STRING, time_received TIMESTAMP, prefix STRING, proto STRING"
    return ", ".join([names, *[f"{c} DOUBLE" for c in columns.split()], *[f"{u}_alert BOOLEAN" for u in _UNITS]])


def _factor(sensitivity: str) -> str:
    return codes.value_map(sensitivity, codes.BASELINE_FACTORS, f"{codes.DEFAULT_BASELINE_FACTOR}D")


class _Names:
    """SQL pieces that read the named tables for an evaluation at argument ``as_of``."""

    def __init__(self, spark: SparkSession, function: str, rules: str):
        self.spark, self.rules = spark, rules
        self.minute = slot_start(f"{function}.as_of", MINUTE)

    def between(self, table: str, start: str, end: str) -> str:
        test = f"time_received BETWEEN {start} AND {end}"
        if "date" in self.spark.table(table).columns:
            test += f" AND date BETWEEN {utc_date(start)} AND {utc_date(end)}"
        return test

    def back(self, minutes: str | int) -> str:
        return f"{self.minute} - make_dt_interval(0, 0, CAST({minutes} AS INT), 0)"

    def ruled(self, kind: str, *columns: str) -> str:
        names = ", ".join(["id", *columns])
        return f"ruled AS (SELECT {names}, explode(array_distinct(prefixes)) AS prefix FROM {self.rules} WHERE type = '{kind}')"

    def minutes(self, table: str, look_back: str | int, *keys: str) -> str:
        """Merged minutes of prefixes that some rule names."""
        by = ", ".join(["prefix", *keys, "time_received"])
        sums = ", ".join(f"try_sum({c}) AS {c}" for c in _UNITS.values())
        return (
            f"minutes AS (SELECT {by}, {sums} FROM {table} WHERE {self.between(table, self.back(look_back), self.minute)}"
            f" AND prefix IN (SELECT prefix FROM ruled) GROUP BY {by})"
        )


def _static(spark: SparkSession, totals: str, rules: str) -> str:
    n = _Names(spark, "static_threshold_alerts_at", rules)
    reach = "static_threshold_alerts_at.max_duration"
    bps, pps = (_RATE[u].format(_UNITS[u]) for u in ("bps", "pps"))
    flags = [(detect.all_over("bps", "bandwidth_threshold"), "bps"), (detect.all_over("pps", "packet_threshold"), "pps")]
    judged = ", ".join(
        f"{test} AS {name}_alert, array_max(transform(_seen, x -> x.{u})) AS peak_{u}"
        for (test, u), name in zip(flags, ("bandwidth", "packet"))
    )
    limits = "bandwidth_threshold, packet_threshold, duration"
    return f"""
WITH {n.ruled("threshold", *limits.split(", "))}, {n.minutes(totals, reach)},
seen AS (
  SELECT id, prefix, {limits}, array_sort(collect_list(struct(time_received, {bps} AS bps, {pps} AS pps))) AS _seen
  FROM minutes JOIN ruled USING (prefix)
  WHERE duration IS NOT NULL AND time_received >= {n.back("duration")} GROUP BY id, prefix, {limits}),
judged AS (SELECT id, prefix, {judged} FROM seen WHERE size(_seen) >= duration)
SELECT id, prefix, bandwidth_alert, peak_bps, packet_alert, peak_pps FROM judged WHERE bandwidth_alert OR packet_alert"""


def _zscore(spark: SparkSession, totals: str, rules: str) -> str:
    n = _Names(spark, "dynamic_threshold_alerts_at", rules)
    short = f"(time_received >= {n.back(detect.SHORT_MINUTES)})"
    stats = ["count(*) FILTER (WHERE NOT recent) AS samples"]
    for u in ("bps", "pps"):
        value = _RATE[u].format(_UNITS[u])
        stats += [
            f"avg({value}) FILTER (WHERE recent) AS short_{u}",
            f"max({value}) FILTER (WHERE recent) AS peak_{u}",
            f"avg({value}) FILTER (WHERE NOT recent) AS long_{u}",
            f"stddev_pop({value}) FILTER (WHERE NOT recent) AS spread_{u}",
        ]
    limit = codes.zscore_limit("zscore_sensitivity")
    flag = (
        "coalesce(zscore_target = '{t}' AND CASE WHEN spread_{u} > 0 THEN (short_{u} - long_{u}) / spread_{u}"
        f" ELSE 0D END >= {limit}, false)"
    )
    return f"""
WITH {n.ruled("zscore", "zscore_sensitivity", "zscore_target")}, {n.minutes(totals, detect.LONG_MINUTES)},
timed AS (SELECT *, {short} AS recent FROM minutes),
stats AS (SELECT prefix, {", ".join(stats)} FROM timed GROUP BY prefix),
judged AS (
  SELECT id, prefix, {flag.format(t="bits", u="bps")} AS bandwidth_alert, peak_bps,
    {flag.format(t="packets", u="pps")} AS packet_alert, peak_pps
  FROM stats JOIN ruled USING (prefix) WHERE samples >= {detect.MIN_SAMPLES} AND long_bps >= {detect.MIN_BPS})
SELECT id, prefix, bandwidth_alert, peak_bps, packet_alert, peak_pps FROM judged WHERE bandwidth_alert OR packet_alert"""


def _current() -> str:
    return ", ".join(f"{_RATE[u].format(f'c.{m}')} AS current_{u}" for u, m in _UNITS.items())


def _raised(limit: str) -> str:
    return ", ".join(f"current_{u} >= {limit}_{u} AS {u}_alert" for u in _UNITS)


def _ddos(spark: SparkSession, profile: str, baseline: str, rules: str) -> str:
    n = _Names(spark, "ddos_alerts_at", rules)
    factor = _factor("ddos_alerts_at.sensitivity")
    week_ago = f"{slot_start('ddos_alerts_at.as_of', DAY)} - INTERVAL {detect.BASELINE_DAYS} DAYS"
    limits = ", ".join(f"{_RATE[u].format(f'b.p95_{m}')} * {factor} AS recommend_{u}" for u, m in _UNITS.items())
    columns = ", ".join(f"{k}_{u}" for k in ("current", "recommend") for u in _UNITS)
    return f"""
WITH {n.ruled("advanced_ddos")}, {n.minutes(profile, 0, "proto")},
rated AS (
  SELECT c.time_received, prefix, proto, {_current()}, {limits} FROM minutes c
  JOIN (SELECT * FROM {baseline} WHERE {n.between(baseline, week_ago, week_ago)}) b USING (prefix, proto)),
judged AS (SELECT *, {_raised("recommend")} FROM rated)
SELECT id, time_received, prefix, proto, {columns}, bps_alert, pps_alert, fps_alert
FROM judged JOIN ruled USING (prefix) WHERE bps_alert OR pps_alert OR fps_alert"""


def _burst(spark: SparkSession, profile: str, rules: str) -> str:
    n = _Names(spark, "burst_alerts_at", rules)
    factor = _factor("burst_alerts_at.sensitivity")
    means = ", ".join(f"avg({m}){' * 8' if u == 'bps' else ''} / 60 AS baseline_{u}" for u, m in _UNITS.items())
    limits = ", ".join(f"baseline_{u} * {factor} AS threshold_{u}" for u in _UNITS)
    columns = ", ".join(f"{k}_{u}" for k in ("current", "baseline", "threshold") for u in _UNITS)
    return f"""
WITH {n.ruled("advanced_ddos")}, {n.minutes(profile, detect.BURST_MINUTES, "proto")},
recent AS (SELECT prefix, proto, {means} FROM minutes WHERE time_received < {n.minute} GROUP BY prefix, proto),
rated AS (
  SELECT c.time_received, prefix, proto, {_current()}, {", ".join(f"baseline_{u}" for u in _UNITS)}, {limits}
  FROM (SELECT * FROM minutes WHERE time_received = {n.minute}) c JOIN recent USING (prefix, proto)
  WHERE baseline_bps >= {detect.MIN_BPS}),
judged AS (SELECT *, {_raised("threshold")} FROM rated)
SELECT id, time_received, prefix, proto, {columns}, bps_alert, pps_alert, fps_alert
FROM judged JOIN ruled USING (prefix) WHERE bps_alert OR pps_alert OR fps_alert"""


def register_detectors(
    spark: SparkSession,
    totals: str = "prefixes_total_1m",
    profile: str = "prefixes_proto_profile_1m",
    baseline: str = "prefixes_proto_profile_1d",
    rules: str = "rules",
) -> None:
    """Create the table functions in the session, over tables or views of these names."""
    current, burst = "current_bps current_pps current_fps", "baseline_bps baseline_pps baseline_fps threshold_bps threshold_pps threshold_fps"
    level = f"sensitivity STRING DEFAULT 'high'"
    functions = {
        f"static_threshold_alerts_at(as_of TIMESTAMP, max_duration INT DEFAULT {detect.MAX_DURATION})": (_ALERT, _static(spark, totals, rules)),
        "dynamic_threshold_alerts_at(as_of TIMESTAMP)": (_ALERT, _zscore(spark, totals, rules)),
        f"ddos_alerts_at(as_of TIMESTAMP, {level})": (
            _rates(f"{current} recommend_bps recommend_pps recommend_fps"), _ddos(spark, profile, baseline, rules)),
        f"burst_alerts_at(as_of TIMESTAMP, {level})": (_rates(f"{current} {burst}"), _burst(spark, profile, rules)),
    }
    for head, (columns, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE ({columns}) RETURN {body}")
