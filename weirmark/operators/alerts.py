"""Alert logs: detector results with rule names, ready to append or show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmark.functions.timeslot import at, to_epoch
from weirmark.operators import detect
from weirmark.operators.joins import lookup_join

LOG_SENSITIVITY = "medium"
SCREEN_SENSITIVITY = "high"


def _named(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Add the rule's name; an alert of a rule that is gone keeps ''."""
    names = rules.select("id", F.col("name").alias("_name"))
    joined = lookup_join(alerts, names, ["id"], "left")
    return joined.withColumn("name", F.coalesce("_name", F.lit(""))).drop("_name")


def _judged(judge: Callable[[DataFrame], DataFrame], rules: DataFrame) -> DataFrame:
    """Alerts that ``judge`` finds, with the rule's name.

    The id carries the name through the detectors, so alerts, of which each rule may have one a minute,
    need no join. Where an id names several rules, every one of them names its alerts.
    """
    if not rules.groupBy("id").count().filter("count > 1").isEmpty():
        return _named(judge(rules), rules)
    found = judge(rules.withColumn("id", F.struct("id", "name")))
    return found.withColumns({"id": F.col("id.id"), "name": F.expr("IF(id.id IS NULL, '', coalesce(id.name, ''))")})


def _both(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    return static.withColumn("type", F.lit("threshold")).unionByName(
        dynamic.withColumn("type", F.lit("zscore"))
    )


def threshold_alerts(
    totals: DataFrame,
    rules: DataFrame,
    as_of: detect.Moment = None,
    max_duration: int = detect.MAX_DURATION,
) -> DataFrame:
    """Static and dynamic alerts of one moment, as shown to a user."""
    now = to_epoch(as_of)
    found = _both(
        detect.static_threshold_alerts(totals, rules, now, max_duration),
        detect.dynamic_threshold_alerts(totals, rules, now),
    )
    return _named(found, rules).select(
        "id", "type", "name", "prefix", "peak_bps", "peak_pps", "bandwidth_alert", "packet_alert"
    )


def _threshold_log(named: DataFrame, time) -> DataFrame:
    return named.select(
        F.col("id").alias("rule_id"),
        F.col("name").alias("rule_name"),
        F.col("type").alias("alert_type"),
        "prefix",
        time.alias("alert_time"),
        "peak_bps",
        "peak_pps",
        F.col("bandwidth_alert").alias("is_bandwidth_alert"),
        F.col("packet_alert").alias("is_packet_alert"),
    )


def log_of(judge: Callable[[DataFrame], tuple[DataFrame, DataFrame]], rules: DataFrame) -> DataFrame:
    """Rows of the alert log from the static and dynamic alerts with ``eval_time`` that ``judge`` finds by the rules."""
    return _threshold_log(_judged(lambda named: _both(*judge(named)), rules), F.col("eval_time"))


def threshold_alert_log(
    totals: DataFrame,
    rules: DataFrame,
    as_of: detect.Moment = None,
    max_duration: int = detect.MAX_DURATION,
) -> DataFrame:
    """Rows to append to the alert log for one evaluation."""
    now = to_epoch(as_of)
    found = _both(
        detect.static_threshold_alerts(totals, rules, now, max_duration),
        detect.dynamic_threshold_alerts(totals, rules, now),
    )
    return _threshold_log(_named(found, rules), F.expr(at(now)))


def threshold_alert_log_grid(
    totals: DataFrame,
    rules: DataFrame,
    start: detect.Moment = None,
    end: detect.Moment = None,
    max_duration: int = detect.MAX_DURATION,
) -> DataFrame:
    """The log of one evaluation per minute over a span."""

    def judge(named: DataFrame) -> tuple[DataFrame, DataFrame]:
        return (
            detect.static_threshold_grid(totals, named, start, end, max_duration),
            detect.dynamic_threshold_grid(totals, named, start, end),
        )

    return log_of(judge, rules)


def ddos_screen(
    profile: DataFrame, baseline: DataFrame, rules: DataFrame, as_of: detect.Moment = None
) -> DataFrame:
    """Week-over-week alerts of one moment, as shown to a user."""
    found = _named(
        detect.ddos_alerts(profile, baseline, rules, as_of, SCREEN_SENSITIVITY), rules
    )
    return found.select("id", "name", *[c for c in found.columns if c not in ("id", "name", "time_received")])


def _ddos_log(named: DataFrame) -> DataFrame:
    rates = [c for c in named.columns if c not in ("id", "name", "prefix", "proto", "time_received")]
    return named.select(
        F.col("id").alias("rule_id"),
        F.col("name").alias("rule_name"),
        "prefix",
        "proto",
        *rates,
        F.col("time_received").alias("alert_time"),
    )


def ddos_alert_log(
    profile: DataFrame,
    baseline: DataFrame,
    rules: DataFrame,
    as_of: detect.Moment = None,
    sensitivity: str = LOG_SENSITIVITY,
) -> DataFrame:
    """Week-over-week alerts to append to the log for one evaluation."""
    return _ddos_log(_named(detect.ddos_alerts(profile, baseline, rules, as_of, sensitivity), rules))


def ddos_alert_log_grid(
    profile: DataFrame,
    baseline: DataFrame,
    rules: DataFrame,
    start: detect.Moment = None,
    end: detect.Moment = None,
    sensitivity: str = LOG_SENSITIVITY,
) -> DataFrame:
    """The log of one evaluation per minute over a span."""
    return _ddos_log(
        _judged(lambda named: detect.ddos_grid(profile, baseline, named, start, end, sensitivity), rules)
    )
