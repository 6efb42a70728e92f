"""Rules as they were: a replay judges each minute by the rules in force then.

A table of versions has the columns of the rules and ``valid_from`` (timestamp), ``version``
(later of two versions with one ``valid_from``) and ``deleted``. A version holds until the
next one of its id; the evaluation of a minute uses what holds at its first second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirmark.functions.timeslot import MINUTE, at, epoch_slot, to_epoch
from weirmark.operators import alerts, detect

#: Stands for the minute after the last one.
FOREVER = (1 << 62) // MINUTE


def rules_as_of(versions: DataFrame, moment: detect.Moment = None) -> DataFrame:
    """The rules in force at one moment, in the columns of rules."""
    latest = Window.partitionBy("id").orderBy(F.desc("valid_from"), F.desc("version"))
    known = versions.filter(f"valid_from <= {at(to_epoch(moment))}")
    last = known.withColumn("_nth", F.row_number().over(latest)).filter("_nth = 1 AND NOT coalesce(deleted, false)")
    return last.drop("_nth", "valid_from", "version", "deleted")


def rule_spans(versions: DataFrame) -> DataFrame:
    """Each version with the minutes it is in force: ``first``, and ``after`` the last one.

    Versions that hold at no full minute, and deletions, have no row.
    """
    line = Window.partitionBy("id").orderBy("valid_from", "version")
    first = F.expr(f"CAST(ceil(unix_micros(valid_from) / {MINUTE * 1_000_000}) AS BIGINT)")
    spans = versions.withColumn("first", first).withColumn("after", F.coalesce(F.lead("first").over(line), F.lit(FOREVER)))
    return spans.filter("first < after AND NOT coalesce(deleted, false)")


def _as_rules(versions: DataFrame) -> DataFrame:
    """Versions as rules of their own: the id holds the name and the span, too."""
    spans = rule_spans(versions)
    own = F.struct("id", "name", "first", "after").alias("id")
    return spans.select(own, *[c for c in spans.columns if c not in ("id", "first", "after", "valid_from", "version", "deleted")])


def _in_force(found: DataFrame, time: str) -> DataFrame:
    """Alerts of versions in the minutes that they are in force."""
    minute = epoch_slot(time, MINUTE)
    return found.filter(f"{minute} >= id.first AND {minute} < id.after")


def threshold_log_replay(
    totals: DataFrame,
    versions: DataFrame,
    start: detect.Moment = None,
    end: detect.Moment = None,
    max_duration: int = detect.MAX_DURATION,
) -> DataFrame:
    """:func:`alerts.threshold_alert_log_grid` with the rules of each minute.

    Windows look back beyond the change of a rule: its new limits judge the old minutes.
    """
    rules = _as_rules(versions)
    static = detect.static_threshold_grid(
        totals, rules, start, end, max_duration, in_force=("id.first", "id.after")
    )
    dynamic = detect.dynamic_threshold_grid(totals, rules, start, end)
    both = static.withColumn("alert_type", F.lit("threshold")).unionByName(dynamic.withColumn("alert_type", F.lit("zscore")))
    return _in_force(both, "eval_time").selectExpr(
        "id.id AS rule_id",
        "coalesce(id.name, '') AS rule_name",
        "alert_type",
        "prefix",
        "eval_time AS alert_time",
        "peak_bps",
        "peak_pps",
        "bandwidth_alert AS is_bandwidth_alert",
        "packet_alert AS is_packet_alert",
    )


def ddos_log_replay(
    profile: DataFrame,
    baseline: DataFrame,
    versions: DataFrame,
    start: detect.Moment = None,
    end: detect.Moment = None,
    sensitivity: str = alerts.LOG_SENSITIVITY,
) -> DataFrame:
    """:func:`alerts.ddos_alert_log_grid` with the rules of each minute."""
    found = _in_force(detect.ddos_grid(profile, baseline, _as_rules(versions), start, end, sensitivity), "time_received")
    rates = [c for c in found.columns if c not in ("id", "prefix", "proto", "time_received")]
    return found.selectExpr(
        "id.id AS rule_id", "coalesce(id.name, '') AS rule_name", "prefix", "proto", *rates, "time_received AS alert_time"
    )
