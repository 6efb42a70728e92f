"""Rules that change, windows that close in a stream, quantiles from histograms."""

import random
import statistics

import pytest
import test_detect as td
from pyspark.sql import functions as F

from weirmark import schema
from weirmark.operators import alerts, report, versions
from weirmark.sources.tables import Store
from weirmark.streaming import pipeline, windows


def history(spark, *changes):
    """(minute, version, deleted, values) each; all of one rule unless the values name another."""
    found = None
    for minute, version, deleted, values in changes:
        row = td.rule(spark, "threshold", **values).withColumns(
            {"valid_from": F.lit(td.stamp(minute)), "version": F.lit(version), "deleted": F.lit(deleted).cast("boolean")}
        )
        found = row if found is None else found.unionByName(row)
    return found


def fired(log):
    rows = log.select("rule_id", "rule_name", F.unix_seconds("alert_time").alias("t")).collect()
    return sorted((r.rule_id, r.rule_name, (r.t - td.T0) // 60) for r in rows)


def test_each_minute_is_judged_by_its_rules(spark):
    totals = td.totals(spark, {m: 600 for m in range(20)})
    over = dict(bandwidth_threshold=80, duration=3)
    versions_of = history(
        spark,
        (-10, 0, None, {**over, "bandwidth_threshold": 81}),
        (5, 1, False, {**over, "name": "one"}),
        (8, 2, False, {**over, "name": "lost", "duration": 1}),  # replaced at the same time
        (8, 3, False, {**over, "name": "two", "duration": 10}),
        (12.5, 4, True, over),  # takes effect at the next full minute
        (15.2, 5, False, {**over, "name": "three"}),
        (15.8, 6, False, {**over, "name": "four"}),  # the one before holds at no full minute
    )
    log = versions.threshold_log_replay(totals, versions_of)
    want = [("r", "one", m) for m in (5, 6, 7)] + [("r", "two", m) for m in range(9, 13)] + [("r", "four", m) for m in range(16, 21)]
    assert fired(log) == sorted(want)
    names = [[r.name for r in versions.rules_as_of(versions_of, td.T0 + m * 60).collect()] for m in (-11, 5, 8, 14, 16)]
    assert names == [[], ["one"], ["two"], [], ["four"]]


def test_replay_equals_grids_between_changes(spark):
    """The pruned replay says what a grid with the rules of each minute says, over chunk edges and long durations."""
    draw = random.Random(3)
    values = {m: (draw.choice((600, 600, 599, 1200)), draw.choice((60, 60, 59))) for m in range(1380, 1500) if draw.random() < 0.9}
    totals = td.totals(spark, values)
    changes = [(m, n, n % 5 == 4, dict(bandwidth_threshold=80, packet_threshold=1, duration=1 + n * 3 % 11, name=f"v{n}"))
               for n, m in enumerate((0, 1390, 1401, 1437, 1439, 1441, 1460, 1461))]
    versions_of = history(spark, *changes)
    got = versions.threshold_log_replay(totals, versions_of)
    want = None
    for (start, n, deleted, kept), after in zip(changes, [c[0] for c in changes[1:]] + [1600]):
        if deleted:
            continue
        one = alerts.threshold_alert_log_grid(
            totals, td.rule(spark, "threshold", **kept), td.T0 + start * 60, td.T0 + (after - 1) * 60)
        want = one if want is None else want.unionByName(one)
    assert not want.isEmpty() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_evaluation_of_a_past_span_uses_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create()
    store.append("prefixes_total_1m", td.totals(spark, {m: 600 for m in range(10)}), 0)
    over = dict(bandwidth_threshold=80, duration=1)
    then = history(spark, (0, 0, False, over), (4, 1, True, over))
    dims = pipeline.Dimensions(lambda: None, lambda: versions.rules_as_of(then), lambda: None, lambda: then)
    pipeline.evaluate_span(store, dims, td.T0, td.T0 + 9 * 60)
    assert [m for _, _, m in fired(store.read("threshold_alerts"))] == [0, 1, 2, 3]


def test_no_versions_no_alerts(spark):
    empty = spark.createDataFrame([], schema.RULES).selectExpr(
        "*", "CAST(NULL AS TIMESTAMP) AS valid_from", "0 AS version", "false AS deleted")
    assert versions.threshold_log_replay(td.totals(spark, {0: 600}), empty).isEmpty()


def flows(spark, *rows):
    """(minute, prefixes, bytes) each."""
    return spark.createDataFrame(
        [(td.stamp(m), p, b, 1) for m, p, b in rows], "time_received timestamp, prefixes array<string>, total_bytes long, total_packets long")


def test_windows_close_once_over_restarts(spark, tmp_path):
    root, everything = str(tmp_path), None

    def arrive(*rows):
        nonlocal everything
        batch = flows(spark, *rows)
        everything = batch if everything is None else everything.unionByName(batch)
        batch.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        windows.start_cascade(stream, root, availableNow=True)
        return {
            name: sorted(((int(r.time_received.timestamp()) - td.T0) // 60, r.prefix, r.bytes, r.flows)
                         for r in windows.read_closed(spark, root, name).collect())
            for name in windows.LEVELS
        }

    assert arrive((0, ["a", "b"], 5), (1, ["a"], 6)) == {"1m": [], "10m": [], "1d": []}
    got = arrive((0.5, ["a"], 7), (1441, ["a"], 1))  # in time for minute 0
    assert got["1m"] == [(0, "a", 12, 2), (0, "b", 5, 1), (1, "a", 6, 1)] and got["10m"] == []
    got = arrive((0, ["a", "c"], 100), (2900, ["a"], 2), (5800, [], 0))  # minute 0 is closed
    assert got["1m"][:3] == [(0, "a", 12, 2), (0, "b", 5, 1), (1, "a", 6, 1)] and (0, "c", 100, 1) not in got["1m"]
    assert got["1m"][3:] == [(1441, "a", 1, 1), (2900, "a", 2, 1)]
    day = [(0, "a", 18, 3), (0, "b", 5, 1)]
    assert got["10m"] == [*day, (1440, "a", 1, 1)] and got["1d"] == day
    got = arrive((5805, ["z"], 1), (9000, ["z"], 1))
    assert got["1m"][5:] == [(5805, "z", 1, 1)] and got["10m"][3:] == [(2900, "a", 2, 1)] and got["1d"][2:] == [(1440, "a", 1, 1)]
    totals = windows_totals(everything)
    late = windows.late_partials(totals, windows.read_closed(spark, root, "1m"), F.lit(td.stamp(1000)))
    assert sorted((r.prefix, r.bytes, r.packets, r.flows) for r in late.collect()) == [("a", 100, 1, 1), ("c", 100, 1, 1)]


def windows_totals(tagged):
    from weirmark.operators import rollup

    return rollup.prefix_totals(tagged)


@pytest.mark.parametrize("days", [1, 3])
def test_quantiles_from_histograms(spark, days):
    draw = random.Random(days)
    rows = [(key, td.stamp(draw.randrange(days * 1440)), draw.choice((None, float(draw.randrange(40)), draw.random())))
            for key in ("a", "b", None) for _ in range(500)] + [("none", td.stamp(0), None), ("one", td.stamp(1), 4.0)]
    df = spark.createDataFrame(rows, "key string, time timestamp, bps double")
    histograms = report.value_histogram(df, ["key"], "bps")
    assert histograms.groupBy("key").agg(F.count_distinct("day").alias("n")).agg(F.max("n")).first()[0] == days
    got = {r.key: r for r in report.histogram_summary(report.merge_histograms(histograms, ["key"], "bps"), ["key"], "bps").collect()}
    want = {r.key: r for r in df.groupBy("key").agg(
        F.percentile("bps", 0.95).alias("p"), F.min("bps").alias("min"), F.max("bps").alias("max")).collect()}
    assert set(got) == set(want)
    for key, row in want.items():
        values = [v for k, _, v in rows if k == key and v is not None]
        assert (got[key]["min"], got[key]["max"]) == (row["min"], row["max"])
        assert got[key]["quantile"] == (pytest.approx(row.p, rel=1e-12) if values else None)
        assert got[key]["mean"] == (pytest.approx(statistics.fmean(values)) if values else None)
    assert got["one"]["quantile"] == got["one"]["last"] == 4.0 and got["none"]["last"] is None
    assert report.histogram_summary(report.merge_histograms(histograms.limit(0), ["key"], "bps"), ["key"], "bps").isEmpty()
