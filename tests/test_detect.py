"""Detectors on hand-made rollups, and grid = single evaluation at each minute."""

import random

import pytest

from weirmark import schema
from weirmark.operators import alerts, detect, report, rollup

T0 = 1704067200  # a midnight
P = "10.0.0.0/8"


def stamp(minute):
    from datetime import datetime, timezone

    return datetime.fromtimestamp(T0 + minute * 60, tz=timezone.utc)


def totals(spark, values, prefix=P):
    """{minute: bytes} or {minute: (bytes, packets)}"""
    rows = [(prefix, stamp(m), *(v if isinstance(v, tuple) else (v, 0)), 1) for m, v in values.items()]
    return spark.createDataFrame(rows, schema.PREFIX_TOTALS)


def rule(spark, kind, **values):
    base = dict(id="r", name="Rule", prefixes=[P], type=kind, bandwidth_threshold=None, packet_threshold=None,
                duration=None, zscore_sensitivity=None, zscore_target=None)
    return spark.createDataFrame([tuple({**base, **values}.values())], schema.RULES)


def at(minute):
    return T0 + minute * 60 + 30


def static(spark, values, minute, **r):
    rules = rule(spark, "threshold", **{"bandwidth_threshold": 80, "duration": 3, **r})
    return [(a.bandwidth_alert, a.packet_alert, a.peak_bps)
            for a in detect.static_threshold_alerts(totals(spark, values), rules, at(minute)).collect()]


def test_static_window(spark):
    over = {m: 600 for m in range(10)}  # exactly 80 bps
    assert static(spark, over, 9) == [(True, False, 80.0)]
    assert static(spark, {**over, 8: 599}, 9) == []
    assert static(spark, {**over, 6: 1}, 9) == [(True, False, 80.0)]  # only the last three rows count
    assert static(spark, {7: 600, 8: 600}, 9) == []  # two rows present
    assert static(spark, {6: 900, 7: 600, 9: 600}, 9) == [(True, False, 120.0)]  # one minute missing
    assert static(spark, {6: 600, 7: 600, 8: 600}, 9) == [(True, False, 80.0)]  # running minute silent
    assert static(spark, over, 9, duration=None) == []
    assert static(spark, over, 9, bandwidth_threshold=None) == []
    assert static(spark, over, 9, prefixes=[P, P], duration=11) == []  # listed twice counts once
    assert static(spark, {m: 600 for m in range(100)}, 99, duration=61) == [(True, False, 80.0)]
    assert static(spark, {m: 600 for m in range(100)}, 99, duration=62) == []
    assert static(spark, {m: (0, 60) for m in range(5)}, 4, packet_threshold=1) == [(False, True, 0.0)]


def test_static_reads_partials(spark):
    half = totals(spark, {m: 300 for m in range(5)})
    rules = rule(spark, "threshold", bandwidth_threshold=80, duration=3)
    assert detect.static_threshold_alerts(half, rules, at(4)).isEmpty()
    assert detect.static_threshold_alerts(half.union(half), rules, at(4)).count() == 1


def zscore(spark, values, minute, **r):
    rules = rule(spark, "zscore", **{"zscore_target": "bits", "zscore_sensitivity": "high", **r})
    return [(a.bandwidth_alert, a.packet_alert)
            for a in detect.dynamic_threshold_alerts(totals(spark, values), rules, at(minute)).collect()]


def wave(count, low=7_500_000, step=750_000):
    return {m: (low + m % 2 * step, 100 + m % 2) for m in range(count)}


def test_zscore_needs_samples_floor_and_deviation(spark):
    spike = {m: (80_000_000, 1) for m in range(30, 36)}
    assert zscore(spark, {**wave(30), **spike}, 35) == [(True, False)]
    assert zscore(spark, {k: v for k, v in {**wave(30), **spike}.items() if k != 5}, 35) == []  # 29 samples
    assert zscore(spark, {**wave(30, 75, 7), **spike}, 35) == []  # under 1 Mbps
    assert zscore(spark, {**wave(30, step=0), **spike}, 35) == []  # no deviation
    assert zscore(spark, {**wave(30), **spike}, 35, zscore_target=None) == []
    packets = {m: (7_500_000, 9000) for m in range(30, 36)}
    assert zscore(spark, {**wave(30), **packets}, 35, zscore_target="packets", zscore_sensitivity=None) == [(False, True)]
    assert zscore(spark, wave(36), 41) == []  # nothing in the short window


def classes(spark, values, proto="udp"):
    rows = [(P, stamp(m), proto, b, b // 100, f) for m, (b, f) in values.items()]
    return spark.createDataFrame(rows, schema.CLASS_PROFILE)


def test_daily_baseline_interpolates_and_truncates(spark):
    profile = classes(spark, {0: (1, 1), 1: (2, 1), 2: (10, 1), 1440: (5, 2)})
    halves = profile.union(profile)  # partials: every value doubles
    rows = {r.time_received.day: r for r in rollup.daily_baseline(halves).collect()}
    assert (rows[1].p95_bytes, rows[1].max_bytes) == (18, 20)  # 18.4 cut
    assert (rows[2].p95_bytes, rows[2].p95_flows) == (10, 4)
    one = rollup.daily_baseline(profile, T0 + 5).collect()
    assert [(r.p95_bytes, r.max_bytes) for r in one] == [(9, 10)]  # 9.2 cut


def test_week_over_week(spark):
    week = 7 * 1440
    profile = classes(spark, {m: (1000, 6) for m in range(60)}).union(
        classes(spark, {week + 10: (1500, 8), week + 11: (1499, 8), week + 12: (1, 10)}))
    base = rollup.daily_baseline(profile)
    rules = rule(spark, "advanced_ddos")
    got = detect.ddos_alerts(profile, base, rules, at(week + 10), "high").collect()
    assert [(r.bps_alert, r.pps_alert, r.fps_alert, r.recommend_bps) for r in got] == [(True, True, False, 200.0)]
    assert detect.ddos_alerts(profile, base, rules, at(week + 11), "high").isEmpty()
    assert [r.fps_alert for r in detect.ddos_alerts(profile, base, rules, at(week + 12), "high").collect()] == [True]
    assert detect.ddos_alerts(profile, base, rules, at(week + 10), "medium").isEmpty()
    assert detect.ddos_alerts(profile, base, rule(spark, "threshold"), at(week + 10), "high").isEmpty()
    log = alerts.ddos_alert_log_grid(profile, base, rules, sensitivity="high").collect()
    assert [r.alert_time.minute for r in log] == [10, 12] and log[0].rule_name == "Rule"


def test_burst(spark):
    profile = classes(spark, {0: (7_500_000, 1), 1: (7_500_000, 1), 4: (15_000_000, 1), 5: (15_000_000, 1)})
    rules = rule(spark, "advanced_ddos")
    got = detect.burst_alerts(profile, rules, at(4), "medium").collect()
    assert [(r.bps_alert, r.fps_alert, r.baseline_bps) for r in got] == [(True, False, 1_000_000.0)]
    assert detect.burst_alerts(profile, rules, at(5), "medium").isEmpty()
    assert detect.burst_alerts(profile, rules, at(2), "medium").isEmpty()  # no row in that minute
    small = classes(spark, {0: (7_000_000, 1), 1: (70_000_000, 1)})
    assert detect.burst_alerts(small, rules, at(1), "medium").isEmpty()  # base under 1 Mbps


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("chunk", [30, 1440])
def test_grid_equals_single_evaluations(spark, chunk):
    rnd = random.Random(11)
    busy = {m: (rnd.choice([8_000_000, 9_000_000, 9_500_000]), rnd.choice([90, 110, 4000]))
            for m in range(120) if rnd.random() < 0.8}
    busy.update({m: (90_000_000, 9000) for m in range(100, 104)})
    df = totals(spark, busy).union(totals(spark, {m: v for m, v in busy.items() if m % 3}, "::/0")).cache()
    rules = rule(spark, "threshold", id="s", bandwidth_threshold=1_100_000, packet_threshold=2, duration=2,
                 prefixes=[P, "::/0"]).union(
        rule(spark, "zscore", id="z", zscore_target="bits", zscore_sensitivity="high", prefixes=[P, "::/0"])).cache()
    minutes = [3, 29, 30, 60, 101, 105, 109, 119, 120, 121, 130]
    columns = ("id", "prefix", "bandwidth_alert", "peak_bps", "packet_alert", "peak_pps")
    for single, grid in ((detect.static_threshold_alerts, detect.static_threshold_grid),
                         (detect.dynamic_threshold_alerts, detect.dynamic_threshold_grid)):
        whole = grid(df, rules, chunk=chunk).cache()
        for m in minutes:
            here = whole.filter(f"unix_seconds(eval_time) = {T0 + m * 60}")
            assert rows_of(here, *columns) == rows_of(single(df, rules, at(m)), *columns), (single.__name__, m)
        part = grid(df, rules, at(60), at(105), chunk=chunk)
        inside = whole.filter(f"unix_seconds(eval_time) BETWEEN {T0 + 3600} AND {T0 + 105 * 60}")
        assert rows_of(part, "eval_time", *columns) == rows_of(inside, "eval_time", *columns)
        assert not whole.isEmpty()


@pytest.mark.parametrize("chunk", [7, 1440])
def test_burst_grid_equals_single_evaluations(spark, chunk):
    rnd = random.Random(5)
    profile = classes(spark, {m: (rnd.choice([8_000_000, 30_000_000]), 3) for m in range(40) if rnd.random() < 0.7}).cache()
    rules = rule(spark, "advanced_ddos")
    whole = detect.burst_grid(profile, rules, sensitivity="high", chunk=chunk).cache()
    assert not whole.isEmpty()
    for m in (0, 5, 6, 7, 8, 13, 14, 20, 21, 22, 39):
        here = whole.filter(f"unix_seconds(time_received) = {T0 + m * 60}")
        assert rows_of(here, *whole.columns) == rows_of(detect.burst_alerts(profile, rules, at(m), "high"), *whole.columns)


def test_alert_of_a_lost_rule_keeps_an_empty_name(spark):
    found = detect.static_threshold_alerts(
        totals(spark, {m: 600 for m in range(5)}), rule(spark, "threshold", bandwidth_threshold=80, duration=3), at(4))
    other = rule(spark, "threshold", id="other")
    assert [r.name for r in alerts._named(found, other).collect()] == [""]


def test_series(spark):
    df = totals(spark, {0: (600, 60), 1: (1200, 60), 5: (60, 1)})
    series = report.rate_series(df, "prefix", "bps", 300)
    assert [(r.time.minute, r.bps) for r in series.collect()] == [(0, 48.0), (5, 1.6)]
    assert [r.pps for r in report.rate_series(df, "prefix", "pps", 60, T0, T0 + 60).collect()] == [1.0, 1.0]
    got = report.series_summary(report.rate_series(df, "prefix"), "prefix").first()
    assert (got["min"], got["max"], got["last"]) == (8.0, 160.0, 8.0)
    wide = report.series_to_columns(series, "prefix", "bps", [P])
    assert wide.columns == ["time", P]


@pytest.mark.parametrize("max_duration, chunk", [(60, 1440), (6, 20), (6, 7)])
def test_streaks_equal_single_evaluations(spark, max_duration, chunk):
    """Gaps, quiet minutes, both limits, every duration around max_duration, streaks across chunk edges."""
    draw = random.Random(chunk)
    values = {m: (draw.choice((600, 600, 600, 599, 1200)), draw.choice((60, 60, 59))) for m in range(60) if draw.random() < 0.85}
    rules = rule(spark, "threshold", bandwidth_threshold=80, packet_threshold=1, duration=1)
    for d in range(2, 10):
        rules = rules.unionByName(rule(spark, "threshold", id=f"r{d}", bandwidth_threshold=80, packet_threshold=1 if d % 2 else None, duration=d))
    rows = totals(spark, values)
    found = sorted((int(r[0].timestamp()), *r[1:]) for r in detect.static_threshold_grid(
        rows, rules, at(0), at(70), max_duration, chunk).collect())
    want = []
    for m in range(71):
        low = {t: v for t, v in values.items() if t <= m}
        for d in range(1, 10):
            reach = min(d, max_duration)
            seen = [low[t] for t in sorted(low) if t >= m - reach]
            last = seen[-d:]
            bits = len(seen) >= d and all(b >= 600 for b, _ in last)
            packets = len(seen) >= d and all(p >= 60 for _, p in last) and (d == 1 or d % 2 == 1)
            if bits or packets:
                name = "r" if d == 1 else f"r{d}"
                want.append((T0 + m * 60, name, P, bits, max(b for b, _ in seen) * 8 / 60, packets, max(p for _, p in seen) / 60))
    assert found == sorted(want) and len({f[1] for f in found}) > 3


def test_zscore_moments_are_exact(spark):
    """A steady four hours after a burst deviate by nothing at all, and huge values keep their order."""
    burst = {m: (10**12 + 7919 * m, 1) for m in range(20)}
    steady = {m: (75_000_001, 1) for m in range(20, 320)}
    rules = rule(spark, "zscore", zscore_target="bits", zscore_sensitivity="high")
    values = {**burst, **steady, 320: (75_000_002, 1)}
    grid = detect.dynamic_threshold_grid(totals(spark, values), rules, at(280), at(321))
    assert grid.isEmpty()  # with a deviation of rounding errors the last minute would stand out
    large = {m: (2**62 + (m % 3) * 2**50, 1) for m in range(60)} | {60: (2**63 - 1, 1)}
    for values in ({**wave(60), 60: (2**40, 1)}, large):
        rows = totals(spark, values)
        found = {int(r.eval_time.timestamp()) for r in detect.dynamic_threshold_grid(rows, rules, at(58), at(62)).collect()}
        single = {T0 + m * 60 for m in range(58, 63) if not detect.dynamic_threshold_alerts(rows, rules, at(m)).isEmpty()}
        assert found == single and found


def test_windows_do_not_grow_with_the_rules_of_a_prefix(spark, monkeypatch):
    """Rules of one duration share a window, and the alerts of many rules are dealt to many tasks."""
    monkeypatch.setattr(detect, "RULES_A_TASK", 7)
    values = {m: (600 + m, 60) for m in range(20)}
    rules = rule(spark, "threshold", id="r0", bandwidth_threshold=80, duration=2)
    rules = rules.crossJoin(spark.range(40).withColumnRenamed("id", "n")).selectExpr(
        "concat('r', n) AS id", "concat('Rule ', n) AS name", "prefixes", "type", "80 + n % 3 AS bandwidth_threshold",
        "packet_threshold", "2 + n % 2 AS duration", "zscore_sensitivity", "zscore_target")
    ruled, _ = detect._static_rules(rules, 60)
    assert ruled.tasks == 6
    minutes = detect._chunked(totals(spark, values), ["prefix"], 4, 1440)
    assert detect._lowest(minutes.filter("_chunk = floor(_m / 1440)"), ruled.rows, 60, 1440).count() <= 2 * 21
    grid = detect.static_threshold_grid(totals(spark, values), rules)
    assert grid.rdd.getNumPartitions() == 6
    found = {(r.id, (int(r.eval_time.timestamp()) - T0) // 60) for r in grid.collect()}
    want = set()
    for n in range(40):
        over = [m for m in range(20) if (600 + m) * 8 / 60 >= 80 + n % 3]
        d = 2 + n % 2
        want |= {(f"r{n}", m) for m in range(21) if sum(t in over for t in range(m - d, m + 1)) >= d and (m in over or m == 20)}
    assert found == want


def test_log_names_rules_that_share_an_id(spark):
    rules = rule(spark, "threshold", bandwidth_threshold=80, duration=1)
    both = rules.unionByName(rule(spark, "zscore", name="Other", zscore_target="bits"))
    rows = totals(spark, {m: 600 for m in range(3)})
    assert {r.rule_name for r in alerts.threshold_alert_log_grid(rows, both).collect()} == {"Rule", "Other"}
    nameless = rule(spark, "threshold", id=None, bandwidth_threshold=80, duration=1)
    assert {r.rule_name for r in alerts.threshold_alert_log_grid(rows, nameless).collect()} == {""}
