"""Evaluation with state per prefix: restarts, late partials, quiet minutes."""

import test_detect as td
from pyspark import cloudpickle
from pyspark.sql import functions as F

from weirmark import schema
from weirmark.plans import queries as q
from weirmark.sources.tables import Store
from weirmark.streaming import pipeline, stateful


def test_windows_of_a_minute():
    minutes = {m: (600 + m, None if m == 3 else 60) for m in range(10)}
    row = stateful.window_row("p", 9, minutes, 3)
    assert [x["_t"] for x in row["_seen"]] == [6, 7, 8, 9] and row["samples"] == 4
    assert row["short_avg_pps"] == 1.0 and row["long_avg_pps"] == 1.0 and row["long_stddev_pps"] == 0.0
    assert stateful.window_row("p", 11, minutes, 3)["_seen"] == []  # two quiet minutes
    assert stateful.window_row("p", 15, minutes, 3) is None


def test_windows_of_many_minutes_are_those_of_each():
    minutes = {m: (None if m % 7 == 3 else (1 << 61) + m, m * m) for m in range(0, 300, 2)}
    rows = list(stateful.window_rows("p", range(-2, 320), minutes, 60))
    assert [r[1] for r in rows] == list(range(0, 298 + 6))
    for row in rows:
        t, named = row[1], dict(zip(stateful.COLUMNS, row))
        for unit, k, scale in (("bps", 0, 8 / 60), ("pps", 1, 1 / 60)):
            known = {m: v[k] for m, v in minutes.items() if v[k] is not None and m <= t}
            long = [v for m, v in known.items() if t - 240 <= m < t - 5]
            short = [v for m, v in known.items() if m >= t - 5]
            assert named[f"peak_{unit}"] == (max(short) * scale if short else None)
            assert named[f"long_avg_{unit}"] == (sum(long) * scale / len(long) if long else None)
        assert named["_m"].tolist() == ([m for m in minutes if t - 60 <= m <= t] if t < 300 else [])


def test_workers_need_no_copy_of_the_library():
    assert b"weirmark.operators" not in cloudpickle.dumps(stateful.MinuteWindows(60))


def test_restart_and_late_partials(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", q.ROCKSDB)
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    rules = td.rule(spark, "threshold", bandwidth_threshold=80, duration=3)
    dims = pipeline.Dimensions(lambda: None, lambda: rules, lambda: None)
    source = str(tmp_path / "in")

    def arrive(values):
        td.totals(spark, values).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema.PREFIX_TOTALS).option("maxFilesPerTrigger", 1).parquet(source)
        stateful.start_stateful_evaluation(stream, store, dims, str(tmp_path / "cp"), availableNow=True).awaitTermination()
        rows = store.read("threshold_alerts").orderBy("alert_time").collect()
        return [(int(r.alert_time.timestamp()) - td.T0) // 60 for r in rows]

    half = {m: 300 for m in range(4)}
    assert arrive({**half, 20: 1}) == []  # minutes up to 9 are closed, each with half its bytes
    assert arrive({m: 600 for m in range(12, 15)}) == []  # late, but its minutes are still open
    assert arrive({40: 1}) == [14, 15]  # the third minute, and the quiet one after it
    assert arrive({**half, 60: 1}) == [14, 15]  # beyond the watermark: dropped
    rows = store.read("threshold_alerts").collect()
    assert {r.peak_bps for r in rows} == {80.0} and store.read("threshold_alerts").filter(F.col("rule_name") == "Rule").count() == 2
