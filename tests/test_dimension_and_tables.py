from pyspark.sql import functions as F

from weirmark import schema
from weirmark.operators import detect, dimension, prefix, report, retention, rollup
from weirmark.sources import dims, tables


def routers(spark, *rows):
    return spark.createDataFrame(list(rows), schema.ROUTERS)


def rule_rows(spark, *changes):
    base = dict(id="", name="Edge uplinks", prefixes=["198.18.0.0/15"], type="threshold", bandwidth_threshold=7_000_000,
                packet_threshold=1200, duration=4, zscore_sensitivity=None, zscore_target=None)
    return spark.createDataFrame([tuple({**base, "id": f"r{i}", **c}.values()) for i, c in enumerate(changes)], schema.RULES)


def test_rules_are_checked(spark):
    valid, rejected = dimension.check_rules(rule_rows(
        spark,
        {},
        {"type": "zscore", "zscore_sensitivity": "low", "zscore_target": "packets", "bandwidth_threshold": None},
        {"prefixes": ["198.18.0.0/15", "203.0.113.64/26", "2001:DB8:0::/32", "198.51.100.9", "192.0.2.0/255.255.255.0"], "duration": None},
        {"prefixes": []},
        {"type": "burst", "duration": 0},
        {"name": "n" * 257},
        {"prefixes": ["192.0.2.1/24"]},
        {"zscore_sensitivity": "none", "zscore_target": "bytes", "packet_threshold": 0},
        {"prefixes": None, "type": None},
    ))
    assert {r.id: r.prefixes for r in valid.collect()} == {
        "r0": ["198.18.0.0/15"], "r1": ["198.18.0.0/15"],
        "r2": ["198.18.0.0/15", "203.0.113.64/26", "2001:db8::/32", "198.51.100.9/32", "192.0.2.0/24"]}
    assert {r.id: r.reasons for r in rejected.collect()} == {
        "r3": ["prefixes"], "r4": ["type", "duration"], "r5": ["name"], "r6": ["prefixes"],
        "r7": ["packet_threshold", "zscore_sensitivity", "zscore_target"], "r8": ["prefixes", "type"]}
    assert valid.columns == schema.RULES.names


def test_rules_that_never_fire_are_reported(spark):
    rules = rule_rows(spark, {"duration": 61}, {"duration": 62}, {"duration": 900, "type": "zscore"}, {"duration": None})
    assert [r.id for r in detect.never_firing(rules).collect()] == ["r1"]


def test_routers_are_checked(spark):
    valid, rejected = dimension.check_routers(routers(
        spark, ("m", "mux", "203.0.113.7", 4096), ("n", "nox", "2001:DB8::7", 0), ("o", "oak", "203.0.113.256", 1),
        ("p", "pad", "198.51.100.2", -5)))
    assert {r.id: r.router_ip for r in valid.collect()} == {"m": "203.0.113.7", "n": "2001:db8::7"}
    assert {r.id: r.reasons for r in rejected.collect()} == {"o": ["router_ip"], "p": ["default_sampling"]}


def test_upsert_delete_find(spark):
    now = routers(spark, ("k7", "kiln", "198.51.100.7", 64), ("k8", "kelp", "198.51.100.8", 128))
    changes = routers(spark, ("k8", "kelp moved", "198.51.100.18", 256), ("k9", "kite", "198.51.100.9", 32),
                      ("k8", "kelp again", "198.51.100.28", 512)).withColumn(
        "version", F.expr("CASE default_sampling WHEN 512 THEN 4 ELSE 2 END"))
    after = dimension.upsert(now, changes, "version")
    assert {r.id: r.name for r in after.collect()} == {"k7": "kiln", "k8": "kelp again", "k9": "kite"}
    assert dimension.find(after, "k8").first().router_ip == "198.51.100.28"
    left = dimension.delete(after, spark.createDataFrame([("k8",), ("zz",)], "id string"))
    assert sorted(r.id for r in left.collect()) == ["k7", "k9"]
    assert dimension.find(left, "k8").isEmpty()


def test_claims_of_one_batch_are_settled_in_order(spark):
    """Two spellings of one free address, a held one, and a router that keeps its own."""
    now = routers(spark, ("held", "", "2001:db8:0:0::5", 8), ("own", "", "192.0.2.77", 8))
    changes = routers(
        spark, ("late", "", "2001:DB8::99", 1), ("early", "", "2001:db8:0::99", 1), ("thief", "", "2001:DB8::5", 1),
        ("own", "", "192.0.2.77", 9), ("bad", "", "no address", 1), ("early", "", "2001:db8::0:99", 2),
    ).withColumn("version", F.expr("CASE id WHEN 'late' THEN 30 WHEN 'early' THEN 20 ELSE 10 END"))
    free, taken = dimension.new_routers(now, changes)
    assert sorted(r.id for r in free.collect()) == ["bad", "early", "early", "own"]
    assert sorted(r.id for r in taken.collect()) == ["late", "thief"]
    both = now.unionByName(changes.filter("id = 'thief'").drop("version"))
    assert [tuple(r) for r in dimension.router_conflicts(both).collect()] == [("2001:db8::5", 2, "held")]


def test_ids(spark):
    ids = [r[0] for r in spark.range(5).select(dimension.new_id()).collect()]
    assert len(set(ids)) == 5 and all(len(i) == 32 and int(i, 16) >= 0 for i in ids)


def test_protocols(spark, tmp_path):
    packaged = dims.read_protocols(spark)
    assert packaged.count() == 29
    read = dims.read_protocols(spark, str(dims.PROTOCOLS_CSV))
    assert packaged.exceptAll(read).isEmpty() and read.count() == 29


def test_list_prefixes(spark):
    df = rule_rows(spark, {"prefixes": ["10.0.0.0/8", "::/0"]}, {"prefixes": ["::/0"]})
    assert sorted(r.prefix for r in prefix.list_prefixes(df).collect()) == ["10.0.0.0/8", "::/0"]


def test_retention(spark):
    now = 1704067200 + 40 * 86400 + 100
    df = spark.range(12).selectExpr("timestamp_seconds(1704067200 + (id + 5) * 86400 + 86399) AS t", "id + 5 AS day")
    assert sorted(r.day for r in retention.retain(df, "t", 30 * 86400, now).collect()) == [11, 12, 13, 14, 15, 16]
    alert = spark.sql(f"SELECT timestamp_seconds({now} - id * 1800) AS t, id FROM range(5)")
    assert sorted(r.id for r in retention.retain(alert, "t", 3600, now, by_day=False).collect()) == [0, 1]


def test_store_round_trip_and_idempotence(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "store"))
    store.create()
    for name in tables.TABLES:
        assert store.read(name).isEmpty()
    rows = spark.sql("SELECT 'p' AS prefix, timestamp_seconds(1704067200 + id * 43200) AS time_received,"
                     " id AS bytes, id AS packets, 1L AS flows FROM range(10)")
    store.append("prefixes_total_1m", rows, 7)
    store.append("prefixes_total_1m", rows, 7)
    store.append("prefixes_total_1m", rows.limit(2), 8)
    assert store.read("prefixes_total_1m").count() == 12
    assert store.read("prefixes_total_1m", 1704067200 + 86400, 1704067200 + 2 * 86400).count() == 3
    assert store.read("prefixes_total_1m").columns == [*schema.PREFIX_TOTALS.names, "date"]
    dropped = store.drop_expired("prefixes_total_1m", 1704067200 + 31 * 86400)
    assert dropped == ["date=2024-01-01", "date=2024-01-02"]
    assert store.read("prefixes_total_1m").count() == 6
    ranges = prefix.prefix_ranges(rule_rows(spark, {}, {"prefixes": ["::/0"]}))
    store.replace("prefixes_range", ranges)
    store.replace("prefixes_range", ranges.limit(1))
    assert store.read("prefixes_range").count() == 1


def minute_rows(spark, n, gain=1):
    return spark.sql(f"SELECT concat('p', id % 3) AS prefix, timestamp_seconds(1704067200 + id % 50 * 60) AS time_received,"
                     f" id * {gain} AS bytes, id AS packets, 1L AS flows FROM range({n})")


def test_unfinished_jobs_are_invisible(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "store"))
    store.create()
    store.append("prefixes_total_1m", minute_rows(spark, 10), "s.1")
    store.write("prefixes_total_1m", minute_rows(spark, 10, 5), "s.1")  # fails before it is published
    store.write("prefixes_total_1m", minute_rows(spark, 10), "s.2")
    assert store.read("prefixes_total_1m").agg(F.sum("bytes")).first()[0] == 45
    store.append("prefixes_total_1m", minute_rows(spark, 10, 2), "s.1")
    assert store.read("prefixes_total_1m").agg(F.sum("bytes")).first()[0] == 90
    store.append("prefixes_total_1m", minute_rows(spark, 10).limit(0), "s.1")  # the repeat has no rows
    assert store.read("prefixes_total_1m").isEmpty()


def test_merged_days_keep_their_sums(spark, tmp_path):
    store, day = tables.Store(spark, str(tmp_path / "store")), 1704067200 // 86400
    store.create()
    for part in range(6):
        store.append("prefixes_total_1m", minute_rows(spark, 300), f"s.{part}")
    keys = ["prefix", "time_received"]
    before = rollup.merge_partials(store.read("prefixes_total_1m"), keys).collect()
    store.merge_day("prefixes_total_1m", day)
    assert sorted(store.read("prefixes_total_1m").drop("date").collect()) == sorted(before)
    store.append("prefixes_total_1m", minute_rows(spark, 300), "s.9")  # late rows
    store.append("prefixes_total_1m", minute_rows(spark, 300, 3), "s.2")  # a merged part is replaced
    for _ in range(2):
        late = {tuple(r)[:2]: r.flows for r in rollup.merge_partials(store.read("prefixes_total_1m"), keys).collect()}
        assert sum(late.values()) == sum(r.flows for r in before) + 600
        store.merge_day("prefixes_total_1m", day)
    assert store.read("prefixes_total_1m").count() == len(before)


def test_alerts_live_for_an_hour(spark, tmp_path):
    store, now = tables.Store(spark, str(tmp_path / "store")), 1704067200 + 600
    store.create()
    rows = spark.sql(f"SELECT 'r' AS rule_id, 'n' AS rule_name, 'threshold' AS alert_type, 'p' AS prefix,"
                     f" timestamp_seconds({now} - id * 1800) AS alert_time, 1D AS peak_bps, 1D AS peak_pps,"
                     f" true AS is_bandwidth_alert, false AS is_packet_alert FROM range(4)")
    store.append("threshold_alerts", rows, "at.1")
    assert store.read("threshold_alerts").count() == 4
    assert store.live("threshold_alerts", now).count() == 2


def test_sums_beyond_64_bits_do_not_abort(spark):
    big = 5 * 10**18
    raw = spark.createDataFrame(
        [(["a"], 60, big, 1), (["a"], 61, big, 2), (["b"], 60, None, 7), (["b"], 60, 3, 1)],
        "prefixes array<string>, s long, total_bytes long, total_packets long",
    ).withColumn("time_received", F.expr("timestamp_seconds(s)"))
    found = {r.prefix: r for r in rollup.prefix_totals(raw).collect()}
    assert (found["a"].bytes, found["a"].packets, found["a"].flows) == (None, 3, 2)
    assert (found["b"].bytes, found["b"].packets, found["b"].flows) == (3, 8, 2)
    one = rollup.prefix_totals(raw.limit(1))
    assert rollup.merge_partials(one.union(one), ["prefix"]).first().bytes is None
    assert report.rate_series(one, "prefix").first().bps == big * 8 / 60


def test_one_row_for_each_series(spark):
    rates = report.rate_series(minute_rows(spark, 30), "prefix", "pps", 600)
    rows = report.series_points(rates, "prefix", "pps").collect()
    assert sorted(r.prefix for r in rows) == ["p0", "p1", "p2"] and all(len(r.points) == 3 for r in rows)
    assert all(p.time < q.time for r in rows for p, q in zip(r.points, r.points[1:]))
