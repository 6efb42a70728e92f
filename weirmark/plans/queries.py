"""Registered queries: every operator over the whole derived tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmark.functions import codes, ip, timeslot
from weirmark.operators import alerts, detect, dimension, enrich, prefix, report, retention, rollup, table_functions, versions
from weirmark.plans import fixture as fx
from weirmark.plans.fixture import BASE_US, DENSE, NATURAL
from weirmark.session import checkpoint_folder
from weirmark.sources import flows as sources
from weirmark.sources.tables import Store
from weirmark.streaming import pipeline, stateful, windows

BASE = BASE_US // 1_000_000
AS_OF_DENSE = BASE + 603 * 60 + 17  # inside the dense spike
AS_OF_NATURAL = BASE + (28 * 1440 + 5) * 60 + 5  # just inside the natural spike
RETENTION_NOW = BASE + 40 * 86400 + 3600
ONE_PREFIX = "10.0.0.0/8"


def _index(spark: SparkSession, d: str) -> prefix.PrefixIndex:
    return prefix.index_prefixes(prefix.prefix_ranges(fx.rules(spark, d)))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return fx.flows(spark, d).selectExpr(
        "sequence_num",
        f"{ip.ip_key('dst_addr', 'etype')} AS dst_addr",
        f"{ip.ip_family('dst_addr', 'etype')} AS family",
    )


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return rollup.prefix_totals(fx.tagged(spark, d))


def _classes(spark: SparkSession, d: str, timing: str = DENSE) -> DataFrame:
    return rollup.class_profile(fx.tagged(spark, d, timing))


def enrich_flows(spark: SparkSession, d: str) -> DataFrame:
    raw = enrich.enrich_flows(
        fx.flows(spark, d), fx.routers(spark, d), _index(spark, d), fx.protocols(spark)
    )
    return raw.selectExpr(
        "sequence_num",
        "type_str",
        "sampler_address_str",
        "time_received",
        "time_flow_start",
        "time_flow_end",
        "total_bytes",
        "total_packets",
        "lower(hex(src_addr)) AS src_addr",
        "src_addr_str",
        "lower(hex(dst_addr)) AS dst_addr",
        "dst_addr_str",
        "etype_str",
        "proto_str",
        "tcp_flags_str",
        "lower(hex(next_hop)) AS next_hop",
        "forwarding_status_str",
        "array_join(prefixes, ' ') AS prefixes",
    )


def enrich_sampling(spark: SparkSession, d: str) -> DataFrame:
    scaled = enrich.scale_samples(fx.flows(spark, d), fx.routers(spark, d))
    return scaled.select("sequence_num", "sampling_rate", "total_bytes", "total_packets")


def flow_code_names(spark: SparkSession, d: str) -> DataFrame:
    flows, protocols = fx.flows(spark, d), fx.protocols(spark)
    raw_fix = codes.effective_forwarding_status(
        "forwarding_status", ip.is_all_zero("next_hop"), "out_if", "bare_state"
    )
    return enrich.decode_names(flows, protocols).selectExpr(
        "sequence_num",
        "type_str",
        "etype_str",
        "proto_str",
        "forwarding_status_str",
        f"{codes.forwarding_status_name(raw_fix)} AS forwarding_unfixed",
    )


def tcp_flag_names(spark: SparkSession, d: str) -> DataFrame:
    return fx.flows(spark, d).selectExpr(
        "sequence_num",
        f"{codes.tcp_flags_text('tcp_flags')} AS tcp_flags_str",
        f"array_join({codes.bitmask_to_array('tcp_flags')}, ',') AS bits",
        f"{codes.tcp_flag_name('tcp_flags')} AS as_single_flag",
    )


def address_text(spark: SparkSession, d: str) -> DataFrame:
    texts = {
        "sampler": ("sampler_address", None),
        "src": ("src_addr", "etype"),
        "dst": ("dst_addr", "etype"),
    }
    return ip.with_ip_text(fx.flows(spark, d), texts).select("sequence_num", *texts)


def cidr_ranges(spark: SparkSession, d: str) -> DataFrame:
    return prefix.prefix_ranges(fx.rules(spark, d)).selectExpr(
        "prefix", "family", "length", "lower(hex(start)) AS start_hex", "lower(hex(end)) AS end_hex"
    )


def prefix_match_all(spark: SparkSession, d: str) -> DataFrame:
    matched = prefix.match_prefixes(_keyed(spark, d), _index(spark, d), "dst_addr", "family")
    return matched.selectExpr("sequence_num", "array_join(prefixes, ' ') AS prefixes")


def prefix_match_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """The way taken when the prefix table is too large to broadcast."""
    matched = prefix.match_prefixes(
        _keyed(spark, d), _index(spark, d), "dst_addr", "family", max_rows=0
    )
    return matched.selectExpr("sequence_num", "array_join(prefixes, ' ') AS prefixes")


def prefix_longest_match(spark: SparkSession, d: str) -> DataFrame:
    matched = prefix.match_prefixes(_keyed(spark, d), _index(spark, d), "dst_addr", "family")
    return matched.selectExpr("sequence_num", f"{prefix.longest_prefix('prefixes')} AS prefix")


def prefixes_by_address(spark: SparkSession, d: str) -> DataFrame:
    found = prefix.prefixes_by_address(_keyed(spark, d), _index(spark, d), "dst_addr", "family")
    return found.selectExpr(
        "lower(hex(dst_addr)) AS dst_addr", "array_join(prefixes, ' ') AS prefixes"
    )


def prefix_totals_1m(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d)


def prefix_totals_from_partials(spark: SparkSession, d: str) -> DataFrame:
    """Partials as seven arriving batches would leave them, merged on read."""
    parts = (
        fx.tagged(spark, d)
        .selectExpr(
            "explode(prefixes) AS prefix",
            f"{timeslot.slot_start('time_received', 60)} AS time_received",
            "sequence_num % 7 AS batch",
            "total_bytes",
            "total_packets",
        )
        .groupBy("batch", "prefix", "time_received")
        .agg(
            F.sum("total_bytes").alias("bytes"),
            F.sum("total_packets").alias("packets"),
            F.count("*").alias("flows"),
        )
    )
    return rollup.merge_partials(parts, ["prefix", "time_received"])


def source_profile_10m(spark: SparkSession, d: str) -> DataFrame:
    return rollup.source_profile(fx.tagged(spark, d))


def class_profile_1m(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d)


def class_profile_map(spark: SparkSession, d: str) -> DataFrame:
    return rollup.unpack_classes(rollup.pack_classes(_classes(spark, d)))


def class_profile_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Parallel arrays and back."""
    packed = rollup.pack_classes(_classes(spark, d))
    arrays = [f"transform(map_values(classes), v -> v.{c}) AS {c}" for c in rollup.SUMS]
    nested = packed.selectExpr(
        "prefix", "time_received", f"struct(map_keys(classes) AS proto, {', '.join(arrays)}) AS protoMap"
    )
    return rollup.unzip_classes(nested)


def daily_baseline(spark: SparkSession, d: str) -> DataFrame:
    return rollup.daily_baseline(_classes(spark, d, NATURAL))




def static_alerts(spark: SparkSession, d: str) -> DataFrame:
    return detect.static_threshold_alerts(_totals(spark, d), fx.rules(spark, d), AS_OF_DENSE)


def static_alerts_grid(spark: SparkSession, d: str) -> DataFrame:
    return detect.static_threshold_grid(_totals(spark, d), fx.rules(spark, d))


def zscore_alerts(spark: SparkSession, d: str) -> DataFrame:
    return detect.dynamic_threshold_alerts(_totals(spark, d), fx.rules(spark, d), AS_OF_DENSE)


def zscore_alerts_grid(spark: SparkSession, d: str) -> DataFrame:
    return detect.dynamic_threshold_grid(_totals(spark, d), fx.rules(spark, d))


def ddos_alerts(spark: SparkSession, d: str) -> DataFrame:
    profile = _classes(spark, d, NATURAL)
    baseline = rollup.daily_baseline(profile)
    return detect.ddos_alerts(profile, baseline, fx.rules(spark, d), AS_OF_NATURAL)


def ddos_alerts_grid(spark: SparkSession, d: str) -> DataFrame:
    profile = _classes(spark, d, NATURAL)
    baseline = rollup.daily_baseline(profile)
    return detect.ddos_grid(profile, baseline, fx.rules(spark, d))


def burst_alerts(spark: SparkSession, d: str) -> DataFrame:
    return detect.burst_alerts(_classes(spark, d), fx.rules(spark, d), AS_OF_DENSE, "medium")


def burst_alerts_grid(spark: SparkSession, d: str) -> DataFrame:
    return detect.burst_grid(_classes(spark, d), fx.rules(spark, d), sensitivity="medium")


def _called(spark: SparkSession, d: str, call: str, timing: str = DENSE) -> DataFrame:
    """A detector called from SQL, over views of the derived tables."""
    profile = _classes(spark, d, timing)
    views = {
        "view_totals": _totals(spark, d),
        "view_profile": profile,
        "view_baseline": rollup.daily_baseline(profile),
        "view_rules": fx.rules(spark, d),
    }
    for name, rows in views.items():
        rows.createOrReplaceTempView(name)
    table_functions.register_detectors(spark, *views)
    return spark.sql(f"SELECT * FROM {call}")


def sql_static_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _called(spark, d, f"static_threshold_alerts_at(timestamp_seconds({AS_OF_DENSE}L))")


def sql_zscore_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _called(spark, d, f"dynamic_threshold_alerts_at(timestamp_seconds({AS_OF_DENSE}L))")


def sql_ddos_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _called(spark, d, f"ddos_alerts_at(timestamp_seconds({AS_OF_NATURAL}L))", NATURAL)


def sql_burst_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _called(spark, d, f"burst_alerts_at(timestamp_seconds({AS_OF_DENSE}L), sensitivity => 'medium')")


def threshold_alert_log(spark: SparkSession, d: str) -> DataFrame:
    return alerts.threshold_alert_log(_totals(spark, d), fx.rules(spark, d), AS_OF_DENSE)


def threshold_alert_log_grid(spark: SparkSession, d: str) -> DataFrame:
    return alerts.threshold_alert_log_grid(_totals(spark, d), fx.rules(spark, d))


def threshold_replay_versions(spark: SparkSession, d: str) -> DataFrame:
    """The log of a past half day in which rules were changed, deleted and turned into others."""
    return versions.threshold_log_replay(_totals(spark, d), fx.rule_versions(spark, d))


def ddos_replay_versions(spark: SparkSession, d: str) -> DataFrame:
    """Week-over-week alerts of a month; the rules hold from or up to its twenty-ninth day."""
    profile = _classes(spark, d, NATURAL)
    baseline = rollup.daily_baseline(profile)
    later = fx.rule_versions(spark, d).withColumn("valid_from", F.expr("valid_from + INTERVAL '28' DAY - INTERVAL '10' HOUR"))
    return versions.ddos_log_replay(profile, baseline, later)


def rules_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Rules in force ten hours and three minutes into the half day."""
    then = versions.rules_as_of(fx.rule_versions(spark, d), BASE + 603 * 60)
    return then.select("id", "name", "type", "bandwidth_threshold", "packet_threshold", "duration")


def threshold_alert_screen(spark: SparkSession, d: str) -> DataFrame:
    return alerts.threshold_alerts(_totals(spark, d), fx.rules(spark, d), AS_OF_DENSE)


def ddos_alert_log(spark: SparkSession, d: str) -> DataFrame:
    profile = _classes(spark, d, NATURAL)
    baseline = rollup.daily_baseline(profile)
    return alerts.ddos_alert_log(profile, baseline, fx.rules(spark, d), AS_OF_NATURAL)


def ddos_alert_log_grid(spark: SparkSession, d: str) -> DataFrame:
    profile = _classes(spark, d, NATURAL)
    baseline = rollup.daily_baseline(profile)
    return alerts.ddos_alert_log_grid(profile, baseline, fx.rules(spark, d))


def ddos_alert_screen(spark: SparkSession, d: str) -> DataFrame:
    profile = _classes(spark, d, NATURAL)
    baseline = rollup.daily_baseline(profile)
    return alerts.ddos_screen(profile, baseline, fx.rules(spark, d), AS_OF_NATURAL)


def rate_series_5m(spark: SparkSession, d: str) -> DataFrame:
    return report.rate_series(_totals(spark, d), "prefix", "bps", 300)


def packet_rate_series(spark: SparkSession, d: str) -> DataFrame:
    return report.rate_series(
        _totals(spark, d), "prefix", "pps", 60, BASE + 3600, BASE + 7200
    )


def class_rate_series(spark: SparkSession, d: str) -> DataFrame:
    return report.rate_series(_classes(spark, d), "proto", "bps", 300, prefix=ONE_PREFIX)


def class_packet_rate_series(spark: SparkSession, d: str) -> DataFrame:
    return report.rate_series(_classes(spark, d), "proto", "pps", 600, prefix=ONE_PREFIX)


def series_summary(spark: SparkSession, d: str) -> DataFrame:
    series = report.rate_series(_totals(spark, d), "prefix", "bps", 60, ordered=False)
    return report.series_summary(series, "prefix").selectExpr(
        "prefix", "min", "max", "round(p95, 3) AS p95", "round(mean, 3) AS mean", "last"
    )


def series_pivot(spark: SparkSession, d: str) -> DataFrame:
    series = report.rate_series(_totals(spark, d), "prefix", "bps", 300, ordered=False)
    points = report.series_points(series, "prefix")
    text = "transform(points, p -> concat(unix_seconds(p.time), '=', CAST(floor(p.bps) AS BIGINT)))"
    return points.selectExpr("prefix", "size(points) AS n_points", f"array_join({text}, ',') AS points")


def prefix_list(spark: SparkSession, d: str) -> DataFrame:
    return prefix.list_prefixes(fx.rules(spark, d))


def _router_changes(spark: SparkSession, d: str) -> DataFrame:
    """Later router versions: every supplier edits one, some edit it twice."""
    return fx.table(spark, d, "supplier").selectExpr(
        "CAST(s_suppkey * 7 % 90 AS STRING) AS id",
        "s_name AS name",
        "concat('192.168.', s_suppkey div 256 % 256, '.', s_suppkey % 256) AS router_ip",
        "CAST(s_nationkey AS BIGINT) AS default_sampling",
        "s_suppkey AS version",
    )


def dim_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return dimension.upsert(fx.routers(spark, d), _router_changes(spark, d), "version").drop(
        "version"
    )


def dim_delete(spark: SparkSession, d: str) -> DataFrame:
    return dimension.delete(fx.routers(spark, d), _router_changes(spark, d))


def _flawed_rules(spark: SparkSession, d: str) -> DataFrame:
    return fx.rules(spark, d).selectExpr(
        "id",
        "CASE WHEN substring(id, 2) % 17 = 3 THEN repeat(name, 20) ELSE name END AS name",
        "CASE substring(id, 2) % 13 WHEN 1 THEN CAST(array() AS ARRAY<STRING>)"
        " WHEN 2 THEN array('10.0.0.1/8') WHEN 3 THEN array('10.0.0.0/8', 'nowhere')"
        " ELSE prefixes END AS prefixes",
        "CASE WHEN substring(id, 2) % 19 = 5 THEN 'other' ELSE type END AS type",
        "CASE WHEN substring(id, 2) % 7 = 4 THEN 0L ELSE bandwidth_threshold END AS bandwidth_threshold",
        "packet_threshold",
        "CASE WHEN substring(id, 2) % 23 = 6 THEN -1L ELSE duration END AS duration",
        "CASE WHEN substring(id, 2) % 29 = 7 THEN 'none' ELSE zscore_sensitivity END AS zscore_sensitivity",
        "CASE WHEN substring(id, 2) % 31 = 8 THEN 'bytes' ELSE zscore_target END AS zscore_target",
    )


def dim_validate_rules(spark: SparkSession, d: str) -> DataFrame:
    valid, rejected = dimension.check_rules(_flawed_rules(spark, d))
    return valid.selectExpr("id", "array_join(prefixes, ' ') AS prefixes", "'' AS reasons").unionByName(
        rejected.selectExpr(
            "id", "array_join(prefixes, ' ') AS prefixes", "array_join(reasons, ' ') AS reasons"
        )
    )


def dim_validate_routers(spark: SparkSession, d: str) -> DataFrame:
    flawed = fx.routers(spark, d).selectExpr(
        "id",
        "name",
        "CASE id % 5 WHEN 1 THEN concat(router_ip, '.7') WHEN 2 THEN"
        " concat('2001:DB8:0:0::', lower(hex(id % 200 + 1))) ELSE router_ip END AS router_ip",
        "CASE WHEN id % 7 = 3 THEN -1L ELSE default_sampling END AS default_sampling",
    )
    valid, rejected = dimension.check_routers(flawed)
    return valid.selectExpr("id", "router_ip", "'' AS reasons").unionByName(
        rejected.selectExpr("id", "router_ip", "array_join(reasons, ' ') AS reasons")
    )


def _shared_addresses(spark: SparkSession, d: str) -> DataFrame:
    return fx.routers(spark, d).withColumn(
        "router_ip", F.expr("concat('10.9.0.', CASE WHEN id % 3 = 0 THEN id % 200 ELSE id END)")
    )


def router_ip_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return dimension.router_conflicts(_shared_addresses(spark, d))


def router_free_addresses(spark: SparkSession, d: str) -> DataFrame:
    # every third change claims one of seven addresses, in two spellings
    shared = "concat('2001:DB8:', CASE WHEN version % 2 = 0 THEN ':' ELSE '0:0::' END, lower(hex(version % 7 + 1)))"
    changes = _router_changes(spark, d).withColumn(
        "router_ip", F.expr(f"CASE WHEN version % 3 = 0 THEN {shared} ELSE router_ip END")
    )
    free, taken = dimension.new_routers(fx.routers(spark, d), changes)
    return free.selectExpr("id", "router_ip", "version", "false AS taken").unionByName(
        taken.selectExpr("id", "router_ip", "version", "true AS taken")
    )


def retention_30d(spark: SparkSession, d: str) -> DataFrame:
    totals = rollup.prefix_totals(fx.tagged(spark, d, NATURAL))
    return retention.retain(
        totals, "time_received", retention.KEEP["prefixes_total_1m"], RETENTION_NOW
    )


#: Rows whose many blocks, or many flows, one task makes.
ROWS_A_TASK, FLOWS_A_FILE = 2_000, 500_000


def _many_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every length from 3 to 32, and of IPv6 from 29 to 128, in one column of prefixes."""
    number = "(167772160 + k % 4 * 65536 + k % 256 * 256 + k % 7)"
    # a row becomes 130 blocks, so few rows are work enough for a task
    suppliers = fx.table(spark, d, "supplier").select("s_suppkey")
    tasks = suppliers.count() // ROWS_A_TASK + 1
    if tasks > 1:
        suppliers = suppliers.repartition(tasks, "s_suppkey")
    lengths = suppliers.selectExpr("s_suppkey AS k", "explode(sequence(3, 32)) AS length")
    net = lengths.selectExpr("length", f"shiftleft(shiftright({number}, 32 - length), 32 - length) AS net")
    parts = ", '.', ".join(f"shiftright(net, {s}) % 256" for s in (24, 16, 8, 0))
    v6 = suppliers.selectExpr(
        f"{0x20010DB8 << 32} + (s_suppkey % 150 + 1) * 65536 AS high", "s_suppkey % 7 + 1 AS low", "explode(sequence(29, 128)) AS length"
    )
    cut = v6.selectExpr(
        "length",
        "lpad(hex(IF(length < 64, shiftleft(shiftright(high, 64 - length), 64 - length), high)), 16, '0') AS h",
        "lpad(hex(IF(length <= 64, 0L, shiftleft(shiftright(low, 128 - length), 128 - length))), 16, '0') AS l",
    )
    groups = ", ".join(f"substring({half}, {at}, 4)" for half in "hl" for at in (1, 5, 9, 13))
    return net.selectExpr(f"array(concat({parts}, '/', length)) AS prefixes").unionByName(
        cut.selectExpr(f"array(concat(lower(concat_ws(':', {groups})), '/', length)) AS prefixes")
    )


def prefix_match_many_lengths(spark: SparkSession, d: str) -> DataFrame:
    """More lengths than the chain of lookups takes, so the match goes by distinct address."""
    index = prefix.index_prefixes(prefix.prefix_ranges(_many_prefixes(spark, d)))
    found = prefix.match_prefixes(_keyed(spark, d), index, "dst_addr", "family")
    return found.selectExpr("sequence_num", "size(prefixes) AS n_prefixes", "array_join(prefixes, ' ') AS prefixes")


# --- the live half, over a store of its own in the shared folder ---


def _store(spark: SparkSession) -> Store:
    store = Store(spark, f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}")
    store.create()
    return store


def _dimensions(spark: SparkSession, d: str) -> pipeline.Dimensions:
    return pipeline.Dimensions(
        lambda: fx.routers(spark, d), lambda: fx.rules(spark, d), lambda: fx.protocols(spark)
    )


def stored_totals_merged(spark: SparkSession, d: str) -> DataFrame:
    """Totals of seven parts, one of them written twice, after their days were merged."""
    store = _store(spark)
    # all parts read the tagged flows back, so the tables that tag them are sent around once
    tagged = fx.tagged(spark, d).select("sequence_num", "time_received", "prefixes", "total_bytes", "total_packets").checkpoint()
    for part in (*range(7), 3):
        share = tagged.filter(f"sequence_num % 7 = {part}")
        store.append("prefixes_total_1m", rollup.prefix_totals(share), part)
    for day in (BASE // 86400, BASE // 86400 + 1):
        store.merge_day("prefixes_total_1m", day)
    return store.read("prefixes_total_1m").drop("date")


def stream_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """Totals that the ingest stream leaves behind; the flows come in four lots of files."""
    store, folder = _store(spark), f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    files = fx.table(spark, d, "events").count() // (4 * FLOWS_A_FILE) + 1
    for part in range(4):
        share = fx.flows(spark, d).filter(f"sequence_num % 4 = {part}")
        share = share.coalesce(1) if files == 1 else share.repartition(files, "sequence_num")
        share.write.mode("append").parquet(f"{folder}/in")
    flows = sources.file_flows(spark, f"{folder}/in", max_files=files)
    dims = _dimensions(spark, d)
    pipeline.start_ingest(flows, store, dims, f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return rollup.merge_partials(store.read("prefixes_total_1m"), ["prefix", "time_received"])


def baseline_job(spark: SparkSession, d: str) -> DataFrame:
    """Baselines learnt day by day from stored partials."""
    store, profile = _store(spark), _classes(spark, d, NATURAL)
    for part in range(2):
        store.append("prefixes_proto_profile_1m", profile.filter(f"pmod(hash(prefix), 2) = {part}"), part)
    for day in range(30):
        pipeline.learn_baseline(store, BASE + day * 86400)
    return store.read("prefixes_proto_profile_1d").drop("date")


def evaluation_log(spark: SparkSession, d: str) -> DataFrame:
    """The stored log of an evaluation for every minute of two spans that meet."""
    store, dims = _store(spark), _dimensions(spark, d)
    store.append("prefixes_total_1m", _totals(spark, d), 0)
    for start, end in ((BASE, BASE + 36_000 - 60), (BASE + 36_000, BASE + 172_800)):
        pipeline.evaluate_span(store, dims, start, end)
    return store.read("threshold_alerts").drop("date")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The alert log of a stream of rollup partials, judged from the minutes that each prefix keeps in state.

    The partials come in four files of three hours; a seventh of the last eight minutes of each arrives
    with the next file. A last row, a day later, closes all minutes.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    store, folder = _store(spark), f"{checkpoint_folder(spark)}/stateful-{uuid.uuid4().hex}"
    minute = f"(unix_seconds(time_received) - {BASE}) div 60"
    slow = "CASE WHEN sequence_num % 7 = 3 THEN 8 ELSE 0 END"
    tagged = fx.tagged(spark, d).withColumn("_file", F.expr(f"least(3, ({minute} + {slow}) div 180)"))
    exploded = tagged.selectExpr(
        "_file", "explode(prefixes) AS prefix", f"{timeslot.slot_start('time_received', 60)} AS time_received", "total_bytes", "total_packets"
    )
    sums = [F.sum("total_bytes").alias("bytes"), F.sum("total_packets").alias("packets"), F.count("*").alias("flows")]
    parts = exploded.groupBy("_file", "prefix", "time_received").agg(*sums).checkpoint()
    for part in range(4):
        parts.filter(f"_file = {part}").drop("_file").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    last = f"SELECT '' AS prefix, timestamp_seconds({BASE + 3 * 86400}L) AS time_received, 0L AS bytes, 0L AS packets, 0L AS flows"
    spark.sql(last).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(parts.drop("_file").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stateful.start_stateful_evaluation(stream, store, _dimensions(spark, d), f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return store.read("threshold_alerts").drop("date")


def windows_in_stream(spark: SparkSession, d: str) -> DataFrame:
    """Closed minutes, ten minutes and days of a stream of flows, and what came too late for them.

    The flows come in four files of three hours. A seventh of the last eight minutes of each is in the
    next file, in time; an eleventh of the first three hours is in the last one, too late. Rows of later
    days close all windows.
    """
    root = f"{checkpoint_folder(spark)}/windows-{uuid.uuid4().hex}"
    minute = f"(unix_seconds(time_received) - {BASE}) div 60"
    slow = "CASE WHEN sequence_num % 7 = 3 THEN 8 ELSE 0 END"
    file = f"CASE WHEN sequence_num % 11 = 5 AND {minute} < 172 THEN 3 ELSE least(3, ({minute} + {slow}) div 180) END"
    tagged = fx.tagged(spark, d).select("time_received", "prefixes", "total_bytes", "total_packets", F.expr(file).alias("_file"))
    tagged = tagged.checkpoint()
    for part in range(4):
        tagged.filter(f"_file = {part}").drop("_file").coalesce(1).write.mode("append").parquet(f"{root}/in")
    ends = ", ".join(f"timestamp_seconds({BASE + day * 86400}L)" for day in (3, 5, 7, 9))
    last = f"SELECT explode(array({ends})) AS time_received, array('') AS prefixes, 0L AS total_bytes, 0L AS total_packets"
    spark.sql(last).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(tagged.drop("_file").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    windows.start_cascade(stream, root, availableNow=True)
    closed = {name: windows.read_closed(spark, root, name) for name in windows.LEVELS}
    totals = rollup.prefix_totals(tagged)
    late = windows.late_partials(totals, closed["1m"], F.expr(f"timestamp_seconds({BASE + 86400}L)"))
    found = late.withColumn("level", F.lit("late"))
    for name, rows in closed.items():
        found = found.unionByName(rows.withColumn("level", F.lit(name)))
    return found.filter("prefix <> ''")


def rollup_with_out_of_range(spark: SparkSession, d: str) -> DataFrame:
    """Totals where some flows' bytes, and some minutes' sums, do not fit 64 bits."""
    large = "CASE WHEN sequence_num % 50 = 7 THEN NULL WHEN sequence_num % 10 = 3 THEN 5000000000000000000L ELSE total_bytes END"
    tagged = fx.tagged(spark, d).withColumn("total_bytes", F.expr(large))
    return rollup.merge_partials(rollup.prefix_totals(tagged), ["prefix", "time_received"])


QUERIES = {
    f.__name__: f
    for f in (
        enrich_flows,
        enrich_sampling,
        flow_code_names,
        tcp_flag_names,
        address_text,
        cidr_ranges,
        prefix_match_all,
        prefix_match_shuffled,
        prefix_match_many_lengths,
        prefix_longest_match,
        prefixes_by_address,
        prefix_totals_1m,
        prefix_totals_from_partials,
        source_profile_10m,
        class_profile_1m,
        class_profile_map,
        class_profile_arrays,
        daily_baseline,
        static_alerts,
        static_alerts_grid,
        zscore_alerts,
        zscore_alerts_grid,
        ddos_alerts,
        ddos_alerts_grid,
        burst_alerts,
        burst_alerts_grid,
        sql_static_alerts,
        sql_zscore_alerts,
        sql_ddos_alerts,
        sql_burst_alerts,
        threshold_alert_log,
        threshold_alert_log_grid,
        threshold_replay_versions,
        ddos_replay_versions,
        rules_as_of,
        threshold_alert_screen,
        ddos_alert_log,
        ddos_alert_log_grid,
        ddos_alert_screen,
        rate_series_5m,
        packet_rate_series,
        class_rate_series,
        class_packet_rate_series,
        series_summary,
        series_pivot,
        prefix_list,
        dim_upsert_latest,
        dim_delete,
        dim_validate_rules,
        dim_validate_routers,
        router_ip_conflicts,
        router_free_addresses,
        retention_30d,
        stored_totals_merged,
        stream_equals_batch,
        baseline_job,
        evaluation_log,
        stateful_evaluation,
        windows_in_stream,
        rollup_with_out_of_range,
    )
}
