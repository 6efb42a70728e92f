from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from weirmark.functions import codes, timeslot


def one(spark, sql, **values):
    row = ", ".join(f"{v} AS {k}" for k, v in values.items()) or "1 AS one"
    return spark.sql(f"SELECT {row}").select(F.expr(sql)).first()[0]


@pytest.mark.parametrize("value, want", [
    (0, "EMPTY"), (1, "FIN"), (18, "SYN+ACK"), (1023, "FIN+SYN+RST+PSH+ACK+URG+ECN+CWR+NONCE+RESERVED"),
    (1024, "1024"), (1026, "SYN+1024"), (2147483648, "2147483648"), (3221225473, "FIN+1073741824+2147483648"),
])
def test_tcp_flags(spark, value, want):
    assert one(spark, codes.tcp_flags_text("x"), x=f"{value}L") == want


def test_bitmask(spark):
    assert one(spark, codes.bitmask_to_array("x"), x="2147483649L") == [1, 1 << 31]


def test_names_fall_back_to_numbers(spark):
    assert one(spark, codes.flow_type_name("x"), x=4) == "IPFIX"
    assert one(spark, codes.flow_type_name("x"), x=9) == "9"
    assert one(spark, codes.ether_type_name("x"), x=0x86DD) == "IPv6"
    assert one(spark, codes.ether_type_name("x"), x=1) == "1"
    assert one(spark, codes.tcp_flag_name("x"), x=3) == "3"


def test_forwarding_status(spark):
    assert [one(spark, codes.forwarding_status_name("x"), x=f"{v}L") for v in (0, 64, 128, 192, 256)] == [
        "UNKNOWN", "FORWARDED", "DROPPED", "CONSUMED", "256"]
    for fix, want in (("dropped", "DROPPED"), ("bare_state", "UNKNOWN")):
        status = codes.effective_forwarding_status("s", "hop", "o", fix)
        assert one(spark, codes.forwarding_status_name(status), s="64L", hop="true", o="0L") == want
        assert one(spark, codes.forwarding_status_name(status), s="64L", hop="true", o="1L") == "FORWARDED"


def test_sensitivity_scales(spark):
    got = [one(spark, codes.zscore_limit("x"), x=v) for v in ("'low'", "'medium'", "'high'", "CAST(NULL AS STRING)")]
    assert got == [5, 4, 3, 4]
    assert [codes.baseline_factor(s) for s in ("low", "medium", "high", "odd")] == [3.0, 2.0, 1.5, 1.5]


def test_slots_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        ns = 1704067199_123456789  # one second before 2024 in UTC
        df = spark.sql(f"SELECT {timeslot.from_nanos(f'{ns}L')} AS t").selectExpr(
            "unix_micros(t)", f"unix_seconds({timeslot.slot_start('t', 60)})",
            f"unix_seconds({timeslot.slot_start('t', 600)})", f"unix_seconds({timeslot.slot_start('t', 86400)})",
            f"CAST({timeslot.utc_date('t')} AS STRING)", timeslot.epoch_slot("t", 60))
        assert tuple(df.first()) == (1704067199123456, 1704067140, 1704066600, 1703980800, "2023-12-31", 28401119)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_moments():
    assert timeslot.to_minute(datetime(2024, 1, 1, 0, 1, 59)) == 1704067260
    assert timeslot.to_epoch(datetime(2024, 1, 1, tzinfo=timezone.utc)) == 1704067200


def test_time_range_prunes_date_folders(spark, tmp_path):
    spark.sql("SELECT timestamp_seconds(1704067200 + id * 43200) AS time_received, id FROM range(20)").withColumn(
        "date", F.expr(timeslot.utc_date("time_received"))).write.partitionBy("date").parquet(str(tmp_path / "t"))
    got = timeslot.time_range(spark.read.parquet(str(tmp_path / "t")), 1704067200 + 86400, 1704067200 + 2 * 86400)
    assert sorted(r.id for r in got.collect()) == [2, 3, 4]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(time_received)" in plan
