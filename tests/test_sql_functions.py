from weirmark.functions import sql


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql(
        "SELECT ip_text(X'0A010203'), ip_text(unhex(concat('20010db8', repeat('00', 11), '01'))),"
        " hex(ip_key(X'0A010203')), flow_type_name(4), ether_type_name(2048), tcp_flag_name(2),"
        " tcp_flags_text(18), forwarding_status_name(128), zscore_limit('low'),"
        " protocol_name(17), protocol_name(251)"
    ).first()
    assert tuple(row) == ("10.1.2.3", "2001:db8::1", "00" * 12 + "0A010203", "IPFIX", "IPv4", "SYN",
                          "SYN+ACK", "DROPPED", 5, "UDP", "251")


def test_detectors_prune_by_the_argument(spark, tmp_path):
    """Bounds that follow from as_of reach the scan, the date folder among them; arguments may be named."""
    from weirmark.operators import table_functions

    rows = "prefix string, time_received timestamp, bytes long, packets long, flows long"
    spark.sql("SELECT '10.0.0.0/8' AS prefix, timestamp_seconds(1704067200 + 60 * id) AS time_received, 600L AS bytes, 1L AS packets,"
              " 1L AS flows, date_from_unix_date(19723 + id div 1440) AS date FROM range(4000)").write.partitionBy("date").parquet(str(tmp_path / "t"))
    spark.read.schema(f"{rows}, date date").parquet(str(tmp_path / "t")).createOrReplaceTempView("t_totals")
    spark.sql("SELECT 'r' AS id, array('10.0.0.0/8') AS prefixes, 'threshold' AS type, 80L AS bandwidth_threshold, NULL AS packet_threshold,"
              " d AS duration, NULL AS zscore_sensitivity, NULL AS zscore_target FROM VALUES (5L), (9L), (61L), (62L) AS v(d)").createOrReplaceTempView("t_rules")
    spark.sql("SELECT prefix, 'tcp' AS proto, time_received, bytes, packets, flows FROM t_totals").createOrReplaceTempView("t_profile")
    spark.sql("SELECT prefix, proto, time_received, bytes AS p95_bytes, packets AS p95_packets, flows AS p95_flows FROM t_profile").createOrReplaceTempView("t_base")
    table_functions.register_detectors(spark, "t_totals", "t_profile", "t_base", "t_rules")
    call = spark.sql("SELECT * FROM static_threshold_alerts_at(as_of => TIMESTAMP '2024-01-02 12:00:30')")
    assert call.count() == 3
    assert spark.sql("SELECT * FROM static_threshold_alerts_at(TIMESTAMP '2024-01-02 12:00:30', max_duration => 8)").count() == 2
    plan = call._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "time_received" in line)
    assert "date#" in scan.split("PartitionFilters")[1] and "2024-01-02 11:00:00" in scan
    for name in ("dynamic_threshold_alerts_at", "ddos_alerts_at", "burst_alerts_at"):
        assert spark.sql(f"SELECT * FROM {name}(TIMESTAMP '2024-01-02 12:00:30')").isEmpty()
