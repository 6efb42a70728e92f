"""Flows, routers and rules derived from the driver's tables.

The driver has no flow table. Each row of ``events`` becomes one flow message
by a fixed integer rule, each ``customer`` a router and each ``supplier`` a
rule, so that every input grows with the data. ``oracle.py`` states the same
rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirmark import schema
from weirmark.operators.enrich import tag_flows
from weirmark.operators.prefix import index_prefixes, prefix_ranges
from weirmark.sources.dims import read_protocols

BASE_US = 1_704_067_200_000_000  # 2024-01-01 00:00 UTC
DENSE = "dense"  # 30 days squeezed into 12 hours
NATURAL = "natural"

_NET10, _NET192, _NET172 = 167_772_160, 3_232_235_520, 2_886_729_728  # first addresses


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_v6_zero = "X'" + "00" * 16 + "'"


def _v4(number: str) -> str:
    """IPv4 number to wire bytes: four, or sixteen for every second flow."""
    four = f"unhex(lpad(hex({number}), 8, '0'))"
    return f"CASE WHEN n % 2 = 1 THEN rpad({four}, 16, X'00') ELSE {four} END"


def _v6(third: str, fourth: str, last: str) -> str:
    """2001:db8:third:fourth::last as sixteen bytes."""
    groups = [f"lpad(hex({g}), 4, '0')" for g in (third, fourth, last)]
    return f"unhex(concat('20010db8', {groups[0]}, {groups[1]}, '000000000000', {groups[2]}))"


def flows(spark: SparkSession, sf_dir: str, timing: str = DENSE) -> DataFrame:
    """Flow messages in wire layout."""
    epoch = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
    tus = {DENSE: f"{BASE_US} + (us - {BASE_US}) div 60", NATURAL: "us"}[timing]
    spike = {
        DENSE: "mi BETWEEN 600 AND 605 AND u % 4 = 1",
        NATURAL: "mi >= 28 * 1440 AND mi < 28 * 1440 + 180",
    }[timing]
    columns = {
        "type": "n % 6",
        "sequence_num": "n",
        "sampling_rate": "CASE WHEN n % 4 = 0 THEN 0 ELSE 1000 END",
        "sampler_address": _v4(
            f"CASE WHEN n % 8 < 4 THEN {_NET192} ELSE {_NET172} END + u % 65536"
        ),
        "time_received_ns": "tus * 1000",
        "time_flow_start_ns": "tus * 1000 - 2000000000",
        "time_flow_end_ns": "tus * 1000 - 1000000000",
        "bytes": "cents * 64 * gain",
        "packets": "(1 + n % 64) * gain",
        "src_addr": f"CASE WHEN v6 THEN {_v6('65535', 'u % 16', 'n % 256 + 1')}"
        f" ELSE {_v4(f'{_NET192} + u % 16 * 256 + n % 256')} END",
        "dst_addr": f"CASE WHEN v6 THEN {_v6('u % 65000 + 1', '0', 'n % 256 + 1')}"
        f" ELSE {_v4(f'{_NET10} + u % 4 * 65536 + u * 256 + n % 256')} END",
        "etype": "CASE WHEN v6 THEN 34525 WHEN n % 97 = 5 THEN 2054 ELSE 2048 END",
        "proto": "CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 17"
        " WHEN 'error' THEN CASE WHEN v6 THEN 58 ELSE 1 END"
        " WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 47 ELSE 50 END"
        " ELSE CASE WHEN k % 3 = 0 THEN 0 ELSE 132 END END",
        "ip_tos": "n % 8 * 4",
        "ip_ttl": "32 + n % 32",
        "ip_flags": "n % 3",
        "tcp_flags": "k + CASE WHEN n % 50 = 7 THEN 1024 ELSE 0 END",
        "icmp_type": "n % 16",
        "icmp_code": "n % 4",
        "src_port": "1024 + u % 60000",
        "dst_port": "CASE WHEN n % 2 = 0 THEN 443 ELSE 53 END",
        "src_as": "64512 + u % 16",
        "dst_as": "64600 + u % 4",
        "src_net": "CASE WHEN v6 THEN 64 ELSE 24 END",
        "dst_net": "CASE WHEN v6 THEN 48 ELSE 16 END",
        "next_hop": f"CASE WHEN n % 5 = 0 THEN {_v6_zero} ELSE {_v4(f'{_NET172} + n % 256')} END",
        "next_hop_as": "64700 + n % 4",
        "bgp_next_hop": _v6_zero,
        "in_if": "n % 7",
        "out_if": "n % 3",
        "src_mac": "n * 16 + 1",
        "dst_mac": "n * 16 + 2",
        "forwarding_status": "k % 4 * 64",
        "observation_domain_id": "n % 2",
        "observation_point_id": "n % 3",
    }
    kinds = {f.name: f.dataType.simpleString() for f in schema.FLOW.fields}
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "event_id AS n",
            "user_id AS u",
            "event_type",
            f"timestampdiff(MICROSECOND, {epoch}, CAST(ts AS TIMESTAMP_NTZ)) AS us",
            "CAST(round(value * 100) AS BIGINT) AS cents",
            "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k",
            "event_id % 10 = 9 AS v6",
        )
        .selectExpr("*", f"{tus} AS tus")
        .selectExpr("*", f"(tus - {BASE_US}) div 60000000 AS mi")
        .selectExpr("*", f"CASE WHEN {spike} THEN 40 ELSE 1 END AS gain")
        .selectExpr(*[f"CAST({columns[c]} AS {kind}) AS {c}" for c, kind in kinds.items()])
    )


def routers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS id",
        "c_name AS name",
        "concat('192.168.', c_custkey div 256 % 256, '.', c_custkey % 256) AS router_ip",
        "CAST(100 + c_nationkey * 50 AS BIGINT) AS default_sampling",
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = ", ".join(
        f"CASE WHEN {test} THEN concat({parts}) END"
        for test, parts in (
            ("true", "'10.', k % 4, '.', k % 256, '.0/24'"),
            ("k % 2 = 0", "'10.', k div 2 % 4, '.0.0/16'"),
            ("k % 10 < 3", "'10.0.0.0/8'"),
            ("k % 10 = 4", "'0.0.0.0/0'"),
            ("k % 10 = 5", "'10.2.0.0/15'"),
            ("k % 10 = 6", "'10.', k % 4, '.128.0/17'"),
            ("k % 10 = 7", "'10.', k % 4, '.', k % 256, '.128/25'"),
            ("k % 3 <> 0", "'2001:db8:', lower(hex(k % 65000 + 1)), '::/48'"),
            ("k % 10 = 8", "'2001:db8::/33'"),
            ("k % 10 = 9", "'::/0'"),
        )
    )
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_name").selectExpr(
        "concat('r', k) AS id",
        "s_name AS name",
        f"array_compact(array({prefixes})) AS prefixes",
        "CASE k % 3 WHEN 0 THEN 'threshold' WHEN 1 THEN 'zscore' ELSE 'advanced_ddos' END AS type",
        "CAST(CASE WHEN k % 5 <> 4 THEN 100000000 + k % 7 * 150000000 END AS BIGINT)"
        " AS bandwidth_threshold",
        "CAST(CASE WHEN k % 2 = 0 THEN 1500 + k % 5 * 1000 END AS BIGINT) AS packet_threshold",
        "CAST(CASE WHEN k % 11 = 10 THEN NULL WHEN k % 12 = 9 THEN array(30, 60, 61, 62)[k div 12 % 4]"
        " ELSE 1 + k % 4 END AS BIGINT) AS duration",
        "CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END"
        " AS zscore_sensitivity",
        "CASE WHEN k % 2 = 0 THEN 'packets' ELSE 'bits' END AS zscore_target",
    )


def rule_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule as it is, and as some are changed or deleted within the dense half day."""
    k = "CAST(substring(id, 2) AS BIGINT)"
    now = rules(spark, sf_dir)

    def changed(which: str, seconds: str, version: int, deleted: str = "false", **new: str) -> DataFrame:
        columns = [f"{new[c]} AS {c}" if c in new else c for c in now.columns]
        valid = f"timestamp_seconds({BASE_US // 1_000_000}L + {seconds}) AS valid_from"
        return now.filter(which.format(k=k)).selectExpr(
            *columns, valid.format(k=k), f"{version} AS version", f"{deleted.format(k=k)} AS deleted"
        )

    lower = changed("{k} % 2 = 0", "21600 + {k} % 7 * 90", 1, name="concat(name, ' v1')", bandwidth_threshold="bandwidth_threshold div 4")
    other = changed("{k} % 3 = 0", "36120 + {k} % 5 * 30", 2, "{k} % 6 = 0", name="concat(name, ' v2')", type="'zscore'")
    twice = [
        changed("{k} % 4 = 1", "28800", n, duration=f"{n - 2}L", packet_threshold="1000L") for n in (3, 4)
    ]
    versions = changed("true", "-86400", 0)
    for more in (lower, other, *twice):
        versions = versions.unionByName(more)
    return versions


def protocols(spark: SparkSession) -> DataFrame:
    return read_protocols(spark)


def tagged(spark: SparkSession, sf_dir: str, timing: str = DENSE) -> DataFrame:
    """Flows with totals and prefixes, the input of all rollups."""
    index = index_prefixes(prefix_ranges(rules(spark, sf_dir)))
    return tag_flows(flows(spark, sf_dir, timing), routers(spark, sf_dir), index)
