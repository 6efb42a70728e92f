"""The scalar functions under names for SQL users, as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from weirmark.functions import codes, ip
from weirmark.sources.dims import read_protocols

# name: (argument type, result type, expression builder)
FUNCTIONS = {
    "ip_text": ("BINARY", "STRING", ip.ip_text),
    "ip_key": ("BINARY", "BINARY", ip.ip_key),
    "flow_type_name": ("INT", "STRING", codes.flow_type_name),
    "ether_type_name": ("INT", "STRING", codes.ether_type_name),
    "tcp_flag_name": ("BIGINT", "STRING", codes.tcp_flag_name),
    "tcp_flags_text": ("BIGINT", "STRING", codes.tcp_flags_text),
    "forwarding_status_name": ("BIGINT", "STRING", codes.forwarding_status_name),
    "zscore_limit": ("STRING", "INT", codes.zscore_limit),
}


def protocol_name(spark: SparkSession) -> str:
    """Expression for the name of protocol ``x``; at most 256 numbers have one."""
    names = {r["proto"]: r["name"] for r in read_protocols(spark).collect()}
    return codes.value_map("x", names, "CAST(x AS STRING)")


def register(spark: SparkSession) -> None:
    """Create the functions in the session, e.g. ``SELECT ip_text(dst_addr)``."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION protocol_name(x INT)"
        f" RETURNS STRING RETURN {protocol_name(spark)}"
    )
    for name, (argument, result, build) in FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x {argument})"
            f" RETURNS {result} RETURN {build('x')}"
        )
