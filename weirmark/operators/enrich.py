"""Flow messages to enriched flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmark import schema
from weirmark.functions import codes, ip, timeslot
from weirmark.operators import joins
from weirmark.operators.prefix import PrefixIndex, match_prefixes

#: Tasks that share the flows of one input split where they must be shuffled; a flow in memory is far larger than in its file.
TASKS_A_SPLIT = 16


def router_defaults(routers: DataFrame) -> DataFrame:
    """Router address → default sampling, one row per address."""
    compact = "CASE WHEN _ip.family = 4 THEN substring(_ip.key, 13, 4) ELSE _ip.key END"
    return (
        routers.withColumn("_ip", F.expr(ip.parse_ip("router_ip")))
        .filter("_ip IS NOT NULL")
        .groupBy(F.expr(compact).alias("_sampler"))
        .agg(F.min_by("default_sampling", "id").alias("_default_sampling"))
    )


def scale_samples(flows: DataFrame, routers: DataFrame) -> DataFrame:
    """Add ``total_bytes, total_packets``.

    A message without a sampling rate takes the default of its router, an
    unknown router counts as 0. Totals outside the 64-bit range are NULL, see
    :func:`out_of_range`.
    """
    df = flows.withColumn("_sampler", F.expr(ip.ip_compact("sampler_address")))
    defaults = router_defaults(routers)
    # a row per address: of routers there may be many more
    small = joins.at_most(defaults, joins.BROADCAST_ROWS)
    tasks = 1 if small else TASKS_A_SPLIT * df.rdd.getNumPartitions()
    df = joins.lookup_join(df, defaults, ["_sampler"], "left", small=small, tasks=tasks)
    rate = (
        "CASE WHEN sampling_rate = 0 THEN coalesce(_default_sampling, 0L) ELSE sampling_rate END"
    )
    total = "CASE WHEN {0} >= 0 AND _rate >= 0 THEN try_multiply({0}, _rate) END"
    return (
        df.withColumn("_rate", F.expr(rate))
        .withColumns(
            {
                "total_bytes": F.expr(total.format("bytes")),
                "total_packets": F.expr(total.format("packets")),
            }
        )
        .drop("_sampler", "_default_sampling", "_rate")
    )


def tag_flows(flows: DataFrame, routers: DataFrame, index: PrefixIndex) -> DataFrame:
    """The part of the enrichment that rollups need: time, totals, prefixes.

    Source and destination become 16-byte keys.
    """
    df = scale_samples(flows, routers).withColumns(
        {
            "time_received": F.expr(timeslot.from_nanos("time_received_ns")),
            "_family": F.expr(ip.ip_family("dst_addr", "etype")),
            "src_addr": F.expr(ip.ip_key("src_addr", "etype")),
            "dst_addr": F.expr(ip.ip_key("dst_addr", "etype")),
        }
    )
    return match_prefixes(df, index, "dst_addr", "_family").drop("_family")


def decode_names(
    flows: DataFrame, protocols: DataFrame, discard_fix: str = "dropped"
) -> DataFrame:
    """Add the names of all codes and the flow's start and end time."""
    # protocol numbers have eight bits, so this side never exceeds 256 rows
    names = (
        protocols.filter("proto BETWEEN 0 AND 255")
        .groupBy("proto")
        .agg(F.min("name").alias("_proto_name"))
    )
    status = codes.effective_forwarding_status(
        "forwarding_status", ip.is_all_zero("next_hop"), "out_if", discard_fix
    )
    return (
        flows.join(F.broadcast(names), "proto", "left")
        .withColumns(
            {
                "type_str": F.expr(codes.flow_type_name("type")),
                "etype_str": F.expr(codes.ether_type_name("etype")),
                "proto_str": F.expr("coalesce(_proto_name, CAST(proto AS STRING))"),
                "tcp_flags_str": F.expr(codes.tcp_flags_text("tcp_flags")),
                "forwarding_status_str": F.expr(codes.forwarding_status_name(status)),
                "time_flow_start": F.expr(timeslot.from_nanos("time_flow_start_ns")),
                "time_flow_end": F.expr(timeslot.from_nanos("time_flow_end_ns")),
            }
        )
        .drop("_proto_name")
    )


def enrich_flows(
    flows: DataFrame,
    routers: DataFrame,
    index: PrefixIndex,
    protocols: DataFrame,
    discard_fix: str = "dropped",
) -> DataFrame:
    """Decode, scale and tag flow messages; no shuffle while dimensions are small."""
    named = decode_names(flows, protocols, discard_fix)
    texted = ip.with_ip_text(
        named,
        {
            "sampler_address_str": ("sampler_address", None),
            "src_addr_str": ("src_addr", "etype"),
            "dst_addr_str": ("dst_addr", "etype"),
        },
    )
    tagged = tag_flows(texted, routers, index)
    others = ("sampler_address", "next_hop", "bgp_next_hop")
    return tagged.withColumns({name: F.expr(ip.ip_key(name)) for name in others}).select(
        *schema.RAW.names
    )


def out_of_range(raw: DataFrame) -> DataFrame:
    """Flows whose scaled totals do not fit 64 bits: the quarantine."""
    return raw.filter("total_bytes IS NULL OR total_packets IS NULL")
