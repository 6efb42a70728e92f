"""Column layouts of the tables.

Unsigned wire integers get the next wider signed Spark type. Addresses are
16-byte big-endian binaries (IPv4 in the last four bytes), so that Spark's
unsigned byte-wise comparison orders them like 128-bit numbers.
"""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    names = {
        "int": T.IntegerType(),
        "long": T.LongType(),
        "double": T.DoubleType(),
        "bool": T.BooleanType(),
        "str": T.StringType(),
        "bin": T.BinaryType(),
        "ts": T.TimestampType(),
        "date": T.DateType(),
        "strs": T.ArrayType(T.StringType()),
    }
    out = T.StructType()
    for line in spec.strip().splitlines():
        kind, columns = line.split(":")
        for column in columns.split():
            out = out.add(column, names[kind.strip()])
    return out


# One decoded flow message as it arrives from an exporter.
FLOW = _struct("""
int:  type
long: sequence_num sampling_rate
bin:  sampler_address
long: time_received_ns time_flow_start_ns time_flow_end_ns bytes packets
bin:  src_addr dst_addr
int:  etype proto
long: ip_tos ip_ttl ip_flags tcp_flags icmp_type icmp_code
int:  src_port dst_port
long: src_as dst_as src_net dst_net
bin:  next_hop
long: next_hop_as
bin:  bgp_next_hop
long: in_if out_if src_mac dst_mac forwarding_status
long: observation_domain_id observation_point_id
""")

# One enriched flow.
RAW = _struct("""
int:  type
str:  type_str
long: sequence_num sampling_rate
bin:  sampler_address
str:  sampler_address_str
ts:   time_received time_flow_start time_flow_end
long: time_received_ns bytes total_bytes packets total_packets
bin:  src_addr
str:  src_addr_str
bin:  dst_addr
str:  dst_addr_str
int:  etype
str:  etype_str
int:  proto
str:  proto_str
long: ip_tos ip_ttl ip_flags tcp_flags
str:  tcp_flags_str
long: icmp_type icmp_code
int:  src_port dst_port
long: src_as dst_as src_net dst_net
bin:  next_hop
long: next_hop_as
bin:  bgp_next_hop
long: in_if out_if src_mac dst_mac forwarding_status
str:  forwarding_status_str
long: observation_domain_id observation_point_id
strs: prefixes
""")

ROUTERS = _struct("""
str:  id name router_ip
long: default_sampling
""")

RULES = _struct("""
str:  id name
strs: prefixes
str:  type
long: bandwidth_threshold packet_threshold duration
str:  zscore_sensitivity zscore_target
""")

PROTOCOLS = _struct("""
int:  proto
str:  name description
""")

PREFIX_RANGES = _struct("""
str: prefix
bin: start end
""")

PREFIX_TOTALS = _struct("""
str:  prefix
ts:   time_received
long: bytes packets flows
""")

SOURCE_PROFILE = _struct("""
str:  prefix network
ts:   time_received
long: bytes packets flows
""")

# Long form: one row per traffic class instead of parallel arrays.
CLASS_PROFILE = _struct("""
str:  prefix
ts:   time_received
str:  proto
long: bytes packets flows
""")

DAILY_BASELINE = _struct("""
str:  prefix
ts:   time_received
str:  proto
long: p95_bytes p95_packets p95_flows max_bytes max_packets max_flows
""")

THRESHOLD_ALERTS = _struct("""
str:    rule_id rule_name alert_type prefix
ts:     alert_time
double: peak_bps peak_pps
bool:   is_bandwidth_alert is_packet_alert
""")

DDOS_ALERTS = _struct("""
str:    rule_id rule_name prefix proto
double: current_bps current_pps current_fps
double: recommend_bps recommend_pps recommend_fps
bool:   bps_alert pps_alert fps_alert
ts:     alert_time
""")
