"""SQL counterparts of the registered queries, written for DuckDB.

They state the same derivation and the same operators a second time, in another
engine and by other means: ranges are numbers compared with BETWEEN, windows
are self-joins over candidate minutes.
"""

from __future__ import annotations

from weirmark.operators.rollup import CLASSES
from weirmark.plans.fixture import BASE_US, DENSE, NATURAL
from weirmark.plans.queries import (
    AS_OF_DENSE,
    AS_OF_NATURAL,
    BASE,
    ONE_PREFIX,
    RETENTION_NOW,
)
from weirmark.sources.dims import PROTOCOLS_CSV

_HEAD = 0x20010DB8 << 96  # 2001:db8::
_S80 = 1 << 80
_S64 = 1 << 64


def _dotted(number: str) -> str:
    return " || '.' || ".join(f"(({number}) // {1 << s} % 256)" for s in (24, 16, 8, 0))


_SRC4 = "(3232235520 + u % 16 * 256 + n % 256)"
_DST4 = "(167772160 + u % 4 * 65536 + u * 256 + n % 256)"
_SAMPLER = "(CASE WHEN n % 8 < 4 THEN 3232235520 ELSE 2886729728 END + u % 65536)"


def _flows(timing: str = DENSE) -> str:
    tus = {DENSE: f"{BASE_US} + (us - {BASE_US}) // 60", NATURAL: "us"}[timing]
    spike = {
        DENSE: "mi BETWEEN 600 AND 605 AND u % 4 = 1",
        NATURAL: "mi >= 28 * 1440 AND mi < 28 * 1440 + 180",
    }[timing]
    return f"""
ev0 AS (
  SELECT event_id AS n, user_id AS u, event_type, epoch_us(ts) AS us,
    CAST(round(value * 100) AS BIGINT) AS cents,
    CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, event_id % 10 = 9 AS v6
  FROM events),
ev1 AS (SELECT *, {tus} AS tus FROM ev0),
ev2 AS (SELECT *, (tus - {BASE_US}) // 60000000 AS mi FROM ev1),
router AS (
  SELECT '192.168.' || (c_custkey // 256 % 256) || '.' || (c_custkey % 256) AS router_ip,
    100 + c_nationkey * 50 AS default_sampling, CAST(c_custkey AS VARCHAR) AS id, c_name AS name
  FROM customer),
router_rate AS (
  SELECT router_ip, min_by(default_sampling, id) AS rate FROM router GROUP BY ALL),
ev3 AS (
  SELECT *, CASE WHEN {spike} THEN 40 ELSE 1 END AS gain,
    {_dotted(_SAMPLER)} AS sampler,
    CASE WHEN v6 THEN 34525 WHEN n % 97 = 5 THEN 2054 ELSE 2048 END AS etype,
    CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 17
      WHEN 'error' THEN CASE WHEN v6 THEN 58 ELSE 1 END
      WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 47 ELSE 50 END
      ELSE CASE WHEN k % 3 = 0 THEN 0 ELSE 132 END END AS proto,
    k + CASE WHEN n % 50 = 7 THEN 1024 ELSE 0 END AS tcp_flags,
    CASE WHEN v6 THEN '2001:db8:ffff'
        || CASE WHEN u % 16 = 0 THEN '' ELSE ':' || lower(hex(u % 16)) END
        || '::' || lower(hex(n % 256 + 1))
      ELSE {_dotted(_SRC4)} END AS src,
    CASE WHEN v6 THEN '2001:db8:' || lower(hex(u % 65000 + 1)) || '::' || lower(hex(n % 256 + 1))
      ELSE {_dotted(_DST4)} END AS dst,
    CASE WHEN v6 THEN CAST({_HEAD} AS UHUGEINT) + CAST(65535 AS UHUGEINT) * {_S80}
        + CAST(u % 16 AS UHUGEINT) * {_S64} + CAST(n % 256 + 1 AS UHUGEINT)
      ELSE CAST({_SRC4} AS UHUGEINT) END AS src_num,
    CASE WHEN v6 THEN CAST({_HEAD} AS UHUGEINT) + CAST(u % 65000 + 1 AS UHUGEINT) * {_S80}
        + CAST(n % 256 + 1 AS UHUGEINT)
      ELSE CAST({_DST4} AS UHUGEINT) END AS dst_num
  FROM ev2),
flows AS (
  SELECT ev3.*, make_timestamp(tus) AS received,
    cents * 64 * gain * rate0 AS total_bytes, (1 + n % 64) * gain * rate0 AS total_packets
  FROM (SELECT ev3.*, CASE WHEN n % 4 = 0 THEN COALESCE(rate, 0) ELSE 1000 END AS rate0
        FROM ev3 LEFT JOIN router_rate ON sampler = router_ip) ev3)"""


_RULES = f"""
sup AS (SELECT s_suppkey AS k, s_name AS name FROM supplier),
rule AS (
  SELECT 'r' || k AS id, k, name,
    CASE k % 3 WHEN 0 THEN 'threshold' WHEN 1 THEN 'zscore' ELSE 'advanced_ddos' END AS type,
    CASE WHEN k % 5 <> 4 THEN 100000000 + k % 7 * 150000000 END AS bt,
    CASE WHEN k % 2 = 0 THEN 1500 + k % 5 * 1000 END AS pt,
    CASE WHEN k % 11 = 10 THEN NULL WHEN k % 12 = 9 THEN [30, 60, 61, 62][1 + k // 12 % 4] ELSE 1 + k % 4 END AS d,
    CASE k % 4 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 4 END AS zlimit,
    CASE WHEN k % 2 = 0 THEN 'packets' ELSE 'bits' END AS target
  FROM sup),
rp AS (
  SELECT k, pos, '10.' || (k % 4) || '.' || (k % 256) || '.0/24' AS prefix, 4 AS fam, 24 AS len,
    CAST(167772160 + k % 4 * 65536 + k % 256 * 256 AS UHUGEINT) AS lo, {2**8 - 1}::UHUGEINT AS span
  FROM sup, (SELECT 1 AS pos)
  UNION ALL SELECT k, 2, '10.' || (k // 2 % 4) || '.0.0/16', 4, 16,
    CAST(167772160 + k // 2 % 4 * 65536 AS UHUGEINT), {2**16 - 1}::UHUGEINT FROM sup WHERE k % 2 = 0
  UNION ALL SELECT k, 3, '10.0.0.0/8', 4, 8, 167772160::UHUGEINT, {2**24 - 1}::UHUGEINT
    FROM sup WHERE k % 10 < 3
  UNION ALL SELECT k, 4, '0.0.0.0/0', 4, 0, 0::UHUGEINT, {2**32 - 1}::UHUGEINT FROM sup WHERE k % 10 = 4
  UNION ALL SELECT k, 5, '10.2.0.0/15', 4, 15, 167903232::UHUGEINT, {2**17 - 1}::UHUGEINT
    FROM sup WHERE k % 10 = 5
  UNION ALL SELECT k, 6, '10.' || (k % 4) || '.128.0/17', 4, 17,
    CAST(167772160 + k % 4 * 65536 + 32768 AS UHUGEINT), {2**15 - 1}::UHUGEINT FROM sup WHERE k % 10 = 6
  UNION ALL SELECT k, 7, '10.' || (k % 4) || '.' || (k % 256) || '.128/25', 4, 25,
    CAST(167772160 + k % 4 * 65536 + k % 256 * 256 + 128 AS UHUGEINT), {2**7 - 1}::UHUGEINT
    FROM sup WHERE k % 10 = 7
  UNION ALL SELECT k, 8, '2001:db8:' || lower(hex(k % 65000 + 1)) || '::/48', 6, 48,
    CAST({_HEAD} AS UHUGEINT) + CAST(k % 65000 + 1 AS UHUGEINT) * {_S80}, {2**80 - 1}::UHUGEINT
    FROM sup WHERE k % 3 <> 0
  UNION ALL SELECT k, 9, '2001:db8::/33', 6, 33, CAST({_HEAD} AS UHUGEINT), {2**95 - 1}::UHUGEINT
    FROM sup WHERE k % 10 = 8
  UNION ALL SELECT k, 10, '::/0', 6, 0, 0::UHUGEINT, {2**128 - 1}::UHUGEINT FROM sup WHERE k % 10 = 9),
ranges AS (SELECT DISTINCT prefix, fam, len, lo, lo + span AS hi FROM rp),
ruled AS (SELECT rule.*, rp.prefix FROM rule JOIN rp USING (k))"""



def _versioned(shift: int = 0) -> str:
    """Versions of the rules in place of the rules, with the minutes they hold; ``shift`` in seconds."""
    columns = "k, {name} AS name, {type} AS type, {bt} AS bt, {pt} AS pt, {d} AS d, zlimit, target"

    def changed(which: str, seconds: str, version: int, deleted: str = "false", **new: str) -> str:
        values = {c: c for c in ("name", "type", "bt", "pt", "d")} | new
        return (
            f"SELECT id, {columns.format(**values)}, {version} AS version, {deleted} AS deleted,"
            f" {BASE + shift} + {seconds} AS since FROM rule WHERE {which}"
        )

    parts = [
        changed("true", "-86400", 0),
        changed("k % 2 = 0", "21600 + k % 7 * 90", 1, name="name || ' v1'", bt="bt // 4"),
        changed("k % 3 = 0", "36120 + k % 5 * 30", 2, "k % 6 = 0", name="name || ' v2'", type="'zscore'"),
        *(changed("k % 4 = 1", "28800", n, d=str(n - 2), pt="1000") for n in (3, 4)),
    ]
    plain = "ruled AS (SELECT rule.*, rp.prefix FROM rule JOIN rp USING (k))"
    assert plain in _RULES
    return _RULES.replace(
        plain,
        f"""ver AS ({" UNION ALL ".join(parts)}),
span AS (
  SELECT *, (since + 59) // 60 AS first,
    COALESCE(lead((since + 59) // 60) OVER (PARTITION BY id ORDER BY since, version), 1099511627776) AS after FROM ver),
held AS (SELECT * FROM span WHERE first < after AND NOT deleted),
ruled AS (SELECT held.*, rp.prefix FROM held JOIN rp USING (k))""",
    )


_MATCHED = """
matched AS (
  SELECT flows.*, prefix, len FROM flows JOIN ranges
    ON fam = CASE WHEN v6 THEN 6 ELSE 4 END AND dst_num BETWEEN lo AND hi)"""

_SUMS = (
    "CAST(sum(total_bytes) AS BIGINT) AS bytes, CAST(sum(total_packets) AS BIGINT) AS packets,"
    " count(*) AS flows"
)


def _slot(seconds: int) -> str:
    step = seconds * 1_000_000
    return f"make_timestamp(tus // {step} * {step})"


_TOTALS = f"""
totals AS (
  SELECT prefix, {_slot(60)} AS time_received, tus // 60000000 AS m, {_SUMS}
  FROM matched GROUP BY ALL),
rates AS (SELECT *, bytes * 8 / 60 AS bps, packets / 60 AS pps FROM totals)"""

_CLASS_TESTS = {
    "general": "true",
    "hopopt": "proto = 0",
    "tcp": "proto = 6",
    "udp": "proto = 17",
    "gre": "proto = 47",
    "esp": "proto = 50",
    "icmp": "(etype = 2048 AND proto = 1) OR (etype = 34525 AND proto = 58)",
    "tcp_syn": "proto = 6 AND tcp_flags // 2 % 2 = 1",
    "tcp_rst": "proto = 6 AND tcp_flags // 4 % 2 = 1",
    "tcp_ack": "proto = 6 AND tcp_flags // 16 % 2 = 1",
}
assert list(_CLASS_TESTS) == list(CLASSES)

_CLASSES = (
    "\nclassed AS ("
    + " UNION ALL ".join(
        f"SELECT prefix, '{name}' AS proto, tus, total_bytes, total_packets FROM matched WHERE {test}"
        for name, test in _CLASS_TESTS.items()
    )
    + f"),\nclasses AS (SELECT prefix, {_slot(60)} AS time_received, proto, tus // 60000000 AS m,"
    f" {_SUMS} FROM classed GROUP BY ALL)"
)


def _p95(column: str) -> str:
    """Linear interpolation between neighbours, cut to a whole number."""
    values = f"list({column} ORDER BY {column})"
    at = "(count(*) - 1) * CAST(0.95 AS DOUBLE)"
    low, high = f"CAST(floor({at}) AS BIGINT)", f"CAST(ceil({at}) AS BIGINT)"
    return (
        f"CAST(floor(CASE WHEN {low} = {high} THEN CAST({values}[{low} + 1] AS DOUBLE)"
        f" ELSE ({high} - {at}) * {values}[{low} + 1] + ({at} - {low}) * {values}[{high} + 1]"
        f" END) AS BIGINT)"
    )


_MEASURES = ("bytes", "packets", "flows")
_BASELINE = (
    "\nbaseline AS (SELECT prefix, date_trunc('day', time_received) AS day, proto, "
    + ", ".join(f"{_p95(c)} AS p95_{c}" for c in _MEASURES)
    + ", "
    + ", ".join(f"max({c}) AS max_{c}" for c in _MEASURES)
    + " FROM classes GROUP BY ALL)"
)

# every minute at which a window of up to four hours can see a row
_STATIC = """
cand AS (
  SELECT DISTINCT prefix, m + o AS t FROM totals, (SELECT unnest(range(0, {reach})) AS o)),
seen AS (
  SELECT r.id, r.prefix, r.bt, r.pt, r.d, c.t, x.bps, x.pps,
    row_number() OVER (PARTITION BY r.id, r.prefix, c.t ORDER BY x.m DESC) AS rn
  FROM cand c JOIN ruled r ON r.prefix = c.prefix AND r.type = 'threshold'
  JOIN rates x ON x.prefix = c.prefix AND x.m BETWEEN c.t - least(r.d, {max_duration}) AND c.t
  WHERE {when}),
static0 AS (
  SELECT id, prefix, t,
    COALESCE(bt IS NOT NULL AND count(*) >= d AND bool_and(bps >= bt) FILTER (WHERE rn <= d), false)
      AS bandwidth_alert, max(bps) AS peak_bps,
    COALESCE(pt IS NOT NULL AND count(*) >= d AND bool_and(pps >= pt) FILTER (WHERE rn <= d), false)
      AS packet_alert, max(pps) AS peak_pps
  FROM seen GROUP BY id, prefix, t, bt, pt, d),
static AS (
  SELECT make_timestamp(t * 60000000) AS eval_time, * EXCLUDE (t) FROM static0
  WHERE bandwidth_alert OR packet_alert)"""

_ZSCORE = """
zcand AS (
  SELECT DISTINCT prefix, m + o AS t FROM totals, (SELECT unnest(range(0, 241)) AS o)
  WHERE prefix IN (SELECT prefix FROM ruled WHERE type = 'zscore')),
stats AS (
  SELECT c.prefix, c.t, count(*) FILTER (WHERE x.m < c.t - 5) AS samples,
    avg(bps) FILTER (WHERE x.m >= c.t - 5) AS sb, avg(pps) FILTER (WHERE x.m >= c.t - 5) AS sp,
    max(bps) FILTER (WHERE x.m >= c.t - 5) AS peak_bps, max(pps) FILTER (WHERE x.m >= c.t - 5) AS peak_pps,
    avg(bps) FILTER (WHERE x.m < c.t - 5) AS lb, avg(pps) FILTER (WHERE x.m < c.t - 5) AS lp,
    stddev_pop(bps) FILTER (WHERE x.m < c.t - 5) AS db, stddev_pop(pps) FILTER (WHERE x.m < c.t - 5) AS dp
  FROM zcand c JOIN rates x ON x.prefix = c.prefix AND x.m BETWEEN c.t - 240 AND c.t
  WHERE {when} GROUP BY ALL),
dynamic0 AS (
  SELECT r.id, r.prefix, s.t,
    COALESCE(target = 'bits' AND CASE WHEN db > 0 THEN (sb - lb) / db ELSE 0 END >= zlimit, false)
      AS bandwidth_alert, peak_bps,
    COALESCE(target = 'packets' AND CASE WHEN dp > 0 THEN (sp - lp) / dp ELSE 0 END >= zlimit, false)
      AS packet_alert, peak_pps
  FROM stats s JOIN ruled r ON r.prefix = s.prefix AND r.type = 'zscore'
  WHERE samples >= 30 AND lb >= 1000000),
dynamic AS (
  SELECT make_timestamp(t * 60000000) AS eval_time, * EXCLUDE (t) FROM dynamic0
  WHERE bandwidth_alert OR packet_alert)"""


def _ddos(factor: float, when: str) -> str:
    rates = (("bps", "bytes", "* 8 / 60"), ("pps", "packets", "/ 60"), ("fps", "flows", "/ 60"))
    current = ", ".join(f"c.{m} {f} AS current_{u}" for u, m, f in rates)
    limits = ", ".join(f"b.p95_{m} {f} * {factor} AS recommend_{u}" for u, m, f in rates)
    flags = ", ".join(f"current_{u} >= recommend_{u} AS {u}_alert" for u, _, _ in rates)
    return f"""
ddos0 AS (
  SELECT r.id, c.time_received, c.prefix, c.proto, {current}, {limits}
  FROM classes c JOIN baseline b ON b.prefix = c.prefix AND b.proto = c.proto
    AND b.day = date_trunc('day', c.time_received) - INTERVAL 7 DAY
  JOIN ruled r ON r.prefix = c.prefix AND r.type = 'advanced_ddos' WHERE {when}),
ddos1 AS (SELECT *, {flags} FROM ddos0),
ddos AS (SELECT * FROM ddos1 WHERE bps_alert OR pps_alert OR fps_alert)"""


def _burst(factor: float, when: str) -> str:
    units = ("bps", "pps", "fps")
    limits = ", ".join(f"baseline_{u} * {factor} AS threshold_{u}" for u in units)
    flags = ", ".join(f"current_{u} >= threshold_{u} AS {u}_alert" for u in units)
    return f"""
burst0 AS (
  SELECT c.time_received, c.prefix, c.proto, c.bytes * 8 / 60 AS current_bps,
    c.packets / 60 AS current_pps, c.flows / 60 AS current_fps,
    avg(h.bytes) * 8 / 60 AS baseline_bps, avg(h.packets) / 60 AS baseline_pps,
    avg(h.flows) / 60 AS baseline_fps
  FROM classes c JOIN classes h ON h.prefix = c.prefix AND h.proto = c.proto
    AND h.m BETWEEN c.m - 5 AND c.m - 1 WHERE {when} GROUP BY ALL),
burst1 AS (SELECT *, {limits} FROM burst0 WHERE baseline_bps >= 1000000),
burst2 AS (SELECT *, {flags} FROM burst1),
burst AS (SELECT r.id, b.* FROM burst2 b
  JOIN ruled r ON r.prefix = b.prefix AND r.type = 'advanced_ddos'
  WHERE bps_alert OR pps_alert OR fps_alert)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _static(when: str = "true", max_duration: int = 60) -> str:
    return _STATIC.format(when=when, reach=62, max_duration=max_duration)


def _threshold_log(static: str, dynamic: str, time: str) -> str:
    return (
        _with(_flows(), _RULES, _MATCHED, _TOTALS, static, dynamic)
        + f""" SELECT a.id AS rule_id, r.name AS rule_name, alert_type, prefix, {time} AS alert_time,
  peak_bps, peak_pps, bandwidth_alert AS is_bandwidth_alert, packet_alert AS is_packet_alert
FROM (SELECT 'threshold' AS alert_type, * FROM static
      UNION ALL BY NAME SELECT 'zscore' AS alert_type, * FROM dynamic) a JOIN rule r USING (id)"""
    )


_DDOS_COLUMNS = (
    "current_bps, current_pps, current_fps, recommend_bps, recommend_pps, recommend_fps,"
    " bps_alert, pps_alert, fps_alert"
)
_ALERT = "id, prefix, bandwidth_alert, peak_bps, packet_alert, peak_pps"
_MINUTE_DENSE = AS_OF_DENSE // 60
_MINUTE_NATURAL = AS_OF_NATURAL // 60
_AT_DENSE = f"make_timestamp({AS_OF_DENSE}000000)"

_FLAG_NAMES = "FIN SYN RST PSH ACK URG ECN CWR NONCE RESERVED".split()
_FLAG_TEXT = ", ".join(
    f"CASE WHEN tcp_flags // {1 << i} % 2 = 1"
    f" THEN '{_FLAG_NAMES[i] if i < len(_FLAG_NAMES) else 1 << i}' END"
    for i in range(12)
)
_BITS = ", ".join(f"CASE WHEN tcp_flags // {1 << i} % 2 = 1 THEN '{1 << i}' END" for i in range(12))
_ONE_FLAG = " ".join(f"WHEN {1 << i} THEN '{name}'" for i, name in enumerate(_FLAG_NAMES))

_TYPE_NAME = (
    "CASE n % 6 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'SFLOW_5' WHEN 2 THEN 'NETFLOW_V5'"
    " WHEN 3 THEN 'NETFLOW_V9' WHEN 4 THEN 'IPFIX' ELSE CAST(n % 6 AS VARCHAR) END"
)
_ETYPE_NAME = "CASE etype WHEN 2048 THEN 'IPv4' WHEN 2054 THEN 'ARP' ELSE 'IPv6' END"
_PROTO_NAME = (
    "CASE proto "
    + " ".join(
        "WHEN {} THEN '{}'".format(*line.split(",")[:2])
        for line in PROTOCOLS_CSV.read_text().splitlines()[2:]
    )
    + " ELSE CAST(proto AS VARCHAR) END"
)
_STATE = "CASE k % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'FORWARDED' WHEN 2 THEN 'DROPPED' ELSE 'CONSUMED' END"
_DISCARD = "n % 5 = 0 AND n % 3 = 0"
_HEX = "lpad(lower(hex({})), 32, '0')"
_PREFIXES = "string_agg(prefix, ' ' ORDER BY len, prefix)"

_UPSERT = """
changes AS (
  SELECT CAST(s_suppkey * 7 % 90 AS VARCHAR) AS id, s_name AS name,
    '192.168.' || (s_suppkey // 256 % 256) || '.' || (s_suppkey % 256) AS router_ip,
    CAST(s_nationkey AS BIGINT) AS default_sampling, s_suppkey AS version FROM supplier)"""


def _failed(tests: dict[str, str]) -> str:
    return "concat_ws(' ', " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests.items()) + ")"


def oracle_sql() -> dict[str, str]:
    flows, natural = _flows(), _flows(NATURAL)
    matched = (flows, _RULES, _MATCHED)
    totals = _with(*matched, _TOTALS)
    classes = _with(*matched, _CLASSES)
    weekly = (natural, _RULES, _MATCHED, _CLASSES, _BASELINE)
    own = "prefix, time_received, bytes, packets, flows"
    class_rows = "prefix, time_received, proto, bytes, packets, flows"
    log_ddos = f"""
SELECT d.id AS rule_id, r.name AS rule_name, prefix, proto, {_DDOS_COLUMNS}, time_received AS alert_time
FROM ddos d JOIN rule r USING (id)"""
    match_rows = f"""SELECT n AS sequence_num, COALESCE(p, '') AS prefixes FROM flows
LEFT JOIN (SELECT n, {_PREFIXES} AS p FROM matched GROUP BY n) USING (n)"""
    series = lambda unit, step: f"{_slot(step).replace('tus', 'epoch_us(time_received)')} AS time"
    at_natural = f"c.m = {_MINUTE_NATURAL}"

    found = {
        "enrich_flows": _with(*matched)
        + f""" SELECT n AS sequence_num, {_TYPE_NAME} AS type_str, sampler AS sampler_address_str,
  received AS time_received, received - INTERVAL 2 SECOND AS time_flow_start,
  received - INTERVAL 1 SECOND AS time_flow_end, total_bytes, total_packets,
  {_HEX.format('src_num')} AS src_addr, src AS src_addr_str,
  {_HEX.format('dst_num')} AS dst_addr, dst AS dst_addr_str, {_ETYPE_NAME} AS etype_str,
  {_PROTO_NAME} AS proto_str,
  CASE WHEN tcp_flags = 0 THEN 'EMPTY' ELSE concat_ws('+', {_FLAG_TEXT}) END AS tcp_flags_str,
  {_HEX.format('CASE WHEN n % 5 = 0 THEN 0 ELSE 2886729728 + n % 256 END')} AS next_hop,
  CASE WHEN {_DISCARD} THEN 'DROPPED' ELSE {_STATE} END AS forwarding_status_str,
  COALESCE(p, '') AS prefixes
FROM flows LEFT JOIN (SELECT n, {_PREFIXES} AS p FROM matched GROUP BY n) USING (n)""",
        "enrich_sampling": _with(flows)
        + """ SELECT n AS sequence_num, CASE WHEN n % 4 = 0 THEN 0 ELSE 1000 END AS sampling_rate,
  total_bytes, total_packets FROM flows""",
        "flow_code_names": _with(flows)
        + f""" SELECT n AS sequence_num, {_TYPE_NAME} AS type_str, {_ETYPE_NAME} AS etype_str,
  {_PROTO_NAME} AS proto_str,
  CASE WHEN {_DISCARD} THEN 'DROPPED' ELSE {_STATE} END AS forwarding_status_str,
  CASE WHEN {_DISCARD} THEN 'UNKNOWN' ELSE {_STATE} END AS forwarding_unfixed FROM flows""",
        "tcp_flag_names": _with(flows)
        + f""" SELECT n AS sequence_num,
  CASE WHEN tcp_flags = 0 THEN 'EMPTY' ELSE concat_ws('+', {_FLAG_TEXT}) END AS tcp_flags_str,
  concat_ws(',', {_BITS}) AS bits,
  CASE tcp_flags {_ONE_FLAG} ELSE CAST(tcp_flags AS VARCHAR) END AS as_single_flag FROM flows""",
        "address_text": _with(flows) + " SELECT n AS sequence_num, sampler, src, dst FROM flows",
        "cidr_ranges": _with(_RULES)
        + f""" SELECT prefix, fam AS family, len AS length, {_HEX.format('lo')} AS start_hex,
  {_HEX.format('hi')} AS end_hex FROM ranges""",
        "prefix_match_all": _with(*matched) + " " + match_rows,
        "prefix_match_shuffled": _with(*matched) + " " + match_rows,
        "prefix_match_many_lengths": _with(flows)
        + f""", many AS (
  SELECT DISTINCT len, (167772160 + s_suppkey % 4 * 65536 + s_suppkey % 256 * 256 + s_suppkey % 7) // (1 << (32 - len))
    * (1 << (32 - len)) AS net FROM supplier, (SELECT unnest(range(3, 33)) AS len)),
six AS (
  SELECT DISTINCT len, h, l FROM (
    SELECT len, CAST({0x20010DB8 << 32} + (s_suppkey % 150 + 1) * 65536 AS UHUGEINT) * {_S64} + CAST(s_suppkey % 7 + 1 AS UHUGEINT) AS a,
      CAST(pow(2::DOUBLE, 128 - len) AS UHUGEINT) AS size, CAST(a // size * size // {_S64} AS UBIGINT) AS h,
      CAST(a // size * size % {_S64} AS UBIGINT) AS l
    FROM supplier, (SELECT unnest(range(29, 129)) AS len))),
names AS (
  SELECT *, lpad(lower(hex(h)), 16, '0') || lpad(lower(hex(l)), 16, '0') AS t, CAST(h AS UHUGEINT) * {_S64} + l AS lo,
    lo + CAST(pow(2::DOUBLE, 128 - len) AS UHUGEINT) - 1 AS hi FROM six),
hit AS (
  SELECT n, len, {_dotted('net')} || '/' || len AS p FROM flows JOIN many
    ON NOT v6 AND CAST(dst_num AS BIGINT) // (1 << (32 - len)) * (1 << (32 - len)) = net
  UNION ALL SELECT n, len, array_to_string([t[1 + 4 * i : 4 + 4 * i] for i in range(8)], ':') || '/' || len
  FROM flows JOIN names ON v6 AND dst_num BETWEEN lo AND hi)
SELECT n AS sequence_num, count(len) AS n_prefixes, coalesce(string_agg(p, ' ' ORDER BY len), '') AS prefixes
FROM flows LEFT JOIN hit USING (n) GROUP BY n""",
        "prefix_longest_match": _with(*matched)
        + """ SELECT n AS sequence_num, p AS prefix FROM flows
LEFT JOIN (SELECT n, max_by(prefix, len) AS p FROM matched GROUP BY n) USING (n)""",
        "prefixes_by_address": _with(*matched)
        + f""" SELECT {_HEX.format('dst_num')} AS dst_addr, {_PREFIXES} AS prefixes
FROM (SELECT DISTINCT dst_num, prefix, len FROM matched) GROUP BY dst_num""",
        "prefix_totals_1m": totals + f" SELECT {own} FROM totals",
        "prefix_totals_from_partials": totals + f" SELECT {own} FROM totals",
        "source_profile_10m": _with(*matched)
        + f""" SELECT prefix, CASE etype WHEN 2048 THEN '192.168.' || (u % 16) || '.0'
    ELSE '2001:db8:ffff' || CASE WHEN u % 16 = 0 THEN '' ELSE ':' || lower(hex(u % 16)) END || '::' END
    AS network, {_slot(600)} AS time_received, {_SUMS}
FROM matched WHERE etype IN (2048, 34525) GROUP BY ALL""",
        "class_profile_1m": classes + f" SELECT {class_rows} FROM classes",
        "class_profile_map": classes + f" SELECT {class_rows} FROM classes",
        "class_profile_arrays": classes + f" SELECT {class_rows} FROM classes",
        "daily_baseline": _with(*weekly)
        + " SELECT * EXCLUDE (day), day AS time_received FROM baseline",
        "static_alerts": _with(*matched, _TOTALS, _static(f"c.t = {_MINUTE_DENSE}"))
        + f" SELECT {_ALERT} FROM static",
        "static_alerts_grid": _with(*matched, _TOTALS, _static())
        + f" SELECT eval_time, {_ALERT} FROM static",
        "zscore_alerts": _with(*matched, _TOTALS, _ZSCORE.format(when=f"c.t = {_MINUTE_DENSE}"))
        + f" SELECT {_ALERT} FROM dynamic",
        "zscore_alerts_grid": _with(*matched, _TOTALS, _ZSCORE.format(when="true"))
        + f" SELECT eval_time, {_ALERT} FROM dynamic",
        "ddos_alerts": _with(*weekly, _ddos(1.5, at_natural))
        + f" SELECT id, time_received, prefix, proto, {_DDOS_COLUMNS} FROM ddos",
        "ddos_alerts_grid": _with(*weekly, _ddos(1.5, "true"))
        + f" SELECT id, time_received, prefix, proto, {_DDOS_COLUMNS} FROM ddos",
        "burst_alerts": _with(*matched, _CLASSES, _burst(2.0, f"c.m = {_MINUTE_DENSE}"))
        + " SELECT * FROM burst",
        "burst_alerts_grid": _with(*matched, _CLASSES, _burst(2.0, "true"))
        + " SELECT * FROM burst",
        "threshold_alert_log": _threshold_log(
            _static(f"c.t = {_MINUTE_DENSE}"), _ZSCORE.format(when=f"c.t = {_MINUTE_DENSE}"), _AT_DENSE
        ),
        "threshold_alert_log_grid": _threshold_log(
            _static(), _ZSCORE.format(when="true"), "eval_time"
        ),
        "threshold_replay_versions": _with(
            flows,
            _versioned(),
            _MATCHED,
            _TOTALS,
            _static("c.t >= r.first AND c.t < r.after"),
            _ZSCORE.format(when="true").replace(
                "r.type = 'zscore'\n  WHERE samples", "r.type = 'zscore' AND s.t >= r.first AND s.t < r.after\n  WHERE samples"
            ),
        )
        + """ SELECT a.id AS rule_id, h.name AS rule_name, alert_type, prefix, eval_time AS alert_time,
  peak_bps, peak_pps, bandwidth_alert AS is_bandwidth_alert, packet_alert AS is_packet_alert
FROM (SELECT 'threshold' AS alert_type, * FROM static
      UNION ALL BY NAME SELECT 'zscore' AS alert_type, * FROM dynamic) a
JOIN held h ON h.id = a.id AND epoch_us(eval_time) // 60000000 >= h.first AND epoch_us(eval_time) // 60000000 < h.after""",
        "ddos_replay_versions": _with(
            natural, _versioned(28 * 86400 - 36000), _MATCHED, _CLASSES, _BASELINE, _ddos(2.0, "c.m >= r.first AND c.m < r.after")
        )
        + f""" SELECT d.id AS rule_id, h.name AS rule_name, prefix, proto, {_DDOS_COLUMNS}, time_received AS alert_time
FROM ddos d JOIN held h ON h.id = d.id AND epoch_us(time_received) // 60000000 >= h.first
  AND epoch_us(time_received) // 60000000 < h.after""",
        "rules_as_of": _with(_versioned())
        + f""" SELECT id, name, type, bt AS bandwidth_threshold, pt AS packet_threshold, d AS duration FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY since DESC, version DESC) AS nth FROM ver WHERE since <= {BASE + 603 * 60})
WHERE nth = 1 AND NOT deleted""",
        "threshold_alert_screen": _with(
            *matched,
            _TOTALS,
            _static(f"c.t = {_MINUTE_DENSE}"),
            _ZSCORE.format(when=f"c.t = {_MINUTE_DENSE}"),
        )
        + """ SELECT a.id, type, r.name, prefix, peak_bps, peak_pps, bandwidth_alert, packet_alert
FROM (SELECT 'threshold' AS type, * FROM static
      UNION ALL BY NAME SELECT 'zscore' AS type, * FROM dynamic) a JOIN (SELECT id, name FROM rule) r USING (id)""",
        "ddos_alert_log": _with(*weekly, _ddos(2.0, at_natural)) + log_ddos,
        "ddos_alert_log_grid": _with(*weekly, _ddos(2.0, "true")) + log_ddos,
        "ddos_alert_screen": _with(*weekly, _ddos(1.5, at_natural))
        + f" SELECT d.id, r.name, prefix, proto, {_DDOS_COLUMNS} FROM ddos d JOIN rule r USING (id)",
        "rate_series_5m": totals
        + f" SELECT {series('bps', 300)}, prefix, sum(bytes) * 8 / 300 AS bps FROM totals GROUP BY ALL",
        "packet_rate_series": totals
        + f""" SELECT {series('pps', 60)}, prefix, sum(packets) / 60 AS pps FROM totals
WHERE m * 60 BETWEEN {BASE + 3600} AND {BASE + 7200} GROUP BY ALL""",
        "class_rate_series": classes
        + f""" SELECT {series('bps', 300)}, proto, sum(bytes) * 8 / 300 AS bps FROM classes
WHERE prefix = '{ONE_PREFIX}' GROUP BY ALL""",
        "class_packet_rate_series": classes
        + f""" SELECT {series('pps', 600)}, proto, sum(packets) / 600 AS pps FROM classes
WHERE prefix = '{ONE_PREFIX}' GROUP BY ALL""",
        "series_summary": totals
        + """ SELECT prefix, min(bps) AS min, max(bps) AS max, round(quantile_cont(bps, 0.95), 3) AS p95,
  round(avg(bps), 3) AS mean, max_by(bps, m) AS last FROM rates GROUP BY prefix""",
        "series_pivot": totals
        + """ SELECT prefix, count(*) AS n_points,
  string_agg(CAST(s AS VARCHAR) || '=' || CAST(floor(bps) AS BIGINT), ',' ORDER BY s) AS points
FROM (SELECT prefix, m * 60 // 300 * 300 AS s, sum(bytes) * 8 / 300 AS bps FROM totals GROUP BY ALL) GROUP BY prefix""",
        "prefix_list": _with(_RULES) + " SELECT DISTINCT prefix FROM rp",
        "dim_upsert_latest": _with(flows, _UPSERT)
        + """ SELECT id, name, router_ip, default_sampling FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM (
    SELECT id, name, router_ip, default_sampling, -1 AS version FROM router
    UNION ALL SELECT * FROM changes)) WHERE rn = 1""",
        "dim_delete": _with(flows, _UPSERT)
        + """ SELECT id, name, router_ip, default_sampling FROM router
WHERE id NOT IN (SELECT id FROM changes)""",
        "dim_validate_rules": _with(_RULES)
        + " SELECT id, CASE k % 13 WHEN 1 THEN '' WHEN 2 THEN '10.0.0.1/8' WHEN 3 THEN '10.0.0.0/8 nowhere'"
        " ELSE p END AS prefixes, "
        + _failed(
            {
                "name": "k % 17 = 3",
                "prefixes": "k % 13 IN (1, 2, 3)",
                "type": "k % 19 = 5",
                "bandwidth_threshold": "k % 7 = 4",
                "duration": "k % 23 = 6",
                "zscore_sensitivity": "k % 29 = 7",
                "zscore_target": "k % 31 = 8",
            }
        )
        + " AS reasons FROM rule JOIN (SELECT k, string_agg(prefix, ' ' ORDER BY pos) AS p"
        " FROM rp GROUP BY k) USING (k)",
        "dim_validate_routers": _with(flows)
        + """ SELECT id, CASE id::INT % 5 WHEN 1 THEN router_ip || '.7' WHEN 2 THEN
  CASE WHEN id::INT % 7 = 3 THEN '2001:DB8:0:0::' ELSE '2001:db8::' END || lower(hex(id::INT % 200 + 1))
  ELSE router_ip END AS router_ip, """
        + _failed({"router_ip": "id::INT % 5 = 1", "default_sampling": "id::INT % 7 = 3"})
        + " AS reasons FROM router",
        "router_ip_conflicts": _with(flows)
        + """ SELECT router_ip, count(*) AS routers, min(id) AS first_id FROM (
  SELECT id, '10.9.0.' || CASE WHEN id::INT % 3 = 0 THEN id::INT % 200 ELSE id::INT END AS router_ip
  FROM router) GROUP BY router_ip HAVING count(*) > 1""",
        "router_free_addresses": _with(flows, _UPSERT)
        + """, claims AS (
  SELECT id, version, CASE WHEN version % 3 = 0 THEN '2001:DB8:' || CASE WHEN version % 2 = 0 THEN ':' ELSE '0:0::' END
      || CAST(version % 7 + 1 AS VARCHAR) ELSE router_ip END AS router_ip,
    CASE WHEN version % 3 = 0 THEN 'v6 ' || CAST(version % 7 AS VARCHAR) ELSE router_ip END AS address FROM changes),
held AS (
  SELECT *, EXISTS (SELECT 1 FROM router r WHERE r.router_ip = c.address AND r.id <> c.id) AS held FROM claims c)
SELECT id, router_ip, version, held OR EXISTS (
    SELECT 1 FROM held o WHERE o.address = h.address AND NOT o.held AND o.id <> h.id
    AND (o.version, o.id) = (SELECT min((version, id)) FROM held f WHERE f.address = h.address AND NOT f.held)) AS taken
FROM held h""",
        "stored_totals_merged": totals + f" SELECT {own} FROM totals",
        "stream_equals_batch": totals + f" SELECT {own} FROM totals",
        "baseline_job": _with(*weekly)
        + " SELECT * EXCLUDE (day), day AS time_received FROM baseline",
        "evaluation_log": _threshold_log(_static(), _ZSCORE.format(when="true"), "eval_time")
        + f" WHERE eval_time BETWEEN make_timestamp({BASE}000000) AND make_timestamp({BASE + 172_800}000000)",
        "windows_in_stream": _with(*matched)
        + ", part AS (SELECT *, n % 11 = 5 AND tus // 60000000 - " + str(BASE // 60) + " < 172 AS late FROM matched) "
        + " UNION ALL ".join(
            f"SELECT '{level}' AS level, prefix, {_slot(seconds)} AS time_received, {_SUMS} FROM part WHERE {which} GROUP BY ALL"
            for level, seconds, which in (
                ("1m", 60, "NOT late"), ("10m", 600, "NOT late"), ("1d", 86400, "NOT late"), ("late", 60, "late")
            )
        ),
        "rollup_with_out_of_range": _with(*matched)
        + f""", large AS (
  SELECT *, CASE WHEN n % 50 = 7 THEN NULL WHEN n % 10 = 3 THEN 5000000000000000000 ELSE total_bytes END AS b
  FROM matched)
SELECT prefix, {_slot(60)} AS time_received, TRY_CAST(sum(b) AS BIGINT) AS bytes,
  CAST(sum(total_packets) AS BIGINT) AS packets, count(*) AS flows FROM large GROUP BY ALL""",
        "retention_30d": _with(natural, _RULES, _MATCHED, _TOTALS)
        + f""" SELECT {own} FROM totals
WHERE date_trunc('day', time_received) + INTERVAL 30 DAY > make_timestamp({RETENTION_NOW}000000)""",
    }
    for name in ("static_alerts", "zscore_alerts", "ddos_alerts", "burst_alerts"):
        found[f"sql_{name}"] = found[name]
    found["stateful_evaluation"] = found["threshold_alert_log_grid"]
    return found
