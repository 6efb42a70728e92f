"""Numeric codes to names, sensitivity levels to factors.

Like the address functions these take and return SQL text.
"""

from __future__ import annotations

# ---- fixed values: they must equal the published protocol code points -------

FLOW_TYPES = {0: "UNKNOWN", 1: "SFLOW_5", 2: "NETFLOW_V5", 3: "NETFLOW_V9", 4: "IPFIX"}

ETHER_TYPES = {0x0800: "IPv4", 0x0806: "ARP", 0x86DD: "IPv6"}

TCP_FLAGS = {
    1: "FIN",
    2: "SYN",
    4: "RST",
    8: "PSH",
    16: "ACK",
    32: "URG",
    64: "ECN",
    128: "CWR",
    256: "NONCE",
    512: "RESERVED",
}

FORWARDING_STATES = {0: "UNKNOWN", 1: "FORWARDED", 2: "DROPPED", 3: "CONSUMED"}

# Two separate scales: z-score limits per rule, factors on a traffic baseline.
ZSCORE_LIMITS = {"low": 5, "medium": 4, "high": 3}
DEFAULT_ZSCORE_LIMIT = 4
BASELINE_FACTORS = {"low": 3.0, "medium": 2.0, "high": 1.5}
DEFAULT_BASELINE_FACTOR = 1.5

# ---- end of fixed values ----------------------------------------------------

_DISCARDED = 2


def value_map(value: str, names: dict, default: str) -> str:
    """Map ``value`` through a small table; ``default`` is an SQL expression."""

    def literal(item) -> str:
        return f"'{item}'" if isinstance(item, str) else f"{item!r}{'D' if isinstance(item, float) else ''}"

    cases = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in names.items())
    return f"(CASE {value} {cases} ELSE {default} END)"


def _named(code: str, names: dict) -> str:
    return value_map(code, names, f"CAST({code} AS STRING)")


def flow_type_name(code: str) -> str:
    return _named(code, FLOW_TYPES)


def ether_type_name(code: str) -> str:
    return _named(code, ETHER_TYPES)


def tcp_flag_name(flag: str) -> str:
    """Name of one flag value; other values as their number."""
    return _named(flag, TCP_FLAGS)


def bitmask_to_array(mask: str) -> str:
    """Powers of two set in ``mask``, lowest first."""
    powers = ", ".join(f"{1 << i}L" for i in range(32))
    return f"filter(array({powers}), p -> CAST({mask} AS BIGINT) & p <> 0)"


def tcp_flags_text(flags: str) -> str:
    """``EMPTY`` or the names of all set flags joined by ``+``, lowest first."""
    # the named flags stay in generated code, unnamed bits are the rare case
    named = ", ".join(
        f"CASE WHEN {flags} & {bit} <> 0 THEN '{name}' END" for bit, name in TCP_FLAGS.items()
    )
    every = f"array_join(transform({bitmask_to_array(flags)}, b -> {tcp_flag_name('b')}), '+')"
    return (
        f"CASE WHEN {flags} = 0 THEN 'EMPTY'"
        f" WHEN {flags} < {1 << len(TCP_FLAGS)} THEN concat_ws('+', {named})"
        f" ELSE {every} END"
    )


def forwarding_status_name(status: str) -> str:
    """Name of the two upper bits of the eight-bit forwarding status."""
    return value_map(f"shiftright({status}, 6)", FORWARDING_STATES, f"CAST({status} AS STRING)")


def effective_forwarding_status(
    status: str, next_hop_is_empty: str, out_if: str, discard_fix: str = "dropped"
) -> str:
    """Exporters that report discards as "no next hop, interface 0".

    ``discard_fix="dropped"`` yields a status that reads as DROPPED.
    ``discard_fix="bare_state"`` substitutes the bare state number, which the
    two-bit shift then reads as UNKNOWN.
    """
    substitute = {"dropped": _DISCARDED << 6, "bare_state": _DISCARDED}[discard_fix]
    return f"(CASE WHEN {next_hop_is_empty} AND {out_if} = 0 THEN {substitute} ELSE {status} END)"


def zscore_limit(sensitivity: str) -> str:
    return value_map(sensitivity, ZSCORE_LIMITS, str(DEFAULT_ZSCORE_LIMIT))


def baseline_factor(sensitivity: str) -> float:
    """Factor of a level given as a plain parameter."""
    return BASELINE_FACTORS.get(sensitivity, DEFAULT_BASELINE_FACTOR)
