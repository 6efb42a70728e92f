"""Addresses and CIDR networks with built-in SQL functions only.

Wire addresses are binaries of 4 bytes (IPv4) or 16 bytes (IPv6, or IPv4
right-padded with zeros). Keys are 16 bytes, big-endian, IPv4 at the end.
Everything here stays in the JVM, so it is cheap enough for the fact table.

The functions take and return SQL text, for ``F.expr`` and ``selectExpr``: an
argument is a column name or any expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ETYPE_IPV4 = 0x0800
ETYPE_IPV6 = 0x86DD

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4_TEXT = rf"{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}"
_GROUPS = "[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*"


def _zeros(count: int) -> str:
    return "X'" + "00" * count + "'"


def pad16(addr: str) -> str:
    return f"rpad({addr}, 16, X'00')"


def is_all_zero(addr: str) -> str:
    """True for an empty address or one whose bytes are all zero."""
    return f"({pad16(addr)} = {_zeros(16)})"


def is_ipv4(addr: str, etype: str | None = None) -> str:
    """Family test: by length, then by ether type, then by the zero padding."""
    known = ""
    if etype is not None:
        known = f"WHEN {etype} = {ETYPE_IPV6} THEN false WHEN {etype} = {ETYPE_IPV4} THEN true"
    return (
        f"(CASE WHEN length({addr}) <= 4 THEN true {known}"
        f" ELSE substring({pad16(addr)}, 5, 12) = {_zeros(12)} END)"
    )


def ip_family(addr: str, etype: str | None = None) -> str:
    return f"CASE WHEN {is_ipv4(addr, etype)} THEN 4 ELSE 6 END"


def ip_key(addr: str, etype: str | None = None) -> str:
    """Wire address to the 16-byte key."""
    return (
        f"CASE WHEN {is_ipv4(addr, etype)}"
        f" THEN concat({_zeros(12)}, substring({pad16(addr)}, 1, 4)) ELSE {pad16(addr)} END"
    )


def ip_compact(addr: str, etype: str | None = None) -> str:
    """Wire address cut to 4 bytes (IPv4) or padded to 16 (IPv6): a join key
    that keeps the families apart."""
    return (
        f"CASE WHEN {is_ipv4(addr, etype)}"
        f" THEN substring({pad16(addr)}, 1, 4) ELSE {pad16(addr)} END"
    )


def ipv4_number(addr: str) -> str:
    """First four bytes of a wire address as a long."""
    return f"CAST(conv(hex(substring({pad16(addr)}, 1, 4)), 16, 10) AS BIGINT)"


def ipv4_text(number: str) -> str:
    """Dotted text of an IPv4 number."""
    octets = ", ".join(f"shiftright({number}, {s}) & 255" for s in (24, 16, 8, 0))
    return f"concat_ws('.', {octets})"


def key_high(key: str) -> str:
    """Upper 64 bits of a key as a two's complement long."""
    return f"CAST(conv(hex(substring({key}, 1, 8)), 16, -10) AS BIGINT)"


def key_low(key: str) -> str:
    """Lower 64 bits of a key as a two's complement long."""
    return f"CAST(conv(hex(substring({key}, 9, 8)), 16, -10) AS BIGINT)"


def halves_to_key(high: str, low: str) -> str:
    """Key from its two 64-bit halves."""
    return f"unhex(concat(lpad(hex({high}), 16, '0'), lpad(hex({low}), 16, '0')))"


# --- text of addresses ---


def _groups(key: str) -> str:
    """Eight groups without leading zeros, a colon before, between and after."""
    groups = ", ".join(
        f"lower(conv(hex(substring({key}, {i}, 2)), 16, 16))" for i in range(1, 17, 2)
    )
    return f"concat(':', concat_ws(':', {groups}), ':')"


def _zero_run(groups: str) -> str:
    """Longest run of two or more zero groups, NULL if there is none."""
    tests = " ".join(
        f"WHEN contains({groups}, '{':0' * n}:') THEN '{':0' * n}:'" for n in range(8, 1, -1)
    )
    return f"CASE {tests} END"


def _shortened(key: str, groups: str, run: str) -> str:
    """IPv6 text: the first longest zero run becomes ``::``, an IPv4-mapped or
    IPv4-compatible tail is written with dots."""
    dotted = ipv4_text(f"CAST(conv(hex(substring({key}, 13, 4)), 16, 10) AS BIGINT)")
    at = f"instr({groups}, {run})"
    head = f"substring({groups}, 2, greatest({at} - 2, 0))"
    tail = (
        f"substring({groups}, {at} + length({run}),"
        f" greatest(length({groups}) - {at} - length({run}), 0))"
    )
    return (
        f"CASE WHEN substring({key}, 1, 12) = {_zeros(12)} AND substring({key}, 13, 2) <> {_zeros(2)}"
        f" THEN concat('::', {dotted})"
        f" WHEN substring({key}, 1, 12) = X'{'00' * 10}FFFF' THEN concat('::ffff:', {dotted})"
        f" WHEN {run} IS NULL THEN substring({groups}, 2, length({groups}) - 2)"
        f" ELSE concat({head}, '::', {tail}) END"
    )


def with_ip_text(df: DataFrame, texts: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Add address texts: ``{output: (address column, ether type column or None)}``.

    In steps, so that each intermediate value is computed once per row; the
    IPv6 parts stay NULL, and cost nothing, for IPv4 addresses.
    """
    columns = df.columns
    steps: list[dict] = [{}, {}, {}]
    for out, (addr, etype) in texts.items():
        v4 = is_ipv4(addr, etype)
        steps[0][f"_g_{out}"] = F.expr(f"CASE WHEN NOT {v4} THEN {_groups(pad16(addr))} END")
        steps[0][f"_n_{out}"] = F.expr(f"CASE WHEN {v4} THEN {ipv4_number(addr)} END")
        steps[1][f"_r_{out}"] = F.expr(_zero_run(f"_g_{out}"))
        text6 = _shortened(pad16(addr), f"_g_{out}", f"_r_{out}")
        steps[2][out] = F.expr(
            f"CASE WHEN _n_{out} IS NOT NULL THEN {ipv4_text(f'_n_{out}')}"
            f" WHEN _g_{out} IS NOT NULL THEN {text6} END"
        )
    for step in steps:
        df = df.withColumns(step)
    return df.select(*columns, *texts)


def ipv6_text(key: str) -> str:
    """IPv6 text as one expression, see :func:`_let`."""
    return _let(
        "_k", key, _let("_g", _groups("_k"), _let("_r", _zero_run("_g"), _shortened("_k", "_g", "_r")))
    )


def ip_text(addr: str, etype: str | None = None) -> str:
    """Text of a wire address of either family as one expression."""
    return (
        f"CASE WHEN {is_ipv4(addr, etype)} THEN {ipv4_text(ipv4_number(addr))}"
        f" ELSE {ipv6_text(pad16(addr))} END"
    )


def key_text(key: str, family: str) -> str:
    """Text of a 16-byte key whose family (4 or 6) is known."""
    return (
        f"CASE WHEN {family} = 4 THEN {ipv4_text(key_low(key))} ELSE {ipv6_text(key)} END"
    )


# --- parsing, meant for the small dimension tables ---


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``: evaluated once and not repeated
    in the plan, at the price of leaving generated code."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def parse_ipv4(text: str) -> str:
    """Dotted text to a long; NULL where it is not an address."""
    octets = " + ".join(
        f"shiftleft(try_cast(try_element_at(_o, {i + 1}) AS BIGINT), {24 - 8 * i})" for i in range(4)
    )
    return (
        f"CASE WHEN {text} RLIKE '^{_IPV4_TEXT}$'"
        f" THEN {_let('_o', f'''split({text}, '[.]')''', octets)} END"
    )


def parse_ipv6(text: str) -> str:
    """IPv6 text to sixteen bytes; NULL where it is not an address."""
    tail = f"regexp_extract({text}, '^[0-9A-Fa-f:]*:({_IPV4_TEXT})$', 1)"
    digits = _let(
        "_h",
        f"lpad(hex({parse_ipv4('_tail')}), 8, '0')",
        "concat(substring(_h, 1, 4), ':', substring(_h, 5, 4))",
    )
    spelled = (
        f"CASE WHEN _tail <> '' THEN concat(regexp_replace({text}, '[0-9.]+$', ''), {digits})"
        f" ELSE {text} END"
    )
    widened = (
        "transform(_sides, s -> array_join(transform("
        "filter(split(s, ':'), g -> g <> ''), g -> lpad(g, 4, '0')), ''))"
    )
    present = "length(array_join(_halves, ''))"
    filled = (
        f"CASE WHEN size(_halves) = 1 AND {present} = 32 THEN _halves[0]"
        f" WHEN size(_halves) = 2 AND {present} <= 28"
        f" THEN concat(_halves[0], repeat('0', 32 - {present}), _halves[1]) END"
    )
    sound = (
        f"size(_sides) <= 2 AND forall(_sides, s -> s = '' OR s RLIKE '^{_GROUPS}$')"
    )
    packed = f"CASE WHEN {sound} THEN unhex({_let('_halves', widened, filled)}) END"
    return _let("_plain", _let("_tail", tail, spelled), _let("_sides", "split(_plain, '::', -1)", packed))


def parse_ip(text: str) -> str:
    """Address text to ``struct(family, key)``; NULL where it is invalid."""
    v4 = f"struct(4 AS family, {halves_to_key('0L', '_v4')} AS key)"
    v6 = "CASE WHEN _v6 IS NOT NULL THEN struct(6 AS family, _v6 AS key) END"
    return _let(
        "_v4",
        parse_ipv4(text),
        f"CASE WHEN _v4 IS NOT NULL THEN {v4} ELSE {_let('_v6', parse_ipv6(text), v6)} END",
    )


def _mask64(bits: str) -> str:
    """Long with its upper ``bits`` (0 to 64) set."""
    return (
        f"(CASE WHEN {bits} <= 0 THEN 0L WHEN {bits} >= 64 THEN -1L"
        f" ELSE shiftleft(-1L, 64 - ({bits})) END)"
    )


def _prefix_length(suffix: str, family: str) -> str:
    """Length after the slash: a number, or an IPv4 net or host mask."""
    limit = f"(CASE WHEN {family} = 4 THEN 32 ELSE 128 END)"
    ones = "4294967295L"
    net = f"({ones} & {_mask64('bit_count(_m) + 32')})"
    host = f"({ones} ^ ({ones} & {_mask64('64 - bit_count(_m)')}))"
    from_mask = (
        f"CASE WHEN _m = {net} THEN bit_count(_m) WHEN _m = {host} THEN 32 - bit_count(_m) END"
    )
    number = f"try_cast({suffix} AS INT)"
    return (
        f"CASE WHEN {suffix} IS NULL THEN {limit}"
        f" WHEN {suffix} RLIKE '^[0-9]{{1,3}}$' THEN CASE WHEN {number} <= {limit} THEN {number} END"
        f" WHEN {family} = 4 THEN {_let('_m', parse_ipv4(suffix), from_mask)} END"
    )


def parse_network(text: str) -> str:
    """Network text to ``struct(family, length, start, end, is_network, name)``.

    ``is_network`` is false where bits behind the length are set; ``name`` is
    the canonical spelling. NULL where the text is no network at all.
    """
    # an IPv4 key keeps its zero upper part at both ends of the range
    high, low = _mask64("_wide"), _mask64("_wide - 64")
    bounds = (
        "struct("
        + halves_to_key(f"{key_high('_ip.key')} & {high}", f"{key_low('_ip.key')} & {low}")
        + " AS start, "
        + halves_to_key(f"{key_high('_ip.key')} | ~{high}", f"{key_low('_ip.key')} | ~{low}")
        + " AS end)"
    )
    packed = (
        "struct(_ip.family AS family, CAST(_len AS INT) AS length, _b.start AS start,"
        " _b.end AS end, _ip.key = _b.start AS is_network,"
        f" concat({key_text('_b.start', '_ip.family')}, '/', _len) AS name)"
    )
    ranged = _let(
        "_wide",
        "CASE WHEN _ip.family = 4 THEN _len + 96 ELSE _len END",
        _let("_b", bounds, packed),
    )
    body = _let(
        "_len",
        _prefix_length("try_element_at(_parts, 2)", "_ip.family"),
        f"CASE WHEN _ip IS NOT NULL AND _len IS NOT NULL THEN {ranged} END",
    )
    of_parts = f"CASE WHEN size(_parts) <= 2 THEN {_let('_ip', parse_ip('_parts[0]'), body)} END"
    return _let("_parts", f"split(trim({text}), '/', -1)", of_parts)


# --- source networks ---


def source_network_key(key: str, etype: str) -> str:
    """Leading bytes of the source: /24 for IPv4, /64 for IPv6, else NULL."""
    return (
        f"CASE WHEN {etype} = {ETYPE_IPV4} THEN substring({key}, 13, 3)"
        f" WHEN {etype} = {ETYPE_IPV6} THEN substring({key}, 1, 8) END"
    )


def source_network_addr(network: str) -> str:
    """Wire address of a key from :func:`source_network_key`."""
    return f"CASE WHEN length({network}) = 3 THEN concat({network}, X'00') ELSE {pad16(network)} END"


def source_network_etype(network: str) -> str:
    return f"CASE WHEN length({network}) = 3 THEN {ETYPE_IPV4} ELSE {ETYPE_IPV6} END"
