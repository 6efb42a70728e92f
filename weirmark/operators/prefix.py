"""Prefix ranges and matching of addresses against all covering prefixes.

Spark has no range-join strategy: ``addr BETWEEN start AND end`` becomes a
nested loop over every prefix. CIDR blocks allow an equi-join instead. For each
prefix length in use, the address shifted to that length is looked up in a hash
table, so a flow costs as many lookups as there are distinct lengths (161 at
most, a handful in practice), however many prefixes exist.

With many lengths, or more prefixes than can be broadcast, the bounds of all blocks
cut the number line into elementary intervals, each with its list of
covering prefixes. An address then takes the list of the last bound before it, found by one
sorted pass over bounds and distinct addresses.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirmark.functions import ip
from weirmark.operators import joins
from weirmark.session import ensure_checkpoint_folder

# Above this many distinct lengths the plan would get too long.
MAX_LOOKUPS = 24


def rule_prefixes(rules: DataFrame, *columns: str) -> DataFrame:
    """One row per rule and prefix; a prefix listed twice counts once."""
    return rules.select(*columns, F.explode(F.array_distinct("prefixes")).alias("prefix"))


def list_prefixes(rules: DataFrame) -> DataFrame:
    """Distinct prefixes of all rules."""
    return rule_prefixes(rules).distinct()


def prefix_ranges(rules: DataFrame) -> DataFrame:
    """``prefix, family, length, start, end`` of every distinct valid prefix."""
    return (
        list_prefixes(rules)
        .withColumn("net", F.expr(ip.parse_network("prefix")))
        .filter("net IS NOT NULL")
        .select("prefix", "net.family", "net.length", "net.start", "net.end")
    )


@dataclass(frozen=True)
class PrefixIndex:
    """Stored lookup table with its checked size and the lengths in use."""

    table: DataFrame  # _tag, _upper, _lower → names of the prefixes with that block, and its bounds
    rows: int
    lengths: tuple[tuple[int, int], ...]  # (family, length), shortest first

    @cached_property
    def intervals(self) -> tuple[DataFrame, list[bytes]]:
        """Elementary intervals, built where they are needed first; see :func:`elementary_intervals`."""
        return elementary_intervals(self)


def index_prefixes(ranges: DataFrame) -> PrefixIndex:
    """Build the lookup table once and learn its size and lengths.

    The table is checkpointed to the shared folder, because every lookup of a
    chain would otherwise carry the parsing of all prefixes in its plan. The
    profile that reaches the driver has at most 162 rows.
    """
    ensure_checkpoint_folder(ranges.sparkSession)
    table = _lookup_table(ranges).checkpoint()
    found = table.groupBy("_tag").count().collect()
    return PrefixIndex(
        table=table,
        rows=sum(row["count"] for row in found),
        lengths=tuple(sorted(divmod(row["_tag"], 1000) for row in found)),
    )


def _split_address(df: DataFrame, key: str, family: str) -> DataFrame:
    """Numeric parts of an address; NULL where the family differs."""
    return df.withColumns(
        {
            "_v4": F.expr(f"CASE WHEN {family} = 4 THEN {ip.key_low(key)} END"),
            "_high": F.expr(f"CASE WHEN {family} = 6 THEN {ip.key_high(key)} END"),
            "_low": F.expr(f"CASE WHEN {family} = 6 THEN {ip.key_low(key)} END"),
        }
    )


_PARTS = ["_v4", "_high", "_low"]
_KEYS = ["_tag", "_upper", "_lower"]


def _lookup_key(family: int, length: int) -> tuple[str, str, str]:
    """The split address shifted to one prefix length, tagged with the length.

    The tag is NULL for the other family, so those rows match nothing.
    """
    own = "_v4" if family == 4 else "_high"
    tag = f"CASE WHEN {own} IS NOT NULL THEN {family * 1000 + length} END"
    if family == 4:
        return tag, f"shiftright(_v4, {32 - length})", "0L"
    if length == 0:
        return tag, "0L", "0L"
    if length <= 64:
        return tag, f"shiftrightunsigned(_high, {64 - length})", "0L"
    return tag, "_high", f"shiftrightunsigned(_low, {128 - length})"


def _lookup_table(ranges: DataFrame) -> DataFrame:
    """``_tag, _upper, _lower`` → names of the prefixes with exactly that block."""
    upper = (
        "CASE WHEN family = 4 THEN shiftright(_v4, 32 - length)"
        " WHEN length = 0 THEN 0L"
        " WHEN length <= 64 THEN shiftrightunsigned(_high, 64 - length) ELSE _high END"
    )
    lower = "CASE WHEN length > 64 THEN shiftrightunsigned(_low, 128 - length) ELSE 0L END"
    return (
        _split_address(ranges, "start", "family")
        .selectExpr(
            "family * 1000 + length AS _tag", f"{upper} AS _upper", f"{lower} AS _lower", "prefix",
            f"{_line('start', 'family')} AS _first", f"{_line('end', 'family')} AS _last",
        )
        .groupBy(*_KEYS)
        .agg(
            F.array_sort(F.collect_set("prefix")).alias("_names"),
            F.min("_first").alias("_first"),  # one block, so one value
            F.max("_last").alias("_last"),
        )
    )


def _match_by_lookups(df: DataFrame, index: PrefixIndex, output: str) -> DataFrame:
    """Chain of map-side lookups: no shuffle and no extra rows on the fact side.

    Every lookup of a family has the same build side and build keys, so Spark
    sends and keeps one hash table for all of them. IPv4 keys fit one long,
    for which Spark has a compact table.
    """
    v4 = index.table.filter("_tag < 6000").selectExpr(
        f"{_one_long('_tag', '_upper')} AS _key", "_names"
    )
    v6 = index.table.filter("_tag >= 6000").select(*_KEYS, "_names")
    names = []
    for i, (family, length) in enumerate(index.lengths):
        side = v4 if family == 4 else v6
        side = side.select(*[F.col(c).alias(f"{c}{i}") for c in side.columns])
        tag, upper, lower = _lookup_key(family, length)
        if family == 4:
            test = f"{_one_long(4000 + length, upper)} = _key{i}"
        else:
            test = f"{tag} = _tag{i} AND {upper} = _upper{i} AND {lower} = _lower{i}"
        df = df.join(F.broadcast(side), F.expr(test), "left")
        names.append(f"_names{i}")
    return df.withColumn(output, F.expr(f"flatten(array_compact(array({', '.join(names)})))"))


def _one_long(tag: str | int, upper: str) -> str:
    return f"{tag} * 4294967296L + {upper}"


def _line(key: str, family: str) -> str:
    """Place of an address on one line of both families, as binary that sorts like the number."""
    return f"concat(CASE WHEN {family} = 4 THEN X'04' ELSE X'06' END, {key})"


#: Parts of the line that are searched apart, and order of what stands at one place: blocks that
#: begin there, the address itself, blocks that end there.
BUCKETS = 64
BEGINS, ADDRESS, ENDED = 0, 1, 2


def elementary_intervals(index: PrefixIndex) -> tuple[DataFrame, list[bytes]]:
    """``_place, _kind, _list``: the prefixes that cover what follows each bound, up to the next; and splits of the line.

    A bound is the first address of a block (``BEGINS``) or its last (``ENDED``: the list holds after it).
    The splits are bounds that begin blocks, at most ``BUCKETS``, so each part of the line knows its list from its first row.
    """
    bounds = (
        index.table.select(F.col("_first").alias("_place"), F.lit(BEGINS).alias("_kind"))
        .unionByName(index.table.select(F.col("_last").alias("_place"), F.lit(ENDED).alias("_kind")))
        .distinct()
    )
    points = bounds.select("_place").distinct().selectExpr(
        "_place", "substring(_place, 2, 16) AS _key", "CASE WHEN substring(_place, 1, 1) = X'04' THEN 4 ELSE 6 END AS _family"
    )
    keys = ", ".join(
        f"struct({tag} AS _tag, {upper} AS _upper, {lower} AS _lower)"
        for tag, upper, lower in (_lookup_key(*pair) for pair in index.lengths)
    )
    blocks = (
        _split_address(points, "_key", "_family")
        .select("_place", F.inline(F.expr(f"array({keys})")))
        .filter("_tag IS NOT NULL")
    )
    # one block of each length at most covers a bound
    covering = (
        joins.lookup_join(blocks, index.table, _KEYS, small=index.rows <= joins.BROADCAST_ROWS)
        .groupBy("_place")
        .agg(F.array_sort(F.collect_list(F.struct("_tag", "_names", "_last"))).alias("_cover"))
    )
    lists = bounds.join(covering, "_place").select(
        "_place",
        "_kind",
        F.expr(f"flatten(transform(filter(_cover, b -> _kind = {BEGINS} OR b._last > _place), b -> b._names))").alias("_list"),
    )
    table = lists.checkpoint()
    begins = table.filter(F.col("_kind") == BEGINS).select("_place")
    split = begins.repartitionByRange(BUCKETS, "_place").groupBy(F.spark_partition_id().alias("part")).agg(F.min("_place").alias("at"))
    return table, sorted(bytes(r["at"]) for r in split.collect())


def _bucket(place: str, splits: list[bytes], below: int = 0) -> str:
    """Number of splits up to a place, by halving; 0 before the first, where no block is."""
    if not splits:
        return str(below)
    half = len(splits) // 2
    left, right = _bucket(place, splits[:half], below), _bucket(place, splits[half + 1 :], below + half + 1)
    return f"CASE WHEN {place} < X'{splits[half].hex()}' THEN {left} ELSE {right} END"


def _match_by_intervals(df: DataFrame, index: PrefixIndex, key: str, family: str, output: str) -> DataFrame:
    """For prefix tables too large to broadcast (or too many lengths).

    Works on distinct addresses, whose partial aggregation absorbs a flood of flows to one
    destination: one row per address meets the bounds of its part of the line in order and takes the list
    of the last one. A part is dealt over salts, with its bounds in each. The result is joined back by
    address; a destination with much of the traffic is split by the adaptive skew join.
    """
    intervals, splits = index.intervals
    df = df.withColumn("_place", F.expr(_line(key, family)))
    part = F.expr(_bucket("_place", splits)).alias("_part")
    addresses = df.select("_place").filter("_place IS NOT NULL").distinct().select(
        part,
        F.pmod(F.xxhash64("_place"), F.lit(joins.SALTS)).cast("int").alias("_salt"),
        "_place",
        F.lit(ADDRESS).alias("_kind"),
        F.expr("CAST(NULL AS ARRAY<STRING>)").alias("_list"),
    )
    bounds = intervals.select(part, F.explode(F.sequence(F.lit(0), F.lit(joins.SALTS - 1))).alias("_salt"), "_place", "_kind", "_list")
    line = Window.partitionBy("_part", "_salt").orderBy("_place", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        addresses.unionByName(bounds)
        .withColumn("_matched", F.last("_list", ignorenulls=True).over(line))
        .filter(F.col("_kind") == ADDRESS)
        .select("_place", "_matched")
    )
    joined = df.join(found, "_place", "left")
    return joined.withColumn(output, F.expr("coalesce(_matched, CAST(array() AS ARRAY<STRING>))"))


def match_prefixes(
    df: DataFrame,
    index: PrefixIndex,
    key: str,
    family: str,
    output: str = "prefixes",
    max_rows: int = joins.BROADCAST_ROWS,
    max_lookups: int = MAX_LOOKUPS,
) -> DataFrame:
    """Add an array of all prefixes that cover the address, shortest first.

    The array is empty where nothing matches. Families are kept apart: ``::/0``
    covers IPv6 addresses only.
    """
    columns = df.columns
    if not index.lengths:
        return df.withColumn(output, F.expr("CAST(array() AS ARRAY<STRING>)"))
    if index.rows <= max_rows and len(index.lengths) <= max_lookups:
        matched = _match_by_lookups(_split_address(df, key, family), index, output)
    else:
        matched = _match_by_intervals(df, index, key, family, output)
    return matched.select(*columns, output)


def longest_prefix(prefixes: str) -> str:
    """Most specific entry of an array from :func:`match_prefixes`."""
    return f"try_element_at({prefixes}, -1)"


def prefixes_by_address(df: DataFrame, index: PrefixIndex, key: str, family: str) -> DataFrame:
    """Prefix list of each distinct address that has one."""
    distinct = df.select(key, family).distinct()
    return match_prefixes(distinct, index, key, family).filter("size(prefixes) > 0")
