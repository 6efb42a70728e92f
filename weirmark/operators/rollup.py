"""Rollups of enriched flows and the daily baseline.

Rollups are partial sums. They may be appended per micro-batch and are merged
on read, so a late flow simply adds another partial to its old slot. A sum that
64 bits cannot hold is NULL; a flow whose own total is NULL still counts as a flow.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmark.functions import ip, timeslot

SUMS = ("bytes", "packets", "flows")


def _sums() -> list[Column]:
    return [
        F.try_sum("total_bytes").alias("bytes"),
        F.try_sum("total_packets").alias("packets"),
        F.count(F.lit(1)).alias("flows"),
    ]


def merge_partials(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add up rows with equal keys."""
    return df.groupBy(*keys).agg(*[F.try_sum(c).alias(c) for c in SUMS])


def _per_prefix(raw: DataFrame, step: int, *columns: Column) -> DataFrame:
    """One row per flow and covering prefix; flows without a prefix vanish."""
    return raw.select(
        F.explode("prefixes").alias("prefix"),
        F.expr(timeslot.slot_start("time_received", step)).alias("time_received"),
        *columns,
        "total_bytes",
        "total_packets",
    )


def prefix_totals(raw: DataFrame, step: int = timeslot.MINUTE) -> DataFrame:
    """Bytes, packets and flows per prefix and time slot."""
    return _per_prefix(raw, step).groupBy("prefix", "time_received").agg(*_sums())


def source_profile(raw: DataFrame, step: int = timeslot.TEN_MINUTES) -> DataFrame:
    """Totals per prefix, source network (/24 or /64) and time slot.

    Groups by the network's bytes; only the grouped rows get its text.
    """
    network = F.expr(ip.source_network_key("src_addr", "etype"))
    sums = (
        _per_prefix(raw, step, network.alias("_network"))
        .filter("_network IS NOT NULL")
        .groupBy("prefix", "_network", "time_received")
        .agg(*_sums())
        .withColumns(
            {
                "_addr": F.expr(ip.source_network_addr("_network")),
                "_etype": F.expr(ip.source_network_etype("_network")),
            }
        )
    )
    return ip.with_ip_text(sums, {"network": ("_addr", "_etype")}).select(
        "prefix", "network", "time_received", *SUMS
    )


# fixed values: traffic classes with the protocol numbers, ether types and TCP
# flag bits they stand for; a flow may be in several
CLASSES = {
    "general": "true",
    "hopopt": "proto = 0",
    "tcp": "proto = 6",
    "udp": "proto = 17",
    "gre": "proto = 47",
    "esp": "proto = 50",
    "icmp": "etype = 2048 AND proto = 1 OR etype = 34525 AND proto = 58",
    "tcp_syn": "proto = 6 AND tcp_flags & 2 = 2",
    "tcp_rst": "proto = 6 AND tcp_flags & 4 = 4",
    "tcp_ack": "proto = 6 AND tcp_flags & 16 = 16",
}


def class_mask() -> str:
    """All classes of a flow as a bit mask (bit i = i-th class)."""
    return " | ".join(
        f"(CASE WHEN {test} THEN {1 << i} ELSE 0 END)" for i, test in enumerate(CLASSES.values())
    )


def mask_classes(mask: str) -> str:
    """Names of the classes in a mask."""
    names = ", ".join(
        f"CASE WHEN {mask} & {1 << i} <> 0 THEN '{name}' END" for i, name in enumerate(CLASSES)
    )
    return f"array_compact(array({names}))"


def class_profile(raw: DataFrame, step: int = timeslot.MINUTE) -> DataFrame:
    """Totals per prefix, traffic class and time slot, one row per class.

    Flows are first summed per class *combination* (a few dozen exist), so the
    fan-out to single classes runs on rollup rows and not on flows.
    """
    combined = (
        _per_prefix(raw, step, F.expr(class_mask()).alias("_mask"))
        .groupBy("prefix", "time_received", "_mask")
        .agg(*_sums())
    )
    single = combined.select(
        "prefix", "time_received", F.explode(F.expr(mask_classes("_mask"))).alias("proto"), *SUMS
    )
    return merge_partials(single, ["prefix", "time_received", "proto"])


def pack_classes(profile: DataFrame) -> DataFrame:
    """One row per prefix and slot with a map class → (bytes, packets, flows)."""
    merged = merge_partials(profile, ["prefix", "time_received", "proto"])
    entry = F.struct(F.col("proto").alias("key"), F.struct(*SUMS).alias("value"))
    # a group holds one entry per class, ten at most
    return merged.groupBy("prefix", "time_received").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("classes")
    )


def unpack_classes(packed: DataFrame) -> DataFrame:
    """Inverse of :func:`pack_classes`."""
    return packed.select(
        "prefix", "time_received", F.explode("classes").alias("proto", "_sums")
    ).select("prefix", "time_received", "proto", "_sums.*")


def unzip_classes(nested: DataFrame, column: str = "protoMap") -> DataFrame:
    """Long form of parallel arrays ``column.proto/bytes/packets/flows``."""
    zipped = F.arrays_zip(*[F.col(f"{column}.{c}").alias(c) for c in ("proto", *SUMS)])
    return nested.select("prefix", "time_received", F.inline(zipped))


def daily_baseline(profile: DataFrame, day: datetime | int | None = None) -> DataFrame:
    """95th percentile and maximum of the minute values per prefix, class, day.

    Takes one closed day, or every day present. One shuffle on (prefix, class,
    day) serves both the merge of partials and the percentile; a group holds
    1,440 minutes at most, so no key can grow hot.
    """
    if day is not None:
        start = timeslot.to_epoch(day) // timeslot.DAY * timeslot.DAY
        profile = timeslot.time_range(profile, start, start + timeslot.DAY - 1)
    keys = ["prefix", "proto", "_day"]
    minutes = (
        profile.withColumn("_day", F.expr(timeslot.slot_start("time_received", timeslot.DAY)))
        .repartition(*keys)
        .groupBy(*keys, "time_received")
        .agg(*[F.try_sum(c).alias(c) for c in SUMS])
    )
    return (
        minutes.groupBy(*keys)
        .agg(
            # linear interpolation, then cut to a whole number
            *[F.floor(F.percentile(c, 0.95)).alias(f"p95_{c}") for c in SUMS],
            *[F.max(c).alias(f"max_{c}") for c in SUMS],
        )
        .withColumnRenamed("_day", "time_received")
        .select("prefix", "time_received", "proto", *[f"{k}_{c}" for k in ("p95", "max") for c in SUMS])
    )
