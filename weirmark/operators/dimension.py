"""Upkeep of the small tables (rules, routers) as batch jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmark.functions import ip
from weirmark.operators.joins import lookup_join
from weirmark.sources.dims import latest_by_id

# fixed values: what a rule may hold
RULE_TYPES = ("threshold", "zscore", "advanced_ddos")
SENSITIVITIES = ("low", "medium", "high")
TARGETS = ("bits", "packets")
MAX_NAME = 256


def new_id() -> Column:
    """Random id of 32 hexadecimal digits."""
    return F.expr("replace(uuid(), '-', '')")


def find(df: DataFrame, id: str) -> DataFrame:
    """The row with an id, if any."""
    return df.filter(F.col("id") == id)


def upsert(current: DataFrame, changes: DataFrame, version: str, key: str = "id") -> DataFrame:
    """Insert or replace rows; the highest ``version`` of a key wins.

    ``current`` may lack the version column, it then counts as older.
    """
    if version not in current.columns:
        current = current.withColumn(version, F.lit(None).cast(changes.schema[version].dataType))
    return latest_by_id(current.unionByName(changes), version, key)


def delete(current: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among ``ids``."""
    return lookup_join(current, ids.select(key).distinct(), [key], "left_anti")


def _checked(df: DataFrame, tests: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with the names of the failed tests.

    A test that is NULL has failed.
    """
    failed = ", ".join(
        f"CASE WHEN NOT coalesce({test}, false) THEN '{name}' END" for name, test in tests.items()
    )
    marked = df.withColumn("reasons", F.expr(f"array_compact(array({failed}))"))
    return (
        marked.filter("size(reasons) = 0").drop("reasons"),
        marked.filter("size(reasons) > 0"),
    )


def _among(column: str, values: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"{column} IN ({listed})"


def check_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rules with canonical prefixes, and rejected rules with reasons."""
    networks = rules.withColumn(
        "_nets", F.expr(f"transform(prefixes, p -> {ip.parse_network('p')})")
    )
    positive = {
        f"{c}": f"{c} IS NULL OR {c} >= 1"
        for c in ("bandwidth_threshold", "packet_threshold", "duration")
    }
    valid, rejected = _checked(
        networks,
        {
            "name": f"length(name) <= {MAX_NAME}",
            "prefixes": "size(prefixes) >= 1 AND forall(_nets, n -> n IS NOT NULL AND n.is_network)",
            "type": _among("type", RULE_TYPES),
            **positive,
            "zscore_sensitivity": f"zscore_sensitivity IS NULL OR {_among('zscore_sensitivity', SENSITIVITIES)}",
            "zscore_target": f"zscore_target IS NULL OR {_among('zscore_target', TARGETS)}",
        },
    )
    canonical = valid.withColumn("prefixes", F.expr("transform(_nets, n -> n.name)"))
    return canonical.drop("_nets"), rejected.drop("_nets")


def check_routers(routers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid routers with canonical addresses, and rejected ones with reasons."""
    valid, rejected = _checked(
        routers.withColumn("_ip", F.expr(ip.parse_ip("router_ip"))),
        {
            "name": "name IS NOT NULL",
            "router_ip": "_ip IS NOT NULL",
            "default_sampling": "default_sampling >= 0",
        },
    )
    canonical = valid.withColumn("router_ip", F.expr(ip.key_text("_ip.key", "_ip.family")))
    return canonical.drop("_ip"), rejected.drop("_ip")


def _addressed(routers: DataFrame) -> DataFrame:
    """With the parsed address, which is the same for all its spellings."""
    return routers.withColumn("_ip", F.expr(ip.parse_ip("router_ip")))


def router_conflicts(routers: DataFrame) -> DataFrame:
    """Addresses held by more than one router, however they are spelled."""
    return (
        _addressed(routers)
        .groupBy("_ip")
        .agg(F.count_distinct("id").alias("routers"), F.min("id").alias("first_id"))
        .filter("routers > 1 AND _ip IS NOT NULL")
        .select(F.expr(ip.key_text("_ip.key", "_ip.family")).alias("router_ip"), "routers", "first_id")
    )


def new_routers(
    current: DataFrame, changes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Changes whose address is free, and those another router already has.

    Of several routers that claim a free address, the one with the first
    change by ``version`` (by id, if there is no such column) gets it.
    """
    # the least and greatest holder decide: somebody else holds the address
    # unless both are the changed router itself
    holders = _addressed(current).groupBy("_ip").agg(
        F.min("id").alias("_least"), F.max("id").alias("_greatest")
    )
    marked = lookup_join(_addressed(changes), holders, ["_ip"], "left").withColumn(
        "_taken", F.expr("coalesce(_least <> id OR _greatest <> id, false)")
    )
    order = [c for c in ("version", "id") if c in changes.columns]
    claims = marked.filter("NOT _taken AND _ip IS NOT NULL").groupBy("_ip")
    winners = claims.agg(F.min_by("id", F.struct(*order)).alias("_winner"))
    marked = lookup_join(marked, winners, ["_ip"], "left").withColumn(
        "_taken", F.expr("_taken OR coalesce(_winner <> id, false)")
    )
    marked = marked.select(*changes.columns, "_taken")
    return marked.filter("NOT _taken").drop("_taken"), marked.filter("_taken").drop("_taken")
