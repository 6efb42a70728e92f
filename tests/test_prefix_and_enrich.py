import ipaddress
import random

from pyspark.sql import functions as F

from weirmark import schema
from weirmark.functions import ip
from weirmark.operators import enrich, joins, prefix

NETS = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.128/25", "10.1.2.3/32", "10.0.0.0/15",
        "172.16.0.0/12", "255.255.255.255/32", "0.0.0.0/32", "128.0.0.0/1",
        "::/0", "2001:db8::/32", "2001:db8::/64", "2001:db8::/65", "2001:db8::1/128", "8000::/1", "ffff::/16",
        "2001:db8:0:0:8000::/65", "::/128"]


def rules_of(spark, *prefix_lists):
    rows = [(f"r{i}", f"Rule {i}", list(p), "threshold", 1000, None, 3, None, None) for i, p in enumerate(prefix_lists)]
    return spark.createDataFrame(rows, schema.RULES)


def index_of(spark, *prefix_lists):
    return prefix.index_prefixes(prefix.prefix_ranges(rules_of(spark, *prefix_lists)))


def addresses():
    rnd = random.Random(3)
    nets = [ipaddress.ip_network(n) for n in NETS]
    out = set()
    for net in nets:
        for a in (net.network_address, net.broadcast_address):
            for step in (-1, 0, 1):
                try:
                    out.add(a + step)
                except ipaddress.AddressValueError:
                    pass
        out.add(net[rnd.randrange(min(net.num_addresses, 2**62))])
    return sorted(out, key=lambda a: (a.version, int(a)))


def keyed(spark):
    rows = [(a.packed.rjust(16, b"\0"), a.version, str(a)) for a in addresses()] + [(None, None, None)]
    return spark.createDataFrame(rows, "key binary, family int, text string")


def expected(text):
    if text is None:
        return []
    addr = ipaddress.ip_address(text)
    hits = [n for n in map(ipaddress.ip_network, NETS) if n.version == addr.version and addr in n]
    return [str(n) for n in sorted(hits, key=lambda n: n.prefixlen)]


def test_every_way_of_matching_equals_ipaddress(spark):
    index, df = index_of(spark, NETS[:12], NETS[8:]), keyed(spark)
    assert index.rows == len(NETS)
    for limits in ({}, {"max_rows": 0}, {"max_lookups": 3}):
        got = prefix.match_prefixes(df, index, "key", "family", **limits)
        assert got.columns == ["key", "family", "text", "prefixes"]
        rows = got.collect()
        assert len(rows) == df.count()
        for row in rows:
            assert row.prefixes == expected(row.text), (row.text, limits)


def test_lookups_equal_between(spark):
    ranges = prefix.prefix_ranges(rules_of(spark, NETS))
    df = keyed(spark).filter("key IS NOT NULL")
    between = (
        df.alias("a").join(ranges.alias("r"), F.expr("a.family = r.family AND key BETWEEN start AND end"))
        .groupBy("text").agg(F.array_sort(F.collect_set("prefix")).alias("p")))
    looked = prefix.match_prefixes(df, index_of(spark, NETS), "key", "family").filter("size(prefixes) > 0")
    assert {r.text: r.p for r in between.collect()} == {r.text: sorted(r.prefixes) for r in looked.collect()}


def test_two_spellings_of_one_block_and_invalid_prefixes(spark):
    index = index_of(spark, ["10.0.0.0/8", "10.9.9.9/8", "nonsense", "10.0.0.0/40"], ["10.0.0.0/8"])
    df = spark.createDataFrame([(bytes(12) + bytes([10, 1, 1, 1]), 4)], "key binary, family int")
    assert prefix.match_prefixes(df, index, "key", "family").first().prefixes == ["10.0.0.0/8", "10.9.9.9/8"]


def test_no_prefixes_and_longest(spark):
    df = keyed(spark)
    none = prefix.match_prefixes(df, index_of(spark, []), "key", "family")
    assert none.filter("size(prefixes) = 0").count() == df.count()
    best = prefix.match_prefixes(df, index_of(spark, NETS), "key", "family").select(
        "text", F.expr(prefix.longest_prefix("prefixes")).alias("p"))
    for row in best.collect():
        assert row.p == (expected(row.text) or [None])[-1]


def test_matching_needs_no_shuffle_and_shares_one_table(spark, tmp_path):
    keyed(spark).write.parquet(str(tmp_path / "k"))
    got = prefix.match_prefixes(spark.read.parquet(str(tmp_path / "k")), index_of(spark, NETS), "key", "family")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Exchange hashpartitioning" not in plan
    assert plan.count("BroadcastExchange") - plan.count("ReusedExchange") <= 2 + plan.count("ReusedExchange")
    assert "ReusedExchange" in plan


def test_salted_join_equals_broadcast_join(spark):
    facts = spark.range(1000).selectExpr("CAST(id % 3 = 0 AS INT) * id AS k", "id")
    dim = spark.range(500).selectExpr("id AS k", "id * 2 AS v")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = joins.lookup_join(facts, dim, ["k"], how, small=True)
        b = joins.lookup_join(facts, dim, ["k"], how, small=False)
        assert a.columns == b.columns
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), how


def flow(spark, **changes):
    base = dict(
        type=2, sequence_num=1, sampling_rate=0, sampler_address=bytes([192, 168, 1, 1]),
        time_received_ns=1704067261_500000000, time_flow_start_ns=1704067260_000000000,
        time_flow_end_ns=1704067261_000000000, bytes=100, packets=2, src_addr=bytes([1, 2, 3, 4]),
        dst_addr=bytes([10, 1, 2, 3]), etype=0x800, proto=6, ip_tos=0, ip_ttl=64, ip_flags=0, tcp_flags=18,
        icmp_type=0, icmp_code=0, src_port=1, dst_port=2, src_as=1, dst_as=2, src_net=24, dst_net=24,
        next_hop=bytes(16), next_hop_as=0, bgp_next_hop=b"", in_if=1, out_if=0, src_mac=1, dst_mac=2,
        forwarding_status=64, observation_domain_id=0, observation_point_id=0)
    return tuple({**base, **changes}[n] for n in schema.FLOW.names)


def enriched(spark, flows, routers, **options):
    from weirmark.sources.dims import read_protocols

    df = spark.createDataFrame(flows, schema.FLOW)
    dims = spark.createDataFrame(routers, schema.ROUTERS)
    return enrich.enrich_flows(df, dims, index_of(spark, NETS), read_protocols(spark), **options)


def test_enrichment_of_single_flows(spark):
    v6 = ipaddress.ip_address("2001:db8::").packed
    flows = [
        flow(spark),
        flow(spark, sequence_num=2, sampler_address=bytes([9, 9, 9, 9])),
        flow(spark, sequence_num=3, sampling_rate=7, proto=200, tcp_flags=0, out_if=3),
        flow(spark, sequence_num=4, dst_addr=v6, src_addr=v6, etype=0x86DD, proto=58, next_hop=bytes([1, 1, 1, 1])),
        flow(spark, sequence_num=5, bytes=1 << 62, sampling_rate=4),
        flow(spark, sequence_num=6, dst_addr=b""),
    ]
    routers = [("b", "Router", "192.168.1.1", 500), ("a", "Same address", "192.168.1.1", 100)]
    rows = {r.sequence_num: r for r in enriched(spark, flows, routers).collect()}
    assert len(rows) == 6
    first = rows[1]
    assert (first.total_bytes, first.total_packets) == (10000, 200)  # one router only, the first by id
    assert first.sampler_address_str == "192.168.1.1" and first.dst_addr_str == "10.1.2.3"
    assert first.tcp_flags_str == "SYN+ACK" and first.proto_str == "TCP" and first.type_str == "NETFLOW_V5"
    assert first.forwarding_status_str == "DROPPED"
    assert first.prefixes == expected("10.1.2.3")
    assert str(first.time_received) == "2024-01-01 00:01:01.500000"
    assert (rows[2].total_bytes, rows[2].total_packets) == (0, 0)
    assert (rows[3].total_bytes, rows[3].proto_str, rows[3].tcp_flags_str) == (700, "200", "EMPTY")
    assert rows[3].forwarding_status_str == "FORWARDED"
    assert rows[4].dst_addr_str == "2001:db8::" and rows[4].prefixes == expected("2001:db8::")
    assert bytes(rows[4].next_hop) == bytes(12) + bytes([1, 1, 1, 1])
    assert rows[5].total_bytes is None and rows[5].total_packets == 8
    assert rows[6].dst_addr_str == "0.0.0.0"


def test_discard_fix_and_quarantine(spark):
    raw = enriched(spark, [flow(spark), flow(spark, sequence_num=2, bytes=1 << 62, sampling_rate=9)], [],
                   discard_fix="bare_state")
    assert raw.schema.names == schema.RAW.names
    assert [r.forwarding_status_str for r in raw.collect()] == ["UNKNOWN"] * 2
    assert [r.sequence_num for r in enrich.out_of_range(raw).collect()] == [2]


def test_elementary_intervals(spark, monkeypatch):
    """Neighbouring and nested blocks over several splits; an address is one row of the search."""
    monkeypatch.setattr(prefix, "BUCKETS", 5)
    nets = [f"10.0.{i}.0/24" for i in range(40)] + [f"10.0.{i}.{j}/{n}" for i in range(0, 40, 3) for j, n in ((0, 25), (128, 26), (255, 32))]
    nets += [f"2001:db8:{i:x}::/48" for i in range(20)] + ["10.0.0.0/19", "2001:db8::/44"]
    index = index_of(spark, nets)
    table, splits = index.intervals
    assert 1 < len(splits) <= 5 and table.count() < 2 * len(nets)  # blocks share bounds
    parsed = [ipaddress.ip_network(n) for n in nets]
    rnd = random.Random(5)
    points = {a + s for n in parsed for a in (n.network_address, n.broadcast_address) for s in (-1, 0, 1)}
    points |= {ipaddress.ip_address((10 << 24) + rnd.randrange(1 << 14)) for _ in range(500)}
    rows = [(a.packed.rjust(16, b"\0"), a.version, str(a)) for a in points] * 2
    df = spark.createDataFrame(rows, "key binary, family int, text string")
    found = prefix.match_prefixes(df, index, "key", "family", max_rows=0)
    got = found.collect()
    assert len(got) == len(rows)
    for row in got:
        a = ipaddress.ip_address(row.text)
        want = sorted((n for n in parsed if n.version == a.version and a in n), key=lambda n: n.prefixlen)
        assert [ipaddress.ip_network(p) for p in row.prefixes] == want  # names are kept as they are listed
