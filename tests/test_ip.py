import ipaddress
import random
import socket

from pyspark.sql import functions as F

from weirmark.functions import ip


def _pick(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def _addresses(n=400):
    rnd = random.Random(7)
    out = [bytes(16), bytes(15) + b"\x01", socket.inet_pton(socket.AF_INET6, "2001:db8::")]
    out += [socket.inet_pton(socket.AF_INET6, t) for t in (
        "::ffff:1.2.3.4", "::1.2.3.4", "1:0:0:2:0:0:3:4", "1:0:2:3:4:5:6:7", "fe80::1:0:0:1",
        "0:0:1::", "1::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "0:1:0:1:0:1:0:1", "::ffff:0:0")]
    while len(out) < n:
        out.append(b"".join(
            rnd.choice([b"\0\0", b"\0\0", bytes([0, rnd.randrange(256)]), rnd.randbytes(2)]) for _ in range(8)))
    return out


def test_ipv6_text_matches_inet_ntop(spark):
    rows = [(a,) for a in _addresses()]
    got = _pick(spark, rows, "a binary", "a", F.expr(ip.ipv6_text("a")))
    assert [t for _, t in got] == [socket.inet_ntop(socket.AF_INET6, bytes(a)) for a, _ in got]


def test_ipv6_round_trip(spark):
    rows = [(a,) for a in _addresses()]
    back = F.expr(ip.parse_ipv6("t"))
    assert all(bytes(a) == bytes(b) for a, b in spark.createDataFrame(rows, "a binary").withColumn("t", F.expr(ip.ipv6_text("a"))).select("a", back).collect())


def test_parse_ip_agrees_with_ipaddress(spark):
    texts = ["1.2.3.4", "0.0.0.0", "255.255.255.255", "256.1.1.1", "01.2.3.4", "1.2.3", "1.2.3.4.5", "",
             "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::",
             "1::2::3", ":::", ":1", "1:", "12345::", "g::", "::ffff:9.8.7.6", "1:2:3:4:5:6:7.8.9.10",
             "2001:DB8::A", "1:2:3:4:5:6:7", "::1.2.3.400", "1.2.3.4::"]
    got = _pick(spark, [(t,) for t in texts], "t string", "t", F.expr(ip.parse_ip("t")))
    for text, parsed in got:
        try:
            want = ipaddress.ip_address(text)
        except ValueError:
            assert parsed is None, text
            continue
        assert parsed.family == want.version, text
        assert int.from_bytes(parsed.key, "big") == int(want), text


def test_parse_network_agrees_with_ipaddress(spark):
    texts = ["10.0.0.0/8", "0.0.0.0/0", "1.2.3.4/32", "1.2.3.4", "10.1.2.3/16", "10.0.0.0/33", "10.0.0.0/-1",
             "10.0.0.0/255.0.0.0", "10.0.0.0/0.255.255.255", "10.0.0.0/255.0.255.0", "172.16.0.0/12",
             "10.0.0.0/15", "192.168.1.128/25", "0.0.0.0/1", "128.0.0.0/1", "192.168.1.255/31",
             "::/0", "::1/128", "2001:db8::/32", "2001:DB8:0:0::/48", "2001:db8::1/32", "fe80::/10",
             "2001:db8::/129", "2001:db8:0:1::/63", "2001:db8:0:0:8000::/65", "::1", "x/8", "10.0.0.0/8/8", "/8",
             "8000::/1", "2001:db8::/64", "1.2.3.4/"]
    got = _pick(spark, [(t,) for t in texts], "t string", "t", F.expr(ip.parse_network("t")))
    for text, parsed in got:
        try:
            want = ipaddress.ip_network(text, strict=False)
        except ValueError:
            assert parsed is None, text
            continue
        assert parsed is not None, text
        assert (parsed.family, parsed.length) == (want.version, want.prefixlen), text
        assert int.from_bytes(parsed.start, "big") == int(want.network_address), text
        assert int.from_bytes(parsed.end, "big") == int(want.broadcast_address), text
        assert parsed.name == str(want), text
        try:
            ipaddress.ip_network(text)
            assert parsed.is_network, text
        except ValueError:
            assert not parsed.is_network, text


def test_wire_addresses(spark):
    v4 = bytes([10, 1, 2, 3])
    doc = socket.inet_pton(socket.AF_INET6, "2001:db8::")
    rows = [(v4, 0x800), (v4 + bytes(12), 0x800), (v4 + bytes(12), None), (bytes(4), 0x800), (bytes(16), None),
            (doc, 0x86DD), (doc, None), (socket.inet_pton(socket.AF_INET6, "2001:db8::5"), None)]
    got = _pick(spark, rows, "a binary, e int", F.expr(ip.ip_text("a", "e")),
                F.hex(F.expr(ip.ip_key("a", "e"))), F.expr(ip.is_all_zero("a")))
    assert [g[0] for g in got] == ["10.1.2.3", "10.1.2.3", "10.1.2.3", "0.0.0.0", "0.0.0.0",
                                   "2001:db8::", "32.1.13.184", "2001:db8::5"]
    assert got[0][1] == "00" * 12 + "0A010203" == got[1][1]
    assert got[5][1] == doc.hex().upper()
    assert [g[2] for g in got] == [False, False, False, True, True, False, False, False]


def test_with_ip_text_equals_expression(spark):
    rows = [(a, 0x86DD) for a in _addresses()] + [(bytes([10, 1, 2, i]), 0x800) for i in range(9)] + [(None, 5)]
    df = spark.createDataFrame(rows, "a binary, e int").withColumn("want", F.expr(ip.ip_text("a", "e")))
    got = ip.with_ip_text(df, {"t": ("a", "e")})
    assert got.columns == ["a", "e", "want", "t"]
    assert got.filter("NOT (t <=> want) AND a IS NOT NULL").count() == 0


def test_source_network(spark):
    v6 = socket.inet_pton(socket.AF_INET6, "2001:db8:1:2:3:4:5:6")
    rows = [(bytes([10, 1, 2, 3]), 0x800), (v6, 0x86DD), (bytes([10, 1, 2, 3]), 0x806)]
    net = ip.source_network_key(ip.ip_key("a", "e"), "e")
    df = spark.createDataFrame(rows, "a binary, e int").withColumn("n", F.expr(net))
    text = ip.ip_text(ip.source_network_addr("n"), ip.source_network_etype("n"))
    got = df.select(F.expr(f"CASE WHEN n IS NOT NULL THEN {text} END")).collect()
    assert [g[0] for g in got] == ["10.1.2.0", "2001:db8:1:2::", None]
