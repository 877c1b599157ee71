import ipaddress
import random

from pyspark.sql import functions as F

from palisade.operators.networks import most_specific

MAPPED = int(ipaddress.IPv6Address("::ffff:0:0"))


def number(address):
    return int(address) + (MAPPED if address.version == 4 else 0)


def table_of(blocks):
    """Fixed bits -> smallest text, by plain Python."""
    known = {}
    for text in blocks:
        try:
            net = ipaddress.ip_network(text.strip(), strict=False)
        except ValueError:
            continue
        length = net.prefixlen + (96 if net.version == 4 else 0)
        bits = f"{number(net.network_address):0128b}"[:length]
        known[bits] = min(text, known.get(bits, text))
    return known


def slow(ip, known):
    try:
        bits = f"{number(ipaddress.ip_address(ip)):0128b}"
    except ValueError:
        return None
    return next((known[bits[:n]] for n in range(128, -1, -1) if bits[:n] in known), None)


def check(spark, ips, blocks):
    df = spark.createDataFrame([(n, ip) for n, ip in enumerate(ips)], "n int, clientIp string")
    got = most_specific(df, spark.createDataFrame([(b,) for b in blocks], "cidr string"))
    rows = {r["n"]: r["network"] for r in got.collect()}
    known = table_of([b for b in blocks if b is not None])
    assert got.columns == ["n", "clientIp", "network"] and len(rows) == len(ips)
    assert rows == {n: None if ip is None else slow(ip, known) for n, ip in enumerate(ips)}
    return rows


def test_nested_blocks_of_both_families(spark):
    ips = ["10.1.2.3", "::ffff:10.1.2.3", "10.1.9.9", "11.0.0.1", "2001:db8::1", "2001:DB8:0:1::",
           "192.168.0.1", "no address", "10.1.2", "", None, "10.1.2.3", "::1"]
    blocks = ["10.0.0.0/8", "10.1.2.77/24", "10.1.2.0/24", " 10.1.2.3/32", "2001:db8::/32",
              "2001:db8::/64", "::ffff:192.168.0.0/112", "300.0.0.0/8", "10.0.0.0/40",
              "10.0.0.0", "x/8", None, "::/200"]
    rows = check(spark, ips, blocks)
    assert rows[0] == " 10.1.2.3/32" and rows[2] == "10.0.0.0/8" and rows[3] is None
    assert check(spark, ips, [*blocks, "::/0"])[3] == "::/0"
    assert set(check(spark, ips, ["nothing"]).values()) == {None}
    assert check(spark, [], blocks) == {}


def test_a_hundred_thousand_nested_blocks_and_a_hot_subnet(spark):
    rng = random.Random(3)
    blocks = [f"{rng.randrange(1, 30)}.{rng.randrange(256)}.{rng.randrange(256)}"
              f".{rng.randrange(256)}/{rng.randrange(6, 33)}" for _ in range(90_000)]
    blocks += [f"2001:db8:{rng.randrange(40):x}:{rng.randrange(99):x}::{rng.randrange(9):x}"
               f"/{rng.randrange(20, 129)}" for _ in range(10_000)]
    ips = [f"{rng.randrange(1, 32)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}"
           for _ in range(3000)]
    ips += [f"2001:db8:{rng.randrange(44):x}:{rng.randrange(99):x}::{rng.randrange(12):x}"
            for _ in range(1000)]
    ips += [f"7.7.7.{rng.randrange(256)}" for _ in range(2500)] + ["7.7.7.7"] * 2500
    assert sum(v is not None for v in check(spark, ips, blocks).values()) > 5000


def test_no_cross_join_and_addresses_are_asked_once(spark):
    df = spark.range(10).select(F.concat(F.lit("10.0.0."), "id").alias("clientIp"))
    blocks = spark.createDataFrame([("10.0.0.0/8",)], "cidr string")
    plan = most_specific(df, blocks)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
