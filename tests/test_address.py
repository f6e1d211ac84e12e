import ipaddress
import random

from pyspark.sql import functions as F

from recallflow.functions.address import groups, is_internal
from recallflow.operators.analytics import is_infra_ip


def _spellings(a):
    """The address in every form it may be written."""
    out = [str(a), a.exploded, str(a).upper()]
    if a.version == 4:
        n = int(a)
        out += [f"::ffff:{a}", f"0:0:0:0:0:ffff:{a}", f"::ffff:{n >> 16:x}:{n & 0xFFFF:x}", f"::FFFF:{n >> 16:04X}:{n & 0xFFFF:04X}"]
    else:
        out += [":".join(f"{int(g, 16):x}" for g in a.exploded.split(":")), f"{a}%eth0"]
    return out


def test_addresses_equal_the_registries(spark):
    rng = random.Random(5)
    edge = []
    for n in ("0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 "
              "::/127 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 fc00::/7 fe80::/10").split():
        net = ipaddress.ip_network(n)
        kind = type(net.network_address)
        for v in (int(net.network_address) - 1, int(net.network_address), int(net.broadcast_address), int(net.broadcast_address) + 1):
            if 0 <= v < 1 << net.max_prefixlen and not (net.version == 6 and v >> 32 == 0 and v > 1):
                edge.append(kind(v))
    edge += [ipaddress.IPv4Address(rng.getrandbits(32)) for _ in range(150)] + [ipaddress.IPv6Address(rng.getrandbits(128)) for _ in range(100)]
    edge += [ipaddress.ip_address(a) for a in ("192.0.0.9", "192.0.0.10", "2001:1::1", "2001:3::5", "2001:4:112::9", "2001:20::1", "2a00:1450::1", "8.8.8.8", "::", "::1")]
    want = {s: a.is_private or a.is_loopback or a.is_link_local for a in edge for s in _spellings(a)}
    rows = spark.createDataFrame([(s,) for s in want], "ip string").select("ip", is_internal(F.col("ip")).alias("x"), groups(F.col("ip")).isNotNull().alias("ok"))
    found = {r.ip: r.x for r in rows.collect()}
    assert {s for s in want if found[s] != want[s]} == set()
    assert rows.where("NOT ok").count() == 0


def test_texts_that_are_no_address(spark):
    texts = ["", "unknown", None, " Unknown ", "10.0.0", "256.1.1.1", "1:2:3", "::1::", ":::1", "1:2:3:4:5:6:7:8:9", "12345::", "g::1", "10.0.0.1:80", "host", "1::2:3:4:5:6:7:8"]
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", groups(F.col("ip")).alias("g"), is_infra_ip(F.col("ip")).alias("x")).collect()
    assert all(r.g is None for r in rows)
    assert {r.ip for r in rows if r.x} == {"", "unknown", None, " Unknown "}
