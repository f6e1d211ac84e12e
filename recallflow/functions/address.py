"""Internet addresses as eight numbers of 16 bits, and the ranges that are not public."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Private, loopback and link-local ranges of the address registries.
INTERNAL = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    "::/127", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
]
# Ranges inside the ones above that are public all the same.
PUBLIC = ["192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]

_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_BYTE}(?:\.{_BYTE}){{3}}"


def groups(ip: Column) -> Column:
    """The address as eight numbers, an IPv4 one as ::ffff:a.b.c.d; null if it is none.
    Letters may be of either case, a zone (%eth0) is left out."""
    host = F.regexp_replace(F.lower(F.trim(ip)), r"%[^%/:]+$", "")
    tail = F.regexp_extract(host, rf"(?:^|:)({_V4})$", 1)
    b = F.transform(F.split(tail, r"\."), lambda x: x.try_cast("int"))
    pair = lambda i: F.lower(F.hex(F.get(b, F.lit(i)) * 256 + F.get(b, F.lit(i + 1))))
    start = F.substr(host, F.lit(1), F.length(host) - F.length(tail))
    lead = F.when(start == "", F.lit("::ffff:")).otherwise(start)
    text = F.when(tail != "", F.concat(lead, pair(0), F.lit(":"), pair(2))).otherwise(host)
    sides = F.split(text, "::")
    side = lambda i: F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda x: x != "")
    left, right = side(0), side(1)
    held = F.size(left) + F.size(right)
    short = F.size(sides) == 2
    every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - held, F.lit(0))), right)
    # one colon between groups, at most one gap, which stands for one group or more
    form = text.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$") & text.contains(":")
    good = form & (F.size(sides) <= 2) & F.when(short, held <= 7).otherwise(held == 8)
    return F.when(good, F.transform(every, lambda x: F.conv(x, 16, 10).cast("int")))


def _inside(g: Column, network: str) -> Column:
    net = ipaddress.ip_network(network)
    bits, low = (net.prefixlen, int(net.network_address)) if net.version == 6 else (96 + net.prefixlen, 0xFFFF << 32 | int(net.network_address))
    out = F.lit(True)
    for k in range(8):
        own = min(16, max(0, bits - 16 * k))
        if own:
            mask = 0xFFFF << 16 - own & 0xFFFF
            out = out & (F.get(g, F.lit(k)).bitwiseAND(F.lit(mask)) == F.lit(low >> 112 - 16 * k & mask))
    return out


def is_internal(ip: Column) -> Column:
    """Whether an address is private, loopback or link-local, in any of its spellings; false
    for texts that are no address."""
    def test(g: Column) -> Column:
        held, free = F.lit(False), F.lit(False)
        for n in INTERNAL:
            held = held | _inside(g, n)
        for n in PUBLIC:
            free = free | _inside(g, n)
        return held & ~free

    # one element, so that the groups are computed once
    return F.coalesce(F.get(F.transform(F.array(groups(ip)), test), F.lit(0)), F.lit(False))
