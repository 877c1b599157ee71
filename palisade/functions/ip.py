"""CIDR membership of textual IP addresses, in native expressions.

An IPv4 address equals its IPv4-mapped form (``::ffff:a.b.c.d``), so a block of either family
may match rows of the other.
"""
from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DOTTED = r"\.".join([_OCTET] * 4)
_MAPPED = ipaddress.IPv6Network("::ffff:0:0/96")


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` mentions it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _hex_octet(digits: Column) -> Column:
    return F.lpad(F.lower(F.hex(digits.try_cast("bigint"))), 2, "0")


def _no_groups() -> Column:
    return F.array().cast("array<string>")


def _groups(text: Column) -> Column:
    return F.when(text == "", _no_groups()).otherwise(F.split(text, ":"))


def _ipv6_digits(ip: Column) -> Column:
    # A dotted tail is rewritten to two hex groups first.
    tail_pattern = f"^(.*:){_DOTTED}$"
    part = [F.regexp_extract(ip, tail_pattern, i) for i in range(1, 6)]
    octets = [_hex_octet(p) for p in part[1:]]
    plain = F.concat(part[0], octets[0], octets[1], F.lit(":"), octets[2], octets[3])
    text = F.lower(F.when(ip.rlike(tail_pattern), plain).otherwise(ip))

    def from_halves(halves: Column) -> Column:
        compressed = F.size(halves) == 2
        head = _groups(F.get(halves, F.lit(0)))
        rest = F.when(compressed, _groups(F.get(halves, F.lit(1)))).otherwise(_no_groups())
        missing = F.lit(8) - F.size(head) - F.size(rest)
        shape = F.when(compressed, missing >= 1).otherwise(
            (F.size(halves) == 1) & (missing == 0))
        every = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), rest)
        return F.when(shape, _bound(every, lambda groups: F.when(
            F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")),
            F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))))

    return _bound(F.split(text, "::"), from_halves)


def ipv6_key(ip: Column) -> Column:
    """32 hex digits of an IPv6 address, which sort as the address does; null otherwise."""
    return F.when(ip.contains(":"), _bound(ip, _ipv6_digits))


def address_bits(ip: Column) -> Column:
    """128 binary digits of an address of either family, IPv4 in its mapped form, so that the
    first ``n`` of them are its prefix of that length; null for other text."""
    octets = [_hex_octet(F.regexp_extract(ip, f"^{_DOTTED}$", i)) for i in range(1, 5)]
    key = F.when(ip.rlike(f"^{_DOTTED}$"), F.concat(F.lit("0" * 20 + "ffff"), *octets)).otherwise(
        ipv6_key(ip))
    return _bound(key, lambda k: F.concat(*(
        F.lpad(F.conv(F.substring(k, at, 16), 16, 2), 64, "0") for at in (1, 17))))


def block_bits(block: Column) -> Column:
    """The fixed leading digits of a block in CIDR notation, host bits ignored; null for text
    that is no block."""
    address, length = F.split_part(F.trim(block), F.lit("/"), F.lit(1)), F.regexp_extract(
        F.trim(block), r"^[^/]+/(\d{1,3})$", 1).try_cast("int")
    short = address.rlike(f"^{_DOTTED}$")
    fixed = F.when(short & (length <= 32), length + 96).when(~short & (length <= 128), length)
    return F.when(fixed.isNotNull(), _bound(
        address_bits(address), lambda bits: bits.substr(F.lit(1), fixed)))


def _ipv4_pattern(block: ipaddress.IPv4Network) -> str:
    """Regex of a block's addresses: fixed octets, one listed octet, free octets."""
    parts = []
    for low, high in zip(block.network_address.packed, block.broadcast_address.packed):
        if (low, high) == (0, 255):
            parts.append(_OCTET)
        else:
            parts.append(f"(?:{'|'.join(str(n) for n in range(low, high + 1))})")
    return "^" + re.escape(".").join(parts) + "$"


def parse_block(block: str) -> ipaddress.IPv4Network | ipaddress.IPv6Network:
    return ipaddress.ip_network(block.strip(), strict=False)


def in_cidr(ip: Column, block: str) -> Column:
    """Whether the address lies in the block; text that is not an address does not."""
    network = parse_block(block)
    if network.version == 4:
        v4 = network
        v6 = ipaddress.IPv6Network(
            (int(_MAPPED.network_address) + int(v4.network_address), 96 + v4.prefixlen))
    else:
        v6 = network
        if v6.supernet_of(_MAPPED):
            v4 = ipaddress.IPv4Network("0.0.0.0/0")
        elif v6.subnet_of(_MAPPED):
            v4 = ipaddress.IPv4Network(
                (int(v6.network_address) & 0xFFFFFFFF, v6.prefixlen - 96))
        else:
            v4 = None
    low, high = (f"{int(a):032x}" for a in (v6.network_address, v6.broadcast_address))
    long_form = _bound(ip, lambda x: _bound(_ipv6_digits(x), lambda k: k.between(low, high)))
    short_form = F.lit(False) if v4 is None else ip.rlike(_ipv4_pattern(v4))
    return F.coalesce(
        F.when(ip.contains(":"), long_form).otherwise(short_form), F.lit(False))
