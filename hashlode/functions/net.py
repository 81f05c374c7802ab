"""Native codecs for addresses, ids and fixed-width records, on hex strings and longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IPv4 ranges as (first address, prefix length): fixed values.
PRIVATE_V4 = (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16))
LOOPBACK_V4 = (("127.0.0.0", 8),)
UNSPECIFIED_V4 = (("0.0.0.0", 32),)
SPECIAL_V4 = (("169.254.0.0", 16), ("224.0.0.0", 4), ("192.0.2.0", 24), ("198.51.100.0", 24), ("203.0.113.0", 24), ("198.18.0.0", 15))
#: IPv6 patterns on 32 lower-case hex digits: fixed values.
LOCAL_V6 = ("0{31}1", "0{32}", "f[cd].*")
SPECIAL_V6 = ("ff.*", "fe[89ab].*", "20010db8.*")


def number(hex_: Column) -> Column:
    return F.conv(hex_, 16, 10).cast("long")


def part(hex_: Column, start: int, length: int) -> Column:
    """``length`` bytes from byte ``start`` of a hex string."""
    return F.substring(hex_, start * 2 + 1, length * 2)


def v4_number(ip: Column) -> Column:
    """A dotted address as a long; null if it is none."""
    bits = F.split(ip, r"\.")
    ok = ip.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & F.forall(bits, lambda b: b.try_cast("int") <= 255)
    return F.when(ok, F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s * 256 + b.try_cast("long")))


def v4_text(n: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def _in_v4(n: Column, ranges: tuple[tuple[str, int], ...]) -> Column:
    out = F.lit(False)
    for first, length in ranges:
        low = sum(int(x) << s for x, s in zip(first.split("."), (24, 16, 8, 0), strict=True))
        out = out | n.between(low, low + (1 << (32 - length)) - 1)
    return out


def _like(hex32: Column, patterns: tuple[str, ...]) -> Column:
    return hex32.rlike("^(" + "|".join(patterns) + ")$")


def routable(v4: Column, v6_hex: Column) -> Column:
    """Publicly routable, for discovery: no private, local, multicast or documentation range (C11)."""
    bad4 = _in_v4(v4, PRIVATE_V4 + LOOPBACK_V4 + UNSPECIFIED_V4 + SPECIAL_V4)
    return F.coalesce(F.when(v4.isNotNull(), ~bad4), ~_like(v6_hex, LOCAL_V6 + SPECIAL_V6), F.lit(False))


def reachable_peer(v4: Column, v6_hex: Column, port: Column) -> Column:
    """The looser filter of enrichment: port not 0; link-local, multicast and documentation ranges pass."""
    bad4 = _in_v4(v4, PRIVATE_V4 + LOOPBACK_V4 + UNSPECIFIED_V4)
    return F.coalesce(port != 0, F.lit(False)) & F.coalesce(F.when(v4.isNotNull(), ~bad4), ~_like(v6_hex, LOCAL_V6), F.lit(False))


def chunks(hex_: Column, size: int) -> Column:
    """Whole chunks of ``size`` bytes; a rest is ignored."""
    return F.regexp_extract_all(hex_, F.lit(f"(.{{{size * 2}}})"), F.lit(1))


def compact_node(hex_: Column, family: int) -> Column:
    """struct(id, ip, port) of a 26-byte (v4) or 38-byte (v6) record; ip of v6 as 32 hex digits."""
    wide = 4 if family == 4 else 16
    ip = part(hex_, 20, wide)
    return F.struct(part(hex_, 0, 20).alias("id"), (v4_text(number(ip)) if family == 4 else ip).alias("ip"), number(part(hex_, 20 + wide, 2)).cast("int").alias("port"))


def compact_peer(hex_: Column) -> Column:
    """struct(family, ip, port) of 6 or 18 bytes; null for any other length."""
    v4 = F.struct(F.lit(4).alias("family"), v4_text(number(part(hex_, 0, 4))).alias("ip"), number(part(hex_, 4, 2)).cast("int").alias("port"))
    v6 = F.struct(F.lit(6).alias("family"), part(hex_, 0, 16).alias("ip"), number(part(hex_, 16, 2)).cast("int").alias("port"))
    return F.when(F.length(hex_) == 12, v4).when(F.length(hex_) == 36, v6)


def xor_distance(a: Column, b: Column) -> Column:
    """XOR of two 40-digit ids, as 40 digits that order as the distance does."""
    lanes = (number(part(a, 4 * i, 4)).bitwiseXOR(number(part(b, 4 * i, 4))) for i in range(5))
    return F.concat(*(F.lpad(F.lower(F.hex(x)), 8, "0") for x in lanes))


def time_key(ms: Column, info_hash: Column) -> Column:
    """16 hex digits of max(ms, 0), then the hash: orders by time, then hash."""
    return F.concat(F.lpad(F.lower(F.hex(F.greatest(ms, F.lit(0)))), 16, "0"), info_hash)


def time_of_key(key: Column) -> Column:
    return number(F.substring(key, 1, 16))
