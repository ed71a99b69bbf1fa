"""32-bit hashes of strings as column expressions, and coins that don't depend on partitioning.

Numbers are BIGINT masked to 32 bits. Products stay below 2**63 (ANSI mode raises on overflow), so
a 32-bit factor is applied by its 16-bit halves. Characters count by code point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The public constants of FNV-1a, djb2, sdbm and the murmur3 finalizer.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
DJB2_START, SDBM_FACTOR = 5381, 65599
MURMUR_A, MURMUR_B = 0x85EBCA6B, 0xC2B2AE35
MASK = 0xFFFFFFFF


def u32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def times(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32, of x below 2**32."""
    high, low = factor >> 16, factor & 0xFFFF
    return u32(F.shiftleft((x * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16) + x * F.lit(low))


def characters(s: Column) -> Column:
    """Code points; null of null."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))


def _folded(s: Column, start: int, step) -> Column:
    return F.aggregate(characters(s), F.lit(start).cast("bigint"), lambda h, c: u32(step(h, c)))


def fnv1a(s: Column, start: int = FNV_OFFSET) -> Column:
    return _folded(s, start, lambda h, c: h.bitwiseXOR(c) * F.lit(FNV_PRIME))


def djb2(s: Column) -> Column:
    return _folded(s, DJB2_START, lambda h, c: h * 33 + c)


def sdbm(s: Column) -> Column:
    return _folded(s, 0, lambda h, c: h * F.lit(SDBM_FACTOR) + c)


def hash32(s: Column) -> Column:
    """FNV-1a with the murmur3 finalizer."""
    folded = lambda h, by: h.bitwiseXOR(F.shiftright(h, by))
    h = let(fnv1a(s), lambda h: folded(h, 16))
    h = let(let(h, lambda h: times(h, MURMUR_A)), lambda h: folded(h, 13))
    return let(let(h, lambda h: times(h, MURMUR_B)), lambda h: folded(h, 16))


def shard_of(s: Column, shards: int) -> Column:
    """djb2 as a signed number, without its sign, modulo shards."""
    return F.pmod(F.abs(let(djb2(s), lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))), F.lit(shards))


def coin(salt: str, *keys: Column) -> Column:
    """A number in [0, 1) from a salt and keys; the same wherever and however often it is computed."""
    text = F.concat_ws("|", F.lit(salt), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


def bloom_slots(s: Column, m: int, k: int) -> Column:
    """k probe places (h1 + i * h2) mod m, h1 of FNV-1a, h2 of djb2 xor sdbm, sums and products modulo 2**32."""
    both = F.struct(fnv1a(s).alias("h1"), djb2(s).bitwiseXOR(sdbm(s)).alias("h2"))
    steps = F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))
    return let(both, lambda h: F.transform(steps, lambda i: F.pmod(u32(h["h1"] + u32(i * h["h2"])), F.lit(m))))
