"""Unsigned 64-bit arithmetic on LongType bit patterns, without overflow errors, as plain column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = 0xFFFFFFFF
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def word(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x evaluated once, however often body uses it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def add(*terms: Column) -> Column:
    """The sum modulo 2**64."""
    low = sum((t.bitwiseAND(F.lit(LOW)) for t in terms[1:]), terms[0].bitwiseAND(F.lit(LOW)))
    high = sum((F.shiftrightunsigned(t, 32) for t in terms[1:]), F.shiftrightunsigned(terms[0], 32))
    return let(low, lambda s: F.shiftleft(high + F.shiftrightunsigned(s, 32), 32).bitwiseOR(s.bitwiseAND(F.lit(LOW))))


def times(x: Column, factor: int) -> Column:
    """The product modulo 2**64, from 16-bit limbs of x and 32-bit halves of the factor."""
    halves = (factor & LOW, factor >> 32)

    def product(v: Column) -> Column:
        part = lambda i, h: F.shiftleft(F.shiftrightunsigned(v, 16 * i).bitwiseAND(F.lit(0xFFFF)) * F.lit(halves[h]), 16 * i + 32 * h)
        return add(*(part(i, h) for i in range(4) for h in range(2) if 16 * i + 32 * h < 64))

    return let(x, product)


def xor_down(x: Column, bits: int) -> Column:
    return let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, bits)))


def rotated(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def splitmix(x: Column) -> Column:
    """splitmix64: the increment, then the finaliser."""
    z = times(xor_down(add(x, word(GOLDEN)), 30), FIRST)
    return xor_down(times(xor_down(z, 27), SECOND), 31)


def unsigned_order(x: Column) -> Column:
    """A signed value that sorts as x does when read as unsigned."""
    return x.bitwiseXOR(word(1 << 63))


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def unit(run: int, seed: int, sample: Column, stream: int, epoch: int) -> Column:
    """A reproducible float in [0, 1) for a sample and a stream of choices; run is a number made of the manifest's hash."""
    turned = lambda x, k: (x << k | x >> (64 - k)) % (1 << 64)
    fixed = (run + turned(seed, 7) + turned(stream, 29) + turned(epoch, 41)) % (1 << 64)
    ratio = lambda v: ((F.shiftrightunsigned(v, 32).cast("double") * 4294967296.0 + v.bitwiseAND(F.lit(LOW)).cast("double")) / 18446744073709551616.0).cast("float")
    return let(splitmix(add(rotated(sample, 17), word(fixed))), ratio)
