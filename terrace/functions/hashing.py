"""Hashes of row positions and category codes as column expressions, without overflow in ANSI mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers of the finalizer of MurmurHash3, 32 bits.
FIRST, SECOND = 0x85EBCA6B, 0xC2B2AE35
LOW = 0xFFFFFFFF


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body has it."""
    return F.get(F.transform(F.array(value), body), 0)


def times32(x: Column, c: int) -> Column:
    """x * c modulo 2**32 for x from 0 to 2**32 - 1: in two halves, so that no product leaves 48 bits."""
    high = (F.shiftright(x, 16) * c).bitwiseAND(F.lit(0xFFFF))
    return (x.bitwiseAND(F.lit(0xFFFF)) * c + F.shiftleft(high, 16)).bitwiseAND(F.lit(LOW))


def shifted(x: Column, bits: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, bits))


def mix32(x: Column) -> Column:
    first = let(let(x, lambda v: shifted(v, 16)), lambda v: times32(v, FIRST))
    second = let(let(first, lambda v: shifted(v, 13)), lambda v: times32(v, SECOND))
    return let(second, lambda v: shifted(v, 16))


def hash32(x: Column, seed: int) -> Column:
    """A 32-bit hash of a long: its halves are mixed one after the other."""
    low = lambda v: mix32(v.bitwiseAND(F.lit(LOW)).bitwiseXOR(F.lit(seed & LOW)))
    return let(x.cast("long"), lambda v: mix32(low(v).bitwiseXOR(F.shiftrightunsigned(v, 32))))


def hash01(x: Column, seed: int) -> Column:
    """A hash of a long, at least 0 and under 1."""
    return hash32(x, seed) / F.lit(float(1 << 32))


def hash32_of(x: int, seed: int) -> int:
    """hash32 of one integer."""

    def mix(v: int) -> int:
        v ^= v >> 16
        v = v * FIRST & LOW
        v ^= v >> 13
        v = v * SECOND & LOW
        return v ^ v >> 16

    return mix(mix(x & LOW ^ seed & LOW) ^ (x >> 32 & LOW))


def category_key(value: Column, buckets: int = 0, seed: int = 0) -> Column:
    """A category's key: its code rounded half away from zero (NaN and null: 0), or that hashed into `buckets`."""
    x = value.cast("double")
    x = F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.least(x, F.lit(9.0e18)), F.lit(-9.0e18)))
    code = F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5)).cast("long")
    return F.pmod(hash32(code, seed), F.lit(buckets)).cast("long") if buckets else code
