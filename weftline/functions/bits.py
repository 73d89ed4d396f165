"""Unsigned 64-bit arithmetic on BIGINT columns, which raise on overflow under ANSI rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW16, _LOW32 = 0xFFFF, 0xFFFFFFFF


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it: steps that build on one another stay small trees."""
    return F.element_at(F.transform(F.array(x), f), 1)


def times(x: Column, constant: int) -> Column:
    """x * constant modulo 2 ** 64: halves of x by 16-bit limbs of the constant, summed up in two 32-bit halves."""
    c = [constant >> 16 * k & _LOW16 for k in range(4)]

    def product(low: Column, high: Column) -> Column:
        t = [low * F.lit(k).cast("long") for k in c]
        lower = t[0].bitwiseAND(F.lit(_LOW32)) + F.shiftleft(t[1].bitwiseAND(F.lit(_LOW16)), 16)
        upper = F.shiftrightunsigned(t[0], 32) + F.shiftrightunsigned(t[1], 16) + t[2] + F.shiftleft(t[3].bitwiseAND(F.lit(_LOW16)), 16)
        upper = upper + high * F.lit(c[0]).cast("long") + F.shiftleft((high * F.lit(c[1]).cast("long")).bitwiseAND(F.lit(_LOW16)), 16)
        return bound(lower, lambda v: F.shiftleft((upper + F.shiftrightunsigned(v, 32)).bitwiseAND(F.lit(_LOW32)), 32).bitwiseOR(v.bitwiseAND(F.lit(_LOW32))))

    return bound(x, lambda v: product(v.bitwiseAND(F.lit(_LOW32)), F.shiftrightunsigned(v, 32)))


def splitmix(x: Column) -> Column:
    """The splitmix64 finalizer."""

    def step(shift: int, constant: int) -> Callable[[Column], Column]:
        return lambda v: times(v.bitwiseXOR(F.shiftrightunsigned(v, shift)), constant)

    x = bound(bound(x, step(30, 0xBF58476D1CE4E5B9)), step(27, 0x94D049BB133111EB))
    return bound(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)))


def unsigned_mod(x: Column, n: int) -> Column:
    return F.pmod(F.pmod(F.shiftrightunsigned(x, 1), F.lit(n)) * 2 + x.bitwiseAND(F.lit(1)), F.lit(n))
