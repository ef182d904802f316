"""Unsigned 24-bit arithmetic on BIGINT columns: all results wrap, booleans are 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 24) - 1
#: Stands for unreachable, absent or the minimum of nothing at an operator's outer edge; inside it is null.
INF = MASK


def wrap(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK))


def add(a: Column, b: Column) -> Column:
    return wrap(a + b)


def sub(a: Column, b: Column) -> Column:
    return wrap(a - b)


def mul(a: Column, b: Column) -> Column:
    return wrap(a * b)


def div(a: Column, b: Column) -> Column:
    """Floor division; a zero divisor raises."""
    return F.call_function("div", a, b)


def mod(a: Column, b: Column) -> Column:
    return a % b


def eq(a: Column, b: Column) -> Column:
    return (a == b).cast("bigint")


def ne(a: Column, b: Column) -> Column:
    return (a != b).cast("bigint")


def lt(a: Column, b: Column) -> Column:
    return (a < b).cast("bigint")


def gt(a: Column, b: Column) -> Column:
    return (a > b).cast("bigint")


def le(a: Column, b: Column) -> Column:
    return (a <= b).cast("bigint")


def ge(a: Column, b: Column) -> Column:
    return (a >= b).cast("bigint")


def not0(a: Column) -> Column:
    return (a != 0).cast("bigint")


def band(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bor(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bxor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def shl(a: Column, b: Column) -> Column:
    """Left shift; 24 places or more leave nothing."""
    return F.when(b < 24, wrap(F.call_function("shiftleft", a, b.cast("int")))).otherwise(F.lit(0).cast("bigint"))


def shr(a: Column, b: Column) -> Column:
    return F.when(b < 24, F.call_function("shiftright", a, b.cast("int"))).otherwise(F.lit(0).cast("bigint"))


def select(c: Column, a: Column, b: Column) -> Column:
    return F.when(c != 0, a).otherwise(b)


def popcount(a: Column) -> Column:
    return F.bit_count(a).cast("bigint")


def bit_length(a: Column) -> Column:
    return F.when(a == 0, F.lit(0)).otherwise(F.length(F.bin(a))).cast("bigint")


def pack(*fields: tuple[Column, int]) -> Column:
    """Fields (column, bits), lowest first, in one number."""
    out, at = F.lit(0).cast("bigint"), 0
    for column, bits in fields:
        out = out.bitwiseOR(F.shiftleft(column.bitwiseAND(F.lit((1 << bits) - 1)), at))
        at += bits
    return out


def unpack(c: Column, *bits: int) -> list[Column]:
    out, at = [], 0
    for b in bits:
        out.append(F.shiftright(c, at).bitwiseAND(F.lit((1 << b) - 1)))
        at += b
    return out


def _fold(upto: Column, zero: Column, step) -> Column:  # noqa: ANN001
    """Folds 1 .. upto; nothing for upto below 1."""
    numbers = F.when(upto >= 1, F.sequence(F.lit(1).cast("bigint"), upto)).otherwise(F.expr("CAST(array() AS ARRAY<BIGINT>)"))
    return F.aggregate(numbers, zero, step)


def factorial(n: Column) -> Column:
    return _fold(n, F.lit(1).cast("bigint"), lambda a, x: mul(a, x))


def fibonacci(n: Column) -> Column:
    pair = lambda a, b: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return _fold(n, pair(F.lit(0), F.lit(1)), lambda s, _: pair(s["b"], add(s["a"], s["b"])))["a"]


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor; gcd(0, 0) = 0. Euclid needs at most 35 steps on 24 bits."""
    pair = lambda x, y: F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    step = lambda s, _: pair(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]), F.when(s["y"] == 0, F.lit(0)).otherwise(F.try_mod(s["x"], s["y"])))
    return F.aggregate(F.sequence(F.lit(1), F.lit(36)), pair(a, b), step)["x"]


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(wrap(F.call_function("div", a, gcd(a, b)) * b))


def powmod(b: Column, e: Column, m: Column) -> Column:
    """b to the e modulo m by squaring over the 24 bits of e; 0 to the 0 is 1 % m."""
    pair = lambda r, s: F.struct(r.cast("bigint").alias("r"), s.cast("bigint").alias("s"))
    bit = lambda i: F.call_function("shiftright", e, i).bitwiseAND(F.lit(1))
    step = lambda a, i: pair(F.when(bit(i) == 1, a["r"] * a["s"] % m).otherwise(a["r"]), a["s"] * a["s"] % m)
    return F.aggregate(F.sequence(F.lit(0), F.lit(23)), pair(F.lit(1) % m, b % m), step)["r"]


def isqrt(a: Column) -> Column:
    """Whole square root; the double's root is off by at most one."""
    r = F.floor(F.sqrt(a.cast("double")))
    return F.when(r * r > a, r - 1).when((r + 1) * (r + 1) <= a, r + 1).otherwise(r).cast("bigint")


def trailing_zeros(a: Column) -> Column:
    return F.when(a == 0, F.lit(24)).otherwise(F.bit_count(a.bitwiseXOR(a - 1)) - 1).cast("bigint")


def triangular(a: Column) -> Column:
    return wrap(F.call_function("div", a * (a + 1), F.lit(2)))


def digit_sum(a: Column, base: int) -> Column:
    """Sum of a's digits in a base from 2 on."""
    places, p = [], 1
    while p <= MASK:
        places.append(p)
        p *= base
    return sum((F.call_function("div", a, F.lit(p)) % base for p in places[1:]), a % base).cast("bigint")


def collatz(a: Column) -> Column:
    """Steps to 1 of the 3n + 1 walk, counted for a whole Arrow batch at once; 0 and 1 take none. Below 2^24 the walk stays within BIGINT."""
    import numpy as np
    import pandas as pd

    def steps(x):  # noqa: ANN001, ANN202
        value = x.fillna(0).to_numpy(np.int64).copy()
        count, at = np.zeros(len(value), np.int64), np.flatnonzero(value > 1)
        while len(at):
            v = value[at]
            value[at] = np.where(v & 1, 3 * v + 1, v >> 1)
            count[at] += 1
            at = at[value[at] > 1]
        return pd.Series(count).where(x.notna())

    steps.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(steps, "bigint")(a)
