"""Declared folds over sequences (seq_id, pos, v).

An associative fold becomes plain aggregates, positions in them standing in for order, so that partial aggregation before
the shuffle is safe. A fold that isn't associative runs step by step over each sequence's ordered array and
never as partial aggregates; such a sequence must fit a task. `check` tests a monoid's laws before it is trusted.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan import u24
from loomspan.operators import seq
from loomspan.u24 import INF, MASK, wrap

SATURATED = 1_000_000


@dataclass(frozen=True)
class Monoid:
    """A fold as unit, lift of an element, combination of two states and what is shown at the end."""

    unit: object
    lift: Callable
    comb: Callable
    fin: Callable = staticmethod(lambda s: s)

    def over(self, items: list) -> object:
        state = self.unit
        for x in items:
            state = self.comb(state, self.lift(x))
        return self.fin(state)


def check(m: Monoid, elements: list, most: int = 3) -> list[str]:
    """Laws that fail on states reached from up to `most` elements: identity, associativity, homomorphism; commutativity is told too."""
    states = [m.unit]
    for n in range(1, most + 1):
        for xs in itertools.product(elements, repeat=n):
            s = m.unit
            for x in xs:
                s = m.comb(s, m.lift(x))
            if s not in states:
                states.append(s)
    states, broken = states[:40], []
    if any(m.comb(m.unit, s) != s or m.comb(s, m.unit) != s for s in states):
        broken.append("identity")
    if any(m.comb(m.comb(a, b), c) != m.comb(a, m.comb(b, c)) for a, b, c in itertools.product(states, repeat=3)):
        broken.append("associativity")
    for n in range(2, most + 1):
        for xs in itertools.product(elements, repeat=n):
            if any(m.fin(m.comb(_state(m, xs[:k]), _state(m, xs[k:]))) != m.fin(_state(m, xs)) for k in range(n + 1)):
                return [*broken, "homomorphism"]
    if any(m.comb(a, b) != m.comb(b, a) for a, b in itertools.product(states, repeat=2)):
        broken.append("commutativity")
    return broken


def _state(m: Monoid, xs: tuple) -> object:
    s = m.unit
    for x in xs:
        s = m.comb(s, m.lift(x))
    return s


# --- folds of one's own on DataFrames -------------------------------------------------------------------


class FoldError(ValueError):
    """A fold whose laws don't hold, so that partial results must not be combined."""


@dataclass(frozen=True)
class ColumnFold:
    """A fold in Spark expressions: state of no elements, of one, of two parts one behind the other, and what is shown of it."""

    unit: Callable[[], Column]
    lift: Callable[[Column], Column]
    comb: Callable[[Column, Column], Column]
    fin: Callable[[Column], Column] = staticmethod(lambda s: s)


#: Folds that passed their test, by name.
TRUSTED: dict[str, ColumnFold] = {}


def trust(name: str, model: Monoid, fold: ColumnFold, elements: list) -> ColumnFold:
    """Puts a fold among TRUSTED if its model in plain Python keeps the laws on states of up to three of elements; FoldError tells which law fails.

    Order is kept wherever parts meet, so that a fold needn't be commutative.
    """
    broken = [law for law in check(model, elements) if law != "commutativity"]
    if broken:
        raise FoldError(f"{name} can't be combined from parts: {', '.join(broken)} fails")
    TRUSTED[name] = fold
    return fold


def in_parts(df: DataFrame, fold: ColumnFold, column: str = "v") -> DataFrame:
    """(seq_id, value) of a trusted fold: parts of 65,536 positions by themselves, then the parts in order, so that a sequence of any length is spread over tasks."""
    rows = df.withColumn("block", F.shiftright("pos", 16))
    items = F.array_sort(F.collect_list(F.struct("pos", F.col(column).alias("x"))))
    part = F.aggregate(items, fold.unit(), lambda s, e: fold.comb(s, fold.lift(e["x"])))
    parts = rows.groupBy("seq_id", "block").agg(part.alias("part"))
    whole = F.array_sort(F.collect_list(F.struct("block", "part")))
    return parts.groupBy("seq_id").agg(fold.fin(F.aggregate(whole, fold.unit(), lambda s, e: fold.comb(s, e["part"]))).alias("value"))


def trusted(df: DataFrame, name: str) -> DataFrame:
    """in_parts of a fold by its name; FoldError for one that never passed its test."""
    if name not in TRUSTED:
        raise FoldError(f"{name} hasn't been tested")
    return in_parts(df, TRUSTED[name])


def _zero(value: int = 0) -> Callable[[], Column]:
    return lambda: F.lit(value).cast("bigint")


trust("product", Monoid(1, lambda x: x, lambda a, b: a * b & MASK), ColumnFold(_zero(1), lambda x: x, u24.mul), [0, 2, 3, MASK])
trust("gcd", Monoid(0, lambda x: x, math.gcd), ColumnFold(_zero(), lambda x: x, u24.gcd), [0, 4, 6, 9])


def _profile(*xs: Column) -> Column:
    return F.struct(*[x.cast("bigint").alias(n) for x, n in zip(xs, ("total", "low", "high"))])


#: Running height: total, lowest and highest prefix sum, where even values go up and odd ones down.
trust(
    "heights",
    Monoid((0, 0, 0), lambda x: (1, 0, 1) if x % 2 == 0 else (-1, -1, 0), lambda a, b: (a[0] + b[0], min(a[1], a[0] + b[1]), max(a[2], a[0] + b[2]))),
    ColumnFold(
        lambda: _profile(F.lit(0), F.lit(0), F.lit(0)),
        lambda x: F.when(x % 2 == 0, _profile(F.lit(1), F.lit(0), F.lit(1))).otherwise(_profile(F.lit(-1), F.lit(-1), F.lit(0))),
        lambda a, b: _profile(a["total"] + b["total"], F.least(a["low"], a["total"] + b["low"]), F.greatest(a["high"], a["total"] + b["high"])),
        lambda s: F.array(s["total"], s["low"], s["high"]),
    ),
    [1, 2, 4],
)


def affine_hash(df: DataFrame, base: int = 31) -> DataFrame:
    """h * base + x along the sequence, wrapping: each element counts base to the number of elements behind it, so sums may meet in any order."""
    size = df.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n__"))
    steps = F.sequence(F.lit(0), F.lit(23))
    pair = lambda r, s: F.struct(r.alias("r"), s.alias("s"))
    behind = F.col("n__") - 1 - F.col("pos")
    power = F.aggregate(steps, pair(F.lit(1).cast("bigint"), F.lit(base).cast("bigint")), lambda a, i: pair(F.when(F.call_function("shiftright", behind, i).bitwiseAND(F.lit(1)) == 1, wrap(a["r"] * a["s"])).otherwise(a["r"]), wrap(a["s"] * a["s"])))["r"]
    return seq.reduced(df.join(size, "seq_id"), wrap(F.sum(wrap(power * F.col("v")))), 0)


def _array(f: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: seq.arrays(df).select("seq_id", f(F.col("xs")).alias("value"))


def _steps(step: Callable[[Column, Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return _array(lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), step))


def _plain(value: Callable[[], Column], empty: int | None) -> Callable[[DataFrame], DataFrame]:
    return lambda df: seq.reduced(df, value(), empty)


def _v() -> Column:
    return F.col("v")


def _pos() -> Column:
    return F.col("pos")


def _key() -> Column:
    """A small key of each element, for folds over pairs (key, pos)."""
    return F.col("v") % 5


def _equal_neighbours(df: DataFrame) -> DataFrame:
    return seq.reduced(seq.neighbour(df, "v", "p__", -1), F.count_if(F.col("p__") == F.col("v")), 0)


def _top3(df: DataFrame) -> DataFrame:
    return seq.sort(df, True).where("pos < 3").groupBy("seq_id").agg(*[F.coalesce(F.max(F.when(F.col("pos") == i, F.col("v"))), F.lit(0)).alias(f"v{i}") for i in range(3)]).select("seq_id", F.array("v0", "v1", "v2").alias("value"))


def _average(df: DataFrame) -> DataFrame:
    pair = lambda m, n: F.struct(m.cast("bigint").alias("m"), n.cast("bigint").alias("n"))
    return _array(lambda xs: F.aggregate(xs, pair(F.lit(0), F.lit(0)), lambda s, x: pair(F.call_function("div", wrap(s["m"] * s["n"] + x), s["n"] + 1), s["n"] + 1))["m"])(df)


#: Associative folds: order does not matter to how partial results meet.
ASSOCIATIVE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sum": _plain(lambda: wrap(F.sum(_v())), 0),
    "product": lambda df: trusted(df, "product"),
    "length": _plain(lambda: F.count(_v()), 0),
    "max": _plain(lambda: F.max(_v()), 0),
    "min": _plain(lambda: F.min(_v()), INF),
    "count_even": _plain(lambda: F.count_if(_v() % 2 == 0), 0),
    "argmax_first": _plain(lambda: F.max_by(_pos(), F.struct(_v(), -_pos())), 0),
    "argmin_first": _plain(lambda: F.min_by(_pos(), F.struct(_v(), _pos())), 0),
    "second_largest": lambda df: seq.kth(df, 1, True),
    "longest_run": seq.longest_run,
    "is_sorted": seq.is_sorted,
    "last": _plain(lambda: F.max_by(_v(), _pos()), 0),
    "xor_all": _plain(lambda: F.call_function("bit_xor", _v()), 0),
    "category_set": _plain(lambda: F.call_function("bit_or", F.call_function("shiftleft", F.lit(1), (_v() % 7).cast("int"))), 0),
    "all_positive": _plain(lambda: F.bool_and(_v() > 0).cast("bigint"), 1),
    "any_zero": _plain(lambda: F.bool_or(_v() == 0).cast("bigint"), 0),
    "count_gt500": _plain(lambda: F.count_if(_v() > 500), 0),
    "sum_squares": _plain(lambda: wrap(F.sum(wrap(_v() * _v()))), 0),
    "gcd": lambda df: trusted(df, "gcd"),
    "lexmin_pair": _plain(lambda: F.to_json(F.min(F.struct(_key().alias("a"), _pos().alias("b")))), None),
    "top3_merge": _top3,
    "sat_sum_cap": _plain(lambda: F.least(F.sum(F.least(_v(), F.lit(SATURATED))), F.lit(SATURATED)), 0),
    "sat_sum_24": _plain(lambda: F.least(F.sum(_v()), F.lit(MASK)), 0),
    "minmax_pair": _plain(lambda: F.array(F.min(_v()), F.max(_v())), None),
    "mean_floor": _plain(lambda: F.call_function("div", wrap(F.sum(_v())), F.greatest(F.count(_v()), F.lit(1))), 0),
    "hash_affine": affine_hash,
    "adjacent_equal": lambda df: _equal_neighbours(seq.mapped(df, lambda v: v % 3)),
    "category_counts": _plain(lambda: F.array(*[F.count_if(_v() % 7 == i) for i in range(7)]), None),
    "max_priority_guest": _plain(lambda: F.array(F.max(_key()), F.min_by(_pos(), F.struct(-_key(), _pos()))), None),
    "first_violation": _plain(lambda: F.min(F.when(_v() % 4 != 0, _pos())), INF),
    "section_fill_cap6": _plain(lambda: F.least(F.count(_v()), F.lit(6)), 0),
}
#: Folds whose step isn't associative: always along the ordered array.
SEQUENTIAL: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sub_fold": _steps(u24.sub),
    "hash31": _steps(lambda a, x: wrap(a * 31 + x)),
    "abs_diff": _steps(lambda a, x: F.abs(a - x)),
    "alternating": _steps(lambda a, x: wrap(x - a)),
    "sat_sub": _steps(lambda a, x: F.greatest(a - x, F.lit(0))),
    "horner_square": _steps(lambda a, x: wrap(a * a + x)),
    "xorshift_hash": _steps(lambda a, x: wrap(a * 2).bitwiseXOR(x)),
    "midpoint": _steps(lambda a, x: F.shiftright(wrap(a + x), 1)),
    "sat_sum_unclamped": _steps(lambda a, x: F.least(wrap(a + x), F.lit(SATURATED))),
    "glitch_1e3": _steps(lambda a, x: F.when((a.bitwiseAND(F.lit(63)) == 63) & (x.bitwiseAND(F.lit(15)) == 15), F.lit(0)).otherwise(wrap(a + x))),
    "planted_point": _steps(lambda a, x: F.when((a == 12345678) & (x == 8765432), F.lit(0)).otherwise(wrap(a + x))),
    "avg_wrong_merge": _average,
    "adjacent_equal_wrong": lambda df: _equal_neighbours(seq.mapped(df, lambda v: v % 3)),
}


def fold(df: DataFrame, name: str) -> DataFrame:
    """(seq_id, value) of a declared fold."""
    return (ASSOCIATIVE.get(name) or SEQUENTIAL[name])(df)
