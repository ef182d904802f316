"""Sequence operators on all short lists over {0, 1, 2} and on wide values, all lists in one table."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomspan import u24
from loomspan.operators import folds, keyed, seq
from loomspan.u24 import MASK

R = random.Random(4)
LISTS = [list(x) for n in range(1, 4) for x in itertools.product(range(3), repeat=n)] + [[R.randrange(MASK + 1) for _ in range(R.randrange(1, 40))] for _ in range(30)] + [[MASK] * 5, [MASK, 1], list(range(40, 0, -1))]


def table(spark, lists=LISTS):
    return spark.createDataFrame([(i, p, v) for i, xs in enumerate(lists) for p, v in enumerate(xs)] or [], "seq_id bigint, pos bigint, v bigint").repartition(3)


def lists(df):
    out = {i: [] for i in range(len(LISTS))}
    for r in sorted(df.select("seq_id", "pos", "v").collect()):
        assert r.pos == len(out[r.seq_id]), r
        out[r.seq_id].append(r.v)
    return list(out.values())


def values(df):
    out = {r.seq_id: r.value for r in df.collect()}
    return [out.get(i) for i in range(len(LISTS))]


def running(f):
    return lambda xs: list(itertools.accumulate(xs, f))


def run_heads(xs):
    return [k for k, _ in itertools.groupby(xs)]


STAGES = {
    "filter": (lambda d: seq.kept(d, lambda v: v % 2 == 0), lambda xs: [x for x in xs if x % 2 == 0]),
    "take": (lambda d: seq.take(d, 2), lambda xs: xs[:2]),
    "drop": (lambda d: seq.drop(d, 2), lambda xs: xs[2:]),
    "reverse": (seq.reverse, lambda xs: xs[::-1]),
    "sort": (seq.sort, sorted),
    "sort_desc": (lambda d: seq.sort(d, True), lambda xs: sorted(xs, reverse=True)),
    "dedup": (seq.dedup_runs, run_heads),
    "diff": (seq.diff, lambda xs: [(b - a) & MASK for a, b in zip(xs, xs[1:])]),
    "runsum": (lambda d: seq.running(d, "sum"), running(lambda a, b: (a + b) & MASK)),
    "runxor": (lambda d: seq.running(d, "xor"), running(lambda a, b: a ^ b)),
    "runmax": (lambda d: seq.running(d, "max"), running(max)),
    "runmin": (lambda d: seq.running(d, "min"), running(min)),
    "distinct": (seq.distinct_sorted, lambda xs: sorted(set(xs))),
    "append": (lambda d: seq.append(d, d), lambda xs: xs + xs),
    "merge": (lambda d: seq.merge(seq.sort(d), seq.sort(d)), lambda xs: sorted(xs + xs)),
    "zip": (lambda d: seq.zipped(d, seq.reverse(d), u24.add), lambda xs: [(a + b) & MASK for a, b in zip(xs, xs[::-1])]),
    "intersect": (lambda d: seq.intersect(d, seq.take(d, 1)), lambda xs: xs[:1]),
    "histogram": (lambda d: seq.group_counts(d, 3), lambda xs: [xs.count(i) for i in range(3)]),
}


@pytest.mark.parametrize("name", STAGES)
def test_stage(spark, name):
    f, plain = STAGES[name]
    assert lists(f(table(spark))) == [plain(xs) for xs in LISTS]


@pytest.mark.parametrize("name", ["runsum", "diff", "dedup", "filter", "runmin"])
def test_across_blocks(spark, name, monkeypatch):
    """The same with sequences over several blocks."""
    monkeypatch.setattr(seq, "BLOCK", 4)
    monkeypatch.setattr(seq, "_blocks", lambda df: df.withColumn("block", F.shiftright("pos", 2)))
    f, plain = STAGES[name]
    assert lists(f(table(spark))) == [plain(xs) for xs in LISTS]


def lis(xs):
    best = []
    for i, x in enumerate(xs):
        best.append(1 + max((best[j] for j in range(i) if xs[j] < x), default=0))
    return max(best)


REDUCERS = {
    "inversions": (seq.inversions, lambda xs: sum(a > b for a, b in itertools.combinations(xs, 2))),
    "lis": (seq.lis, lis),
    "median": (seq.median, lambda xs: sorted(xs)[len(xs) // 2]),
    "mode": (seq.mode, lambda xs: min(xs, key=lambda x: (-xs.count(x), x))),
    "longest_run": (seq.longest_run, lambda xs: max(len(list(g)) for _, g in itertools.groupby(xs))),
    "is_sorted": (seq.is_sorted, lambda xs: int(xs == sorted(xs))),
    "kth": (lambda d: seq.kth(d, 2), lambda xs: sorted(xs)[2] if len(xs) > 2 else 0),
    "argmax": (lambda d: seq.reduce(d, "argmax"), lambda xs: xs.index(max(xs))),
    "argmin": (lambda d: seq.reduce(d, "argmin"), lambda xs: xs.index(min(xs))),
    "above_first": (seq.count_above_first, lambda xs: sum(x > xs[0] for x in xs)),
    "closest": (lambda d: seq.closest(d, F.lit(1)), lambda xs: min(xs, key=lambda x: (abs(x - 1), x))),
    "first_at": (lambda d: seq.index_of(d, F.col("v") == 2, "first"), lambda xs: xs.index(2) if 2 in xs else MASK),
    "affine": (folds.affine_hash, lambda xs: __import__("functools").reduce(lambda h, x: (h * 31 + x) & MASK, xs, 0)),
}


@pytest.mark.parametrize("name", REDUCERS)
def test_reducer(spark, name):
    f, plain = REDUCERS[name]
    assert values(f(table(spark))) == [plain(xs) for xs in LISTS]


def test_empty_sequences(spark):
    every = spark.createDataFrame([(0,), (1,)], "seq_id bigint")
    some = table(spark, [[5, 7]])
    assert sorted(map(tuple, seq.reduce(some, "sum", every).collect())) == [(0, 12), (1, 0)]
    assert sorted(map(tuple, seq.reduce(some, "min", every).collect())) == [(0, 5), (1, MASK)]
    none = table(spark, [])
    for f, _ in STAGES.values():
        assert f(none).collect() == []


def test_bignum(spark):
    r = random.Random(2)
    digits = lambda n: [] if n == 0 else [n % 4096, *digits(n // 4096)]
    pairs = [(0, 0), (0, 5), (4095, 1), (4096**5 - 1, 1)] + [(r.randrange(4096 ** r.randrange(1, 7)), r.randrange(4096 ** r.randrange(1, 7))) for _ in range(40)]
    df = spark.createDataFrame([(i, digits(a), digits(b)) for i, (a, b) in enumerate(pairs)], "id int, a array<bigint>, b array<bigint>")
    got = df.select("id", seq.bignum_add(F.col("a"), F.col("b")).alias("s"), seq.bignum_mul(F.col("a"), F.col("b")).alias("p"), seq.bignum_mul_small(F.col("a"), F.lit(4095)).alias("k")).orderBy("id").collect()
    assert [(r.s, r.p, r.k) for r in got] == [(digits(a + b), digits(a * b), digits(a * 4095)) for a, b in pairs]


def test_fold_laws():
    good = folds.Monoid((0, 0), lambda x: (x, 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[0])
    affine = folds.Monoid((1, 0), lambda x: (31, x), lambda a, b: (a[0] * b[0] & MASK, (a[1] * b[0] + b[1]) & MASK), lambda s: s[1])
    assert folds.check(good, [0, 1, 2]) == [] and folds.check(affine, [0, 1, 2]) == ["commutativity"]
    assert "associativity" in folds.check(folds.Monoid(0, lambda x: x, lambda a, b: a - b), [0, 1, 2])
    assert "associativity" in folds.check(folds.Monoid(0, lambda x: x, lambda a, b: (a + b) >> 1), [0, 1, 5])


def test_keyed(spark):
    state = spark.createDataFrame([(1, 5), (2, 7)], "key bigint, value bigint")
    delta = spark.createDataFrame([(1, 4, 0), (1, 9, 1), (3, 2, 0)], "key bigint, value bigint, pos bigint")
    want = {"add": {1: 18, 2: 7, 3: 2}, "max": {1: 9, 2: 7, 3: 2}, "min": {1: 4, 2: 7, 3: 2}, "set": {1: 9, 2: 7, 3: 2}, "inc": {1: 7, 2: 7, 3: 1}, "dec": {1: 3, 2: 7, 3: MASK}, "set1": {1: 1, 2: 7, 3: 1}, "or": {1: 13, 2: 7, 3: 2}}
    for name, expected in want.items():
        assert {r.key: r.value for r in keyed.upsert(state, delta, name).collect()} == expected, name
    assert {r.key: r["values"] for r in keyed.push(delta).collect()} == {1: [9, 4], 3: [2]}
    assert [tuple(r) for r in keyed.selected(state, lambda v: v > 5).collect()] == [(0, 2, 7)]
