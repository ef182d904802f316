"""Trees as path rows against nested tuples (left, value, right)."""

import itertools
import random

from pyspark.sql import functions as F

from loomspan.operators import lang, tree
from loomspan.u24 import MASK

R = random.Random(3)


def grow(n):
    if n == 0:
        return None
    k = R.randrange(n)
    return grow(k), R.randrange(MASK + 1), grow(n - 1 - k)


TREES = [grow(n) for n in range(0, 14) for _ in range(2)]


def rows(t, path=""):
    return [] if t is None else [*rows(t[0], path + "0"), (path, t[1]), *rows(t[2], path + "2")]


def table(spark, trees=TREES):
    return spark.createDataFrame([(i, *r) for i, t in enumerate(trees) for r in rows(t)], "t bigint, path string, v bigint")


def built(df, n=len(TREES)):
    found = {}
    for r in df.collect():
        found.setdefault(r.t, {})[r.path] = r.v
    make = lambda at, p: (make(at, p + "0"), at[p], make(at, p + "2")) if p in at else None
    out = [make(found.get(i, {}), "") for i in range(n)]
    assert sum(len(rows(t)) for t in out) == sum(map(len, found.values()))
    return out


def orders(t):
    if t is None:
        return [], [], []
    (a, b, c), (x, y, z) = orders(t[0]), orders(t[2])
    return a + [t[1]] + x, [t[1]] + b + y, c + z + [t[1]]


def height(t):
    return 0 if t is None else 1 + max(height(t[0]), height(t[2]))


def hashed(t):
    return 0 if t is None else (2 * hashed(t[0]) + 3 * t[1] + 5 * hashed(t[2]) + 1) & MASK


def sums(t, s=0):
    if t is None:
        return []
    s = (s + t[1]) & MASK
    return sums(t[0], s) + sums(t[2], s) or [s]


def overlay(a, b):
    return a if b is None else b if a is None else (overlay(a[0], b[0]), (a[1] + b[1]) & MASK, overlay(a[2], b[2]))


def mirror(t):
    return t and (mirror(t[2]), t[1], mirror(t[0]))


def test_orders_and_folds(spark):
    df = table(spark)
    for i, order in enumerate(("in", "pre", "post")):
        got = {}
        for r in sorted(tree.listed(df, order).collect()):
            got.setdefault(r.t, []).append(r.v)
        assert got == {k: orders(t)[i] for k, t in enumerate(TREES) if t}
    some = lambda f: {k: f(t) for k, t in enumerate(TREES) if t}
    assert {r.t: r.height for r in tree.facts(df).collect()} == some(height)
    assert {r.t: r.value for r in tree.fold_hash(df).collect()} == some(hashed)
    wide = lambda t: 0 if t is None else max(height(t[0]) + height(t[2]), wide(t[0]), wide(t[2]))
    assert {r.t: r.value for r in tree.diameter(df).collect()} == some(wide)
    got = {}
    for r in sorted(tree.path_sums(df).collect()):
        got.setdefault(r.t, []).append(r.v)
    assert got == some(sums)


def test_shapes(spark):
    df = table(spark)
    assert built(tree.mirrored(df)) == [mirror(t) for t in TREES]
    other = TREES[1:] + TREES[:1]
    assert built(tree.merged(df, table(spark, other))) == [overlay(a, b) for a, b in zip(TREES, other)]


def insert(t, x):
    if t is None:
        return None, x, None
    return t if x == t[1] else (insert(t[0], x), t[1], t[2]) if x < t[1] else (t[0], t[1], insert(t[2], x))


def no_least(t):
    return t if t is None else t[2] if t[0] is None else (no_least(t[0]), t[1], t[2])


def test_search_trees(spark):
    trees = []
    for n in range(9):
        for _ in range(3):
            t = None
            for x in R.sample(range(0, 40, 2), n):
                t = insert(t, x)
            trees.append(t)
    asked = [R.randrange(40) for _ in trees]
    df, n = table(spark, trees), len(trees)
    k = spark.createDataFrame(list(enumerate(asked)), "t bigint, k bigint")
    assert built(tree.inserted(df, k), n) == [insert(t, x) for t, x in zip(trees, asked)]
    assert built(tree.without_least(df), n) == [no_least(t) for t in trees]
    assert built(tree.inserted(tree.inserted(df, k), k), n) == [insert(t, x) for t, x in zip(trees, asked)]
    kth = {r.t: r.value for r in tree.kth(df, F.lit(2)).collect()}
    assert kth == {i: (orders(t)[0] + [MASK] * 3)[2] if len(orders(t)[0]) > 2 else MASK for i, t in enumerate(trees) if t}


def test_balanced(spark):
    def half(xs):
        if not xs:
            return None
        m = (len(xs) - 1) // 2
        return half(xs[:m]), xs[m], half(xs[m + 1 :])

    lists = [list(range(n)) for n in range(0, 30)]
    df = spark.createDataFrame([(i, p, v) for i, xs in enumerate(lists) for p, v in enumerate(xs)], "t bigint, pos bigint, v bigint")
    assert built(tree.from_sorted(df), len(lists)) == [half(xs) for xs in lists]


def test_parens(spark):
    texts = ["".join(x) for n in range(0, 8) for x in itertools.product("()", repeat=n)]

    def plain(s):
        bad = level = deepest = prefix = total = 0
        broken = False
        for i, c in enumerate(s):
            total += 1 if c == "(" else -1
            broken |= total < 0
            deepest = max(deepest, total)
            prefix = i + 1 if total == 0 and not broken else prefix
            if c == "(":
                level += 1
            elif level:
                level -= 1
            else:
                bad += 1
        return bad, level, deepest, prefix

    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = df.select("i", lang.paren_profile(F.col("s")).alias("p")).orderBy("i").collect()
    assert [tuple(r.p) for r in got] == [plain(s) for s in texts]


def test_language():
    for text in ("0", "7", "1+2*3", "(1+2)*3", " 2 * ( 3 + 4 ) * 5 ", "16777215+1", "((((9))))", "2*3+4*5", "1+(2+3)", "4096*4096"):
        e = lang.parse(text)
        assert lang.evaluate(e) == eval(text) & MASK == lang.eval_rpn(lang.rpn(text)) == lang.evaluate(lang.parse(lang.printed(e)))
        assert lang.evaluate(lang.simplified(e)) == lang.evaluate(e)
    deep = "(" * 5000 + "1" + ")" * 5000 + "+1" * 5000
    assert lang.evaluate(lang.parse(deep)) == 5001
    assert lang.simplified((2, (3, 0), (0, 1))) == (3, 0) and lang.simplified((1, (0, 0), (2, (3, 1), (0, 0)))) == (0, 0)
    assert lang.derivative((2, (3, 0), (0, 5))) == (1, (2, (0, 1), (0, 5)), (2, (3, 0), (0, 0)))
    assert lang.nnf((3, (4, (2, 0), (3, (0,))))) == (5, (3, (2, 0)), (0,))
    assert lang.models((5, (2, 0), (4, (2, 1), (3, (2, 2))))) == 5
    assert lang.stack_machine([(0, 7), (0, 2), (7, 0)]) == 5 and lang.stack_machine([(0, 0), (6, 3), (0, 9)]) == 0
    assert lang.matches("(()())") == [5, 2, 1, 4, 3, 0] and lang.bracket_error("([)]") == 3


def test_broken_text_is_null(spark):
    df = spark.createDataFrame(list(enumerate(["1+", "", None, "1 2", "a", "1-2", "(1", "3"])), "i int, s string")
    got = lang.each(df, ["i"], "s", lambda s: lang.evaluate(lang.parse(s))).orderBy("i").collect()
    assert [r.value for r in got] == [None] * 7 + [3]
