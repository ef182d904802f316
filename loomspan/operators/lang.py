"""Texts, tokens, expressions and small machines, one text in a row; Python runs over Arrow batches.

Expressions are tuples with a constructor number first: numbers (0, n), sums (1, a, b), products (2, a, b), variables (3, i);
formulas false (0,), true (1,), variables (2, i), not (3, a), and (4, a, b), or (5, a, b). All walks keep their own
stack, so that depth isn't limited. Text that breaks the grammar gives null.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.u24 import MASK

_KINDS = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
_PAIRS = {")": "(", "]": "[", "}": "{"}


def each(df: DataFrame, ids: list[str], column: str, f: Callable, out: str = "value", kind: str = "bigint") -> DataFrame:
    """(ids..., out): f of each row's value; null for null and where f raises ValueError, KeyError or IndexError."""
    kinds = {x.name: x.dataType.simpleString() for x in df.schema.fields}

    def safe(x):  # noqa: ANN001, ANN202
        try:
            return None if x is None else f(x)
        except (ValueError, KeyError, IndexError):
            return None

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            values = [safe(x) for x in batch.column("in__").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in ids], pa.array(values, _KINDS[kind])], names=[*ids, out])

    schema = ", ".join([f"`{i}` {kinds[i]}" for i in ids] + [f"`{out}` {kind}"])
    return df.select(*ids, F.col(column).alias("in__")).mapInArrow(run, schema)


# --- brackets (in the JVM) ---------------------------------------------------------------------------


def paren_profile(text: Column) -> Column:
    """struct(bad, open, deepest, prefix) of a text of ( and ): unmatched ), unmatched (, deepest nesting, longest balanced prefix."""
    zero = F.struct(*[F.lit(0).cast("bigint").alias(x) for x in ("at", "sum", "low", "high", "prefix")])

    def step(s: Column, c: Column) -> Column:
        total = s["sum"] + F.when(c == "(", 1).otherwise(-1)
        low = F.least(s["low"], total)
        return F.struct((s["at"] + 1).alias("at"), total.alias("sum"), low.alias("low"), F.greatest(s["high"], total).alias("high"), F.when((low == 0) & (total == 0), s["at"] + 1).otherwise(s["prefix"]).alias("prefix"))

    chars = F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
    return F.aggregate(chars, zero, step, lambda s: F.struct((-s["low"]).alias("bad"), (s["sum"] - s["low"]).alias("open"), s["high"].alias("deepest"), s["prefix"].alias("prefix")))


def matches(text: str) -> list[int]:
    """Place of each parenthesis's other one."""
    out, stack = [0] * len(text), []
    for i, c in enumerate(text):
        if c == "(":
            stack.append(i)
        else:
            out[i] = stack.pop()
            out[out[i]] = i
    return out


def bracket_error(text: str) -> int:
    """0 if all three kinds nest, the place from 1 of the first closing one that doesn't fit, or the length plus 1 if some stay open."""
    stack = []
    for i, c in enumerate(text):
        if c not in _PAIRS:
            stack.append(c)
        elif not stack or stack.pop() != _PAIRS[c]:
            return i + 1
    return len(text) + 1 if stack else 0


# --- arithmetic text ----------------------------------------------------------------------------------


def tokens(text: str) -> list[tuple[int, int]]:
    """(0, number), (1, code of an operator) or (2, code of a parenthesis); blanks are skipped, other characters break the grammar."""
    if re.search(r"[^0-9+*\-() ]", text):
        raise ValueError(text)
    return [(0, int(x)) if x.isdigit() else (1 if x in "+-*" else 2, ord(x)) for x in re.findall(r"[0-9]+|[-+*()]", text)]


def rpn(text: str) -> list[tuple[int, int]]:
    """Postfix tokens of a text of + * ( ), both operators to the left and * before +."""
    out, waiting, operand = [], [], False
    for kind, value in tokens(text):
        if kind == 0 or value == 40:
            if operand:
                raise ValueError(text)
            if kind == 0:
                if value > MASK:
                    raise ValueError(text)
                out.append((0, value))
                operand = True
            else:
                waiting.append(40)
            continue
        if not operand or value == 45:
            raise ValueError(text)
        while waiting and waiting[-1] != 40 and (value == 41 or waiting[-1] == 42 or value == 43):
            out.append((1, waiting.pop()))
        if value == 41:
            if not waiting:
                raise ValueError(text)
            waiting.pop()
        else:
            waiting.append(value)
            operand = False
    if not operand or 40 in waiting:
        raise ValueError(text)
    return out + [(1, x) for x in reversed(waiting)]


def eval_rpn(items: list[tuple[int, int]]) -> int:
    stack: list[int] = []
    for kind, value in items:
        if kind == 0:
            stack.append(value)
        else:
            b, a = stack.pop(), stack.pop()
            stack.append((a + b if value == 43 else a - b if value == 45 else a * b) & MASK)
    (result,) = stack
    return result


def parse(text: str) -> tuple:
    stack: list[tuple] = []
    for kind, value in rpn(text):
        if kind == 0:
            stack.append((0, value))
        else:
            b, a = stack.pop(), stack.pop()
            stack.append((1 if value == 43 else 2, a, b))
    return stack[0]


def folded(e: tuple, f: Callable[[tuple, list], object]) -> object:
    """f(node, results of its children) from the leaves up."""
    done: list = []
    stack = [(e, False)]
    while stack:
        node, ready = stack.pop()
        children = [x for x in node[1:] if isinstance(x, tuple)]
        if not ready and children:
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(children))
            continue
        first = len(done) - len(children)
        done[first:] = [f(node, done[first:])]
    return done[0]


def evaluate(e: tuple) -> int:
    return folded(e, lambda n, c: n[1] if n[0] == 0 else (c[0] + c[1] if n[0] == 1 else c[0] * c[1]) & MASK)


def depth(e: tuple) -> int:
    return folded(e, lambda n, c: 1 + max(c, default=0))


def printed(e: tuple) -> str:
    return folded(e, lambda n, c: str(n[1]) if n[0] == 0 else f"x{n[1]}" if n[0] == 3 else f"({c[0]}{'+' if n[0] == 1 else '*'}{c[1]})")


def simplified(e: tuple) -> tuple:
    """Constants folded; 0 and 1 vanish where they are neutral, a product with 0 is 0."""

    def f(n: tuple, c: list) -> tuple:
        if n[0] in (0, 3):
            return n
        a, b = c
        if a[0] == 0 and b[0] == 0:
            return (0, (a[1] + b[1] if n[0] == 1 else a[1] * b[1]) & MASK)
        neutral = (0, n[0] - 1)
        if n[0] == 2 and (0, 0) in (a, b):
            return (0, 0)
        return b if a == neutral else a if b == neutral else (n[0], a, b)

    return folded(e, f)


def derivative(e: tuple) -> tuple:
    """By variable 0, nothing simplified."""

    def f(n: tuple, c: list) -> tuple:
        if n[0] in (0, 3):
            return (0, int(n == (3, 0)))
        return (1, c[0], c[1]) if n[0] == 1 else (1, (2, c[0], n[2]), (2, n[1], c[1]))

    return folded(e, f)


def models(f: tuple) -> int:
    """How many of the 8 assignments of three variables make a formula true: a truth table in 8 bits."""
    table = (0b10101010, 0b11001100, 0b11110000)

    def bits(n: tuple, c: list) -> int:
        return (0, 255, None, None)[n[0]] if n[0] < 2 else table[n[1]] if n[0] == 2 else 255 ^ c[0] if n[0] == 3 else c[0] & c[1] if n[0] == 4 else c[0] | c[1]

    return folded(f, bits).bit_count()


def nnf(f: tuple) -> tuple:
    """Negations at variables only: each node gives its form and that of its negation."""

    def both(n: tuple, c: list) -> tuple:
        if n[0] < 2:
            return n, (1 - n[0],)
        if n[0] == 2:
            return n, (3, n)
        if n[0] == 3:
            return c[0][1], c[0][0]
        return (n[0], c[0][0], c[1][0]), (9 - n[0], c[0][1], c[1][1])

    return folded(f, both)[0]


# --- machines -----------------------------------------------------------------------------------------


def stack_machine(program: list[tuple[int, int]]) -> int:
    """Top of the stack at the end (0 if empty). Operations: 0 push, 1 add, 2 multiply, 3 double the top, 4 swap, 5 drop, 6 jump ahead if the popped top is 0, 7 subtract."""
    stack: list[int] = []
    at = 0
    while at < len(program):
        op, arg = program[at]
        at += 1
        if op == 0:
            stack.append(arg)
        elif op == 3:
            stack.append(stack[-1])
        elif op == 5:
            stack.pop()
        elif op == 6:
            if arg < at:
                raise ValueError("a jump back")
            if stack.pop() == 0:
                at = arg
        else:
            b, a = stack.pop(), stack.pop()
            stack += [b, a] if op == 4 else [(a + b if op == 1 else a * b if op == 2 else a - b) & MASK]
    return stack[-1] if stack else 0


def registers(program: Column) -> Column:
    """Four registers after a straight-line program of (op, a, b): 0 set to b, 1 add, 2 subtract, 3 multiply, 4 copy. Stays in the JVM."""
    start = F.array(*[F.lit(0).cast("bigint")] * 4)

    def step(r: Column, x: Column) -> Column:
        a, b = F.get(r, x["a"].cast("int")), F.get(r, x["b"].cast("int"))
        new = F.when(x["op"] == 0, x["b"]).when(x["op"] == 1, a + b).when(x["op"] == 2, a - b).when(x["op"] == 3, a * b).otherwise(b).bitwiseAND(F.lit(MASK))
        return F.transform(r, lambda old, i: F.when(i == x["a"], new).otherwise(old))

    return F.aggregate(program, start, step)
