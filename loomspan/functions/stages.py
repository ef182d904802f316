"""Stage language: one word a line, turned into a chain of sequence operators.

    map lin A B | xor M | and M | add C | sq | mod M | div A | ind P      values
    filter P, take K, drop K, reverse, dedup, runsum, runxor, runmax, runmin, diff, sort
    reduce sum | xor | count | max | min | first | last | argmax | cntgtfirst | idxfirst P | idxlast P | idxsum P      last line only
    id                                                                    nothing at all
    P: gt K, lt K, ge K, even, odd, modeq M R

Anything else is a PlanError that names the line. A plan is checked whole before Spark sees any of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan import u24
from loomspan.operators import seq
from loomspan.u24 import MASK, wrap


class PlanError(ValueError):
    """A program that can't be planned; says where and why."""


@dataclass(frozen=True)
class Word:
    name: str
    args: tuple = ()
    line: int = 0

    def text(self) -> str:
        return " ".join(map(str, (self.name, *self.args)))


#: Number of arguments of each predicate and map word, and least value of each argument.
PREDICATES = {"gt": (0,), "lt": (0,), "ge": (0,), "even": (), "odd": (), "modeq": (1, 0)}
MAPS = {"lin": (0, 0), "xor": (0,), "and": (0,), "add": (0,), "sq": (), "mod": (1,), "div": (1,)}
PLAIN = {"reverse": (), "dedup": (), "runsum": (), "runxor": (), "runmax": (), "runmin": (), "diff": (), "sort": (), "take": (0,), "drop": (0,)}
REDUCERS = {"sum", "xor", "count", "max", "min", "first", "last", "argmax", "cntgtfirst"}
BY_INDEX = {"idxfirst": "first", "idxlast": "last", "idxsum": "sum"}


def _numbers(tokens: list[str], least: tuple, where: str) -> tuple[int, ...]:
    if len(tokens) != len(least) or not all(t.isdigit() for t in tokens):
        raise PlanError(f"{where}: {len(least)} numbers wanted")
    values = tuple(map(int, tokens))
    if any(v < low or v > MASK for v, low in zip(values, least)):
        raise PlanError(f"{where}: number out of range")
    return values


def _predicate(tokens: list[str], where: str) -> tuple:
    if not tokens or tokens[0] not in PREDICATES:
        raise PlanError(f"{where}: unknown predicate")
    return tokens[0], *_numbers(tokens[1:], PREDICATES[tokens[0]], where)


def parse(text: str) -> list[Word]:
    words = []
    for n, raw in enumerate(text.splitlines(), 1):
        tokens = raw.split()
        if not tokens:
            continue
        name, rest, where = tokens[0], tokens[1:], f"line {n} ({raw.strip()})"
        if words and words[-1].name == "reduce":
            raise PlanError(f"{where}: nothing may follow reduce")
        if name == "id" and not rest:
            continue
        if name == "map" and rest and rest[0] in MAPS:
            args = (rest[0], *_numbers(rest[1:], MAPS[rest[0]], where))
        elif name == "map" and rest and rest[0] == "ind":
            args = ("ind", *_predicate(rest[1:], where))
        elif name == "filter":
            args = _predicate(rest, where)
        elif name in PLAIN:
            args = _numbers(rest, PLAIN[name], where)
        elif name == "reduce" and len(rest) == 1 and rest[0] in REDUCERS:
            args = (rest[0],)
        elif name == "reduce" and rest and rest[0] in BY_INDEX:
            args = (rest[0], *_predicate(rest[1:], where))
        else:
            raise PlanError(f"{where}: unknown word")
        words.append(Word(name, args, n))
    return words


def text(words: list[Word]) -> str:
    return "\n".join(w.text() for w in words) or "id"


def holds(predicate: tuple) -> Callable[[Column], Column]:
    name, *k = predicate
    return {
        "gt": lambda v: v > k[0], "lt": lambda v: v < k[0], "ge": lambda v: v >= k[0],
        "even": lambda v: v % 2 == 0, "odd": lambda v: v % 2 == 1, "modeq": lambda v: v % k[0] == k[1],
    }[name]


def mapping(name: str, *k) -> Callable[[Column], Column]:  # noqa: ANN002
    return {
        "lin": lambda v: wrap(v * k[0] + k[1]), "xor": lambda v: v.bitwiseXOR(F.lit(k[0])), "and": lambda v: v.bitwiseAND(F.lit(k[0])), "add": lambda v: wrap(v + k[0]),
        "sq": lambda v: u24.mul(v, v), "mod": lambda v: v % k[0], "div": lambda v: u24.div(v, F.lit(k[0])), "ind": lambda v: holds(k)(v).cast("bigint"),
    }[name]


def stage(df: DataFrame, word: Word) -> DataFrame:
    args = word.args
    if word.name == "map":
        return seq.mapped(df, mapping(*args))
    if word.name == "filter":
        return seq.kept(df, holds(args))
    if word.name.startswith("run"):
        return seq.running(df, word.name[3:])
    return {"take": lambda: seq.take(df, *args), "drop": lambda: seq.drop(df, *args), "reverse": lambda: seq.reverse(df), "dedup": lambda: seq.dedup_runs(df), "diff": lambda: seq.diff(df), "sort": lambda: seq.sort(df)}[word.name]()


@dataclass(frozen=True)
class Pipeline:
    """A checked program; apply it to a sequence table (seq_id, pos, v)."""

    words: tuple[Word, ...]

    @classmethod
    def of(cls, program: str) -> Pipeline:
        return cls(tuple(parse(program)))

    def then(self, other: Pipeline) -> Pipeline:
        if self.words and self.words[-1].name == "reduce" and other.words:
            raise PlanError(f"line {self.words[-1].line}: a reduced result is no sequence")
        return Pipeline(self.words + other.words)

    def __call__(self, df: DataFrame, every: DataFrame | None = None) -> DataFrame:
        """The resulting sequences, or (seq_id, value) after reduce; `every` (seq_id) also gives values to sequences that are empty by then."""
        missing = {"seq_id", "pos", "v"} - set(df.columns)
        if missing:
            raise PlanError(f"the table lacks {sorted(missing)}")
        every = df.select("seq_id").distinct() if every is None else every
        for word in self.words:
            if word.name != "reduce":
                df = stage(df, word)
            elif word.args[0] in BY_INDEX:
                df = seq.index_of(df, holds(word.args[1:])(F.col("v")), BY_INDEX[word.args[0]], every)
            elif word.args[0] == "cntgtfirst":
                df = seq.count_above_first(df, every)
            else:
                df = seq.reduce(df, word.args[0], every)
        return df


def synthesise(examples: list[tuple[list[int], object]], depth: int = 2, numbers: tuple[int, ...] = (0, 1, 2, 3, 5, 10)) -> str | None:
    """Shortest program of up to `depth` stages and a reducer that gives each example's result, found bottom-up over plain lists.

    Programs with equal results on the examples count as one. Runs on the driver; examples are a handful of short lists.
    """
    import itertools

    def predicates() -> list[tuple]:
        return [("even",), ("odd",), *[(p, k) for p in ("gt", "lt", "ge") for k in numbers], *[("modeq", m, r) for m in (2, 3, 5) for r in range(m)]]

    def test(p: tuple, x: int) -> bool:
        return {"gt": lambda: x > p[1], "lt": lambda: x < p[1], "ge": lambda: x >= p[1], "even": lambda: x % 2 == 0, "odd": lambda: x % 2 == 1, "modeq": lambda: x % p[1] == p[2]}[p[0]]()

    acc = lambda f: lambda xs: list(itertools.accumulate(xs, f))
    stages: list[tuple[str, Callable]] = [
        ("reverse", lambda xs: xs[::-1]), ("sort", sorted), ("dedup", lambda xs: [k for k, _ in itertools.groupby(xs)]), ("diff", lambda xs: [(b - a) & MASK for a, b in zip(xs, xs[1:])]),
        ("runsum", acc(lambda a, b: (a + b) & MASK)), ("runxor", acc(lambda a, b: a ^ b)), ("runmax", acc(max)), ("runmin", acc(min)), ("map sq", lambda xs: [x * x & MASK for x in xs]),
    ]
    for k in numbers:
        stages += [(f"take {k}", lambda xs, k=k: xs[:k]), (f"drop {k}", lambda xs, k=k: xs[k:]), (f"map add {k}", lambda xs, k=k: [(x + k) & MASK for x in xs])]
        stages += [(f"map lin {a} {k}", lambda xs, a=a, k=k: [(x * a + k) & MASK for x in xs]) for a in (2, 3, 5)]
        if k:
            stages += [(f"map mod {k}", lambda xs, k=k: [x % k for x in xs]), (f"map div {k}", lambda xs, k=k: [x // k for x in xs])]
    for p in predicates():
        name = " ".join(map(str, p))
        stages += [(f"filter {name}", lambda xs, p=p: [x for x in xs if test(p, x)]), (f"map ind {name}", lambda xs, p=p: [int(test(p, x)) for x in xs])]
    ends: list[tuple[str, Callable]] = [
        ("sum", lambda xs: sum(xs) & MASK), ("count", len), ("max", lambda xs: max(xs, default=0)), ("min", lambda xs: min(xs, default=MASK)), ("first", lambda xs: xs[0] if xs else 0), ("last", lambda xs: xs[-1] if xs else 0),
        ("argmax", lambda xs: xs.index(max(xs)) if xs else 0), ("cntgtfirst", lambda xs: sum(x > xs[0] for x in xs)),
    ]
    for p in predicates():
        ends.append((f"idxfirst {' '.join(map(str, p))}", lambda xs, p=p: next((i for i, x in enumerate(xs) if test(p, x)), MASK)))
    want = [y for _, y in examples]
    seen = {repr([x for x, _ in examples]): ""}
    level = [("", [list(x) for x, _ in examples])]
    for _ in range(depth + 1):
        for program, states in level:
            if states == want:
                return program.strip() or "id"
        for program, states in level:
            for name, f in ends:
                if [f(s) for s in states] == want:
                    return f"{program}\nreduce {name}".strip()
        onward = []
        for program, states in level:
            for name, f in stages:
                new = [f(s) for s in states]
                if (key := repr(new)) not in seen:
                    seen[key] = program
                    onward.append((f"{program}\n{name}", new))
        level = onward
    return None
