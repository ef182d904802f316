"""Arithmetic texts and formulas of orders, and the SQL that gives what the operators must make of them.

A number spells each tree: nodes are numbered as in a heap, 1 at the root, and every node's choices come from a hash of the number
and its own. What a text, its value, its postfix form and so on are follows from the leaves up, level by level, in plain
expressions that Spark and SQL share; so texts vary in depth, nesting, brackets, blanks and faults, and no answer is fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import lang
from loomspan.plans.registry import Registry
from loomspan.sources.tables import table

R = Registry()
LEVELS = ((8, 16), (4, 8), (2, 4), (1, 2))
SPELL = "o_orderkey * 7919 + o_custkey * 31 + 17"
#: What is wrong with one in four of 23 texts, and the tokens that come of it ({t}: those of the good text).
FAULTS = (
    ("{x} || '+'", "{t} || [1, 43]"), ("'(' || {x}", "[2, 40] || {t}"), ("{x} || ' 7'", "{t} || [0, 7]"), ("{x} || 'x'", "null"), ("{x} || ')'", "{t} || [2, 41]"),
    ("{x} || '*99999999'", "{t} || [1, 42, 0, 99999999]"),
)


def _node(k: int, sql: bool) -> dict[str, str]:
    """Columns of node k: its hash first, then what its children give. Those that only the answers need come with sql."""
    div = "//" if sql else "div"
    h, a, b = f"h{k}", 2 * k, 2 * k + 1
    leaf = {"k": "0", "n": f"case when ({h} {div} 7) % 3 = 0 then {h} % 100 else {h} end"}
    n = f"n{k}"
    first = {f"h{k}": f"((x + {k * k * 97}) * 48271) % 65521"}
    second = {n: leaf["n"], f"k{k}": "0" if k >= 8 else f"case when {h} % 4 = 0 and {k} > 1 then 0 else 1 + ({h} {div} 4) % 2 end"}
    out: dict[str, str] = {f"t{k}": f"cast({n} as string)"}
    if sql:
        variable = f"{n} between 2 and 49"
        out |= {
            f"w{k}": f"[0, {n}]", f"v{k}": n, f"r{k}": f"[0, {n}]", f"a{k}": f"'(0, ' || {n} || ')'", f"p{k}": f"cast({n} as varchar)", f"d{k}": "1", f"c{k}": f"not ({variable})", f"q{k}": n,
            f"s{k}": f"case when {variable} then 'x' || ({n} % 3) else cast({n} as varchar) end", f"e{k}": f"case when {variable} and {n} % 3 = 0 then '1' else '0' end",
        }
        out[f"u{k}"] = out[f"s{k}"]
    if k < 8:
        kind, op, code = f"k{k}", f"case k{k} when 1 then '+' else '*' end", f"case k{k} when 1 then 43 else 42 end"
        left = f"({kind} = 2 and k{a} = 1 or ({h} {div} 8) % 3 = 0)"
        right = f"({kind} = 2 and k{b} > 0 or {kind} = 1 and k{b} = 1 or ({h} {div} 24) % 3 = 0)"
        blank = lambda d: f"case ({h} {div} {d}) % 3 when 0 then '' when 1 then ' ' else '  ' end"
        put = lambda need, x: f"case when {need} then '(' || {x} || ')' else {x} end"
        inner = {f"t{k}": f"{put(left, f't{a}')} || {blank(72)} || {op} || {blank(216)} || {put(right, f't{b}')}"}
        if sql:
            list_ = lambda need, x: f"case when {need} then [2, 40] || {x} || [2, 41] else {x} end"
            neutral = f"{kind} - 1"
            value = lambda x, y: f"case {kind} when 1 then {x} + {y} else {x} * {y} end & 16777215"
            zero = f"{kind} = 2 and (c{a} and q{a} = 0 or c{b} and q{b} = 0)"
            pick = lambda both, none, x, other: f"case when c{a} and c{b} then {both} when {zero} then {none} when c{a} and q{a} = {neutral} then {x}{b} when c{b} and q{b} = {neutral} then {x}{a} else {other} end"
            folded = value(f"q{a}", f"q{b}")
            inner |= {
                f"w{k}": f"{list_(left, f'w{a}')} || [1, {code}] || {list_(right, f'w{b}')}", f"v{k}": value(f"v{a}", f"v{b}"), f"r{k}": f"r{a} || r{b} || [1, {code}]",
                f"a{k}": f"'(' || {kind} || ', ' || a{a} || ', ' || a{b} || ')'", f"p{k}": f"'(' || p{a} || {op} || p{b} || ')'", f"d{k}": f"1 + greatest(d{a}, d{b})",
                f"u{k}": f"'(' || u{a} || {op} || u{b} || ')'", f"c{k}": pick("true", "true", "c", "false"), f"q{k}": pick(folded, "0", "q", "0"),
                f"s{k}": pick(f"cast({folded} as varchar)", "'0'", "s", f"'(' || s{a} || {op} || s{b} || ')'"),
                f"e{k}": f"case {kind} when 1 then '(' || e{a} || '+' || e{b} || ')' else '((' || e{a} || '*' || u{b} || ')+(' || u{a} || '*' || e{b} || '))' end",
            }
        out = {c: f"case when {kind} = 0 then {out[c]} else {x} end" for c, x in inner.items()}
    return {"first": first, "second": second, "third": out}  # type: ignore[dict-item]


def _layers(sql: bool) -> list[dict[str, str]]:
    out = []
    for low, high in LEVELS:
        nodes = [_node(k, sql) for k in range(low, high)]
        out += [{c: x for n in nodes for c, x in n[part].items()} for part in ("first", "second", "third")]
    return out


def _texts_sql() -> str:
    """Every column of every node, by one subquery a layer."""
    text = f"select o_orderkey id, {SPELL} x from orders"
    for layer in _layers(True):
        text = f"select *, {', '.join(f'{x} as {c}' for c, x in layer.items())} from ({text})"
    return f"with y as ({text})"


def texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_orderkey as id", f"{SPELL} as x")
    for layer in _layers(False):
        rows = rows.selectExpr("*", *[f"{x} as {c}" for c, x in layer.items()])
    fault = "case x % 23 " + " ".join(f"when {i} then {f.format(x='t1')}" for i, (f, _) in enumerate(FAULTS)) + " else t1 end"
    return rows.selectExpr("id", f"{fault} as text")


def _good(column: str, kind: str = "") -> str:
    value = f"cast({column}1 as {kind})" if kind else f"{column}1"
    return f" select id, case when x % 23 >= {len(FAULTS)} then {value} end as value from y"


def worded(name: str, f: Callable, kind: str, answer: str) -> None:
    R.add(name, lambda spark, d: lang.each(texts(spark, d), ["id"], "text", f, "value", kind), _texts_sql() + answer)


def flat(pairs: list[tuple]) -> list:
    return [x for p in pairs for x in p]


def with_variable(s: str) -> tuple:
    """The text's tree with every leaf from 2 to 49 a variable."""
    return lang.folded(lang.parse(s), lambda n, c: ((3, n[1] % 3) if 2 <= n[1] < 50 else n) if n[0] == 0 else (n[0], *c))


TOKENS = " select id, case x % 23 " + " ".join(f"when {i} then {t.format(t='w1')}" for i, (_, t) in enumerate(FAULTS)) + " else w1 end as value from y"
worded("t4_tokenize", lambda s: flat(lang.tokens(s)), "array<bigint>", TOKENS)
worded("t4_to_rpn", lambda s: flat(lang.rpn(s)), "array<bigint>", _good("r"))
worded("t4_eval_str", lambda s: lang.evaluate(lang.parse(s)), "bigint", _good("v", "bigint"))
worded("t4_eval_rpn", lambda s: lang.eval_rpn(lang.rpn(s)), "bigint", _good("v", "bigint"))
worded("t4_eval_ast", lambda s: lang.evaluate(lang.parse(s)), "bigint", _good("v", "bigint"))
worded("t4_parse", lambda s: str(lang.parse(s)), "string", _good("a"))
worded("t4_print", lambda s: lang.printed(lang.parse(s)), "string", _good("p"))
worded("t4_expr_depth", lambda s: lang.depth(lang.parse(s)), "bigint", _good("d", "bigint"))
worded("t4_fold", lambda s: lang.printed(lang.simplified(with_variable(s))), "string", _good("s"))
worded("t4_deriv", lambda s: lang.printed(lang.derivative(with_variable(s))), "string", _good("e"))


# --- formulas -----------------------------------------------------------------------------------------


def formula(bits: int, depth: int) -> tuple:
    """A formula that a number spells."""
    if depth == 0:
        return ((2, bits % 3), (2, bits % 3), (bits & 1,))[bits % 3 if bits % 5 == 0 else 0]
    if bits % 4 == 0:
        return (3, formula(bits // 4, depth - 1))
    return (4 + bits % 2, formula(bits // 3, depth - 1), formula(bits // 7, depth - 1))


def _truth_sql(by: int, depth: int) -> str:
    """The formula's truth table in 8 bits; a node sees the number divided by `by`."""
    x = f"(x // {by})"
    if depth == 0:
        return f"case when {x} % 5 = 0 and {x} % 3 = 2 then {x} % 2 * 255 when {x} % 3 = 0 then 170 when {x} % 3 = 1 then 204 else 240 end"
    no, a, b = (_truth_sql(by * k, depth - 1) for k in (4, 3, 7))
    return f"case when {x} % 4 = 0 then 255 - ({no}) when {x} % 2 = 0 then ({a}) & ({b}) else ({a}) | ({b}) end"


def _nnf_sql(by: int, depth: int, negated: bool) -> str:
    x = f"(x // {by})"
    if depth == 0:
        variable = f"'(2, ' || {x} % 3 || ')'"
        bit = f"1 - {x} % 2" if negated else f"{x} % 2"
        return f"case when {x} % 5 = 0 and {x} % 3 = 2 then '(' || {bit} || ',)' else " + (f"'(3, ' || {variable} || ')'" if negated else variable) + " end"
    no, a, b = _nnf_sql(by * 4, depth - 1, not negated), *(_nnf_sql(by * k, depth - 1, negated) for k in (3, 7))
    kind = f"5 - {x} % 2" if negated else f"4 + {x} % 2"
    return f"case when {x} % 4 = 0 then {no} else '(' || ({kind}) || ', ' || ({a}) || ', ' || ({b}) || ')' end"


def _by_depth(f: Callable[[int], str]) -> str:
    return "case x % 5 " + " ".join(f"when {i} then {f(i)}" for i in range(4)) + f" else {f(4)} end"


NUMBER = "o_orderkey * 7919 + o_custkey"
FORMULAS = (
    ("t4_sat_count", lambda x: lang.models(formula(x, x % 5)), "bigint", f"cast(bit_count(({_by_depth(lambda i: _truth_sql(1, i))})::bigint) as bigint)"),
    ("t4_nnf", lambda x: str(lang.nnf(formula(x, x % 5))), "string", _by_depth(lambda i: _nnf_sql(1, i, False))),
)
for name, f, kind, sql in FORMULAS:
    R.add(
        name, lambda spark, d, f=f, kind=kind: lang.each(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(NUMBER).alias("x")), ["id"], "x", f, "value", kind),
        f"select id, {sql} as value from (select o_orderkey id, {NUMBER} x from orders)",
    )
