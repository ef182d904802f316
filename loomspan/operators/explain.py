"""Why a merge decision came out as it did: decisions re-run on subsets of a component's facts.

A fact is an accepted pair or a must-not-link pair of one component; a decision asks whether two nodes end in one
cluster. Minimal sets come by delta debugging, then by leaving out fact after fact. Components run as kernels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.kernels import by_group
from loomspan.operators.recon import _merge

Fact = tuple[int, int, int, int]


def together(facts: list[Fact], a: int, b: int, cap: int | None = None) -> bool:
    """Whether a and b end in one cluster when only these facts hold: (0, x, y, 0) apart, (1, -score, u, v) accepted."""
    home: dict[int, int] = {}

    def top(x: int) -> int:
        while home.get(x, x) != x:
            x = home[x]
        return x

    for u, v, _, action, *_ in _merge(cap)(sorted(facts)):
        if action == "merge":
            home[top(u)] = top(v)
    return top(a) == top(b)


def minimal(facts: list[Fact], keeps) -> list[Fact]:  # noqa: ANN001
    """A set of facts that keeps the decision and none of which can be left out: halves, then finer parts, then one by one."""
    if keeps([]):
        return []
    current, parts = list(facts), 2
    while len(current) >= 2:
        size = -(-len(current) // parts)
        chunks = [current[i : i + size] for i in range(0, len(current), size)]
        for i, chunk in enumerate(chunks):
            rest = [f for j, c in enumerate(chunks) if j != i for f in c]
            if keeps(chunk):
                current, parts = chunk, 2
                break
            if len(chunks) > 2 and keeps(rest):
                current, parts = rest, max(parts - 1, 2)
                break
        else:
            if parts >= len(current):
                break
            parts = min(len(current), 2 * parts)
    for fact in list(current):
        less = [f for f in current if f != fact]
        if keeps(less):
            current = less
    return current


def classify(facts: list[Fact], chosen: list[Fact], a: int, b: int, cap: int | None = None) -> dict[str, bool]:
    """sufficient: chosen alone give the decision; necessary: it falls without them; minimal: none of them can be left out."""
    decision = together(facts, a, b, cap)
    sufficient = together(chosen, a, b, cap) == decision
    necessary = together([f for f in facts if f not in chosen], a, b, cap) != decision
    least = sufficient and all(together([g for g in chosen if g != f], a, b, cap) != decision for f in chosen)
    return {"decision": decision, "sufficient": sufficient, "necessary": necessary, "minimal": least, "faithful": sufficient and necessary}


def path(facts: list[Fact], a: int, b: int) -> list[int]:
    """Nodes of a shortest chain of accepted pairs from a to b; empty if there is none."""
    from collections import deque

    near: dict[int, list[int]] = {}
    for kind, _, u, v in facts:
        if kind == 1:
            near.setdefault(u, []).append(v)
            near.setdefault(v, []).append(u)
    came, queue = {a: a}, deque([a])
    while queue:
        u = queue.popleft()
        for v in sorted(near.get(u, ())):
            if v not in came:
                came[v] = u
                queue.append(v)
    out = [b] if b in came else []
    while out and out[-1] != a:
        out.append(came[out[-1]])
    return out[::-1]


def sentence(facts: list[Fact], a: int, b: int, joined: bool) -> str:
    """One line of English for a minimal set."""
    links = [f"{u}-{v} (score {-s})" for kind, s, u, v in facts if kind == 1]
    walls = [f"{x}-{y}" for kind, x, y, _ in facts if kind == 0]
    reasons = [f"accepted {', '.join(links)}"] * bool(links) + [f"must not link {', '.join(walls)}"] * bool(walls)
    return f"{a} and {b} are {'one record' if joined else 'apart'}" + (f" because of {' and '.join(reasons)}" if reasons else "")


def explained(pairs: DataFrame, must_not_link: DataFrame, labels: DataFrame, asked: DataFrame, cap: int | None = None) -> DataFrame:
    """(g, label, a, b, joined, n_facts, why) for asked (g, a, b) of one component each.

    labels (g, v, label) come from components of the accepted pairs; a question across components is answered by that alone and isn't
    asked here. A component's facts must fit a task.
    """
    at = lambda c: labels.select("g", F.col("v").alias(c), "label")
    links = pairs.join(at("u"), ["g", "u"]).select("g", "label", F.lit(1).alias("kind"), (-F.col("score")).alias("x"), F.col("u").alias("y"), F.col("v").alias("z"))
    walls = must_not_link.join(at("a"), ["g", "a"]).select("g", "label", F.lit(0).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"), F.lit(0).cast("bigint").alias("z"))
    one, other = at("a"), labels.select("g", F.col("v").alias("b"), F.col("label").alias("lb"))
    questions = asked.join(one, ["g", "a"]).join(other, ["g", "b"]).where("label = lb").select("g", "label", F.lit(2).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"), F.lit(0).cast("bigint").alias("z"))
    touched = questions.select("g", "label").distinct()
    rows = links.unionByName(walls).join(touched, ["g", "label"], "left_semi").unionByName(questions)

    def kernel(items: list[tuple]) -> list[tuple]:
        facts = [x for x in items if x[0] < 2]
        out = []
        for _, a, b, _ in (x for x in items if x[0] == 2):
            joined = together(facts, a, b, cap)
            # being apart inside a component needs the links that would have joined the two, and what stopped them
            keeps = (lambda fs, a=a, b=b: together(fs, a, b, cap)) if joined else (lambda fs, a=a, b=b: bool(path(fs, a, b)) and not together(fs, a, b, cap))
            chosen = minimal(facts, keeps)
            out.append((a, b, joined, len(chosen), sentence(sorted(chosen), a, b, joined)))
        return out

    return by_group(rows, ["g", "label"], ["kind", "x", "y", "z"], kernel, "a bigint, b bigint, joined boolean, n_facts bigint, why string")
