"""Graph operators on many small random graphs at once, against plain searches."""

import itertools
import random
from collections import deque

import pytest

from loomspan.operators import graph, kernels, recon
from loomspan.operators.fixpoint import NoFixpoint, components, fixpoint, resolve
from loomspan.u24 import MASK

R = random.Random(9)


def random_graph(g):
    n = R.randrange(1, 8)
    every = list(itertools.combinations(range(n), 2))
    return n, [(u, v, R.randrange(1, 6)) for u, v in R.sample(every, R.randrange(0, len(every) + 1))]


GRAPHS = {g: random_graph(g) for g in range(40)}


@pytest.fixture(scope="module")
def data(spark):
    v = spark.createDataFrame([(g, x) for g, (n, _) in GRAPHS.items() for x in range(n)], "g bigint, v bigint")
    e = spark.createDataFrame([(g, *x) for g, (_, es) in GRAPHS.items() for x in es], "g bigint, u bigint, v bigint, w bigint")
    return v, e, v.select("g").distinct()


def near(es, both=True):
    out = {}
    for u, v, w in es:
        out.setdefault(u, []).append((v, w))
        if both:
            out.setdefault(v, []).append((u, w))
    return out


def hops(es, s, both=True):
    d, queue, a = {s: 0}, deque([s]), near(es, both)
    while queue:
        u = queue.popleft()
        for v, _ in sorted(a.get(u, ())):
            if v not in d:
                d[v] = d[u] + 1
                queue.append(v)
    return d


def far(es, s):
    d = {s: 0}
    for _ in range(9):
        for u, v, w in es + [(v, u, w) for u, v, w in es]:
            if u in d and d[u] + w < d.get(v, 10**9):
                d[v] = d[u] + w
    return d


def per_graph(df):
    return {r.g: r.value for r in df.collect()}


def test_distances(spark, data):
    v, e, ids = data
    s = v.where("v = 0").select("g", "v").withColumnRenamed("v", "s")
    got = {(r.g, r.v): r.d for r in graph.distances(graph.symmetric(e), s).collect()}
    assert got == {(g, x): d for g, (_, es) in GRAPHS.items() for x, d in far(es, 0).items()}
    got = {(r.g, r.v): r.d for r in graph.hops(e, s).collect()}
    assert got == {(g, x): d for g, (_, es) in GRAPHS.items() for x, d in hops(es, 0, False).items()}
    order = {}
    for r in sorted(graph.bfs_order(e, s).collect()):
        order.setdefault(r.g, []).append(r.v)
    assert order == {g: list(hops(es, 0)) for g, (_, es) in GRAPHS.items()}


def all_paths(es, s, t):
    a, out = near(es), []

    def walk(path, weight):
        if path[-1] == t:
            out.append((weight, len(path), path))
            return
        for v, w in a.get(path[-1], ()):
            if v not in path:
                walk([*path, v], weight + w)

    walk([s], 0)
    return out


def test_paths(spark, data):
    v, e, ids = data
    st = spark.createDataFrame([(g, 0, n - 1) for g, (n, _) in GRAPHS.items()], "g bigint, s bigint, t bigint")
    got = {}
    for r in sorted(graph.lex_shortest_path(e, st).collect()):
        got.setdefault(r.g, []).append(r.v)
    want = {g: min(p)[2] for g, (n, es) in GRAPHS.items() if (p := all_paths(es, 0, n - 1))}
    assert got == want
    counts = {(r.g, r.v): r.c for r in graph.path_counts(graph.symmetric(e), st).collect()}
    for g, (n, es) in GRAPHS.items():
        lengths = [n for _, n, _ in all_paths(es, 0, n - 1)]
        assert counts.get((g, n - 1), 0) == (lengths.count(min(lengths)) if lengths else 0)


def labels(n, es, gone=None):
    return [min(hops([e for e in es if gone not in e[:2]], x)) for x in range(n) if x != gone]


def test_components(spark, data):
    v, e, ids = data
    found = components(v, e)
    assert sorted(map(tuple, found.collect())) == sorted((g, x, lab) for g, (n, es) in GRAPHS.items() for x, lab in enumerate(labels(n, es)))
    assert per_graph(graph.euler_start(ids, v, e)) == {g: euler(n, es) for g, (n, es) in GRAPHS.items()}
    assert per_graph(graph.forest_weight(ids, graph.spanning_forest(v, e))) == {g: forest(n, es) for g, (n, es) in GRAPHS.items()}


def euler(n, es):
    degree = [sum(x in e[:2] for e in es) for x in range(n)]
    live = [x for x in range(n) if degree[x]]
    odd = [x for x in live if degree[x] % 2]
    if not live or len(hops(es, live[0])) != len(live) or len(odd) not in (0, 2):
        return MASK
    return odd[0] if odd else live[0]


def forest(n, es):
    part, total = list(range(n)), 0
    for u, v, w in sorted(es, key=lambda e: e[2]):
        if part[u] != part[v]:
            total += w
            a, b = part[u], part[v]
            part = [b if x == a else x for x in part]
    return total


def test_strong_components_and_cores(spark, data):
    v, e, ids = data
    arcs = e.selectExpr("g", "if(w % 2 = 0, u, v) u", "if(w % 2 = 0, v, u) v", "w")
    plain = {g: [(u, x, w) if w % 2 == 0 else (x, u, w) for u, x, w in es] for g, (_, es) in GRAPHS.items()}
    reach = {g: {x: set(hops(plain[g], x, False)) for x in range(n)} for g, (n, _) in GRAPHS.items()}
    want = sorted((g, x, min(y for y in r[x] if x in r[y])) for g, r in reach.items() for x in r)
    assert sorted(map(tuple, graph.strong_components(v, arcs).collect())) == want

    def core(n, es, k):
        alive = set(range(n))
        while weak := {x for x in alive if sum(x in e[:2] and alive >= set(e[:2]) for e in es) < k}:
            alive -= weak
        return len(alive)

    assert per_graph(graph.kcore_size(ids, graph.kcore(v, e, 2))) == {g: core(n, es, 2) for g, (n, es) in GRAPHS.items()}
    triangles = lambda es: sum(all({a, b} in [set(e[:2]) for e in es] for a, b in itertools.combinations(c, 2)) for c in itertools.combinations(range(8), 3))
    assert per_graph(graph.triangle_count(ids, v, e)) == {g: triangles(es) for g, (_, es) in GRAPHS.items()}


def test_kernels():
    for n, es in GRAPHS.values():
        base = len(set(labels(n, es)))
        bridges, cut = kernels.cuts(es)
        assert bridges == sorted(e[:2] for e in es if len(set(labels(n, [x for x in es if x != e]))) > base)
        assert cut == [x for x in range(n) if es and len(set(labels(n, es, x))) > base]
        size = lambda k: any(all({a, b} in [set(e[:2]) for e in es] for a, b in itertools.combinations(c, 2)) for c in itertools.combinations(range(n), k))
        if es:
            assert kernels.clique(es) == max(k for k in range(1, n + 1) if size(k))
            cuts = [sum(w for u, v, w in es if u in side and v not in side) for k in range(n) for c in itertools.combinations(range(1, n - 1), k) for side in [{0, *c}]]
            assert kernels.flow(es, 0, n - 1) == min(cuts)
        order = kernels.topological(list(range(n)), es)
        assert sorted(order) == list(range(n)) and all(order.index(u) < order.index(v) for u, v, _ in es)
        if len(es) <= 9:
            assert kernels.matching(es) == max(k for k in range(len(es) + 1) for c in itertools.combinations(es, k) if len({e[0] for e in c}) == k == len({e[1] for e in c}))
        if base == 1 and len(es) <= 10:
            trees = sorted(sum(e[2] for e in c) for c in itertools.combinations(es, n - 1) if len(set(labels(n, list(c)))) == 1)
            assert kernels.second_tree(es) == (trees[1] if len(trees) > 1 else None)
        colour = kernels.first_fit(es)
        assert all(colour[u] != colour[v] for u, v, _ in es)


def test_pointers(spark):
    chain = [(1, i, max(i - 1, 0)) for i in range(300)] + [(2, 0, 1), (2, 1, 0), (2, 2, 1), (2, 3, 3)]
    roots, caught = resolve(spark.createDataFrame(chain, "g bigint, v bigint, p bigint"))
    assert {tuple(r) for r in roots.collect()} == {(1, i, 0) for i in range(300)} | {(2, 3, 3)}
    assert {tuple(r) for r in caught.collect()} == {(2, 0), (2, 1), (2, 2)}


def test_a_loop_without_end_is_told(spark):
    from pyspark.sql import functions as F

    with pytest.raises(NoFixpoint):
        fixpoint(spark.range(1).withColumn("fresh", F.lit(True)), lambda s: s, limit=3)


def greedy(pairs, walls, cap):
    """Plain ordered merging over the whole case."""
    group = {x: {x} for x in range(12)}
    skipped = []
    for u, v, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        a, b = group[u], group[v]
        if a is b:
            continue
        if any((x in a and y in b) or (x in b and y in a) for x, y in walls) or (cap and len(a) + len(b) > cap):
            skipped.append((u, v))
            continue
        for x in b:
            group[x] = a
        a |= b
    return [max(group[x]) for x in range(12)], sorted(skipped)


@pytest.mark.parametrize("cap", [None, 3])
def test_constrained_merging(spark, cap):
    r = random.Random(7)
    pick = lambda k: {tuple(sorted(r.sample(range(12), 2))) for _ in range(r.randrange(k))}
    cases = {g: ([(u, v, r.randrange(5)) for u, v in pick(14)], pick(6)) for g in range(60)}
    nodes = spark.createDataFrame([(g, x) for g in cases for x in range(12)], "g bigint, v bigint")
    pairs = spark.createDataFrame([(g, *p) for g, (ps, _) in cases.items() for p in ps], "g bigint, u bigint, v bigint, score bigint")
    walls = spark.createDataFrame([(g, *w) for g, (_, ws) in cases.items() for w in ws], "g bigint, a bigint, b bigint")
    canon, log = recon.constrained(nodes, pairs, walls, cap)
    got, skipped = {}, {g: [] for g in cases}
    for x in sorted(canon.collect()):
        got.setdefault(x.g, []).append(x.canonical)
    for x in log.where("action in ('must_not_link', 'size')").collect():
        skipped[x.g].append((x.u, x.v))
    for g, (ps, ws) in cases.items():
        assert (got[g], sorted(skipped[g])) == greedy(ps, ws, cap)


@pytest.mark.parametrize("chunk", [1, 7])
def test_components_over_chunks(spark, monkeypatch, chunk):
    """One long path and one hub, in more chunks than a task holds."""
    from loomspan.operators import fixpoint as fx

    monkeypatch.setattr(fx, "CHUNK", chunk)
    order = list(range(40))
    random.Random(1).shuffle(order)
    edges = [(1, a, b) for a, b in zip(order, order[1:])] + [(2, 99, x) for x in range(20)] + [(2, 50, 50)]
    e = spark.createDataFrame(edges, "g bigint, u bigint, v bigint")
    v = spark.createDataFrame([(1, x) for x in order] + [(2, x) for x in [*range(20), 50, 99]], "g bigint, v bigint")
    assert {tuple(r) for r in components(v, e).collect()} == {(1, x, 0) for x in order} | {(2, x, 0) for x in [*range(20), 99]} | {(2, 50, 50)}
    assert {tuple(r) for r in components(v, e, largest=True).collect()} == {(1, x, 39) for x in order} | {(2, x, 99) for x in [*range(20), 99]} | {(2, 50, 50)}


@pytest.mark.parametrize("chunk", [1, 5, 10**6])
def test_forest_over_chunks(spark, data, monkeypatch, chunk):
    from loomspan.operators import fixpoint as fx

    v, e, ids = data
    monkeypatch.setattr(fx, "CHUNK", chunk)
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if chunk < 10 else batches)
    try:
        assert per_graph(graph.forest_weight(ids, graph.spanning_forest(v, e))) == {g: forest(n, es) for g, (n, es) in GRAPHS.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
