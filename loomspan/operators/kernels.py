"""Sequential kernels for contracts that no relational plan expresses well, one connected component (or graph) at a time.

Components are small where these operators make sense; a component must fit one task, which the README lists as
their limit. Rows come in as lists, Python runs once for each Arrow batch.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.fixpoint import components

Edge = tuple[int, int, int]


def by_group(rows: DataFrame, keys: list[str], columns: list[str], kernel: Callable[[list[tuple]], Iterable[tuple]], out: str) -> DataFrame:
    """kernel over each group's rows (tuples of columns, ascending); its tuples become rows (keys..., out)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows__"))
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            picked, made = [], []
            for i, items in enumerate(batch.column("rows__").to_pylist()):
                for row in kernel([tuple(x.values()) for x in items]):
                    picked.append(i)
                    made.append(row)
            if picked:
                at = pa.array(picked)
                values = [list(c) for c in zip(*made)]
                yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in keys] + [pa.array(v) for v in values], names=[*keys, *names])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [out])
    return lists.mapInArrow(run, schema)


def labelled(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the label of their component."""
    labels = components(vertices, edges).select("g", F.col("v").alias("u"), "label")
    return edges.join(labels, ["g", "u"])


def neighbours(edges: Iterable[tuple]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for u, v, *_ in edges:
        out.setdefault(u, []).append(v)
        out.setdefault(v, []).append(u)
    return out


def cuts(edges: list[tuple]) -> tuple[list[tuple[int, int]], list[int]]:
    """(bridges, cut vertices) of a graph without loops and repeated edges, by the earliest visit that each subtree gets back to."""
    near = neighbours(edges)
    seen: dict[int, int] = {}
    back: dict[int, int] = {}
    bridges, cut = [], set()
    for root in sorted(near):
        if root in seen:
            continue
        seen[root] = back[root] = len(seen)
        stack, branches = [(root, None, iter(near[root]))], 0
        while stack:
            at, parent, rest = stack[-1]
            for to in rest:
                if to not in seen:
                    seen[to] = back[to] = len(seen)
                    stack.append((to, at, iter(near[to])))
                    break
                if to != parent:
                    back[at] = min(back[at], seen[to])
            else:
                stack.pop()
                if parent is None:
                    continue
                back[parent] = min(back[parent], back[at])
                if back[at] > seen[parent]:
                    bridges.append((min(parent, at), max(parent, at)))
                if parent == root:
                    branches += 1
                elif back[at] >= seen[parent]:
                    cut.add(parent)
        if branches > 1:
            cut.add(root)
    return sorted(bridges), sorted(cut)


def topological(vertices: list[int], edges: list[tuple]) -> list[int]:
    """Lexicographically least topological order."""
    missing = dict.fromkeys(vertices, 0)
    ahead: dict[int, list[int]] = {}
    for u, v, *_ in edges:
        ahead.setdefault(u, []).append(v)
        missing[v] += 1
    ready = [v for v, n in missing.items() if not n]
    heapq.heapify(ready)
    order = []
    while ready:
        order.append(heapq.heappop(ready))
        for v in ahead.get(order[-1], ()):
            missing[v] -= 1
            if not missing[v]:
                heapq.heappush(ready, v)
    return order


def matching(edges: list[tuple]) -> int:
    """Largest number of edges (left, right) without a common end: shortest augmenting paths in phases."""
    near: dict[int, list[int]] = {}
    for u, v, *_ in edges:
        near.setdefault(u, []).append(v)
    mate_l: dict[int, int] = {}
    mate_r: dict[int, int] = {}
    while True:
        level = {u: 0 for u in near if u not in mate_l}
        queue, open_end = deque(level), False
        while queue:
            u = queue.popleft()
            for v in near[u]:
                w = mate_r.get(v)
                if w is None:
                    open_end = True
                elif w not in level:
                    level[w] = level[u] + 1
                    queue.append(w)
        if not open_end:
            return len(mate_l)
        rest = {u: iter(vs) for u, vs in near.items()}
        for start in [u for u in near if u not in mate_l]:
            path = [start]
            via: list[int] = []
            while path:
                for v in rest[path[-1]]:
                    w = mate_r.get(v)
                    if w is None:
                        via.append(v)
                        for u, x in zip(path, via):
                            mate_l[u], mate_r[x] = x, u
                        path = []
                        break
                    if level.get(w) == level[path[-1]] + 1:
                        via.append(v)
                        path.append(w)
                        break
                else:
                    path.pop()
                    if via:
                        via.pop()


def first_fit(edges: list[tuple]) -> dict[int, int]:
    """Each vertex in order of ids gets the least colour that no smaller neighbour has."""
    near, colour = neighbours(edges), {}
    for v in sorted(near):
        taken = {colour[u] for u in near[v] if u < v}
        colour[v] = next(c for c in range(len(taken) + 1) if c not in taken)
    return colour


def clique(edges: list[tuple]) -> int:
    """Size of the largest clique: vertices in order of degeneracy, sets as bits, cut by how many candidates are left."""
    near = neighbours(edges)
    left = {v: len(n) for v, n in near.items()}
    order, heap = [], [(d, v) for v, d in left.items()]
    heapq.heapify(heap)
    while heap:
        d, v = heapq.heappop(heap)
        if left.get(v) != d:
            continue
        order.append(v)
        del left[v]
        for u in near[v]:
            if u in left:
                left[u] -= 1
                heapq.heappush(heap, (left[u], u))
    place = {v: i for i, v in enumerate(order)}
    bits = [sum(1 << place[u] for u in near[v]) for v in order]
    best, stack = 0, []
    for i in range(len(order)):
        stack.append((1, bits[i] >> (i + 1) << (i + 1)))
        while stack:
            size, among = stack.pop()
            best = max(best, size)
            while among and size + among.bit_count() > best:
                low = among & -among
                among ^= low
                stack.append((size + 1, among & bits[low.bit_length() - 1]))
                # the pushed set only holds later vertices, so each clique is met once
    return best


def second_tree(edges: list[Edge]) -> int | None:
    """Weight of the second lightest spanning tree of a connected graph: one edge outside the lightest takes the place of the heaviest on its path."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    tree: dict[int, list[tuple[int, int]]] = {}
    total, outside = 0, []
    for u, v, w in sorted(edges, key=lambda e: e[2]):
        a, b = top(u), top(v)
        if a == b:
            outside.append((u, v, w))
            continue
        parent[a] = b
        total += w
        tree.setdefault(u, []).append((v, w))
        tree.setdefault(v, []).append((u, w))
    best = None
    for u, v, w in outside:
        heaviest, stack = {u: 0}, [u]
        while stack and v not in heaviest:
            x = stack.pop()
            for y, z in tree[x]:
                if y not in heaviest:
                    heaviest[y] = max(heaviest[x], z)
                    stack.append(y)
        if best is None or w - heaviest[v] < best:
            best = w - heaviest[v]
    return None if best is None else total + best


def girth(edges: list[tuple]) -> int | None:
    """Edges of the shortest cycle; None for a forest."""
    near, best = neighbours(edges), None
    for root in near:
        depth, queue = {root: (0, None)}, deque([root])
        while queue:
            u = queue.popleft()
            d, parent = depth[u]
            if best is not None and 2 * d >= best:
                break
            for v in near[u]:
                if v not in depth:
                    depth[v] = (d + 1, u)
                    queue.append(v)
                elif v != parent and (best is None or d + depth[v][0] + 1 < best):
                    best = d + depth[v][0] + 1
    return best


def independent(edges: list[tuple]) -> int:
    """Largest independent set of a tree or forest: leaves are always worth taking."""
    near = {v: set(n) for v, n in neighbours(edges).items()}
    leaves = [v for v, n in near.items() if len(n) <= 1]
    taken, gone = 0, set()
    while leaves:
        v = leaves.pop()
        if v in gone:
            continue
        taken += 1
        gone.add(v)
        for u in near[v] - gone:
            gone.add(u)
            for w in near[u] - gone:
                near[w].discard(u)
                if len(near[w] - gone) <= 1:
                    leaves.append(w)
    return taken


def flow(edges: list[Edge], s: int, t: int) -> int:
    """Largest flow from s to t: blocking flows in layered graphs of the residual capacities."""
    room: dict[int, dict[int, int]] = {}
    for u, v, w in edges:
        room.setdefault(u, {})[v] = room.setdefault(u, {}).get(v, 0) + w
        room.setdefault(v, {}).setdefault(u, 0)
    if s == t or s not in room or t not in room:
        return 0
    total = 0
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v, r in room[u].items():
                if r and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if t not in level:
            return total
        arcs, at = {u: list(room[u]) for u in level}, dict.fromkeys(level, 0)
        path = [s]
        while path:
            if path[-1] == t:
                least = min(room[a][b] for a, b in zip(path, path[1:]))
                total += least
                for a, b in zip(path, path[1:]):
                    room[a][b] -= least
                    room[b][a] += least
                path = [s]
                continue
            u = path[-1]
            while at[u] < len(arcs[u]):
                v = arcs[u][at[u]]
                if room[u][v] and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
                at[u] += 1
            else:  # a dead end: its edge is done with
                path.pop()
                if path:
                    at[path[-1]] += 1
