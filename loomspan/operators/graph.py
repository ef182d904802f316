"""Graph operators over many graphs at once: vertices (g, v), edges (g, u, v[, w]).

Undirected operators take each edge once in either direction; `symmetric` gives both. Values that don't exist (unreachable, no
cycle) come out as INF or as the contract of each operator says. All graphs run in the same few jobs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.fixpoint import _joined, _nodes, by_chunks, components, fixpoint, improve, in_chunks, relax
from loomspan.session import written
from loomspan.u24 import INF, wrap


def symmetric(edges: DataFrame) -> DataFrame:
    turned = edges.withColumns({"u": F.col("v"), "v": F.col("u")})
    return edges.unionByName(turned)


#: Vertices that one row stands for before they are written out.
RANGE = 1 << 16


def numbered(sizes: DataFrame) -> DataFrame:
    """(g, v): vertices 0 .. n - 1 of each graph (g, n), by ranges that are spread over tasks, so that no task makes all of a large graph."""
    spark = sizes.sparkSession
    ranges = sizes.select("g", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {RANGE}"))).alias("r")).where("n > 0")
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g", "r")
    return ranges.select("g", F.explode(F.sequence(F.col("r") * RANGE, F.least(F.col("n"), (F.col("r") + 1) * RANGE) - 1)).alias("v"))


def graphs(vertices: DataFrame) -> DataFrame:
    return vertices.select("g").distinct()


def _value(ids: DataFrame, found: DataFrame, empty: int = 0) -> DataFrame:
    """(g, value) with `empty` for graphs that found has no row of."""
    return ids.join(found, "g", "left").select("g", F.coalesce(F.col("value").cast("bigint"), F.lit(empty).cast("bigint")).alias("value"))


def _all(vertices: DataFrame, found: DataFrame, column: str, empty: int = INF) -> DataFrame:
    """(g, v, value) for every vertex."""
    return vertices.select("g", "v").join(found.select("g", "v", F.col(column).alias("value")), ["g", "v"], "left").select("g", "v", F.coalesce(F.col("value").cast("bigint"), F.lit(empty).cast("bigint")).alias("value"))


def _from(sources: DataFrame) -> DataFrame:
    return sources.select("g", "s", F.lit(0).cast("bigint").alias("d"))


# --- reach and distances -----------------------------------------------------------------------------


def hops(edges: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """(g, s, v, d): fewest edges from each source, at most limit."""
    unit = edges.select("g", "u", "v", F.lit(1).cast("bigint").alias("w"))
    return relax(unit, _from(sources), "sum", most=limit)


def distances(edges: DataFrame, sources: DataFrame, budget: int | None = None) -> DataFrame:
    """(g, s, v, d): least sum of weights; values above budget are pruned inside the loop."""
    return relax(edges, _from(sources), "sum", most=budget)


def bottlenecks(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(g, s, v, d): least possible largest weight on a path; 0 for the source itself."""
    return relax(edges, _from(sources), "most")


def reach_count(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return hops(edges, sources).groupBy("g").agg(F.count(F.lit(1)).alias("value"))


def reach_queries(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(g, pos, value): 1 where b can be reached from a, else 0, for queries (g, pos, a, b)."""
    found = hops(edges, queries.select("g", F.col("a").alias("s")).distinct()).select("g", F.col("s").alias("a"), F.col("v").alias("b"), F.lit(1).alias("hit"))
    return queries.join(found, ["g", "a", "b"], "left").select("g", "pos", F.coalesce(F.col("hit"), F.lit(0)).cast("bigint").alias("value"))


def distance_list(vertices: DataFrame, found: DataFrame) -> DataFrame:
    """(g, v, value): a single source's distances for every vertex, INF where there is none."""
    return _all(vertices, found, "d")


def distance_to(pairs: DataFrame, found: DataFrame, empty: int = INF) -> DataFrame:
    """(g, value) for each graph's pair (g, s, t); `empty` if t isn't reached or no vertex."""
    return _value(pairs.select("g"), pairs.join(found, ["g", "s"]).where("v = t").select("g", F.col("d").alias("value")), empty)


def within(found: DataFrame) -> DataFrame:
    return found.groupBy("g").agg(F.count(F.lit(1)).alias("value"))


def path_counts(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(g, s, v, d, c): fewest edges and the number of such paths, wrapping; level by level, each edge is used once a source."""
    first = sources.select("g", "s", F.col("s").alias("v"), F.lit(0).cast("bigint").alias("d"), F.lit(1).cast("bigint").alias("c"), F.lit(True).alias("fresh"))
    arcs = edges.select("g", "u", "v")

    def step(state: DataFrame) -> DataFrame:
        ahead = state.where("fresh").select("g", "s", F.col("v").alias("u"), "d", "c").join(arcs, ["g", "u"])
        offers = ahead.groupBy("g", "s", "v").agg((F.min("d") + 1).alias("d"), wrap(F.sum("c")).alias("c"), F.lit(True).alias("fresh"))
        both = state.withColumn("fresh", F.lit(False)).unionByName(offers)
        level = Window.partitionBy("g", "s", "v").orderBy("d")
        return both.withColumn("n", F.row_number().over(level)).where("n = 1").drop("n")

    return fixpoint(first, step)


def eccentricities(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, v, value): largest hop distance to any vertex of the component."""
    every = hops(symmetric(edges), vertices.select("g", F.col("v").alias("s")))
    return every.groupBy("g", F.col("s").alias("v")).agg(F.max("d").alias("value"))


def wiener_index(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    every = hops(symmetric(edges), vertices.select("g", F.col("v").alias("s")))
    return every.groupBy("g").agg(wrap(F.sum(F.when(F.col("s") < F.col("v"), F.col("d")).otherwise(0))).alias("value"))


def distance_matrix(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, u, v, value) for all pairs of each graph's vertices; as many rows as the contract's matrix has."""
    found = distances(edges, vertices.select("g", F.col("v").alias("s"))).select("g", F.col("s").alias("u"), "v", "d")
    rows = vertices.select("g", F.col("v").alias("u")).join(vertices, "g")
    return rows.join(found, ["g", "u", "v"], "left").select("g", "u", "v", F.coalesce("d", F.lit(INF)).alias("value"))


def closure(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(g, s, v): v can be reached from s, s itself included."""
    return hops(edges, vertices.select("g", F.col("v").alias("s"))).select("g", "s", "v")


def closure_size(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return closure(edges, vertices).groupBy("g").agg(wrap(F.count_if(F.col("s") != F.col("v"))).alias("value"))


def walks(edges: DataFrame, sources: DataFrame, k: int, cheapest: bool = False) -> DataFrame:
    """(g, v, value): wrapping number, or least weight, of walks of exactly k edges from each graph's source (g, s)."""
    state = sources.select("g", F.col("s").alias("v"), F.lit(0 if cheapest else 1).cast("bigint").alias("value"))
    for i in range(k):
        ahead = state.withColumnRenamed("v", "u").join(edges, ["g", "u"])
        state = ahead.groupBy("g", "v").agg((F.min(F.col("value") + F.col("w")) if cheapest else wrap(F.sum("value"))).alias("value"))
        if i % 4 == 3:
            state = written(state, "walks")
    return state


def bfs_order(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(g, pos, v): order of a breadth-first search with neighbours ascending.

    Within a level vertices stand by the place of the vertex that found them, then by id; so each level's places
    follow from the level before.
    """
    arcs = symmetric(edges).select("g", "u", "v")
    first = sources.select("g", F.col("s").alias("v"), F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("place"), F.lit(True).alias("fresh"))

    def step(state: DataFrame) -> DataFrame:
        ahead = state.where("fresh").select("g", F.col("v").alias("u"), "d", "place").join(arcs, ["g", "u"])
        new = ahead.groupBy("g", "v").agg(F.min("d").alias("d"), F.min("place").alias("by")).join(state.select("g", "v"), ["g", "v"], "left_anti")
        placed = new.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("by", "v")).cast("bigint"))
        return state.withColumn("fresh", F.lit(False)).unionByName(placed.select("g", "v", (F.col("d") + 1).alias("d"), "place", F.lit(True).alias("fresh")))

    found = fixpoint(first, step)
    return found.select("g", (F.row_number().over(Window.partitionBy("g").orderBy("d", "place")) - 1).cast("bigint").alias("pos"), "v")


def tree_parents(vertices: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(g, v, value): neighbour one step nearer to the root; INF for the root (and what isn't connected to it)."""
    found = hops(symmetric(edges), roots).select("g", "v", "d")
    near = symmetric(edges).select("g", "u", "v").join(found, ["g", "v"]).join(found.select("g", F.col("v").alias("u"), F.col("d").alias("du")), ["g", "u"])
    parents = near.where("du = d - 1").groupBy("g", "v").agg(F.min("u").alias("p"))
    return _all(vertices, parents, "p")


def lex_shortest_path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(g, pos, v): of the paths from s to t the one of least weight, then fewest edges, then least vertex sequence.

    Distances to t are found first; the path then follows, from s on, the least next vertex that keeps both optimal.
    """
    arcs = symmetric(edges)
    start = pairs.select("g", F.col("t").alias("s"), F.struct(F.lit(0).cast("bigint").alias("w"), F.lit(0).cast("bigint").alias("n")).alias("d"))
    to = relax(arcs, start, lambda d, w: F.struct((d["w"] + w).alias("w"), (d["n"] + 1).alias("n"))).select("g", "v", "d")
    ahead = arcs.select("g", "u", "v", "w").join(to, ["g", "v"]).join(to.select("g", F.col("v").alias("u"), F.col("d").alias("du")), ["g", "u"])
    step_to = written(ahead.where((F.col("du.w") == F.col("d.w") + F.col("w")) & (F.col("du.n") == F.col("d.n") + 1)).groupBy("g", "u").agg(F.min("v").alias("v")), "next")
    first = pairs.join(to.select("g", F.col("v").alias("s")), ["g", "s"]).select("g", F.lit(0).cast("bigint").alias("pos"), F.col("s").alias("v"), F.lit(True).alias("fresh"))

    def walk(state: DataFrame) -> DataFrame:
        new = state.where("fresh").withColumnRenamed("v", "u").join(step_to, ["g", "u"]).select("g", (F.col("pos") + 1).alias("pos"), "v", F.lit(True).alias("fresh"))
        return state.withColumn("fresh", F.lit(False)).unionByName(new)

    return fixpoint(first, walk)


# --- components ---------------------------------------------------------------------------------------


def component_count(labels: DataFrame) -> DataFrame:
    return labels.groupBy("g").agg(F.count_if(F.col("v") == F.col("label")).alias("value"))


def component_largest(labels: DataFrame) -> DataFrame:
    return labels.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.max("n").alias("value"))


def cycle_rank(vertices: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges minus vertices plus components."""
    m = edges.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    n = labels.groupBy("g").agg((F.count_if(F.col("v") == F.col("label")) - F.count(F.lit(1))).alias("c"))
    return n.join(m, "g", "left").select("g", (F.coalesce("m", F.lit(0)) + F.col("c")).alias("value"))


def colours(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, v, label, colour, odd): parity of the hop distance from the component's least vertex, and whether the component has an odd cycle."""
    labels = components(vertices, edges)
    roots = labels.where("v = label").select("g", F.col("v").alias("s"))
    parity = hops(symmetric(edges), roots).select("g", "v", F.col("s").alias("label"), (F.col("d") % 2).alias("colour"))
    ends = edges.select("g", "u", "v").join(parity, ["g", "v"]).join(parity.select("g", F.col("v").alias("u"), F.col("colour").alias("cu")), ["g", "u"])
    odd = ends.where("colour = cu").select("g", "label").distinct().withColumn("odd", F.lit(True))
    return parity.join(odd, ["g", "label"], "left").select("g", "v", "label", "colour", F.coalesce("odd", F.lit(False)).alias("odd"))


def two_colour(coloured: DataFrame) -> DataFrame:
    """(g, v, value): the colouring, or INF everywhere in a graph that has none."""
    bad = coloured.groupBy("g").agg(F.bool_or("odd").alias("bad"))
    return coloured.join(bad, "g").select("g", "v", F.when(F.col("bad"), F.lit(INF)).otherwise(F.col("colour")).alias("value"))


def bipartite_components(coloured: DataFrame) -> DataFrame:
    return coloured.where("v = label").groupBy("g").agg(F.count_if(~F.col("odd")).alias("value"))


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, v, label): least id of each vertex's strongly connected component.

    Largest ids are passed forward; a vertex that keeps its own is a root, and what reaches it among the vertices of its colour is its
    component. Those leave and the rest goes on, so that many components end in each pass.
    """
    arcs = edges.select("g", "u", "v", F.lit(0).cast("bigint").alias("w"))
    rest, done = vertices.select("g", "v"), None
    while not rest.isEmpty():
        inside = arcs.join(rest.withColumnRenamed("v", "u"), ["g", "u"], "left_semi").join(rest, ["g", "v"], "left_semi")
        inside = written(inside.select("g", "u", "v"), "arcs")

        def colour(state: DataFrame, inside: DataFrame = inside) -> DataFrame:
            offers = state.where("fresh").select("g", F.col("v").alias("u"), "c").join(inside, ["g", "u"]).select("g", "v", "c")
            return improve(state, offers, ["g", "v"], "c", least=False)

        coloured = fixpoint(rest.select("g", "v", F.col("v").alias("c"), F.lit(True).alias("fresh")), colour)
        ends = inside.join(coloured.select("g", "v", F.col("c").alias("cv")), ["g", "v"]).join(coloured.select("g", F.col("v").alias("u"), F.col("c").alias("cu")), ["g", "u"])
        back = written(ends.where("cu = cv").select("g", F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).cast("bigint").alias("w")), "back")
        found = relax(back, coloured.where("v = c").select("g", F.col("v").alias("s"), F.lit(0).cast("bigint").alias("d")), "same")
        least = found.groupBy("g", "s").agg(F.min("v").alias("label"))
        new = written(found.select("g", "s", "v").join(least, ["g", "s"]).select("g", "v", "label"), "strong")
        done = new if done is None else done.unionByName(new)
        rest = written(rest.join(new.select("g", "v"), ["g", "v"], "left_anti"), "rest")
    return done if done is not None else vertices.select("g", "v", F.col("v").alias("label"))


def cyclic_vertices(strong: DataFrame) -> DataFrame:
    size = strong.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
    return size.groupBy("g").agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("value"))


def dag_longest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges on the longest path of an acyclic graph; on a cycle the loop would not end and raises NoFixpoint."""


    arcs = edges.select("g", "u", "v")

    def step(state: DataFrame) -> DataFrame:
        offers = state.where("fresh").select("g", F.col("v").alias("u"), "d").join(arcs, ["g", "u"]).select("g", "v", (F.col("d") + 1).alias("d"))
        return improve(state, offers, ["g", "v"], "d", least=False)

    limit = vertices.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    state = fixpoint(vertices.select("g", "v", F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("fresh")), step, limit + 3)
    return state.groupBy("g").agg(F.max("d").alias("value"))


# --- degrees and counts -------------------------------------------------------------------------------


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    found = symmetric(edges.select("g", "u", "v")).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    return _all(vertices, found, "n", 0)


def in_out_degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, v, ins, outs)."""
    ends = edges.select("g", "v", F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select("g", F.col("u").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    found = ends.groupBy("g", "v").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"))
    return vertices.select("g", "v").join(found, ["g", "v"], "left").select("g", "v", F.coalesce("ins", F.lit(0)).alias("ins"), F.coalesce("outs", F.lit(0)).alias("outs"))


def sources_sinks(both: DataFrame) -> DataFrame:
    return both.groupBy("g").agg(F.count_if(F.col("ins") == 0).alias("sources"), F.count_if(F.col("outs") == 0).alias("sinks"))


def max_degree_vertex(degree: DataFrame) -> DataFrame:
    return degree.groupBy("g").agg(F.max_by("v", F.struct("value", -F.col("v"))).alias("value"))


def line_graph_edges(degree: DataFrame) -> DataFrame:
    d = F.col("value")
    return degree.groupBy("g").agg(wrap(F.sum(F.call_function("div", d * (d - 1), F.lit(2)))).alias("value"))


def triangle_count(ids: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges point from lower to higher degree, so that a hub has few of them and wedges stay few; each triangle is met once."""
    degree = degrees(vertices, edges).select("g", "v", F.struct("value", "v").alias("rank"))
    ends = edges.select("g", "u", "v").join(degree, ["g", "v"]).join(degree.select("g", F.col("v").alias("u"), F.col("rank").alias("ru")), ["g", "u"])
    low = F.col("ru") < F.col("rank")
    arcs = ends.select("g", F.when(low, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("v"), F.greatest("ru", "rank").alias("rank"))
    one, other = arcs.select("g", F.col("u").alias("a"), F.col("v").alias("u"), F.col("rank").alias("r1")), arcs.select("g", F.col("u").alias("a"), F.col("v"), F.col("rank").alias("r2"))
    wedges = one.join(other, ["g", "a"]).where("r1 < r2").select("g", "u", "v")
    found = wedges.join(arcs.select("g", "u", "v"), ["g", "u", "v"]).groupBy("g").agg(wrap(F.count(F.lit(1))).alias("value"))
    return _value(ids, found)


def euler_start(ids: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Where a walk over every edge once may start: the smaller of two odd vertices, the least vertex with edges if none is odd; INF if there is no such walk."""
    degree = degrees(vertices, edges).where("value > 0")
    labels = components(degree.select("g", "v"), edges)
    found = degree.join(labels, ["g", "v"]).groupBy("g").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count_if(F.col("value") % 2 == 1).alias("odd"), F.min(F.when(F.col("value") % 2 == 1, F.col("v"))).alias("first_odd"), F.min("v").alias("first"))
    value = F.when(F.col("a") != F.col("b"), F.lit(INF)).when(F.col("odd") == 0, F.col("first")).when(F.col("odd") == 2, F.col("first_odd")).otherwise(F.lit(INF))
    return _value(ids, found.select("g", value.alias("value")), INF)


def kcore(vertices: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(g, v) that remain when vertices with fewer than k neighbours leave again and again."""
    arcs = symmetric(edges.select("g", "u", "v"))

    def step(state: DataFrame) -> DataFrame:
        alive = state.where("alive").select("g", "v")
        degree = arcs.join(alive, ["g", "v"], "left_semi").join(alive.withColumnRenamed("v", "u"), ["g", "u"], "left_semi").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
        weak = F.coalesce(F.col("n"), F.lit(0)) < k
        return state.join(degree, ["g", "v"], "left").select("g", "v", (F.col("alive") & ~weak).alias("still"), "alive").select("g", "v", F.col("still").alias("alive"), (F.col("still") != F.col("alive")).alias("fresh"))

    state = fixpoint(vertices.select("g", "v", F.lit(True).alias("alive"), F.lit(True).alias("fresh")), step)
    return state.where("alive").select("g", "v")


def kcore_size(ids: DataFrame, core: DataFrame) -> DataFrame:
    return _value(ids, core.groupBy("g").agg(F.count(F.lit(1)).alias("value")))


def thinned(edges: DataFrame) -> DataFrame:
    """(g, u, v, w, chunk): edges of the lightest spanning forest of each chunk; an edge that isn't in it is in no larger one either."""

    def kernel(g: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        """Every part takes its lightest edge to another, round by round; edges are told apart by (w, u, v)."""
        u, v = np.minimum(u, v), np.maximum(u, v)
        order = np.lexsort((v, u, w))
        g, u, v, w = g[order], u[order], v[order], w[order]
        graph, name, at = _nodes(np.concatenate([g, g]), np.concatenate([u, v]))
        a, b = at[: len(g)], at[len(g) :]
        label, alive, chosen = np.arange(len(name)), np.arange(len(g)), [np.zeros(0, np.int64)]
        while True:
            one, other = label[a[alive]], label[b[alive]]
            apart = one != other
            if not apart.any():
                break
            alive, one, other = alive[apart], one[apart], other[apart]
            best = np.full(len(name), len(g))
            np.minimum.at(best, one, alive)
            np.minimum.at(best, other, alive)
            chosen.append(np.unique(best[best < len(g)]))
            label = _joined(len(name), label[a[chosen[-1]]], label[b[chosen[-1]]])[label]
        kept = np.concatenate(chosen)
        return [g[kept], u[kept], v[kept], w[kept]]

    return by_chunks(edges, ["g", "u", "v", "w"], kernel, ["g", "u", "v", "w"])


def spanning_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, u, v, w), u < v: a minimum spanning forest, edges told apart by (w, u, v).

    Chunks of edges are thinned to their own forests first; a graph within one chunk is done. Those of larger graphs go through rounds in which every
    component takes its least edge to another.
    """
    thin = written(thinned(edges.where("u <> v")), "thin")
    large = in_chunks(thin)
    done = thin.join(large, "g", "left_anti").select("g", "u", "v", "w")
    if large.isEmpty():
        return thin.select("g", "u", "v", "w")
    rest = written(thin.join(large, "g", "left_semi").select("g", "u", "v", "w"), "rest")
    return done.unionByName(_by_rounds(vertices.join(large, "g", "left_semi"), rest))


def _by_rounds(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The forest by rounds; as edges are told apart no cycle can arise, and an edge that two components take counts once."""
    arcs = written(symmetric(edges.select("g", "u", "v", "w").withColumn("id", F.struct("w", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")))), "arcs")
    labels, chosen = written(vertices.select("g", "v", F.col("v").alias("label")), "labels"), None
    while True:
        one = labels.select("g", F.col("v").alias("u"), F.col("label").alias("lu"))
        across = arcs.join(one, ["g", "u"]).join(labels, ["g", "v"]).where("lu <> label")
        picked = across.groupBy("g", F.col("lu").alias("c")).agg(F.min_by("label", "id").alias("to"), F.min("id").alias("id"))
        picked = written(picked, "picked")
        if picked.isEmpty():
            break
        new = picked.select("g", F.col("id.a").alias("u"), F.col("id.b").alias("v"), F.col("id.w").alias("w")).distinct()
        chosen = new if chosen is None else chosen.unionByName(new)
        merged = components(labels.select("g", F.col("label").alias("v")).distinct(), picked.select("g", F.col("c").alias("u"), F.col("to").alias("v")))
        labels = written(labels.join(merged.select("g", F.col("v").alias("label"), F.col("label").alias("new")), ["g", "label"]).select("g", "v", F.col("new").alias("label")), "labels")
    return chosen if chosen is not None else edges.select("g", "u", "v", "w").limit(0)


def forest_weight(ids: DataFrame, forest: DataFrame) -> DataFrame:
    return _value(ids, forest.groupBy("g").agg(wrap(F.sum("w")).alias("value")))
