"""Queries on graphs: each case of candidates is a graph; its pairs are edges, scores plus 1 are weights.

The source is each graph's vertex 0, the target its last one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import graph, kernels
from loomspan.operators.fixpoint import components, frontier
from loomspan.plans.registry import Registry
from loomspan.session import written
from loomspan.sources.tables import table
from loomspan.u24 import INF, wrap

R = Registry()
PRELUDE = """with recursive c as (select case_id g, u, v, score from candidates where u <> v and score is not null),
n as (select g, max(greatest(u, v)) + 1 n from c group by g),
vx as (select g, unnest(range(n)) v from n),
e as (select g, least(u, v) u, greatest(u, v) v, min(score) + 1 w from c group by all),
sy as (select * from e union all select g, v, u, w from e),
a as (select g, u, v, min(score) + 1 w from c group by all),
"""
# hop distances from vertex 0 along {t}
HOPS = "r(g, v, d) using key (g, v) as (select g, 0::bigint, 0::bigint from n union select x.g, x.v, min(r.d + {w}) from r join {t} x on r.g = x.g and r.v = x.u left join recurring.r o on o.g = x.g and o.v = x.v where o.d is null or r.d + {w} < o.d group by x.g, x.v)"
PAIRS = "r(g, s, v, d) using key (g, s, v) as (select g, v, v, 0::bigint from vx union select x.g, r.s, x.v, min(r.d + {w}) from r join {t} x on r.g = x.g and r.v = x.u left join recurring.r o on o.g = x.g and o.s = r.s and o.v = x.v where o.d is null or r.d + {w} < o.d group by x.g, r.s, x.v)"
LABEL = "l as (select g, s v, min(v) label from r group by g, s)"


class Case:
    """Vertices, undirected edges and arcs of the candidates' graphs."""

    def __init__(self, spark: SparkSession, d: str):
        rows = table(spark, d, "candidates").where("u <> v and score is not null").select(F.col("case_id").alias("g"), "u", "v", "score")
        self.n = rows.groupBy("g").agg((F.max(F.greatest("u", "v")) + 1).alias("n"))
        self.v = graph.numbered(self.n)
        self.e = rows.groupBy("g", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg((F.min("score") + 1).alias("w"))
        self.a = rows.groupBy("g", "u", "v").agg((F.min("score") + 1).alias("w"))
        self.ids = self.n.select("g")
        self.s = self.n.select("g", F.lit(0).cast("bigint").alias("s"))
        self.st = self.n.select("g", F.lit(0).cast("bigint").alias("s"), (F.col("n") - 1).alias("t"))

    @property
    def both(self) -> DataFrame:
        return graph.symmetric(self.e)

    @property
    def labels(self) -> DataFrame:
        return components(self.v, self.e)

    @property
    def parts(self) -> DataFrame:
        return kernels.labelled(self.v, self.e)


def add(name: str, f: Callable[[Case], DataFrame], sql: str | None = None) -> None:
    R.add(name, lambda spark, d: f(Case(spark, d)), None if sql is None else PRELUDE + sql)


hop = lambda t: HOPS.format(t=t, w="1")
far = lambda t: HOPS.format(t=t, w="x.w")
pairs = lambda t, w="1": PAIRS.format(t=t, w=w)

# --- reach and distances
add("t3_reach_count", lambda c: graph.reach_count(c.a, c.s), hop("a") + " select g, count(*) as value from r group by g")
add("t3_bfs_dist", lambda c: graph.distance_list(c.v, graph.hops(c.a, c.s)), hop("a") + " select g, v, coalesce(d, 16777215) as value from vx left join r using (g, v)")
add("t3_sp_len", lambda c: graph.distance_to(c.st, graph.hops(c.both, c.s)), hop("sy") + " select g, coalesce(d, 16777215) as value from n left join r on r.g = n.g and r.v = n.n - 1".replace("select g", "select n.g"))
add("t3_khop", lambda c: graph.within(graph.hops(c.both, c.s, 2)), hop("sy") + " select g, count(*) as value from r where d <= 2 group by g")
add("t3_reach_queries", lambda c: graph.reach_queries(c.a, c.v.select("g", F.col("v").alias("pos"), F.col("v").alias("a"), (F.col("v") * 7 % 5).alias("b"))), pairs("a") + " select vx.g, vx.v as pos, cast(d is not null as bigint) as value from vx left join r on r.g = vx.g and r.s = vx.v and r.v = vx.v * 7 % 5")
add("t3_wsp_dist", lambda c: graph.distance_to(c.st, graph.distances(c.both, c.s)), far("sy") + " select n.g, coalesce(d, 16777215) as value from n left join r on r.g = n.g and r.v = n.n - 1")
add("t3_wsp_all_from", lambda c: graph.distance_list(c.v, graph.distances(c.a, c.s)), far("a") + " select g, v, coalesce(d, 16777215) as value from vx left join r using (g, v)")
add("t3_budget_reach", lambda c: graph.within(graph.distances(c.both, c.s, 900)), far("sy") + " select g, count(*) as value from r where d <= 900 group by g")
add("t3_minimax_path", lambda c: graph.distance_to(c.st, graph.bottlenecks(c.both, c.s)), HOPS.replace("r.d + {w}", "greatest(r.d, x.w)").format(t="sy") + " select n.g, coalesce(d, 16777215) as value from n left join r on r.g = n.g and r.v = n.n - 1")
LEVELS = "k(g, v, d, c) as (select g, 0::bigint, 0::bigint, 1::bigint from n union all select g, v, d, c from (select q.g, x.v, q.d + 1 d, sum(q.c)::bigint & 16777215 c from k q join {t} x on q.g = x.g and q.v = x.u join r on r.g = x.g and r.v = x.v where r.d = q.d + 1 group by q.g, x.v, q.d))"
for name, edges, t in (("t3_sp_count", "a", "a"), ("t3_count_shortest_paths", "both", "sy")):
    add(name, lambda c, edges=edges: graph._value(c.ids, c.st.join(graph.path_counts(getattr(c, edges), c.s), ["g", "s"]).where("v = t").select("g", F.col("c").alias("value"))), hop(t) + ", " + LEVELS.format(t=t) + " select n.g, coalesce(c, 0) as value from n left join k on k.g = n.g and k.v = n.n - 1")
# each graph's neighbours as lists by vertex, for walks that go on step by step
NEAR = "nb as (select g, list(l order by v) nb from (select vx.g, vx.v, list(sy.v order by sy.v) filter (sy.v is not null) l from vx left join sy on sy.g = vx.g and sy.u = vx.v group by all) group by g)"
BFS = NEAR + """, st(g, i, seen, nb) as (select g, 1::bigint, [0::bigint], nb from nb
 union all select g, i + 1, seen || list_filter(coalesce(nb[seen[i] + 1], []), lambda x: not list_contains(seen, x)), nb from st where i <= len(seen))
select g, unnest(range(len(seen))) as pos, unnest(seen) as v from (select g, arg_max(seen, i) seen from st group by g)"""
add("t3_bfs_order", lambda c: graph.bfs_order(c.e, c.s), BFS)
add("t3_eccentricities", lambda c: graph.eccentricities(c.v, c.e), pairs("sy") + " select g, s as v, max(d) as value from r group by g, s")
add("t3_wiener_index", lambda c: graph.wiener_index(c.v, c.e), pairs("sy") + " select g, cast(sum(case when s < v then d else 0 end) as bigint) & 16777215 as value from r group by g")
add("t3_apsp_matrix", lambda c: graph.distance_matrix(c.v, c.a), pairs("a", "x.w") + " select p.g, p.v as u, q.v, coalesce(d, 16777215) as value from vx p join vx q on p.g = q.g left join r on r.g = p.g and r.s = p.v and r.v = q.v")
add("t3_closure_size", lambda c: graph.closure_size(c.v, c.a), pairs("a") + " select g, count(*) filter (s <> v) & 16777215 as value from r group by g")
WALK = "k(g, v, c, i) as (select g, 0::bigint, {first}::bigint, 0 from n union all select q.g, x.v, {agg}, q.i + 1 from k q join a x on q.g = x.g and q.v = x.u where q.i < 4 group by q.g, x.v, q.i) select g, v, c as value from k where i = 4"
add("t3_walk_count", lambda c: graph.walks(c.a, c.s, 4), WALK.format(first=1, agg="sum(q.c)::bigint & 16777215"))
add("t3_cheapest_k_walk", lambda c: graph.walks(c.a, c.s, 4, True), WALK.format(first=0, agg="min(q.c + x.w)"))
# weight, then edges, in one number; nt is the least next vertex that keeps both optimal
LEX = """q(g, v, d) using key (g, v) as (select g, n - 1, 0::bigint from n union select x.g, x.v, min(q.d + x.w * 1000 + 1) from q join sy x on q.g = x.g and q.v = x.u
  left join recurring.q o on o.g = x.g and o.v = x.v where o.d is null or q.d + x.w * 1000 + 1 < o.d group by x.g, x.v),
nt as (select x.g, x.u, min(x.v) v from sy x join q a on a.g = x.g and a.v = x.u join q b on b.g = x.g and b.v = x.v where b.d + x.w * 1000 + 1 = a.d group by all),
pt(g, pos, v) as (select g, 0::bigint, v from q where v = 0 union all select pt.g, pos + 1, nt.v from pt join nt on nt.g = pt.g and nt.u = pt.v) select g, pos, v from pt"""
add("t3_lex_shortest_path", lambda c: graph.lex_shortest_path(c.e, c.st), LEX)

# --- messages
BIT = "1::bigint << (vx.v % 24)"


def bits(c: Case) -> DataFrame:
    """Which of 24 marks reach each vertex: sets of bits that go on while they grow."""
    none, own = F.lit(0).cast("bigint"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("v") % 24).cast("int"))
    act = lambda d, x: (d.bitwiseOR(x), d.bitwiseOR(x) != d, d.bitwiseOR(x))
    return frontier(c.v.select("g", "v", none.alias("d")), c.a, c.v.select("g", "v", own.alias("c")), act, lambda m, w: m, "or").withColumnRenamed("d", "value")


def wave(c: Case) -> DataFrame:
    """How many paths lead from vertex 0 to each one along the acyclic edges: a wave that passes on what it brings."""
    start = c.v.select("g", "v", F.lit(0).cast("bigint").alias("d"))
    act = lambda d, x: (wrap(d + x), x > 0, x)
    out = frontier(start, c.e, c.s.select("g", F.col("s").alias("v"), F.lit(1).cast("bigint").alias("c")), act, lambda m, w: m, "add")
    return out.withColumnRenamed("d", "value")


def thrifty(c: Case) -> DataFrame:
    """Least weight from vertex 0 as messages, and by an aggregate of one's own."""
    start = c.v.select("g", "v", F.lit(INF).cast("bigint").alias("d"))
    act = lambda d, x: (F.least(d, x), x < d, x)
    inbox = c.s.select("g", F.col("s").alias("v"), F.lit(0).cast("bigint").alias("c"))
    out = frontier(start, c.a, inbox, act, lambda m, w: m + w, lambda x: F.array_min(F.collect_set(x)))
    return out.withColumnRenamed("d", "value")


add("frontier_or", bits, pairs("a") + ", k as (select r.g, r.v, bit_or(1::bigint << (r.s % 24)) value from r group by all) select g, v, value from k")
WAVES = "k(g, v, c, i) as (select g, 0::bigint, 1::bigint, 0 from n union all select q.g, x.v, sum(q.c)::bigint & 16777215, q.i + 1 from k q join e x on q.g = x.g and q.v = x.u group by q.g, x.v, q.i) "
add("frontier_add", wave, WAVES + "select vx.g, vx.v, cast(coalesce(sum(c), 0) as bigint) & 16777215 as value from vx left join k using (g, v) group by all")
add("frontier_own", thrifty, far("a") + " select g, v, coalesce(d, 16777215) as value from vx left join r using (g, v)")

# --- components
add("t3_cc_label", lambda c: c.labels, pairs("sy") + ", " + LABEL + " select g, v, label from l")
add("t3_cc_count", lambda c: graph.component_count(c.labels), pairs("sy") + ", " + LABEL + " select g, count(distinct label) as value from l group by g")
add("t3_cc_largest", lambda c: graph.component_largest(c.labels), pairs("sy") + ", " + LABEL + " select g, max(n) as value from (select g, label, count(*) n from l group by all) group by g")
add("t3_cycle_rank", lambda c: graph.cycle_rank(c.v, c.e, c.labels), pairs("sy") + ", " + LABEL + " select g, (select count(*) from e where e.g = l.g) - count(*) + count(distinct label) as value from l group by g")
COLOUR = pairs("sy") + ", " + LABEL + ", p as (select l.g, l.v, l.label, r.d % 2 colour from l join r on r.g = l.g and r.s = l.label and r.v = l.v), b as (select distinct p.g, p.label from e join p on p.g = e.g and p.v = e.u join p q on q.g = e.g and q.v = e.v where p.colour = q.colour)"
add("t3_two_colour", lambda c: graph.two_colour(graph.colours(c.v, c.e)), COLOUR + " select g, v, case when g in (select g from b) then 16777215 else colour end as value from p")
add("t3_bipartite_comps", lambda c: graph.bipartite_components(graph.colours(c.v, c.e)), COLOUR + " select g, count(*) filter (v = label and (g, label) not in (select g, label from b)) as value from p group by g")
STRONG = pairs("a") + ", l as (select x.g, x.s v, min(x.v) label from r x join r y on x.g = y.g and x.s = y.v and x.v = y.s group by x.g, x.s)"
add("t3_scc_label", lambda c: graph.strong_components(c.v, c.a), STRONG + " select g, v, label from l")
add("t3_scc_count", lambda c: graph.component_count(graph.strong_components(c.v, c.a)), STRONG + " select g, count(distinct label) as value from l group by g")
add("t3_cyclic_vertices", lambda c: graph.cyclic_vertices(graph.strong_components(c.v, c.a)), STRONG + " select g, cast(sum(case when n > 1 then n else 0 end) as bigint) as value from (select g, label, count(*) n from l group by all) group by g")
add("t3_dag_longest", lambda c: graph.dag_longest(c.v, c.e), "k(g, v, d) as (select g, v, 0::bigint from vx union select q.g, x.v, q.d + 1 from k q join e x on q.g = x.g and q.v = x.u) select g, max(d) as value from k group by g")
TREE = "k(g, a, b, w, v) as (select g, u, v, w, u from e union select k.g, k.a, k.b, k.w, s.v from k join sy s on s.g = k.g and s.u = k.v where (s.w, least(s.u, s.v), greatest(s.u, s.v)) < (k.w, k.a, k.b)), f as (select g, u, v from e where (g, u, v) not in (select g, a, b from k where v = b)), t as (select g, u, v from f union all select g, v, u from f), "
add("t3_tree_parents", lambda c: graph.tree_parents(c.v, graph.spanning_forest(c.v, c.e), c.s), TREE + hop("t") + ", q as (select t.g, t.v, min(t.u) p from t join r a on a.g = t.g and a.v = t.v join r b on b.g = t.g and b.v = t.u where b.d = a.d - 1 group by t.g, t.v) select vx.g, vx.v, coalesce(q.p, 16777215) as value from vx left join q using (g, v)")
add("t3_msf_weight", lambda c: graph.forest_weight(c.ids, graph.spanning_forest(c.v, c.e)), "k(g, a, b, w, v) as (select g, u, v, w, u from e union select k.g, k.a, k.b, k.w, s.v from k join sy s on s.g = k.g and s.u = k.v where (s.w, least(s.u, s.v), greatest(s.u, s.v)) < (k.w, k.a, k.b)), f as (select distinct g, a, b from k where v = b) select n.g, coalesce((select cast(sum(w) as bigint) from e where e.g = n.g and (e.g, e.u, e.v) not in (select g, a, b from f)), 0) & 16777215 as value from n")

# --- degrees and counts
DEGREE = "dg as (select vx.g, vx.v, count(sy.u) d from vx left join sy on sy.g = vx.g and sy.v = vx.v group by all)"
add("t3_degrees", lambda c: graph.degrees(c.v, c.e), DEGREE + " select g, v, d as value from dg")
IO = "io as (select g, v, (select count(*) from a where a.g = vx.g and a.v = vx.v) ins, (select count(*) from a where a.g = vx.g and a.u = vx.v) outs from vx)"
add("t3_in_out_degrees", lambda c: graph.in_out_degrees(c.v, c.a), IO + " select g, v, ins, outs from io")
add("t3_sources_sinks", lambda c: graph.sources_sinks(graph.in_out_degrees(c.v, c.a)), IO + " select g, count(*) filter (ins = 0) as sources, count(*) filter (outs = 0) as sinks from io group by g")
add("t3_max_degree_vertex", lambda c: graph.max_degree_vertex(graph.degrees(c.v, c.e)), DEGREE + " select g, max_by(v, (d, -v)) as value from dg group by g")
add("t3_line_graph_edges", lambda c: graph.line_graph_edges(graph.degrees(c.v, c.e)), DEGREE + " select g, cast(sum(d * (d - 1) // 2) as bigint) & 16777215 as value from dg group by g")
add("t3_triangle_count", lambda c: graph.triangle_count(c.ids, c.v, c.e), "t as (select x.g, count(*) n from e x join e y on x.g = y.g and x.v = y.u join e z on z.g = x.g and z.u = x.u and z.v = y.v group by x.g) select n.g, coalesce(t.n, 0) as value from n left join t using (g)")
add("t3_euler_start", lambda c: graph.euler_start(c.ids, c.v, c.e), pairs("sy") + ", " + LABEL + ", " + DEGREE + ", f as (select g, count(distinct label) k, count(*) filter (d % 2 = 1) o, min(v) filter (d % 2 = 1) fo, min(v) fv from dg join l using (g, v) where d > 0 group by g) select n.g, case when k is null or k > 1 then 16777215 when o = 0 then fv when o = 2 then fo else 16777215 end as value from n left join f using (g)")
CORE = NEAR + """, st(g, alive, nb, go) as (select g, range(n), nb, true from n join nb using (g)
 union all select g, rest, nb, len(rest) < len(alive) from (select g, alive, nb, list_filter(alive, lambda v: len(list_intersect(coalesce(nb[v + 1], []), alive)) >= 3) rest from st where go))
select g, min(len(alive)) as value from st group by g"""
add("t3_kcore_size", lambda c: graph.kcore_size(c.ids, graph.kcore(c.v, c.e, 3)), CORE)


# --- kernels
def cut_counts(c: Case, bridges: bool) -> DataFrame:
    found = kernels.by_group(c.parts, ["g", "label"], ["u", "v"], lambda es: [(len(kernels.cuts(es)[0 if bridges else 1]),)], "n bigint")
    return graph._value(c.ids, found.groupBy("g").agg(F.sum("n").alias("value")))


def weakest(c: Case, f: Callable, best: Callable, empty: int) -> DataFrame:
    found = kernels.by_group(c.parts, ["g", "label"], ["u", "v", "w"], lambda es: [(f(es),)], "n bigint")
    return graph._value(c.ids, found.groupBy("g").agg(best("n").alias("value")), empty)


REST = "k(g, x, v, o) as (select vx.g, vx.v, o.v, o.v from vx join vx o on o.g = vx.g and o.v <> vx.v union select k.g, k.x, s.v, k.o from k join sy s on s.g = k.g and s.u = k.v where s.v <> k.x)"
add("t3_articulation", lambda c: cut_counts(c, False), pairs("sy") + ", " + LABEL + ", " + REST + ", m as (select g, x, o, min(v) label from k group by all), z as (select g, x, count(distinct label) k from m group by all) select n.g, count(*) filter (z.k > (select count(distinct label) from l where l.g = n.g)) as value from n left join z using (g) group by n.g")
AVOID = "k(g, a, b, w, v) as (select g, u, v, w, u from e union select k.g, k.a, k.b, k.w, s.v from k join sy s on s.g = k.g and s.u = k.v where {}) "
add("t3_bridges", lambda c: cut_counts(c, True), AVOID.format("(least(s.u, s.v), greatest(s.u, s.v)) <> (k.a, k.b)") + ", f as (select distinct g, a, b from k where v = b) select n.g, (select count(*) from e where e.g = n.g) - (select count(*) from f where f.g = n.g) as value from n")
add("t3_articulation_points", lambda c: kernels.by_group(c.parts, ["g", "label"], ["u", "v"], lambda es: [(v,) for v in kernels.cuts(es)[1]], "v bigint").select("g", "v"), pairs("sy") + ", " + LABEL + ", " + REST + ", m as (select g, x, o, min(v) label from k group by all), z as (select g, x, count(distinct label) k from m group by all) select z.g, z.x as v from z where z.k > (select count(distinct label) from l where l.g = z.g)")
def topo_order(c: Case) -> DataFrame:
    """Each weakly connected part's least order by itself wouldn't be the graph's, so a graph is one task."""
    rows = c.v.select("g", F.lit(-1).cast("bigint").alias("u"), "v").unionByName(c.e.select("g", "u", "v"))
    order = lambda r: list(enumerate(kernels.topological([v for u, v in r if u < 0], [x for x in r if x[0] >= 0])))
    return kernels.by_group(rows, ["g"], ["u", "v"], order, "pos bigint, v bigint")


TOPO = """pd as (select g, list(l order by v) pd from (select vx.g, vx.v, list(e.u) filter (e.u is not null) l from vx left join e on e.g = vx.g and e.v = vx.v group by all) group by g),
st(g, done, pd, n) as (select n.g, []::bigint[], pd, n from n join pd using (g)
 union all select g, done || list_filter(range(n), lambda v: not list_contains(done, v) and len(list_filter(coalesce(pd[v + 1], []), lambda p: not list_contains(done, p))) = 0)[1:1], pd, n from st where len(done) < n)
select g, unnest(range(n)) as pos, unnest(done) as v from st where len(done) = n"""
add("t3_topo_order", topo_order, TOPO)
add("t3_bipartite_matching", lambda c: weakest(c_sides(c), kernels.matching, F.sum, 0))
FIT = NEAR + """, st(g, cs, nb, n) as (select n.g, []::bigint[], nb, n from n join nb using (g)
 union all select g, cs || [list_filter(range(n), lambda c: not list_contains(list_transform(list_filter(coalesce(nb[len(cs) + 1], []), lambda u: u < len(cs)), lambda u: cs[u + 1]), c))[1]], nb, n from st where len(cs) < n)
select g, unnest(range(n)) as v, unnest(cs) as value from st where len(cs) = n"""
add("t3_greedy_coloring", lambda c: graph._all(c.v, kernels.by_group(c.parts, ["g", "label"], ["u", "v"], lambda es: list(kernels.first_fit(es).items()), "v bigint, colour bigint"), "colour", 0), FIT)
add("t3_clique_number", lambda c: weakest(c, kernels.clique, F.max, 1), "q as (select g, 2 k from e union all select x.g, 3 from e x join e y on x.g = y.g and x.v = y.u join e z on z.g = x.g and z.u = x.u and z.v = y.v union all select x.g, 4 from e x join e y on x.g = y.g and x.v = y.u join e z on z.g = x.g and z.u = x.u and z.v = y.v join e p on p.g = x.g and p.u = x.u join e q2 on q2.g = x.g and q2.u = x.v and q2.v = p.v join e r on r.g = x.g and r.u = y.v and r.v = p.v) select n.g, coalesce(max(k), 1) as value from n left join q using (g) group by n.g")
# deepest vertices first, each taken unless a child of it is
MIS = TREE + PAIRS.format(t="t", w="1") + """, ro as (select g, s v, min(v) root from r group by g, s),
od as (select ro.g, list(ro.v order by r.d desc, ro.v) od from ro join r on r.g = ro.g and r.s = ro.root and r.v = ro.v group by ro.g),
nb as (select g, list(l order by v) nb from (select vx.g, vx.v, list(t.v) filter (t.v is not null) l from vx left join t on t.g = vx.g and t.u = vx.v group by all) group by g),
st(g, i, had, od, nb) as (select g, 1::bigint, []::bigint[], od, nb from od join nb using (g)
 union all select g, i + 1, case when list_has_any(had, coalesce(nb[od[i] + 1], [])) then had else had || [od[i]] end, od, nb from st where i <= len(od))
select g, max(len(had)) as value from st group by g"""
add("t3_forest_mis", lambda c: forest_mis(c), MIS)
# the heaviest edge on each path of the lightest forest; one edge outside takes its place
SECOND = TREE + """tw as (select e.g, e.u, e.v, w from e join f using (g, u, v) union all select e.g, e.v, e.u, w from e join f using (g, u, v)),
pm(g, s, v, b, m) as (select g, v, v, -1::bigint, 0::bigint from vx union all select pm.g, pm.s, tw.v, tw.u, greatest(m, w) from pm join tw on tw.g = pm.g and tw.u = pm.v and tw.v <> pm.b),
lb as (select g, s v, min(v) label from pm group by g, s),
tt as (select lb.g, label, cast(sum(w) as bigint) total from e join f using (g, u, v) join lb on lb.g = e.g and lb.v = e.u group by all),
sd as (select e.g, label, min(e.w - m) d from e join lb on lb.g = e.g and lb.v = e.u join pm on pm.g = e.g and pm.s = e.u and pm.v = e.v where (e.g, e.u, e.v) not in (select g, u, v from f) group by all)
select g, max(coalesce(total + d, 16777215)) as value from tt left join sd using (g, label) group by g"""
add("t3_mst_second", lambda c: weakest(c, lambda es: INF if (w := kernels.second_tree(es)) is None else w, F.max, INF), SECOND)
add("t3_girth", lambda c: weakest(c, kernels.girth, F.min, 0), "r(g, a, b, v, d) using key (g, a, b, v) as (select g, u, v, u, 0::bigint from e union select x.g, r.a, r.b, x.v, min(r.d + 1) from r join sy x on r.g = x.g and r.v = x.u left join recurring.r o on o.g = x.g and o.a = r.a and o.b = r.b and o.v = x.v where (least(x.u, x.v), greatest(x.u, x.v)) <> (r.a, r.b) and (o.d is null or r.d + 1 < o.d) group by x.g, r.a, r.b, x.v) select n.g, coalesce(min(d) + 1, 0) as value from n left join r on r.g = n.g and r.v = r.b group by n.g")
add("t3_max_flow", lambda c: kernels.by_group(c.a.join(c.st, "g"), ["g", "s", "t"], ["u", "v", "w"], lambda es: [(kernels.flow(es, 0, max(max(u, v) for u, v, _ in es)),)], "value bigint").select("g", wrap(F.col("value")).alias("value")))


def c_sides(c: Case) -> Case:
    """The arcs as edges from a left to a right side: even numbers on the left, odd ones on the right."""
    right = c.a.withColumns({"u": F.col("u") * 2, "v": F.col("v") * 2 + 1})
    c.e = right
    c.v = right.select("g", F.col("u").alias("v")).union(right.select("g", "v")).distinct()
    return c


def forest_mis(c: Case) -> DataFrame:
    """On each graph's lightest spanning forest; a vertex without edges counts by itself."""
    forest = written(graph.spanning_forest(c.v, c.e).select("g", "u", "v"), "forest")
    found = kernels.by_group(kernels.labelled(c.v, forest), ["g", "label"], ["u", "v"], lambda es: [(kernels.independent(es),)], "n bigint")
    lone = c.v.join(graph.symmetric(forest).select("g", "v"), ["g", "v"], "left_anti").select("g", F.lit(1).cast("bigint").alias("n"))
    return graph._value(c.ids, found.select("g", "n").unionByName(lone).groupBy("g").agg(F.sum("n").alias("value")))
