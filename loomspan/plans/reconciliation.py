"""Queries on record matching, over candidates, must_not_link and node_attributes; nodes are 0 up to each case's largest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import graph, recon
from loomspan.operators.fixpoint import resolve
from loomspan.plans.registry import Registry
from loomspan.session import written
from loomspan.sources.tables import table

R = Registry()
TAU, CAP = 600, 4
PRELUDE = """with recursive c as (select case_id g, pos, u, v, score from candidates),
m as (select case_id g, a, b from must_not_link),
t as (select case_id g, node, attr_no k, attr_value x from node_attributes),
n as (select g, max(n) + 1 n from (select g, greatest(u, v) n from c union all select g, greatest(a, b) from m union all select g, node from t) group by g),
vx as (select g, unnest(range(n)) v from n),
p as (select g, least(u, v) u, greatest(u, v) v, max(score) score from c where score is not null and u <> v group by all),
ok as (select * from p where score >= 600),
sy as (select g, u, v from ok union all select g, v, u from ok),
r(g, s, v) as (select g, v, v from vx union select r.g, r.s, y.v from r join sy y on y.g = r.g and y.u = r.v),
k as (select g, s v, max(v) canonical, min(v) label from r group by g, s),
z as (select g, canonical, count(*) n from k group by all),
"""


class Case:
    def __init__(self, spark: SparkSession, d: str):
        self.c = table(spark, d, "candidates").select(F.col("case_id").alias("g"), "pos", "u", "v", "score")
        self.m = table(spark, d, "must_not_link").select(F.col("case_id").alias("g"), "a", "b")
        self.t = table(spark, d, "node_attributes").select(F.col("case_id").alias("g"), "node", F.col("attr_no").alias("key"), F.col("attr_value").alias("value"))
        most = self.c.select("g", F.greatest("u", "v").alias("n")).union(self.m.select("g", F.greatest("a", "b"))).union(self.t.select("g", "node"))
        self.n = most.groupBy("g").agg((F.max("n") + 1).alias("n"))
        self.v = graph.numbered(self.n)
        self.ids = self.n.select("g")
        self.p = recon.normalised(self.c)
        self.ok = recon.accepted(self.p, TAU)
        self.e = self.c.select("g", "u", "v", F.col("pos").alias("w"))

    @property
    def k(self) -> DataFrame:
        return recon.canonical(self.v, self.ok)

    @property
    def z(self) -> DataFrame:
        return recon.sizes(self.k)

    def count(self, rows: DataFrame) -> DataFrame:
        return graph._value(self.ids, rows.groupBy("g").agg(F.count(F.lit(1)).alias("value")))


def add(name: str, f: Callable[[Case], DataFrame], sql: str | None = None) -> None:
    R.add(name, lambda spark, d: f(Case(spark, d)), None if sql is None else PRELUDE + sql)


def plain(name: str, f: Callable[[Case], DataFrame], sql: str) -> None:
    add(name, f, "x_ as (select 1) " + sql)


# --- decide
plain("t5_decide_filter", lambda c: recon.accepted(c.c, TAU), "select g, pos, u, v, score from c where score >= 600")
plain("t5_decide_count", lambda c: c.count(recon.accepted(c.c, TAU)), "select n.g, count(c.g) as value from n left join c on c.g = n.g and score >= 600 group by n.g")
plain("family_candidate_sum", lambda c: graph._value(c.ids, recon.accepted(c.c, TAU).groupBy("g").agg(F.sum("score").alias("value"))), "select n.g, coalesce(cast(sum(score) as bigint), 0) as value from n left join c on c.g = n.g and score >= 600 group by n.g")
plain("family_candidate_ids", lambda c: recon.accepted(c.c, TAU).select("g", "pos", "u", "v"), "select g, pos, u, v from c where score >= 600")
ENDS = "select g, u x from c where score >= 600 union select g, v from c where score >= 600"
plain("family_candidate_nodes", lambda c: c.count(recon.accepted(c.c, TAU).select("g", F.explode(F.array("u", "v")).alias("x")).distinct()), f"select n.g, count(x) as value from n left join ({ENDS}) using (g) group by n.g")
plain("t5_decide_normalise", lambda c: c.p, "select * from p")
plain("t5_decide_drop_known", lambda c: recon.drop_known(c.c.where("u < v"), c.m.select("g", F.col("a").alias("u"), F.col("b").alias("v"))), "select g, u, v, pos, score from c where u < v and not exists (select 1 from m where m.g = c.g and a = u and b = v)")
ORDER = "select g, pos, u, v, score, row_number() over (partition by g order by score desc, u, v, pos) - 1 as ord from c where score >= 600"
plain("t5_decide_order", lambda c: recon.processing_order(c.c, TAU), ORDER)
plain("t5_decide_top_k", lambda c: recon.processing_order(c.c, TAU).where("ord < 5"), f"select * from ({ORDER}) where ord < 5")
plain("t5_decide_stage_cap", lambda c: recon.staged(c.c, TAU, 7).withColumn("deferred", F.lit(None).cast("bigint")).unionByName(recon.deferred(c.ids, c.c, TAU, 7).select("g", F.lit(-1).cast("bigint").alias("ord"), F.lit(None).cast("bigint").alias("u"), F.lit(None).cast("bigint").alias("v"), F.col("value").alias("deferred"))), f"select g, ord, u, v, null as deferred from ({ORDER}) where ord < 7 union all select n.g, -1, null, null, greatest(count(c.g) - 7, 0) from n left join c on c.g = n.g and score >= 600 group by n.g")
plain("t5_decide_singleton", lambda c: recon.singleton(c.c.where("pos < 6 and score is not null").select("g", F.col("pos").alias("i"), F.col("score").alias("p")), F.lit(900)), "select g, case when max(score) >= 900 then max_by(pos, (score, -pos)) else 6 end as value from c where pos < 6 and score is not null group by g")
# the contract takes six probabilities: all candidates, in groups of six by pos
plain("t5_decide_singleton_all", lambda c: recon.singleton(c.c.where("score is not null").selectExpr("g", "pos div 6 as six", "pos % 6 as i", "score as p"), F.lit(900), ("g", "six")), "select g, pos // 6 as six, case when max(score) >= 900 then max_by(pos % 6, (score, -pos)) else 6 end as value from c where score is not null group by all")
plain("t5_decide_stage_idem", lambda c: recon.stage_once(c.c.select("g", "pos", (F.col("u") % 6).alias("verb"), F.col("v").alias("target")), c.t.select("g", (F.col("value") % 6).alias("verb"), F.col("node").alias("target"), F.col("key").alias("status"))), "select g, min(pos) as pos, u % 6 as verb, v as target from c where not exists (select 1 from t where t.g = c.g and t.x % 6 = u % 6 and t.node = c.v and k in (0, 1)) group by g, u % 6, v")

# --- cluster
plain("t5_cluster_label", lambda c: recon.components(c.v, c.ok), "select g, v, label from k")
plain("t5_cluster_canon", lambda c: c.k, "select g, v, canonical from k")
plain("t5_cluster_sizes", lambda c: c.z, "select * from z")
for name, column, sql in (("count", "clusters", "count(*)"), ("largest", "largest", "max(n)"), ("singletons", "singletons", "count(*) filter (n = 1)"), ("closure_pairs", "closure_pairs", "cast(sum(n * (n - 1) // 2) as bigint)"), ("count_ge", "ge3", "count(*) filter (n >= 3)"), ("merge_count", "merges", "cast(sum(n) as bigint) - count(*)")):
    plain(f"t5_cluster_{name}", lambda c, column=column: recon.cluster_statistics(c.z).select("g", F.col(column).alias("value")), f"select g, {sql} as value from z group by g")
plain("t5_cluster_histogram", lambda c: recon.size_histogram(c.z), "select i.g, b as bucket, count(z.g) as value from (select g, unnest(range(1, 9)) b from n) i left join z on z.g = i.g and least(z.n, 8) = b group by all")
plain("t5_cluster_list", lambda c: recon.cluster_lists(c.k), "select g, row_number() over (partition by g order by label) - 1 as pos, members from (select g, label, list(v order by v) members from k group by all)")
plain("t5_cluster_emit", lambda c: recon.emitted(c.k), "select g, v as dup, canonical from k where v <> canonical")
plain("t5_cluster_implied_unproposed", lambda c: recon.implied_unproposed(c.z, c.ok), "select z.g, cast(sum(n * (n - 1) // 2) as bigint) - (select count(*) from ok where ok.g = z.g) as value from z group by z.g")
plain("t5_cluster_members_of", lambda c: recon.members_of(c.k, c.ids.withColumn("x", F.lit(3).cast("bigint"))), "select a.g, a.v as x, b.v as v from k a join k b using (g, canonical) where a.v = 3")
plain("t5_cluster_members_of_all", lambda c: recon.members_of(k := written(c.k, "canon"), k.select("g", F.col("v").alias("x"))), "select a.g, a.v as x, b.v as v from k a join k b using (g, canonical)")
plain("t5_cluster_canon_of", lambda c: c.k.where("v = 3").select("g", F.col("canonical").alias("value")), "select g, canonical as value from k where v = 3")
plain("t5_cluster_same", lambda c: recon.same_cluster(c.k, c.c.select("g", "pos", F.col("u").alias("a"), F.col("v").alias("b"))), "select c.g, pos, cast(x.canonical = y.canonical as bigint) as value from c join k x on x.g = c.g and x.v = c.u join k y on y.g = c.g and y.v = c.v")

# --- conflicts
BAD = "bad as (select m.g, a, b, x.canonical from m join k x on x.g = m.g and x.v = a join k y on y.g = m.g and y.v = b where x.canonical = y.canonical) "
add("t5_conflict_count", lambda c: c.count(recon.conflicts(c.k, c.m)), BAD + "select n.g, count(bad.g) as value from n left join bad using (g) group by n.g")
add("t5_conflict_pairs", lambda c: recon.conflicts(c.k, c.m), BAD + "select * from bad")
add("t5_conflict_flags", lambda c: recon.conflict_flags(k := c.k, recon.conflicts(k, c.m)), BAD + "select z.g, z.canonical, cast(exists (select 1 from bad where bad.g = z.g and bad.canonical = z.canonical) as bigint) as value from z")
# merging in order, one pair a step; home tells each node's cluster by one of its nodes
GREEDY = """o as (select g, u, v, score, row_number() over (partition by g order by score desc, u, v) i from ok),
ml as (select g, list([a, b] order by a, b) walls from (select distinct g, least(a, b) a, greatest(a, b) b from m) group by g),
st(g, i, home, u, v, score, hu, hv, n_u, n_v, wall, large) as (
  select g, 0::bigint, range(n), 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, null::bigint[], false from n
  union all
  select g, i, case when hu = hv or wall is not null or large then home else list_transform(home, lambda x: case when x = hu then hv else x end) end, u, v, score, hu, hv, n_u, n_v, wall, large
  from (select *, hu <> hv and n_u + n_v > {cap} large, case when hu <> hv then list_filter(walls, lambda w: home[w[1] + 1] = hu and home[w[2] + 1] = hv or home[w[1] + 1] = hv and home[w[2] + 1] = hu)[1] end wall
    from (select *, len(list_filter(home, lambda x: x = hu)) n_u, len(list_filter(home, lambda x: x = hv)) n_v
      from (select o.g, o.i, home, o.u, o.v, o.score, home[o.u + 1] hu, home[o.v + 1] hv, walls from st join o on o.g = st.g and o.i = st.i + 1 left join ml on ml.g = st.g)))),
lg as (select g, u, v, score, case when hu = hv then 'noop' when wall is not null then 'must_not_link' when large then 'size' else 'merge' end as action, wall[1] as blocker_a, wall[2] as blocker_b,
  wall is not null as mnl_bad, large as cap_bad, n_u, n_v from st where i > 0),
hm as (select g, unnest(range(len(home))) v, unnest(home) h from (select g, arg_max(home, i) home from st group by g)),
kc as (select g, v, max(v) over (partition by g, h) canonical from hm)
"""
ANY_SIZE = GREEDY.format(cap=1 << 60)
CAPPED = GREEDY.format(cap=CAP)
add("t5_conflict_greedy", lambda c: recon.constrained(c.v, c.ok, c.m)[0], ANY_SIZE + "select g, v, canonical from kc")
add("t5_conflict_greedy_cap", lambda c: recon.constrained(c.v, c.ok, c.m, CAP)[0], CAPPED + "select g, v, canonical from kc")


def skipped(c: Case) -> DataFrame:
    log = recon.constrained(c.v, c.ok, c.m, CAP)[1].where("action in ('must_not_link', 'size')")
    return log.select("g", "u", "v", "score", "action")


add("t5_conflict_skipped", skipped, CAPPED + "select g, u, v, score, action from lg where action in ('must_not_link', 'size')")
# the log of the components that needed it: those with a must-not-link pair inside and those above the cap
NEEDED = f"""select lg.* from lg join k on k.g = lg.g and k.v = lg.u where exists (select 1 from m join k x on x.g = m.g and x.v = m.a join k y on y.g = m.g and y.v = m.b
where m.g = k.g and x.label = k.label and y.label = k.label) or (select n from z where z.g = k.g and z.canonical = k.canonical) > {CAP}"""
add("recon_decision_log", lambda c: recon.constrained(c.v, c.ok, c.m, CAP)[1], CAPPED + NEEDED)
add("recon_decision_pools", lambda c: recon.decision_pools(c.v, written(c.ok, "accepted"), c.m, CAP))

# --- properties
PROPS = "q as (select t.g, canonical, t.k as key, x, count(*) c from t join k on k.g = t.g and k.v = t.node where x is not null and t.k is not null group by all), w as (select g, canonical, key, max_by(x, (c, -x)) as value, count(*) n_values from q group by all) "
add("t5_prop_merged", lambda c: recon.merged_properties(c.k, c.t).drop("n_values"), PROPS + "select g, canonical, key, value from w")
add("t5_prop_majority", lambda c: recon.merged_properties(c.k, c.t).where("key = 1").select("g", "canonical", "value"), PROPS + "select g, canonical, value from w where key = 1")
add("t5_prop_conflicts", lambda c: c.count(recon.merged_properties(c.k, c.t).where("n_values > 1")), PROPS + "select n.g, count(w.g) as value from n left join w on w.g = n.g and n_values > 1 group by n.g")
add("t5_prop_conflict_keys", lambda c: recon.merged_properties(c.k, c.t).where("n_values > 1").select("g", "canonical", "key"), PROPS + "select g, canonical, key from w where n_values > 1")
plain("t5_prop_distinct_per_key", lambda c: recon.distinct_values(c.ids, c.t), "select i.g, b as key, count(distinct x) as value from (select g, unnest(range(4)) b from n) i left join t on t.g = i.g and t.k = b group by all")

# --- rewriting
NEW = "e2 as (select c.g, least(x.canonical, y.canonical) u, greatest(x.canonical, y.canonical) v, cast(sum(pos) as bigint) & 16777215 w from c join k x on x.g = c.g and x.v = c.u join k y on y.g = c.g and y.v = c.v where x.canonical <> y.canonical group by all) "
add("t5_rewrite_edges", lambda c: recon.rewritten(c.k, c.e).select("g", "u", "v"), NEW + "select g, u, v from e2")
add("t5_rewrite_weighted", lambda c: recon.rewritten(c.k, c.e), NEW + "select g, u, v, w from e2")
add("t5_rewrite_collapsed", lambda c: recon.collapsed(c.e, recon.rewritten(c.k, c.e)), NEW + "select c.g, count(*) - (select count(*) from e2 where e2.g = c.g) as value from c group by c.g")
DEGREE = ", d2 as (select g, u k, v from e2 union all select g, v, u from e2) "
add("t5_rewrite_degrees", lambda c: recon.rewritten_degrees(k := c.k, recon.rewritten(k, c.e)), NEW + DEGREE + "select z.g, z.canonical, count(d2.k) as value from z left join d2 on d2.g = z.g and d2.k = z.canonical group by all")
add("t5_rewrite_neighbours", lambda c: recon.rewritten_neighbours(recon.rewritten(k := c.k, c.e), k.where("v = 3").select("g", F.col("canonical").alias("k"))), NEW + DEGREE + "select d2.g, d2.k, d2.v from d2 join k on k.g = d2.g and k.canonical = d2.k where k.v = 3")

add("t5_rewrite_neighbours_all", lambda c: recon.rewritten_neighbours(recon.rewritten(k := written(c.k, "canon"), c.e), k.select("g", F.col("canonical").alias("k")).distinct()), NEW + DEGREE + "select g, k, v from d2")


def pointers(c: Case) -> DataFrame:
    """Each node points to the largest partner of its accepted pairs, or to itself."""
    best = c.ok.groupBy("g", F.col("u").alias("v")).agg(F.max("v").alias("p"))
    return c.v.join(best, ["g", "v"], "left").select("g", "v", F.coalesce("p", "v").alias("p"))


POINT = "pt as (select vx.g, vx.v, coalesce(max(ok.v), vx.v) p from vx left join ok on ok.g = vx.g and ok.u = vx.v group by vx.g, vx.v), "
add("t5_rewrite_sameas_roots", lambda c: resolve(pointers(c))[0], POINT + "f(g, v, p) as (select g, v, p from pt union select f.g, f.v, pt.p from f join pt on pt.g = f.g and pt.v = f.p) select f.g, f.v, f.p as root from f join pt on pt.g = f.g and pt.v = f.p and pt.p = pt.v")


def looping(c: Case) -> DataFrame:
    """As pointers, but the largest partner points back, so that cases with pairs have cycles."""
    best = c.ok.select("g", "u", "v").unionByName(c.ok.select("g", F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("g", F.col("u").alias("v")).agg(F.max("v").alias("p"))
    return c.v.join(best, ["g", "v"], "left").select("g", "v", F.coalesce("p", "v").alias("p"))


LOOP = "pt as (select vx.g, vx.v, coalesce(max(sy.v), vx.v) p from vx left join sy on sy.g = vx.g and sy.u = vx.v group by vx.g, vx.v), f(g, v, p) as (select g, v, p from pt union select f.g, f.v, pt.p from f join pt on pt.g = f.g and pt.v = f.p) "
add("t5_rewrite_sameas_cycle", lambda c: graph._value(c.ids, resolve(looping(c))[1].groupBy("g").agg(F.lit(1).alias("value"))), LOOP + "select n.g, cast(exists (select 1 from vx where vx.g = n.g and not exists (select 1 from f join pt on pt.g = f.g and pt.v = f.p and pt.p = pt.v where f.g = vx.g and f.v = vx.v)) as bigint) as value from n")

# --- metrics: clusters at the threshold against those of a higher one
TRUTH = "ok2 as (select * from p where score >= 800), s2 as (select g, u, v from ok2 union all select g, v, u from ok2), r2(g, s, v) as (select g, v, v from vx union select r2.g, r2.s, y.v from r2 join s2 y on y.g = r2.g and y.u = r2.v), k2 as (select g, s v, max(v) truth from r2 group by g, s), lb as (select k.g, k.v, canonical pred, truth from k join k2 using (g, v)), pr as (select a.g, a.pred = b.pred sp, a.truth = b.truth st from lb a join lb b on a.g = b.g and a.v < b.v) "


def labels(c: Case) -> DataFrame:
    truth = recon.canonical(c.v, recon.accepted(c.p, 800)).withColumnRenamed("canonical", "truth")
    return c.k.withColumnRenamed("canonical", "pred").join(truth, ["g", "v"])


add("t5_metric_pairwise", lambda c: recon.metrics(labels(c)).select("g", "tp", "fp", "fn"), TRUTH + "select n.g, count(*) filter (sp and st) as tp, count(*) filter (sp and not st) as fp, count(*) filter (st and not sp) as fn from n left join pr using (g) group by n.g")
add("t5_metric_rand", lambda c: recon.metrics(labels(c)).select("g", F.col("rand").alias("value")), TRUTH + "select n.g, count(*) filter (sp = st) as value from n left join pr using (g) group by n.g")
add("t5_metric_purity", lambda c: recon.metrics(labels(c)).select("g", F.col("purity").alias("value")), TRUTH + "select g, cast(sum(c) as bigint) as value from (select g, pred, max(c) c from (select g, pred, truth, count(*) c from lb group by all) group by all) group by g")

# --- pipeline
plain("t5_reconcile_canon", lambda c: recon.reconcile(c.v, c.c, TAU), "select g, v, canonical from k")
# properties and rewritten edges of the clusters that merging in order leaves
OWN = lambda sql: sql.replace("join k on", "join kc k on").replace("join k ", "join kc ")
FULL = ANY_SIZE + ", " + OWN(NEW) + ", " + OWN(PROPS)
add("t5_reconcile_canon_mnl", lambda c: full(c)["canon"], ANY_SIZE + "select g, v, canonical from kc")
add("t5_reconcile_full", lambda c: full(c)["edges"], FULL + "select g, u, v, w from e2")
add("t5_reconcile_full_props", lambda c: parts(full(c)), FULL + """select g, 0 as part, v as x, canonical as y, null as z from kc
union all select g, 1, u, v, w from e2 union all select g, 2, canonical, key, value from w""")
plain("recon_emit_new", lambda c: recon.emit_new(k := written(c.k, "canon"), recon.emitted(k).where("dup % 2 = 0")), "select g, v as dup, canonical from k where v <> canonical and v % 2 = 1")

# known: what an earlier run at the higher threshold has emitted
add("recon_emit_new_all", lambda c: recon.emit_new(c.k, recon.emitted(recon.canonical(c.v, recon.accepted(c.p, 800)))), TRUTH + "select g, v as dup, pred as canonical from lb where v <> pred and truth <> pred")


def full(c: Case) -> dict[str, DataFrame]:
    return recon.reconcile_full(c.v, c.c, TAU, c.m, c.e, c.t)


def parts(out: dict[str, DataFrame]) -> DataFrame:
    """The pipeline's results in one: part 0 canon (v, canonical), 1 edges (u, v, w), 2 attributes (canonical, key, value)."""
    rows = [out["canon"].select("g", F.lit(0).alias("part"), F.col("v").alias("x"), F.col("canonical").alias("y"), F.lit(None).cast("bigint").alias("z"))]
    rows.append(out["edges"].select("g", F.lit(1).alias("part"), F.col("u").alias("x"), F.col("v").alias("y"), F.col("w").alias("z")))
    rows.append(out["attributes"].select("g", F.lit(2).alias("part"), F.col("canonical").alias("x"), F.col("key").alias("y"), F.col("value").alias("z")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
