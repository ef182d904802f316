"""Queries on stage programs, seating rules and arrangements, explanations, digests and slices.

Guests are customers, a chart for each market segment; a company is a nation, the category a number of the customer key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.stages import Pipeline
from loomspan.operators import explain, recon, seating
from loomspan.operators.fixpoint import components
from loomspan.plans.reconciliation import CAP, Case
from loomspan.plans.reconciliation import PRELUDE as RECON
from loomspan.plans.registry import Registry
from loomspan.plans.sequences import PRELUDE, sequences
from loomspan.session import written
from loomspan.sources import files
from loomspan.sources.tables import table
from loomspan.u24 import wrap

R = Registry()
PROGRAMS = {
    "stage_program_list": ("filter gt 900\nmap lin 3 7\ndedup\nrunsum\ndiff\nid", """, a as (select seq_id, row_number() over (partition by seq_id order by pos) - 1 pos, (v * 3 + 7) & 16777215 v from s where v > 900),
b as (select seq_id, pos, v, lag(v) over (partition by seq_id order by pos) p from a), c as (select seq_id, row_number() over (partition by seq_id order by pos) - 1 pos, v from b where p is null or p <> v),
r as (select seq_id, pos, cast(sum(v) over (partition by seq_id order by pos) as bigint) & 16777215 v from c) select seq_id, pos, (n - v) & 16777215 as v from (select *, lead(v) over (partition by seq_id order by pos) n from r) where n is not null"""),
    "stage_program_reduce": ("sort\ntake 20\nreverse\nreduce idxlast modeq 3 1", """, a as (select seq_id, v, row_number() over (partition by seq_id order by v) - 1 p from s), b as (select seq_id, v, row_number() over (partition by seq_id order by p desc) - 1 pos from a where p < 20)
select seq_id, coalesce(max(pos) filter (v % 3 = 1), 16777215) as value from b group by 1"""),
}
for name, (text, sql) in PROGRAMS.items():
    R.add(name, lambda spark, d, text=text: Pipeline.of(text)(sequences(spark, d)), PRELUDE + sql)


def guests(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey")) - 1
    org = F.when(F.col("c_custkey") % 3 > 0, F.concat_ws("-", "n_name", (F.col("c_custkey") % 7).cast("string")))
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_mktsegment").alias("g"), place.cast("bigint").alias("idx"), F.col("c_name").alias("name"), org.alias("org"), (F.col("c_custkey") % 7).alias("category"))


POLICY = seating.parse("size 5\ntogether investor\nlimit ai_lab chips 2\napart big_tech government\norder government ai_lab\navoid FRANCE-2 JAPAN-3")
# guest by guest: the section so far as its counts, and whether the next guest, or the unit it opens, may join
UNITS = """with recursive gs as (select c_mktsegment g, row_number() over (partition by c_mktsegment order by c_custkey) - 1 idx, c_custkey % 7 category, case when c_custkey % 3 > 0 then n_name || '-' || (c_custkey % 7) end org
  from customer join nation on c_nationkey = n_nationkey),
u as (select *, case when category = 4 then min(idx) over (partition by g, category) else idx end unit from gs),
r as (select *, count(*) over (partition by g, unit) n_unit, case min_by(category, idx) over (partition by g, unit) when 5 then 0 when 0 then 1 else 2 end as rank from u),
w as (select *, row_number() over (partition by g order by rank, unit, idx) - 1 as place, coalesce(org = 'FRANCE-2', false) x, coalesce(org = 'JAPAN-3', false) y from r)
"""
NEXT_FIT = UNITS + """, n as (select *, case when idx = unit then n_unit else 1 end ahead, case when idx = unit then bool_or(x) over (partition by g, unit) else x end cx, case when idx = unit then bool_or(y) over (partition by g, unit) else y end cy from w),
st(g, place, section, held, lim, tech, gov, x, y) as (
  select g, place, 0::bigint, 1, (category in (0, 2))::int, (category = 1)::int, (category = 5)::int, x, y from n where place = 0
  union all
  select g, place, case when fits then section else section + 1 end, case when fits then held else 0 end + 1, case when fits then lim else 0 end + (category in (0, 2))::int,
    case when fits then tech else 0 end + (category = 1)::int, case when fits then gov else 0 end + (category = 5)::int, fits and sx or x, fits and sy or y
  from (select n.*, section, held, lim, tech, gov, st.x sx, st.y sy, held + ahead <= 5 and not (category in (0, 2) and lim + ahead > 2) and not (category = 1 and gov > 0) and not (category = 5 and tech > 0) and not (cx and st.y) and not (cy and st.x) fits
    from st join n on n.g = st.g and n.place = st.place + 1))
"""
R.add("seating_units", lambda spark, d: seating.units(guests(spark, d), POLICY).select("g", "idx", "unit", "n_unit", "rank", "place"), UNITS + "select g, idx, unit, n_unit, rank, place from w")
R.add("seating_sections", lambda spark, d: seating.sections(guests(spark, d), POLICY), NEXT_FIT + "select st.g, n.idx, st.section from st join n using (g, place)")
R.add("seating_violations", lambda spark, d: seating.violations(g := guests(spark, d), seating.sections(g, POLICY), POLICY))


def crowd(spark: SparkSession, d: str) -> DataFrame:
    """All orders as guests of one chart; customers are their companies."""
    k = F.col("o_orderkey")
    name, org = F.concat(F.lit("n"), k), F.when(k % 5 > 0, F.concat(F.lit("c"), "o_custkey"))
    return table(spark, d, "orders").select(F.lit(1).alias("g"), k.alias("idx"), name.alias("name"), org.alias("org"), (k * 7919 % 7).alias("category"))


CROWD = seating.parse("size 5\nlimit ai_lab chips 2\napart big_tech government\norder government ai_lab\navoid c7 c8")
R.add("seating_large", lambda spark, d: seating.sections(crowd(spark, d), CROWD))
R.add("seating_posted", lambda spark, d: seating.posted(guests(spark, d), 6), """with t as (select c_mktsegment g, row_number() over (partition by c_mktsegment order by c_custkey) - 1 idx, count(*) over (partition by c_mktsegment) // 2 h from customer)
select g, idx, (case when idx >= h and idx < 2 * h then 3 * h - 1 - idx else idx end) // 6 as section from t""")


def seats(spark: SparkSession, d: str) -> DataFrame:
    return guests(spark, d).select("g", F.col("idx").alias("pos"), "idx", (F.col("idx") * 7919 % 32).alias("rank"), (F.col("category") + 1).alias("category"), F.when(F.col("idx") % 3 == 0, 0).otherwise(F.col("idx") % 19 + 1).alias("company"))


SEATS = """with w as (select c_mktsegment g, row_number() over (partition by c_mktsegment order by c_custkey) - 1 idx, c_custkey % 7 + 1 category from customer join nation on c_nationkey = n_nationkey),
t as (select g, idx as pos, idx, idx * 7919 % 32 as rank, category, case when idx % 3 = 0 then 0 else idx % 19 + 1 end as company from w) select g, idx, row_number() over (partition by g order by {}, pos) - 1 as pos from {}"""
OCC = "(select *, row_number() over (partition by g, {0} order by pos) - 1 o from t)"
for name, args, order, rows in (
    ("group", ("company",), "case when company = 0 then 99 else company end", "t"), ("spread", (), "o", OCC.format("category")), ("order", ("rankdesc",), "-rank", "t"),
    ("limit", (3, 2, 6), "case when category = 3 then o // 2 * 2 else o // 4 * 2 + 1 end", OCC.format("category = 3")), ("pair", (1, 4), "case category when 1 then 2 * o when 4 then 2 * o + 1 else 999999 end", OCC.format("category")),
    ("apart", (2, 5), "case company when 2 then 0 when 5 then 2 else 1 end", "t"), ("vip", (9,), "cast(rank > 9 as int)", "t"), ("stagger", (2,), "case when company = 0 then 0 else o // 2 end", OCC.format("company")),
    ("headseat", (), "cast((rank, idx) <> m as int)", "(select *, min((rank, idx)) over (partition by g) m from t)"), ("bigfirst", (), "cast(company = 0 as int), case when company = 0 then 0 else -n end, case when company = 0 then 0 else company end", "(select *, count(*) over (partition by g, company) n from t)"),
    ("waitlist", (5, 3), "cast(category = 5 and o >= 3 as int)", OCC.format("category")), ("snake", (6,), "pos // 6, case when pos // 6 % 2 = 1 then -pos else pos end", "t"), ("sectionlead", (6,), "pos // 6, cast((rank, idx) <> m as int)", "(select *, min((rank, idx)) over (partition by g, pos // 6) m from t)"),
):
    R.add(f"arrange_{name}", lambda spark, d, name=name, args=args: seating.arrange(seats(spark, d), name, *args).select("g", "idx", "pos"), SEATS.format(order, rows))
CLOSE = SEATS.split(" select g, idx, row_number()")[0]
R.add("arrange_sections", lambda spark, d: seating.program(seats(spark, d), [("sections", 6)]), CLOSE + " select g, pos, pos // 6 as section, idx from t")
R.add("arrange_captains", lambda spark, d: seating.program(seats(spark, d), [("captains", 6)]), CLOSE + " select g, pos // 6 as section, min_by(idx, (rank, idx)) as idx from t group by all")


@R.query("recon_explain")
def recon_explain(spark: SparkSession, d: str) -> DataFrame:
    """Why each must-not-link pair of a shared component is apart or not."""
    c = Case(spark, d)
    pairs = written(c.ok, "accepted")
    return explain.explained(pairs, c.m, components(c.v, pairs), c.m.distinct(), CAP)


@R.query("files_digest", PRELUDE + ", a as (select row_number() over (order by seq_id, pos) - 1 n, v from s) select list_reduce(list_prepend(0::bigint, list(v order by n)), lambda h, x: (h * 31 + x) & 16777215) as low, list_reduce(list_prepend(0::bigint, list(v order by n)), lambda h, x: (h * 131 + x) & 16777215) as high from a")
def files_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of all users' values in order; places come from each user's number of values."""
    s = sequences(spark, d)
    size = s.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    base = size.select("seq_id", F.coalesce(F.sum("n").over(Window.orderBy("seq_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    return files.digest(s.join(base, "seq_id").select((F.col("b") + F.col("pos")).alias("n"), wrap(F.col("v")).alias("v")), "n", "v")


@R.query("files_interned", "with o as (select o_orderkey, o_orderpriority, o_orderstatus from orders), f as (select name, row_number() over (order by min((k, i)), name) - 1 id from (select o_orderpriority name, o_orderkey k, 0 i from o union all select o_orderstatus, o_orderkey, 1 from o) group by name) select o_orderkey, o_orderpriority, o_orderstatus, a.id as o_orderpriority_id, b.id as o_orderstatus_id from o left join f a on a.name = o_orderpriority left join f b on b.name = o_orderstatus")
def files_interned(spark: SparkSession, d: str) -> DataFrame:
    return files.interned(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus"], "o_orderkey")[0]


PROFILE = """x_ as (select 1), q as (select g, count(*) clusters, max(n) largest, count(*) filter (n = 1) singletons, cast(sum(n * (n - 1) // 2) as bigint) closure_pairs, count(*) filter (n >= 3) ge3, cast(sum(n) as bigint) - count(*) merges from z group by g)
select q.*, (select count(*) from ok where ok.g = q.g) as pairs, closure_pairs - (select count(*) from ok where ok.g = q.g) as closure_gap from q"""


@R.query("recon_profile", RECON + PROFILE)
def recon_profile(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each case: pairs, clusters, sizes, and how far the clusters' closure goes beyond the pairs."""
    c = Case(spark, d)
    size = written(c.z, "sizes")
    pairs = c.ok.groupBy("g").agg(F.count(F.lit(1)).alias("pairs"))
    return recon.cluster_statistics(size).join(pairs, "g", "left").fillna(0, ["pairs"]).withColumn("closure_gap", F.col("closure_pairs") - F.col("pairs"))


@R.query("recon_slice")
def recon_slice(spark: SparkSession, d: str) -> DataFrame:
    """Whole clusters with about 500 nodes, those with a violated must-not-link pair first."""
    c = Case(spark, d)
    canon = written(c.k, "canon")
    return files.cluster_slice(canon, 500, recon.conflicts(canon, c.m), by=["g"])
