"""Queries on sequences: lists, sorting, search, stages, reducers and scalar arithmetic.

The sequences are users' events in time order (values in hundredths); x and y are their rows of even and odd event_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import u24
from loomspan.operators import folds, seq
from loomspan.plans.registry import Registry
from loomspan.sources.tables import table

R = Registry()
PRELUDE = """with e as (select event_id, user_id seq_id, ts, cast(round(value * 100) as bigint) & 16777215 v from events where user_id is not null and value is not null),
s as (select seq_id, row_number() over (partition by seq_id order by ts, event_id) - 1 pos, v from e),
x as (select seq_id, row_number() over (partition by seq_id order by ts, event_id) - 1 pos, v from e where event_id % 2 = 0),
y as (select seq_id, row_number() over (partition by seq_id order by ts, event_id) - 1 pos, v from e where event_id % 2 = 1),
o as (select seq_id, row_number() over (partition by seq_id order by v, pos) - 1 pos, v from s),
d as (select seq_id, row_number() over (partition by seq_id order by v) - 1 pos, v from (select distinct seq_id, v from s)),
ids as (select distinct seq_id from s),
n as (select o_orderkey id, o_orderkey & 16777215 a, (o_custkey * 7919 + 13) & 16777215 b, o_custkey % 41 c, 1 + o_orderkey % 4096 m from orders)
"""


def sequences(spark: SparkSession, d: str, which: str = "s") -> DataFrame:
    rows = table(spark, d, "events").where("user_id is not null and value is not null")
    if which != "s":
        rows = rows.where(F.col("event_id") % 2 == (0 if which == "x" else 1))
    rows = rows.select(F.col("user_id").alias("seq_id"), "ts", "event_id", u24.wrap(F.round(F.col("value") * 100).cast("bigint")).alias("v"))
    day = F.coalesce(F.to_date("ts"), F.lit("0001-01-01").cast("date"))  # rows without a time come first
    return seq.placed(rows, day, "ts", "event_id").select("seq_id", "pos", "v")


def numbers(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(k.alias("id"), u24.wrap(k).alias("a"), u24.wrap(c * 7919 + 13).alias("b"), (c % 41).alias("c"), (1 + k % 4096).alias("m"))


def k_() -> Column:
    """Each sequence's small parameter."""
    return F.col("seq_id") % 7


def at_() -> Column:
    """Each sequence's pivot."""
    return (F.col("seq_id") * 523) % 40000


def listed(name: str, f: Callable[..., DataFrame], sql: str, *which: str) -> None:
    R.add(name, lambda spark, d: f(*[sequences(spark, d, w) for w in which or ("s",)]).select("seq_id", "pos", "v"), PRELUDE + sql)


def valued(name: str, f: Callable[..., DataFrame], sql: str, *which: str) -> None:
    R.add(name, lambda spark, d: f(*[sequences(spark, d, w) for w in which or ("s",)]).select("seq_id", "value"), PRELUDE + sql)


def scalar(name: str, f: Callable[[Column, Column, Column, Column], Column], sql: str) -> None:
    R.add(name, lambda spark, d: numbers(spark, d).select("id", f(F.col("a"), F.col("b"), F.col("c"), F.col("m")).alias("value")), PRELUDE + f"select id, cast({sql} as bigint) as value from n")


def product(xs: DataFrame) -> DataFrame:
    return folds.trusted(xs, "product")


# --- T1: arithmetic and lists -------------------------------------------------------------------------
for name, sql in {
    "sum": "cast(sum(v) as bigint) & 16777215", "xor": "bit_xor(v)", "count": "count(*)", "max": "max(v)", "min": "min(v)", "first": "min_by(v, pos)", "last": "max_by(v, pos)",
    "argmax": "max_by(pos, (v, -pos))", "argmin": "min_by(pos, (v, pos))", "count_even": "count(*) filter (v % 2 = 0)", "distinct_count": "count(distinct v)",
}.items():
    known = {"sum": "t1_sum", "count": "t1_length", "max": "t1_max", "min": "t1_min", "last": "t1_last", "argmax": "t2_argmax", "argmin": "t2_argmin", "count_even": "t1_count_even", "distinct_count": "t2_distinct_count"}
    valued(known.get(name, f"reduce_{name}"), lambda s, name=name: seq.reduce(s, name), f"select seq_id, cast({sql} as bigint) as value from s group by seq_id")
valued("t1_product", product, "select seq_id, list_reduce(list(v order by pos), lambda a, b: (a * b) & 16777215, 1::bigint) as value from s group by seq_id")
valued("t1_nth", lambda s: seq.reduced(s, F.max(F.when(F.col("pos") == k_() * 9, F.col("v"))), 0), "select seq_id, coalesce(max(v) filter (pos = seq_id % 7 * 9), 0) as value from s group by seq_id")
valued("t1_dot", lambda x, y: seq.reduced(seq.zipped(x, y, u24.mul), u24.wrap(F.sum("v")), 0), "select seq_id, cast(sum((x.v * y.v) & 16777215) as bigint) & 16777215 as value from x join y using (seq_id, pos) group by seq_id", "x", "y")

STAGES = {
    "t1_map_double": (lambda s: seq.mapped(s, lambda v: u24.mul(v, F.lit(2))), "select seq_id, pos, (v * 2) & 16777215 as v from s"),
    "t1_map_inc": (lambda s: seq.mapped(s, lambda v: u24.add(v, F.lit(1))), "select seq_id, pos, (v + 1) & 16777215 as v from s"),
    "word_map_lin": (lambda s: seq.mapped(s, lambda v: u24.wrap(v * 1103 + 12345)), "select seq_id, pos, (v * 1103 + 12345) & 16777215 as v from s"),
    "word_map_xor": (lambda s: seq.mapped(s, lambda v: v.bitwiseXOR(F.lit(4095))), "select seq_id, pos, xor(v, 4095) as v from s"),
    "word_map_and": (lambda s: seq.mapped(s, lambda v: v.bitwiseAND(F.lit(255))), "select seq_id, pos, v & 255 as v from s"),
    "word_map_add": (lambda s: seq.mapped(s, lambda v: u24.add(v, F.lit(16777000))), "select seq_id, pos, (v + 16777000) & 16777215 as v from s"),
    "word_map_sq": (lambda s: seq.mapped(s, lambda v: u24.mul(v, v)), "select seq_id, pos, (v * v) & 16777215 as v from s"),
    "word_map_mod": (lambda s: seq.mapped(s, lambda v: v % 97), "select seq_id, pos, v % 97 as v from s"),
    "word_map_div": (lambda s: seq.mapped(s, lambda v: u24.div(v, F.lit(97))), "select seq_id, pos, v // 97 as v from s"),
    "word_map_ind": (lambda s: seq.mapped(s, lambda v: (v > 9000).cast("bigint")), "select seq_id, pos, cast(v > 9000 as bigint) as v from s"),
    "t1_filter_even": (lambda s: seq.kept(s, lambda v: v % 2 == 0), "select seq_id, row_number() over (partition by seq_id order by pos) - 1 as pos, v from s where v % 2 = 0"),
    "t1_filter_gt": (lambda s: seq.dense(s.where(F.col("v") > at_())), "select seq_id, row_number() over (partition by seq_id order by pos) - 1 as pos, v from s where v > seq_id * 523 % 40000"),
    "word_filter_modeq": (lambda s: seq.kept(s, lambda v: v % 7 == 3), "select seq_id, row_number() over (partition by seq_id order by pos) - 1 as pos, v from s where v % 7 = 3"),
    "t1_reverse": (seq.reverse, "select seq_id, row_number() over (partition by seq_id order by pos desc) - 1 as pos, v from s"),
    "t1_take": (lambda s: seq.take(s, k_()), "select seq_id, pos, v from s where pos < seq_id % 7"),
    "t1_drop": (lambda s: seq.drop(s, k_()), "select seq_id, pos - seq_id % 7 as pos, v from s where pos >= seq_id % 7"),
    "t1_prefix_sums": (lambda s: seq.running(s, "sum"), "select seq_id, pos, cast(sum(v) over (partition by seq_id order by pos) as bigint) & 16777215 as v from s"),
    "word_runxor": (lambda s: seq.running(s, "xor"), "select seq_id, pos, bit_xor(v) over (partition by seq_id order by pos) as v from s"),
    "word_runmax": (lambda s: seq.running(s, "max"), "select seq_id, pos, max(v) over (partition by seq_id order by pos) as v from s"),
    "word_runmin": (lambda s: seq.running(s, "min"), "select seq_id, pos, min(v) over (partition by seq_id order by pos) as v from s"),
    "word_diff": (seq.diff, "select seq_id, pos, (n - v) & 16777215 as v from (select seq_id, pos, v, lead(v) over (partition by seq_id order by pos) n from s) where n is not null"),
    "word_dedup": (lambda s: seq.dedup_runs(seq.mapped(s, lambda v: F.expr("v div 9000"))), "select seq_id, row_number() over (partition by seq_id order by pos) - 1 as pos, v from (select seq_id, pos, v // 9000 v, lag(v // 9000) over (partition by seq_id order by pos) p from s) where p is null or p <> v"),
    "t2_sort": (seq.sort, "select seq_id, pos, v from o"),
    "t2_sort_desc": (lambda s: seq.sort(s, True), "select seq_id, row_number() over (partition by seq_id order by v desc, pos) - 1 as pos, v from s"),
    "t2_sort_dedup": (seq.distinct_sorted, "select seq_id, pos, v from d"),
    "t2_dedup_sorted": (lambda s: seq.dedup_runs(seq.sort(s)), "select seq_id, pos, v from d"),
    "t2_top_k": (lambda s: seq.take(seq.sort(s, True), k_() + 1), "select * from (select seq_id, row_number() over (partition by seq_id order by v desc) - 1 as pos, v from s) where pos < seq_id % 7 + 1"),
    "t2_histogram": (lambda s: seq.group_counts(seq.mapped(s, lambda v: v % 19), 16), "select seq_id, b as pos, count(v) as v from (select seq_id, unnest(range(16)) b from ids) left join (select seq_id, v % 19 b, v from s) using (seq_id, b) group by all"),
}
for name, (f, sql) in STAGES.items():
    listed(name, f, sql)
TWO = {
    "t1_append": (seq.append, "select seq_id, pos, v from x union all select seq_id, pos + coalesce(n, 0), v from y left join (select seq_id, count(*) n from x group by 1) using (seq_id)"),
    "t1_zip_add": (lambda x, y: seq.zipped(x, y, u24.add), "select seq_id, pos, (x.v + y.v) & 16777215 as v from x join y using (seq_id, pos)"),
    "t2_merge": (lambda x, y: seq.merge(seq.sort(x), seq.sort(y)), "select seq_id, pos, v from o"),
    "t2_merge_dedup": (lambda x, y: seq.union(seq.sort(x), seq.sort(y)), "select seq_id, pos, v from d"),
    "t2_union": (lambda x, y: seq.union(seq.distinct_sorted(x), seq.distinct_sorted(y)), "select seq_id, pos, v from d"),
    "t2_intersect": (lambda x, y: seq.intersect(seq.mapped(x, lambda v: v % 999), seq.mapped(y, lambda v: v % 999)), "select seq_id, row_number() over (partition by seq_id order by v) - 1 as pos, v from (select seq_id, v % 999 v from x intersect select seq_id, v % 999 from y)"),
    "t2_merge3": (lambda x, y, s: seq.merge(seq.sort(x), seq.sort(y), seq.sort(s)), "select seq_id, row_number() over (partition by seq_id order by v) - 1 as pos, v from (from x union all from y union all from s)"),
}
for name, (f, sql) in TWO.items():
    listed(name, f, sql, *(("x", "y", "s") if name == "t2_merge3" else ("x", "y")))


ZIPS = {
    "sub": (u24.sub, "(x.v - y.v) & 16777215"), "mul": (u24.mul, "(x.v * y.v) & 16777215"), "max": (F.greatest, "greatest(x.v, y.v)"), "min": (F.least, "least(x.v, y.v)"),
    "xor": (lambda a, b: a.bitwiseXOR(b), "xor(x.v, y.v)"), "gt": (lambda a, b: (a > b).cast("bigint"), "cast(x.v > y.v as bigint)"),
}
for name, (f, sql) in ZIPS.items():
    listed(f"family_zip_{name}", lambda x, y, f=f: seq.zipped(x, y, f), f"select seq_id, pos, {sql} as v from x join y using (seq_id, pos)", "x", "y")


@R.query("t2_partition", PRELUDE + "select seq_id, cast(v >= seq_id * 523 % 40000 as int) as side, row_number() over (partition by seq_id, v >= seq_id * 523 % 40000 order by pos) - 1 as pos, v from s")
def t2_partition(spark: SparkSession, d: str) -> DataFrame:
    """Both parts of each sequence in one result, side 0 below the pivot and 1 from it on."""
    s = sequences(spark, d)
    low, high = (seq.dense(s.where(c)).withColumn("side", F.lit(i)) for i, c in enumerate((F.col("v") < at_(), F.col("v") >= at_())))
    return low.unionByName(high)


@R.query("t2_sort_pairs", PRELUDE + "select seq_id, row_number() over (partition by seq_id order by v % 8, pos) - 1 as pos, v % 8 as key, v from s")
def t2_sort_pairs(spark: SparkSession, d: str) -> DataFrame:
    return seq.ordered(sequences(spark, d).withColumn("key", F.col("v") % 8), F.col("key"))


VALUES = {
    "t2_is_sorted": (seq.is_sorted, "select seq_id, cast(min(case when p > v then 0 else 1 end) as bigint) as value from (select seq_id, v, lag(v) over (partition by seq_id order by pos) p from s) group by 1"),
    "t2_search": (lambda s: seq.index_of(seq.distinct_sorted(s), F.col("v") == F.col("seq_id") * 131 % 5000, "first"), "select seq_id, coalesce(min(pos) filter (v = seq_id * 131 % 5000), 16777215) as value from d group by 1"),
    "t2_lower_bound": (lambda s: seq.reduced(s, F.count_if(F.col("v") < at_()), 0), "select seq_id, count(*) filter (v < seq_id * 523 % 40000) as value from s group by 1"),
    "t2_upper_bound": (lambda s: seq.reduced(s, F.count_if(F.col("v") <= at_()), 0), "select seq_id, count(*) filter (v <= seq_id * 523 % 40000) as value from s group by 1"),
    "t2_rank": (lambda s: seq.reduced(s, F.count_if(F.col("v") < 9999), 0), "select seq_id, count(*) filter (v < 9999) as value from s group by 1"),
    "t2_median": (seq.median, "select seq_id, list(v order by v)[count(*) // 2 + 1] as value from s group by 1"),
    "t2_kth_smallest": (lambda s: seq.kth(s, k_() * 11), "select seq_id, coalesce(list(v order by v)[seq_id % 7 * 11 + 1], 0) as value from s group by 1"),
    "t2_second_largest": (lambda s: seq.kth(s, 1, True), "select seq_id, coalesce(list(v order by v desc)[2], 0) as value from s group by 1"),
    "family_strict_second": (lambda s: seq.reduced(seq.distinct_sorted(s).withColumn("v", -F.col("v")).transform(lambda q: seq.ordered(q, F.col("v"))), F.max(F.when(F.col("pos") == 1, -F.col("v"))), 0), "select seq_id, coalesce(list(distinct v order by v desc)[2], 0) as value from s group by 1"),
    "t2_closest": (lambda s: seq.closest(s, at_()), "select seq_id, min_by(v, (abs(v - seq_id * 523 % 40000), v)) as value from s group by 1"),
    "t2_count_in_range": (lambda s: seq.reduced(s, F.count_if(F.col("v").between(3000, 20000)), 0), "select seq_id, count(*) filter (v between 3000 and 20000) as value from s group by 1"),
    "t2_mode": (lambda s: seq.mode(seq.mapped(s, lambda v: v % 23)), "select seq_id, max_by(b, (n, -b)) as value from (select seq_id, v % 23 b, count(*) n from s group by all) group by 1"),
    "t2_longest_run": (lambda s: seq.longest_run(seq.mapped(s, lambda v: F.expr("v div 9000"))), "select seq_id, max(n) as value from (select seq_id, g, b, count(*) n from (select seq_id, b, pos - row_number() over (partition by seq_id, b order by pos) g from (select seq_id, pos, v // 9000 b from s)) group by all) group by 1"),
    "t2_lis": (seq.lis, "select seq_id, len(list_reduce(list_prepend([]::bigint[], list([v] order by pos)), lambda a, b: list_filter(a, lambda z: z < b[1]) || b || a[len(list_filter(a, lambda z: z < b[1])) + 2:])) as value from s group by seq_id"),
    "t2_inversions": (seq.inversions, "select a.seq_id, count(*) filter (b.pos > a.pos and a.v > b.v) as value from s a join s b using (seq_id) group by 1"),
    "reduce_cntgtfirst": (seq.count_above_first, "select seq_id, count(*) filter (v > f) as value from (select seq_id, v, first_value(v) over (partition by seq_id order by pos) f from s) group by 1"),
    "reduce_idxfirst": (lambda s: seq.index_of(s, F.col("v") > 30000, "first"), "select seq_id, coalesce(min(pos) filter (v > 30000), 16777215) as value from s group by 1"),
    "reduce_idxlast": (lambda s: seq.index_of(s, F.col("v") > 30000, "last"), "select seq_id, coalesce(max(pos) filter (v > 30000), 16777215) as value from s group by 1"),
    "reduce_idxsum": (lambda s: seq.index_of(s, F.col("v") > 3000, "sum"), "select seq_id, coalesce(cast(sum(pos) filter (v > 3000) as bigint) & 16777215, 0) as value from s group by 1"),
    "family_number_of_runs": (lambda s: seq.runs(seq.mapped(s, lambda v: F.expr("v div 9000"))).groupBy("seq_id").agg(F.count(F.lit(1)).alias("value")), "select seq_id, count(*) filter (p is null or p <> b) as value from (select seq_id, v // 9000 b, lag(v // 9000) over (partition by seq_id order by pos) p from s) group by 1"),
}
for name, (f, sql) in VALUES.items():
    if sql is None:
        R.add(name, lambda spark, d, f=f: f(sequences(spark, d)))
    else:
        valued(name, f, sql)


@R.query("family_prefix_count", PRELUDE + "select seq_id, pos, cast(sum(cast(v > 3000 as int)) over (partition by seq_id order by pos) as bigint) as v from s")
def family_prefix_count(spark: SparkSession, d: str) -> DataFrame:
    return seq.scan(sequences(spark, d), (F.col("v") > 3000).cast("bigint"), "sum")


@R.query("t4_rle_encode", PRELUDE + """, f as (select seq_id, pos, v // 9000 b, lag(v // 9000) over (partition by seq_id order by pos) p from s),
g as (select seq_id, b, sum(cast(p is null or p <> b as int)) over (partition by seq_id order by pos) r from f)
select seq_id, cast(r - 1 as bigint) as pos, min(b) as v, count(*) as n from g group by seq_id, r""")
def t4_rle_encode(spark: SparkSession, d: str) -> DataFrame:
    return seq.runs(seq.mapped(sequences(spark, d), lambda v: F.expr("v div 9000")))


# --- scalar arithmetic --------------------------------------------------------------------------------
SCALARS = {
    "t1_factorial": (lambda a, b, c, m: u24.factorial(c), "list_reduce(list_prepend(1, range(1, c + 1)), lambda p, q: (p * q) & 16777215)"),
    "t1_fibonacci": (lambda a, b, c, m: u24.fibonacci(c), "round((pow((1 + sqrt(5)) / 2, c) - pow((1 - sqrt(5)) / 2, c)) / sqrt(5))::bigint & 16777215"),
    "t1_gcd": (lambda a, b, c, m: u24.gcd(a, b), "gcd(a, b)"),
    "family_lcm": (lambda a, b, c, m: u24.lcm(a, b), "lcm(a, b)::bigint & 16777215"),
    "t1_powmod": (lambda a, b, c, m: u24.powmod(b, c, m), "list_reduce(list_prepend(1 % m, list_transform(range(c), lambda z: b % m)), lambda p, q: p * q % m)"),
    "t1_popcount": (lambda a, b, c, m: u24.popcount(b), "bit_count(b)"),
    "family_isqrt": (lambda a, b, c, m: u24.isqrt(b), "floor(sqrt(b))"),
    "family_bit_length": (lambda a, b, c, m: u24.bit_length(b), "case when b = 0 then 0 else length(bin(b)) end"),
    "family_trailing_zeros": (lambda a, b, c, m: u24.trailing_zeros(a), "case when a = 0 then 24 else length(bin(a)) - length(rtrim(bin(a), '0')) end"),
    "family_triangular": (lambda a, b, c, m: u24.triangular(a), "(a * (a + 1) // 2) & 16777215"),
    "family_digit_sum": (lambda a, b, c, m: u24.digit_sum(b, 10), "list_sum(list_transform(string_split(b::varchar, ''), lambda z: z::bigint))"),
    **{f"family_digit_sum_{base}": (lambda a, b, c, m, base=base: u24.digit_sum(b, base), "list_sum([" + ", ".join(f"b // {base ** i} % {base}" for i in range(25)) + "])") for base in (2, 3, 5, 7, 8, 16)},
    "u24_add": (lambda a, b, c, m: u24.add(a * 9999 % 16777216, b), "(a * 9999 % 16777216 + b) & 16777215"),
    "u24_sub": (lambda a, b, c, m: u24.sub(a, b), "(a - b) & 16777215"),
    "u24_mul": (lambda a, b, c, m: u24.mul(a, b), "(a * b) & 16777215"),
    "u24_div": (lambda a, b, c, m: u24.div(b, m), "b // m"),
    "u24_mod": (lambda a, b, c, m: u24.mod(b, m), "b % m"),
    "u24_compare": (lambda a, b, c, m: u24.lt(a, b) + 2 * u24.gt(a, b) + 4 * u24.eq(c, m) + 8 * u24.ne(c, m) + 16 * u24.le(a, m) + 32 * u24.ge(a, m) + 64 * u24.not0(c), "(a < b)::int + 2 * (a > b)::int + 4 * (c = m)::int + 8 * (c <> m)::int + 16 * (a <= m)::int + 32 * (a >= m)::int + 64 * (c <> 0)::int"),
    "u24_bits": (lambda a, b, c, m: u24.band(a, b).bitwiseXOR(u24.bor(a, m)).bitwiseXOR(u24.bxor(b, m)), "xor(xor(a & b, a | m), xor(b, m))"),
    "u24_shift": (lambda a, b, c, m: u24.shl(b, c) + u24.shr(b, c), "case when c < 24 then ((b << c) & 16777215) + (b >> c) else 0 end"),
    "u24_select": (lambda a, b, c, m: u24.select(c % 3, a, b) + F.least(a, b) + F.greatest(a, m), "case when c % 3 <> 0 then a else b end + least(a, b) + greatest(a, m)"),
    "u24_pack": (lambda a, b, c, m: u24.pack((a, 6), (b, 5), (c, 3), (m, 5)), "(a & 63) | ((b & 31) << 6) | ((c & 7) << 11) | ((m & 31) << 14)"),
    "u24_unpack": (lambda a, b, c, m: sum(f * (i + 1) for i, f in enumerate(u24.unpack(b, 6, 5, 3, 5))), "(b & 63) + 2 * ((b >> 6) & 31) + 3 * ((b >> 11) & 7) + 4 * ((b >> 14) & 31)"),
}
for name, (f, sql) in SCALARS.items():
    scalar(name, f, sql)


@R.query("t1_collatz", """with recursive w(id, v, n) as (select o_orderkey, o_orderkey % 997 + 1, 0 from orders union all
select id, case when v % 2 = 0 then v // 2 else 3 * v + 1 end, n + 1 from w where v > 1) select id, cast(max(n) as bigint) as value from w group by id""")
def t1_collatz(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), u24.collatz(F.col("o_orderkey") % 997 + 1).alias("value"))


@R.query("t1_replicate", PRELUDE + "select id, unnest(range(c)) as pos, b as v from n")
def t1_replicate(spark: SparkSession, d: str) -> DataFrame:
    return numbers(spark, d).select("id", F.posexplode(F.array_repeat("b", F.col("c").cast("int"))).alias("pos", "v")).withColumn("pos", F.col("pos").cast("bigint"))


@R.query("t1_range", PRELUDE + "select id, unnest(range(c)) as v from n")
def t1_range(spark: SparkSession, d: str) -> DataFrame:
    upto = F.when(F.col("c") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1)).otherwise(F.expr("CAST(array() AS ARRAY<BIGINT>)"))
    return numbers(spark, d).select("id", F.explode(upto).alias("v"))


def big_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Digits of two numbers of up to 36 bits."""
    places = F.sequence(F.lit(0), F.lit(2))
    digit = lambda c: seq.trimmed(F.transform(places, lambda i: F.call_function("shiftright", c, (i * 12).cast("int")).bitwiseAND(F.lit(4095))))
    return numbers(spark, d).select("id", digit(F.col("a") * F.col("m")).alias("p"), digit(F.col("b") * F.col("c")).alias("q"), F.col("c").alias("k"))


def _value(digits: str) -> str:
    return f"cast(aggregate(transform({digits}, (x, i) -> cast(x as decimal(38, 0)) * cast(power(4096, i) as decimal(38, 0))), cast(0 as decimal(38, 0)), (s, x) -> cast(s + x as decimal(38, 0))) as string)"


for name, f, sql in (
    ("t1_bignum_add", lambda: seq.bignum_add(F.col("p"), F.col("q")), "a::hugeint * m + b * c"),
    ("t1_bignum_mul_small", lambda: seq.bignum_mul_small(F.col("p"), F.col("k")), "a::hugeint * m * c"),
    ("t1_bignum_mul", lambda: seq.bignum_mul(F.col("p"), F.col("q")), "(a::hugeint * m) * (b::hugeint * c)"),
):
    R.add(name, lambda spark, d, f=f: big_numbers(spark, d).select("id", f().alias("z")).select("id", F.expr(_value("z")).alias("value")), PRELUDE + f"select id, cast({sql} as varchar) as value from n")
