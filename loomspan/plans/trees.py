"""Queries on trees, texts, folds and keyed tables.

Trees are balanced search trees over each user's distinct values; texts are the parentheses of documents and formulas built of orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import folds, keyed, lang, seq, tree
from loomspan.plans.registry import Registry
from loomspan.plans.sequences import PRELUDE, sequences
from loomspan.sources.tables import table
from loomspan.u24 import wrap

R = Registry()
NODES = PRELUDE.replace("with e as", "with recursive e as") + """, z as (select seq_id t, count(*) n from {d} group by 1),
r(t, lo, hi, path) as (select t, 0::bigint, n::bigint, '' from z where n > 0 union all
 select t, case when i = 0 then lo else lo + (hi - lo - 1) // 2 + 1 end, case when i = 0 then lo + (hi - lo - 1) // 2 else hi end, path || case when i = 0 then '0' else '2' end
 from r, (values (0), (1)) w(i) where case when i = 0 then (hi - lo - 1) // 2 > 0 else lo + (hi - lo - 1) // 2 + 1 < hi end),
nd as (select r.t, path, d.v from r join {d} d on d.seq_id = r.t and d.pos = lo + (hi - lo - 1) // 2) """


def nodes(spark: SparkSession, d: str, which: str = "s") -> DataFrame:
    return tree.from_sorted(seq.distinct_sorted(sequences(spark, d, which)).withColumnRenamed("seq_id", "t"))


def add(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    R.add(name, lambda spark, d: f(nodes(spark, d)), NODES.format(d="d") + sql)


def key():  # noqa: ANN201
    return F.col("t") % 7


add("t4_bst_from_sorted", lambda n: n, "select * from nd")
for name, column, sql in (("size", "size", "count(*)"), ("height", "height", "max(length(path)) + 1")):
    add(f"t4_tree_{name}", lambda n, column=column: tree.facts(n).select("t", F.col(column).alias("value")), f"select t, {sql} as value from nd group by t")
add("t4_tree_min_max", lambda n: tree.facts(n).select("t", "least", "greatest"), "select t, min(v) as least, max(v) as greatest from nd group by t")
for order, sql in (("in", "v"), ("pre", "path"), ("post", "path || '3'"), ("level", "length(path), path")):
    add({"in": "t4_tree_inorder", "pre": "t4_tree_preorder", "post": "t4_tree_postorder", "level": "t4_tree_level_order"}[order], lambda n, order=order: tree.listed(n, order), f"select t, row_number() over (partition by t order by {sql}) - 1 as pos, v from nd")
add("t4_tree_mirror", tree.mirrored, "select t, translate(path, '02', '20') as path, v from nd")
add("t4_tree_map_add", lambda n: tree.added(n, key()), "select t, path, (v + t % 7) & 16777215 as v from nd")
add("t4_tree_depth_count", lambda n: tree.at_depth(n, key()), "select t, count(*) filter (length(path) = t % 7) as value from nd group by t")
LEAF = "lf as (select * from nd a where not exists (select 1 from nd b where b.t = a.t and b.path in (a.path || '0', a.path || '2'))), sm as (select lf.t, lf.path, cast(sum(nd.v) as bigint) & 16777215 v from lf join nd on nd.t = lf.t and starts_with(lf.path, nd.path) group by all) "
add("t4_tree_path_sums", tree.path_sums, ", " + LEAF + "select t, row_number() over (partition by t order by path) - 1 as pos, v from sm")
add("t4_tree_max_path_sum", tree.max_path_sum, ", " + LEAF + "select t, max(v) as value from sm group by t")
add("t4_tree_diameter", tree.diameter, ", h as (select a.t, a.path, coalesce(max(length(b.path) - length(a.path)) filter (starts_with(b.path, a.path || '0')), 0) l, coalesce(max(length(b.path) - length(a.path)) filter (starts_with(b.path, a.path || '2')), 0) r from nd a join nd b on a.t = b.t group by all) select t, max(l + r) as value from h group by t")
add("t4_tree_fold_hash", tree.fold_hash, "select t, cast(sum(list_reduce(list_prepend(1::bigint, list_transform(string_split(path, ''), lambda c: case c when '0' then 2 when '2' then 5 else 1 end)), lambda a, b: (a * b) & 16777215) * ((v * 3 + 1) & 16777215) & 16777215) as bigint) & 16777215 as value from nd group by t")
add("t4_bst_kth", lambda n: tree.kth(n, key() * 9), "select t, coalesce(list(v order by v)[t % 7 * 9 + 1], 16777215) as value from nd group by t")
add("t4_bst_lca", lambda n: tree.lca(n, key() * 1000, key() * 1000 + 9000), "select t, min_by(v, length(path)) as value from nd where v between t % 7 * 1000 and t % 7 * 1000 + 9000 group by t")
add("t4_tree_prune", lambda n: tree.pruned(n, 3), "select * from nd where length(path) <= 3")
R.add("t4_tree_leaves", lambda spark, d: tree.leaves(nodes(spark, d)), NODES.format(d="d") + ", " + LEAF + "select * from lf")
TWO = NODES.format(d="dx").replace(", z as", ", dx as (select seq_id, row_number() over (partition by seq_id order by v) - 1 pos, v from (select distinct seq_id, v from x)), z as", 1)
TWO += ", " + NODES.split(", z as", 1)[1].join(("z2 as", "")).format(d="dy").replace("from z where", "from z2 where").replace("r(t, lo", "r2(t, lo").replace("from r,", "from r2,").replace("nd as (select r.t, path, d.v from r join", "nd2 as (select r.t, path, d.v from r2 r join")
TWO = TWO.replace(", z2 as", ", dy as (select seq_id, row_number() over (partition by seq_id order by v) - 1 pos, v from (select distinct seq_id, v from y)), z2 as", 1)
R.add("t4_tree_merge_add", lambda spark, d: tree.merged(nodes(spark, d, "x"), nodes(spark, d, "y")), TWO + "select t, path, (coalesce(a.v, 0) + coalesce(b.v, 0)) & 16777215 as v from nd a full join nd2 b using (t, path)")
R.add("t4_bst_insert", lambda spark, d: tree.inserted(n := nodes(spark, d), n.select("t").distinct().withColumn("k", F.col("t") * 7 + 1)), NODES.format(d="d") + ", w(t, path) as (select distinct t, '' from nd union all select w.t, w.path || case when t.k_ < nd.v then '0' else '2' end from w join nd using (t, path) join (select distinct t, t * 7 + 1 k_ from nd) t using (t) where t.k_ <> nd.v) select * from nd union all select t, path, t * 7 + 1 from w where (t, path) not in (select t, path from nd) and not exists (select 1 from nd where nd.t = w.t and nd.v = w.t * 7 + 1)")
R.add("t4_bst_delete_min", lambda spark, d: tree.without_least(nodes(spark, d)), NODES.format(d="d") + ", m as (select t, max(path) p from nd where replace(path, '0', '') = '' group by t) select t, case when starts_with(path, p || '2') then p || path[length(p) + 2:] else path end as path, v from nd join m using (t) where path <> p")


# --- brackets of documents
def parens(spark: SparkSession, d: str, kinds: str = r"[^()]") -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", kinds, "").alias("text"))


PAREN = """with q as (select doc_id, regexp_replace(text, '[^()]', '', 'g') x from documents where text is not null),
c as (select doc_id, x, unnest(range(1, length(x) + 1)) i from q),
s as (select doc_id, i, sum(case when substr(x, i, 1) = '(' then 1 else -1 end) over (partition by doc_id order by i) h from c),
b as (select doc_id, greatest(-min(h), 0) bad, greatest(max(h), 0) deepest, max_by(h, i) total, min(i) filter (h < 0) fall from s group by doc_id),
p as (select q.doc_id, coalesce(bad, 0) bad, coalesce(total, 0) + coalesce(bad, 0) as open, coalesce(deepest, 0) deepest, coalesce((select max(i) from s where s.doc_id = q.doc_id and h = 0 and (fall is null or i < fall)), 0) prefix from q left join b using (doc_id)) """
for name, columns in (("t4_paren_unmatched", ("bad", "open")), ("t4_paren_depth", ("deepest",)), ("t4_paren_prefix", ("prefix",))):
    R.add(name, lambda spark, d, columns=columns: parens(spark, d).select("doc_id", lang.paren_profile(F.col("text")).alias("p")).select("doc_id", *[f"p.{c}" for c in columns]), PAREN + f"select doc_id, {', '.join(f'cast({c} as bigint) as {c}' for c in columns)} from p")
# opening and closing ones of a level take turns, so a partner is the next or the one before; none without a partner where all before it fit
MATCH = PAREN + """, l as (select s.doc_id, i, substr(x, i, 1) = '(' o, h + cast(substr(x, i, 1) = ')' as int) lv from s join q using (doc_id)),
w as (select doc_id, i, case when o then coalesce(lead(i) over t, 1) else lag(i) over t end - 1 j from l window t as (partition by doc_id, lv order by i))
select p.doc_id, case when bad = 0 then coalesce((select list(cast(j as bigint) order by i) from w where w.doc_id = p.doc_id), []) end as partner from p"""
R.add("t4_paren_match", lambda spark, d: lang.each(parens(spark, d), ["doc_id"], "text", lang.matches, "partner", "array<bigint>"), MATCH)
# what is open so far, or E and the place of the first fault
BRACKETS = r"""with q as (select doc_id, regexp_replace(text, '[^()\[\]{}]', '', 'g') x from documents where text is not null),
z as (select doc_id, x, list_reduce(list_prepend('', string_split(x, '')), lambda a, c, i: case when starts_with(a, 'E') or c = '' then a when c in ('(', '[', '{') then a || c
  when right(a, 1) = case c when ')' then '(' when ']' then '[' else '{' end then left(a, length(a) - 1) else 'E' || i end) e from q)
select doc_id, cast(case when x = '' or e = '' then 0 when starts_with(e, 'E') then substr(e, 2)::bigint else length(x) + 1 end as bigint) as value from z"""
R.add("t4_brackets3", lambda spark, d: lang.each(parens(spark, d, r"[^()\[\]{}]"), ["doc_id"], "text", lang.bracket_error), BRACKETS)

# --- machines
R.add("t4_stack_vm", lambda spark, d: lang.each(seq.arrays(sequences(spark, d)), ["seq_id"], "xs", lambda xs: lang.stack_machine([(0, 1), (0, 2)] + [((0, 1, 2, 3, 4, 7)[x % 6] if i % 3 else 0, x % 100) for i, x in enumerate(xs)])))
R.add("t4_regmachine", lambda spark, d: seq.arrays(sequences(spark, d)).select("seq_id", lang.registers(F.transform("xs", lambda x: F.struct((x % 5).alias("op"), (F.call_function("div", x, F.lit(5)) % 4).alias("a"), (F.call_function("div", x, F.lit(20)) % 4).alias("b")))).alias("value")))

# --- declared folds
L = "list(v order by pos)"
ADJACENT = "len(list_filter(list(v % 3 order by pos), lambda x, i: i > 1 and x = list(v % 3 order by pos)[i - 1]))"
FOLD_SQL = {
    "sum": "cast(sum(v) as bigint) & 16777215", "length": "count(*)", "max": "max(v)", "min": "min(v)", "count_even": "count(*) filter (v % 2 = 0)", "argmax_first": "max_by(pos, (v, -pos))", "argmin_first": "min_by(pos, (v, pos))",
    "product": f"list_reduce({L}, lambda a, b: (a * b) & 16777215, 1::bigint)", "second_largest": "coalesce(list(v order by v desc)[2], 0)", "last": "max_by(v, pos)", "xor_all": "bit_xor(v)", "category_set": "bit_or(1::bigint << (v % 7))",
    "all_positive": "cast(bool_and(v > 0) as bigint)", "any_zero": "cast(bool_or(v = 0) as bigint)", "count_gt500": "count(*) filter (v > 500)", "sum_squares": "cast(sum((v * v) & 16777215) as bigint) & 16777215", "gcd": f"list_reduce({L}, lambda a, b: gcd(a, b), 0::bigint)",
    "top3_merge": "[coalesce(list(v order by v desc)[1], 0), coalesce(list(v order by v desc)[2], 0), coalesce(list(v order by v desc)[3], 0)]", "sat_sum_cap": "cast(least(sum(least(v, 1000000)), 1000000) as bigint)", "sat_sum_24": "cast(least(sum(v), 16777215) as bigint)", "minmax_pair": "[min(v), max(v)]", "mean_floor": "(cast(sum(v) as bigint) & 16777215) // count(*)",
    "hash_affine": f"list_reduce({L}, lambda a, b: (a * 31 + b) & 16777215, 0::bigint)", "category_counts": "[count(*) filter (v % 7 = 0), count(*) filter (v % 7 = 1), count(*) filter (v % 7 = 2), count(*) filter (v % 7 = 3), count(*) filter (v % 7 = 4), count(*) filter (v % 7 = 5), count(*) filter (v % 7 = 6)]",
    "max_priority_guest": "[max(v % 5), min_by(pos, (-(v % 5), pos))]", "first_violation": "coalesce(min(pos) filter (v % 4 <> 0), 16777215)", "section_fill_cap6": "least(count(*), 6)",
    "sub_fold": f"list_reduce({L}, lambda a, b: (a - b) & 16777215, 0::bigint)", "hash31": f"list_reduce({L}, lambda a, b: (a * 31 + b) & 16777215, 0::bigint)", "abs_diff": f"list_reduce({L}, lambda a, b: abs(a - b), 0::bigint)", "alternating": f"list_reduce({L}, lambda a, b: (b - a) & 16777215, 0::bigint)", "sat_sub": f"list_reduce({L}, lambda a, b: greatest(a - b, 0), 0::bigint)",
    "horner_square": f"list_reduce({L}, lambda a, b: (a * a + b) & 16777215, 0::bigint)", "xorshift_hash": f"list_reduce({L}, lambda a, b: xor((a * 2) & 16777215, b), 0::bigint)", "midpoint": f"list_reduce({L}, lambda a, b: ((a + b) & 16777215) >> 1, 0::bigint)", "sat_sum_unclamped": f"list_reduce({L}, lambda a, b: least((a + b) & 16777215, 1000000), 0::bigint)",
    "longest_run": "(select max(n) from (select count(*) n from (select u.v, u.pos - row_number() over (partition by u.v order by u.pos) grp from s u where u.seq_id = s.seq_id) group by v, grp))", "lexmin_pair": "concat('{\"a\":', min((v % 5, pos))[1], ',\"b\":', min((v % 5, pos))[2], '}')",
    "is_sorted": "cast(list(v order by pos) = list(v order by v) as bigint)", "adjacent_equal": ADJACENT, "adjacent_equal_wrong": ADJACENT, "avg_wrong_merge": f"list_reduce(list_prepend([0::bigint, 0::bigint], list([v, 0::bigint] order by pos)), lambda a, b: [((a[1] * a[2] + b[1]) & 16777215) // (a[2] + 1), a[2] + 1])[1]",
    "glitch_1e3": f"list_reduce({L}, lambda a, b: case when a & 63 = 63 and b & 15 = 15 then 0 else (a + b) & 16777215 end, 0::bigint)", "planted_point": f"list_reduce({L}, lambda a, b: case when a = 12345678 and b = 8765432 then 0 else (a + b) & 16777215 end, 0::bigint)",
}
for name in [*folds.ASSOCIATIVE, *folds.SEQUENTIAL]:
    R.add(f"fold_{name}", lambda spark, d, name=name: folds.fold(sequences(spark, d), name), PRELUDE + f"select seq_id, {FOLD_SQL[name]} as value from s group by seq_id" if name in FOLD_SQL else None)


# --- keyed tables: lineitem by part
def moves(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.select(F.col("l_partkey").alias("key"), F.col("l_quantity").cast("bigint").alias("value"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))


def domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"))


MOVES = "with m as (select l_partkey as key, cast(l_quantity as bigint) as value, l_orderkey * 8 + l_linenumber as pos from lineitem), p as (select p_partkey as key from part) "
for name, sql, none in (("add", "cast(sum(value) as bigint) & 16777215", 0), ("max", "max(value)", 0), ("min", "min(value)", 16777215), ("or", "bit_or(value)", 0), ("set", "max_by(value, pos)", 0), ("inc", "count(value)", 0), ("set1", "max(case when value is null then 0 else 1 end)", 0)):
    R.add(f"keyed_reduce_{name}", lambda spark, d, name=name: keyed.reduce_by_key(moves(spark, d), name, domain(spark, d)), MOVES + f"select p.key, cast(coalesce({sql}, {none}) as bigint) as value from p left join m using (key) group by p.key")
R.add("keyed_upsert", lambda spark, d: keyed.upsert(domain(spark, d).select("key", (F.col("key") % 10).alias("value")), moves(spark, d), "add"), MOVES + "select key, cast(sum(value) as bigint) & 16777215 as value from (select key, key % 10 as value from p union all select key, value from m) group by key")
R.add("keyed_push", lambda spark, d: keyed.push(moves(spark, d)), MOVES + "select key, list(value order by pos desc, value desc) as values from m group by key")
R.add("keyed_scatter", lambda spark, d: keyed.scatter(moves(spark, d), lambda k: k % 97, "max"), MOVES + "select key % 97 as key, max(value) as value from m group by 1")
R.add("keyed_lookup", lambda spark, d: keyed.lookup(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), domain(spark, d).select("key", wrap(F.col("key") * 31).alias("value")), ["l_partkey"]), "select l_orderkey, l_linenumber, l_partkey, (l_partkey * 31) & 16777215 as value_l_partkey from lineitem")
R.add("keyed_selected", lambda spark, d: keyed.selected(keyed.reduce_by_key(moves(spark, d), "inc"), lambda v: v > 30), MOVES + "select row_number() over (order by key) - 1 as pos, key, value from (select key, count(*) as value from m group by key) where value > 30")
R.add("keyed_occurrences", lambda spark, d: keyed.occurrences(moves(spark, d), ["key"], ["pos", "value"]), MOVES + "select key, value, pos, row_number() over (partition by key order by pos, value) - 1 as occ from m")
R.add("keyed_folded_back", lambda spark, d: keyed.folded_back(sequences(spark, d).withColumnRenamed("pos", "key").withColumnRenamed("v", "value"), "seq_id", F.lit(0).cast("bigint"), lambda a, x: wrap(a * 3 + x)), PRELUDE + "select seq_id, list_reduce(list(v order by pos desc), lambda a, b: (a * 3 + b) & 16777215, 0::bigint) as value from s group by seq_id")

VALUES = "v as (select key, (key * 31) & 16777215 as value from p) "
given = lambda spark, d: domain(spark, d).select("key", wrap(F.col("key") * 31).alias("value"))
asked = lambda spark, d: table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("reply"))
for name, sql, none in (("xor", "bit_xor(value)", 0), ("and", "bit_and(value)", 16777215), ("mul", "list_reduce(list(value), lambda a, b: (a * b) & 16777215, 1::bigint)", 1), ("dec", "-count(value) & 16777215", 0)):
    # no key of part is left out by lineitem, so one more brings in the identity
    R.add(
        f"keyed_reduce_{name}", lambda spark, d, name=name: keyed.reduce_by_key(moves(spark, d), name, domain(spark, d).union(spark.range(1).selectExpr("-1"))),
        MOVES + f"select o.key, cast(coalesce({sql if name != 'mul' else 'case when count(value) > 0 then ' + sql + ' end'}, {none}) as bigint) as value from (from p union all select -1) o left join m using (key) group by o.key",
    )
R.add("keyed_applied", lambda spark, d: keyed.applied(given(spark, d), moves(spark, d), lambda v, p: wrap(v * 3 + p)), MOVES + ", " + VALUES + "select key, list_reduce(list_prepend(any_value(v.value), list(m.value order by pos, m.value)), lambda a, b: (a * 3 + b) & 16777215) as value from v join m using (key) group by key")
R.add("keyed_peeked", lambda spark, d: keyed.peeked(given(spark, d), asked(spark, d))[1], MOVES + ", " + VALUES + "select key, pos as reply, v.value from m join v using (key)")
R.add("keyed_delivered", lambda spark, d: keyed.delivered(given(spark, d).where("key % 3 = 0"), asked(spark, d)), MOVES + ", " + VALUES + "select pos as reply, v.value from m join v using (key) where key % 3 = 0")
R.add("keyed_delivered_keep", lambda spark, d: keyed.delivered(given(spark, d).where("key % 3 = 0"), asked(spark, d), keep=True), MOVES + ", " + VALUES + "select key, pos as reply, v.value from m join v using (key) where key % 3 = 0 union all select key, null, value from v where key % 3 = 0")


@R.query("keyed_mapreduce", MOVES + ", " + VALUES + "select key, value + 1 as value from v union all select null, bit_xor(value * key) from v")
def keyed_mapreduce(spark: SparkSession, d: str) -> DataFrame:
    """The new table, and the combined result as a row without key."""
    new, result = keyed.mapreduce(given(spark, d), lambda k, v: (v + 1, v * k), "xor")
    return new.unionByName(result.select(F.lit(None).cast("bigint").alias("key"), "value"))


def tables(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, d).select((F.col("key") % 50).alias("t"), (F.col("key") % 700).alias("key"), "value")


TABLES = MOVES + ", " + VALUES + ", tb as (select key % 50 as t, key % 700 as key, value from v) "
R.add("keyed_broadcast_update", lambda spark, d: keyed.broadcast_update(tables(spark, d), 5, lambda v: wrap(v + 7)), TABLES + "select t, key, case when key = 5 then (value + 7) & 16777215 else value end as value from tb union all select distinct t, 5, 7 from tb where t not in (select t from tb where key = 5)")
R.add("keyed_selected_emit", lambda spark, d: keyed.selected(keyed.reduce_by_key(moves(spark, d), "inc"), lambda v: v > 30, lambda k, v: wrap(k * 100 + v)), MOVES + "select row_number() over (order by key) - 1 as pos, key, (key * 100 + value) & 16777215 as value from (select key, count(*) as value from m group by key) where value > 30")

# --- folds of one's own, walks and places
HEIGHT = "(select seq_id, pos, sum(case when v % 2 = 0 then 1 else -1 end) over (partition by seq_id order by pos) h from s)"
R.add("fold_trusted_heights", lambda spark, d: folds.trusted(sequences(spark, d), "heights"), PRELUDE + f"select seq_id, [cast(max_by(h, pos) as bigint), cast(least(min(h), 0) as bigint), cast(greatest(max(h), 0) as bigint)] as value from {HEIGHT} group by seq_id")
R.add("sequence_argmax_first", lambda spark, d: seq.argmax_first(sequences(spark, d)), PRELUDE + "select seq_id, max(v) as value, min_by(pos, (-v, pos)) as pos from s group by seq_id")
R.add("sequence_at", lambda spark, d: seq.at(sequences(spark, d), F.col("seq_id") % 40, 7), PRELUDE + "select seq_id, coalesce(max(v) filter (pos = seq_id % 40), 7) as value from s group by seq_id")
R.add("sequence_left_over", lambda spark, d: seq.take_first(sequences(spark, d), F.col("seq_id") % 90)[1], PRELUDE + "select seq_id, count(*) filter (pos >= seq_id % 90) as value from s group by seq_id")


@R.query("sequence_walk", PRELUDE + "select seq_id, list_reduce(list_prepend([0::bigint, 0::bigint], list([v, 0::bigint] order by pos)), lambda a, b: case when a[1] + b[1] > 50000 then [0::bigint, a[2] + 1] else [a[1] + b[1], a[2]] end)[2] as value from s group by seq_id")
def sequence_walk(spark: SparkSession, d: str) -> DataFrame:
    """How often a running sum goes above 50,000 and starts anew."""
    state = lambda a, n: F.struct(a.cast("bigint").alias("sum"), n.cast("bigint").alias("n"))
    step = lambda s, x: F.when(s["sum"] + x > 50000, state(F.lit(0), s["n"] + 1)).otherwise(state(s["sum"] + x, s["n"]))
    return seq.walk(sequences(spark, d), state(F.lit(0), F.lit(0)), step, lambda s: s["n"])


for order, by in (("in", "v"), ("pre", "path"), ("post", "path || '3'")):
    R.add(f"family_{order}order_filtered", lambda spark, d, order=order: seq.kept(tree.listed(nodes(spark, d), order).withColumnRenamed("t", "seq_id"), lambda v: v % 3 == 1).select("seq_id", "pos", "v"), NODES.format(d="d") + f"select t as seq_id, row_number() over (partition by t order by {by}) - 1 as pos, v from nd where v % 3 = 1")
