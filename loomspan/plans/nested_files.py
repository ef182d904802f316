"""Queries on nested records, small files and drifting schemas (problems 1, 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import compact, drift
from loomspan.operators.nested import LINKS, METRIC_OBJECTS, METRICS, NAMES, NODES, SEEDS, every_object, every_value, flatten_nested
from loomspan.plans.registry import Registry
from loomspan.sources.tables import table

R = Registry()

P1_SQL = """
with r as (select rec_id, try_cast(seeds as json) j from results where json_valid(seeds)),
width as (
  select rec_id, try_cast(k as bigint) kfac, json_extract(j, '$."' || k || '"') w
  from (select rec_id, j, unnest(json_keys(j)) k from r where json_type(j) = 'OBJECT')
  union all
  select rec_id, try_cast(json_extract_string(w, '$.kfac') as bigint), w
  from (select rec_id, unnest(cast(j as json[])) w from r where json_type(j) = 'ARRAY')),
seeds as (select rec_id, kfac, json_extract(w, '$.seeds') s from width where json_type(w) = 'OBJECT'),
verdict as (
  select rec_id, kfac, try_cast(k as bigint) seed_no, json_extract(s, '$."' || k || '"') v
  from (select rec_id, kfac, s, unnest(json_keys(s)) k from seeds where json_type(s) = 'OBJECT')
  union all
  select rec_id, kfac, try_cast(json_extract_string(v, '$.seed') as bigint), v
  from (select rec_id, kfac, unnest(cast(s as json[])) v from seeds where json_type(s) = 'ARRAY')),
cex as (
  select rec_id, kfac, seed_no, 0 item_no, json_extract(v, '$.cex') c from verdict where json_type(json_extract(v, '$.cex')) = 'OBJECT'
  union all
  select rec_id, kfac, seed_no, unnest(range(len(l))) item_no, unnest(l) c
  from (select rec_id, kfac, seed_no, cast(json_extract(v, '$.cex') as json[]) l from verdict where json_type(json_extract(v, '$.cex')) = 'ARRAY')),
m as (select row_id, cast(metrics as json) j from state where json_valid(metrics)),
lists as (
  select row_id, cast(l as json[]) l from (
    select row_id, json_extract(j, '$."' || k || '"') l from (select row_id, j, unnest(json_keys(j)) k from m where json_type(j) = 'OBJECT'))
  where json_type(l) = 'ARRAY'),
item as (select row_id, unnest(range(len(l))) item_no, unnest(l) c from lists)
select 'results' src, rec_id, 'width' child, coalesce(kfac, -1) kfac, cast(-1 as bigint) seed_no, cast(-1 as bigint) item_no from width where json_type(w) = 'OBJECT'
union all select 'results', rec_id, 'verdict', coalesce(kfac, -1), coalesce(seed_no, -1), -1 from verdict where json_type(v) = 'OBJECT'
union all select 'results', rec_id, 'cex', coalesce(kfac, -1), coalesce(seed_no, -1), item_no from cex where json_type(c) = 'OBJECT'
union all select 'state', row_id, 'item', -1, -1, item_no from item where json_type(c) = 'OBJECT'
"""


@R.query("p1_found", P1_SQL)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    seeds = flatten_nested(table(spark, d, "results"), ["rec_id"], "seeds", SEEDS, LINKS).withColumn("src", F.lit("results"))
    items = flatten_nested(table(spark, d, "state").select(F.col("row_id").alias("rec_id"), "metrics"), ["rec_id"], "metrics", METRICS, LINKS).withColumn("src", F.lit("state"))
    return seeds.unionByName(items).select("src", "rec_id", "child", *LINKS)


#: Fields of the flat tables of seeds, and which of them each table has.
VERDICT_FIELDS = ["size", "pass", "status", "reason", "why", "kind", "metrics", "input", "expected", "got"]
OWN_FIELDS = {c.name: c.fields for c in SEEDS}
INNER = ("metrics", "input", "expected", "got")


def _verdicts_sql(fields: list[str]) -> str:
    """The flat tables with the names of their links; inner JSON comes in duckdb's own layout."""
    pick = lambda child, x: ", ".join(f"json_extract_string({x}, '$.{c}') {c}" if c in OWN_FIELDS[child] else f"cast(null as varchar) {c}" for c in fields)
    head = P1_SQL[: P1_SQL.index(",\nm as (")].replace("seeds as (", "seeds as materialized (")
    head = head.replace("try_cast(k as bigint) kfac, json", "k kfac_name, try_cast(k as bigint) kfac, json").replace("select rec_id, try_cast(json_extract_string(w, '$.kfac') as bigint), w", "select rec_id, json_extract_string(w, '$.kfac'), try_cast(json_extract_string(w, '$.kfac') as bigint), w")
    head = head.replace("rec_id, kfac", "rec_id, kfac_name, kfac").replace("try_cast(k as bigint) seed_no", "k seed_name, try_cast(k as bigint) seed_no")
    head = head.replace("try_cast(json_extract_string(v, '$.seed') as bigint), v", "json_extract_string(v, '$.seed'), try_cast(json_extract_string(v, '$.seed') as bigint), v").replace("kfac, seed_no", "kfac, seed_name, seed_no")
    return head + f"""
select rec_id, 'width' child, coalesce(kfac, -1) kfac, cast(-1 as bigint) seed_no, cast(-1 as bigint) item_no, kfac_name, cast(null as varchar) seed_name, {pick("width", "w")}
from width where json_type(w) = 'OBJECT'
union all select rec_id, 'verdict', coalesce(kfac, -1), coalesce(seed_no, -1), -1, kfac_name, seed_name, {pick("verdict", "v")} from verdict where json_type(v) = 'OBJECT'
union all select rec_id, 'cex', coalesce(kfac, -1), coalesce(seed_no, -1), item_no, kfac_name, seed_name, {pick("cex", "c")} from cex where json_type(c) = 'OBJECT'
"""


#: p1_verdicts as SQL, but for its numbers of nodes and the layout of inner JSON.
P1_VERDICTS_SQL = _verdicts_sql(VERDICT_FIELDS)
PLAIN_FIELDS = [c for c in VERDICT_FIELDS if c not in INNER]


@R.query("p1_verdicts")
def p1_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables of seeds with their own fields, the names of their links, and node and parent by which rows of one record are joined."""
    return flatten_nested(table(spark, d, "results"), ["rec_id"], "seeds", SEEDS, LINKS, VERDICT_FIELDS, NAMES, nodes=True)


@R.query("p1_verdict_fields", _verdicts_sql(PLAIN_FIELDS))
def p1_verdict_fields(spark: SparkSession, d: str) -> DataFrame:
    """p1_verdicts without inner JSON and numbers of nodes."""
    return p1_verdicts(spark, d).drop(*INNER, *NODES)


P1_OBJECTS_SQL = """
with recursive r as (select 'results' src, rec_id, try_cast(seeds as json) j from results where json_valid(seeds) union all select 'state', row_id, try_cast(metrics as json) from state where json_valid(metrics)),
t as materialized (select src, rec_id, x.id, x.parent, x.type, x.fullkey from r, json_tree(r.j) x),
o as (select *, row_number() over (partition by src, rec_id order by id) - 1 node from t where type = 'OBJECT'),
up(src, rec_id, id, p) as (select src, rec_id, id, parent from o union all select u.src, u.rec_id, u.id, t.parent from up u join t on t.src = u.src and t.rec_id = u.rec_id and t.id = u.p and t.type = 'ARRAY')
select o.src, o.rec_id, o.node, coalesce(q.node, -1) as parent, regexp_replace(substr(o.fullkey, 2), '\\."([A-Za-z0-9_]+)"', '.\\1', 'g') as path, coalesce(try_cast(regexp_extract(o.fullkey, '\\[([0-9]+)\\]$', 1) as bigint), -1) as item_no
from o left join (select up.src, up.rec_id, up.id, q.node from up join o q on q.src = up.src and q.rec_id = up.rec_id and q.id = up.p) q on q.src = o.src and q.rec_id = o.rec_id and q.id = o.id
"""


def both(spark: SparkSession, d: str, f) -> DataFrame:  # noqa: ANN001
    """f of the nested texts of both tables, with src."""
    seeds = f(table(spark, d, "results"), ["rec_id"], "seeds").withColumn("src", F.lit("results"))
    metrics = f(table(spark, d, "state").select(F.col("row_id").alias("rec_id"), "metrics"), ["rec_id"], "metrics").withColumn("src", F.lit("state"))
    return seeds.unionByName(metrics)


@R.query("p1_objects", P1_OBJECTS_SQL)
def p1_objects(spark: SparkSession, d: str) -> DataFrame:
    """All inner objects at any depth with their parents."""
    return both(spark, d, every_object)


P1_VALUES_SQL = P1_OBJECTS_SQL[: P1_OBJECTS_SQL.index("up(src")].replace("x.type, x.fullkey", "x.type, x.fullkey, x.atom") + """
up(src, rec_id, id, p) as (select src, rec_id, id, parent from t where type not in ('OBJECT', 'ARRAY') union all select u.src, u.rec_id, u.id, t.parent from up u join t on t.src = u.src and t.rec_id = u.rec_id and t.id = u.p and t.type = 'ARRAY'),
q as (select up.src, up.rec_id, up.id, o.node, o.fullkey from up join o on o.src = up.src and o.rec_id = up.rec_id and o.id = up.p)
select t.src, t.rec_id, coalesce(q.node, -1) as node, regexp_replace(substr(t.fullkey, 1 + length(coalesce(q.fullkey, '$'))), '\\."([A-Za-z0-9_]+)"', '.\\1', 'g') as name,
 case t.type when 'VARCHAR' then 'string' when 'BIGINT' then 'integer' when 'UBIGINT' then 'integer' when 'DOUBLE' then 'number' else lower(t.type) end as kind, json_extract_string(t.atom, '$') as value
from t left join q on q.src = t.src and q.rec_id = t.rec_id and q.id = t.id where t.type not in ('OBJECT', 'ARRAY')
"""


@R.query("p1_values", P1_VALUES_SQL)
def p1_values(spark: SparkSession, d: str) -> DataFrame:
    """All bare values at any depth with the objects they are in."""
    return both(spark, d, every_value)


P1_ITEMS_SQL = """
with m as (select row_id, attempt_id, cast(metrics as json) j from state where json_valid(metrics)),
lists as (select row_id, attempt_id, json_extract(j, '$."' || k || '"') l from (select *, unnest(json_keys(j)) k from m where json_type(j) = 'OBJECT')),
item as (select row_id, attempt_id, unnest(range(len(cast(l as json[])))) item_no, unnest(cast(l as json[])) c from lists where json_type(l) = 'ARRAY')
select row_id, attempt_id, 'item' child, cast(-1 as bigint) kfac, cast(-1 as bigint) seed_no, item_no, json_extract_string(c, '$.size') size, json_extract_string(c, '$.itrs') itrs, json_extract_string(c, '$.depth') depth
from item where json_type(c) = 'OBJECT'
"""


@R.query("p1_items", P1_ITEMS_SQL)
def p1_items(spark: SparkSession, d: str) -> DataFrame:
    return flatten_nested(table(spark, d, "state"), ["row_id", "attempt_id"], "metrics", METRICS, LINKS, ["size", "itrs", "depth"])


P1_METRICS_SQL = """
with m as (select row_id, attempt_id, cast(metrics as json) j from state where json_valid(metrics)),
f as (select row_id, attempt_id, k, json_extract(j, '$."' || k || '"') x from (select *, unnest(json_keys(j)) k from m where json_type(j) = 'OBJECT')),
item as (select row_id, attempt_id, k, unnest(range(len(cast(x as json[])))) item_no, unnest(cast(x as json[])) c from f where json_type(x) = 'ARRAY')
select row_id, attempt_id, 'item' child, cast(-1 as bigint) kfac, cast(-1 as bigint) seed_no, item_no, k as field, json_extract_string(c, '$.size') size, json_extract_string(c, '$.itrs') itrs, json_extract_string(c, '$.depth') depth, null v, null unit
from item where json_type(c) = 'OBJECT'
union all select row_id, attempt_id, 'field', -1, -1, -1, k, null, null, null, json_extract_string(x, '$.v'), json_extract_string(x, '$.unit') from f where json_type(x) = 'OBJECT'
"""


@R.query("p1_metrics", P1_METRICS_SQL)
def p1_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The inner objects of metrics, in lists or fields themselves, with the name of their field."""
    return flatten_nested(table(spark, d, "state"), ["row_id", "attempt_id"], "metrics", METRIC_OBJECTS, LINKS, ["size", "itrs", "depth", "v", "unit"], ["field"])


@R.query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return compact.consolidated_attempts(compact.compact(table(spark, d, "state_files")))


@R.query("p4_packs")
def p4_packs(spark: SparkSession, d: str) -> DataFrame:
    return compact.pack_report(compact.compact(table(spark, d, "state_files")))


P4_FILES_SQL = "select file_id, modified_at, content from state_files"


@R.query("p4_files", P4_FILES_SQL)
def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """Every small file, read out of the packs again."""
    return compact.unpack(compact.compact(table(spark, d, "state_files"))).withColumn("content", F.col("content").cast("string"))


P5_SQL = """
with j as (select row_id, shard, batch_no, attempt_id, cast(metrics as json) m from state where json_valid(metrics) and json_type(metrics) = 'OBJECT'),
f as (select row_id, shard, batch_no, attempt_id, k, json_extract(m, '$."' || k || '"') x from (select *, unnest(json_keys(m)) k from j)),
v as (select *, case json_type(x) when 'VARCHAR' then 'string' when 'BIGINT' then 'integer' when 'UBIGINT' then 'integer' when 'DOUBLE' then 'number' else lower(json_type(x)) end kind from f),
c as (select shard, batch_no, k, kind, count(*) n from v group by all),
t as (select c.*, (select count(*) from j where j.shard = c.shard and j.batch_no = c.batch_no) n_objects, sum(n) over (partition by shard, batch_no, k) n_held from c),
"""
P5_FOUND_SQL = P5_SQL + """s as (select shard, batch_no, k, min_by(kind, (-n, kind)) filter (kind <> 'null') kind from t where n_held * 5 >= n_objects group by all),
b as (select shard, batch_no, lag(batch_no) over (partition by shard order by batch_no) before from (select distinct shard, batch_no from j)),
g as (select b.shard, b.batch_no, b.before, s.k, s.kind from b join s on s.shard = b.shard and s.batch_no = b.before),
h as (select b.shard, b.batch_no, b.before, s.k, s.kind from b join s on s.shard = b.shard and s.batch_no = b.batch_no where before is not null),
d as (select coalesce(g.shard, h.shard) shard, coalesce(g.batch_no, h.batch_no) batch_no, coalesce(g.before, h.before) before, coalesce(g.k, h.k) k, case when h.k is null then 'removed' when g.k is null then 'added' else 'retyped' end change
  from g full join h on g.shard = h.shard and g.batch_no = h.batch_no and g.k = h.k where g.k is null or h.k is null or g.kind <> h.kind),
p as (select x.shard, x.batch_no, x.k gone, y.k come, count(*) n, count(*) filter (o.x = w.x and o.kind = w.kind) same, count(*) filter (o.x = w.x and o.kind = w.kind and o.kind <> 'null') solid
  from d x join d y on x.shard = y.shard and x.batch_no = y.batch_no and x.change = 'removed' and y.change = 'added'
  join v o on o.shard = x.shard and o.batch_no = x.before and o.k = x.k join v w on w.shard = x.shard and w.batch_no = x.batch_no and w.k = y.k and w.attempt_id = o.attempt_id group by all having 2 * same > n and solid > 0),
q as (select * from p qualify row_number() over (partition by shard, batch_no, come order by same desc, gone) = 1),
r as (select * from q qualify row_number() over (partition by shard, batch_no, gone order by same desc, come) = 1)
select d.shard, d.batch_no, d.k as field_name, case when exists (select 1 from r where r.shard = d.shard and r.batch_no = d.batch_no and r.come = d.k) then 'renamed' else change end as change_kind from d
where not exists (select 1 from r where r.shard = d.shard and r.batch_no = d.batch_no and r.gone = d.k)
"""


@R.query("p5_found", P5_FOUND_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "state"), "shard", "batch_no", "attempt_id", "metrics")


@R.query("p5_types", P5_SQL + "z as (select 1) select shard, batch_no, k as field, kind, n, n_objects, cast(n_held as bigint) as n_held from t")
def p5_types(spark: SparkSession, d: str) -> DataFrame:
    """Alternatives of each field in each batch."""
    return drift.union_types(table(spark, d, "state"), ["shard", "batch_no"], "metrics")


P5_PATHS_SQL = P5_SQL[: P5_SQL.index("f as (")] + """
v as (select shard, batch_no, regexp_replace(substr(x.fullkey, 3), '\\[[0-9]+\\]', '[]', 'g') as path, case x.type when 'VARCHAR' then 'string' when 'BIGINT' then 'integer' when 'UBIGINT' then 'integer' when 'DOUBLE' then 'number' else lower(x.type) end kind from j, json_tree(j.m) x where x.fullkey <> '$'),
c as (select shard, batch_no, path, kind, count(*) n from v group by all),
o as (select shard, batch_no, count(*) n_objects from j group by all),
t as (select c.shard, c.batch_no, path, kind, n, n_objects, cast(sum(n) over (partition by c.shard, c.batch_no, path) as bigint) n_held from c join o on o.shard is not distinct from c.shard and o.batch_no is not distinct from c.batch_no),
"""


@R.query("p5_paths", P5_PATHS_SQL + "z as (select 1) select * from t")
def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Alternatives of each path at any depth in each batch; n_held counts values, so items of lists one by one."""
    return drift.union_types(table(spark, d, "state"), ["shard", "batch_no"], "metrics", True).withColumnRenamed("field", "path")


P5_NEW_TYPES_SQL = P5_PATHS_SQL + """b as (select shard, batch_no, lag(batch_no) over (partition by shard order by batch_no) before from o where shard is not null and batch_no is not null)
select t.shard, t.batch_no, path, kind, n, n_held, n_objects, not exists (select 1 from t p where p.shard = b.shard and p.batch_no = b.before and p.path = t.path) as path_is_new
from t join b on b.shard = t.shard and b.batch_no = t.batch_no
where before is not null and not exists (select 1 from t p where p.shard = b.shard and p.batch_no = b.before and p.path = t.path and p.kind = t.kind)"""


@R.query("p5_new_types", P5_NEW_TYPES_SQL)
def p5_new_types(spark: SparkSession, d: str) -> DataFrame:
    """Alternatives, rare ones too, when they first appear against the previous batch."""
    return drift.new_types(table(spark, d, "state"), "shard", "batch_no", "metrics")


@R.query("p5_table")
def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every record, and every value in it, under one name and in typed branches."""
    return drift.consistent_table(table(spark, d, "state"), ["row_id", "shard", "batch_no"], "shard", "batch_no", "attempt_id", "metrics")
