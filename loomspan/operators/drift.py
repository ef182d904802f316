"""Schemas that drift between batches of JSON records.

Tagged-union inference: the structural index gives each field of each record with its JSON type; counts by
(batch, field, type) are fused over all batches, all types of a field are kept, and a field with conflicting types
becomes typed branches plus a canonical text. Changes are read off the fused counts. Paths of inner values read
a.b and a[].b; a name with other signs than letters, digits and _ of ASCII stands in quotes there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import json_index as J
from loomspan.operators.fixpoint import components
from loomspan.session import written
from loomspan.sources.tables import map_arrow

#: A batch has a field if one in SHARE of its readable records holds it.
SHARE = 5


def _top_fields(t: J.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of whole objects, and of the values that are their fields."""
    if not len(t.kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = np.flatnonzero((t.kind == J.OBJ) & (t.container < 0) & t.valid[t.doc])
    place = np.zeros(len(t.kind) + 1, bool)
    place[top] = True
    return top, np.flatnonzero(t.is_value & place[t.container] & (t.container >= 0))


def _in_path(name: Column) -> Column:
    return F.when(name.rlike(J.PLAIN), name).otherwise(F.concat(F.lit('"'), name, F.lit('"')))


def _all_values(t: J.Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Tokens of whole objects; those of all values in them; the field that each lies in, and the rest of its path without and with the places in lists."""
    top, at = _top_fields(t)
    values = np.flatnonzero(t.is_value & (t.container >= 0)) if len(t.kind) else at
    root, rest, place = at, pa.array([""] * len(at), pa.string()), pa.array([""] * len(at), pa.string())
    levels = [(at, root, rest, place)]
    while len(at):
        number = np.full(len(t.kind), -1, np.int64)
        number[at] = np.arange(len(at))
        owner = number[t.container[values]]
        at, owner = values[owner >= 0], owner[owner >= 0]
        key = t.key[at]
        named, of = pa.array(key >= 0), np.maximum(key, 0)
        name = pc.binary_join_element_wise(".", J.quoted(J.names(t.data, np.where(key >= 0, t.start[of] + 1, 0), np.where(key >= 0, t.end[of] - 1, 0))), "")
        item = pc.binary_join_element_wise("[", pa.array(t.item[at]).cast(pa.string()), "]", "")
        owned = pa.array(owner)
        rest, place = pc.binary_join_element_wise(rest.take(owned), pc.if_else(named, name, "[]"), ""), pc.binary_join_element_wise(place.take(owned), pc.if_else(named, name, item), "")
        root = root[owner]
        levels.append((at, root, rest, place))
    return top, np.concatenate([x[0] for x in levels]), np.concatenate([x[1] for x in levels]), pa.concat_arrays([x[2] for x in levels]), pa.concat_arrays([x[3] for x in levels])


def _kinds(t: J.Tokens, at: np.ndarray) -> pa.Array:
    names, codes = np.unique(J.type_names(t, at), return_inverse=True)
    return pa.array(names.tolist(), pa.string()).take(pa.array(codes))


def fields(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids..., field, kind, value): a row for each top-level field of each readable record; value is its JSON text, without a string's quotes.

    A readable record itself gives a row with null field and kind. Text that is null or no complete JSON object
    gives no rows. A name that a record has twice gives a row for each.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        t = J.index(batch.column("__text"))
        top, at = _top_fields(t)
        if not len(top):
            return None
        names = J.names(t.data, t.start[t.key[at]] + 1, t.end[t.key[at]] - 1)
        values = J.gather(t.data, *J.inner_spans(t, at))
        types = _kinds(t, at)
        rows = pa.array(np.concatenate([t.doc[top], t.doc[at]]))
        none = pa.nulls(len(top), pa.string())
        columns = [batch.column(c).take(rows) for c in ids]
        columns += [pa.concat_arrays([none, x]) for x in (names, types, values)]
        return pa.RecordBatch.from_arrays(columns, names=[*ids, "field", "kind", "value"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ids] + ["field string", "kind string", "value string"])
    return map_arrow(df.select(*ids, F.col(text).alias("__text")), "__text", one, schema)


def inner_fields(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids..., field, rest, place, kind, value): fields with all values in them; rest and place are what follows the field in the value's path, empty for the field itself.

    place has the places in lists, as in [1].itrs, rest has not, as in [].itrs.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        t = J.index(batch.column("__text"))
        _, at, root, rest, place = _all_values(t)
        if not len(at):
            return None
        names = J.names(t.data, t.start[t.key[root]] + 1, t.end[t.key[root]] - 1)
        columns = [batch.column(c).take(pa.array(t.doc[at])) for c in ids] + [names, rest, place, _kinds(t, at), J.gather(t.data, *J.inner_spans(t, at))]
        return pa.RecordBatch.from_arrays(columns, names=[*ids, "field", "rest", "place", "kind", "value"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ids] + ["field string", "rest string", "place string", "kind string", "value string"])
    return map_arrow(df.select(*ids, F.col(text).alias("__text")), "__text", one, schema)


def type_counts(df: DataFrame, batch: list[str], text: str, inner: bool = False) -> DataFrame:
    """(batch..., field, kind, n): how often each alternative occurs, counted within each Arrow batch already; field and kind are null for the records themselves.

    inner: by the full path of all values, in place of the fields alone.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [*batch, "field", "kind"]

    def one(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        t = J.index(rows.column("__text"))
        top, at, root, rest, _ = _all_values(t) if inner else (*(x := _top_fields(t)), x[1], None, None)
        if not len(top):
            return None
        found = J.names(t.data, t.start[t.key[root]] + 1, t.end[t.key[root]] - 1)
        found = pc.binary_join_element_wise(J.quoted(found), rest, "") if inner else found
        place = pa.array(np.concatenate([t.doc[top], t.doc[at]]))
        none = pa.nulls(len(top), pa.string())
        columns = [rows.column(c).take(place) for c in batch] + [pa.concat_arrays([none, x]) for x in (found, _kinds(t, at))]
        counted = pa.table(columns, names=names).group_by(names).aggregate([([], "count_all")]).combine_chunks()
        return pa.RecordBatch.from_arrays([counted.column(c).chunk(0) for c in [*names, "count_all"]], names=[*names, "n"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in batch] + ["field string, kind string, n bigint"])
    counts = map_arrow(df.select(*batch, F.col(text).alias("__text")), "__text", one, schema)
    return counts.groupBy(*names).agg(F.sum("n").alias("n"))


def union_types(df: DataFrame, batch: list[str], text: str, inner: bool = False) -> DataFrame:
    """(batch..., field, kind, n, n_objects, n_held): alternatives of each field, or with inner of each path, in each batch, of all records."""
    counts = type_counts(df, batch, text, inner)
    objects = F.max(F.when(F.col("field").isNull(), F.col("n"))).over(Window.partitionBy(*batch))
    held = F.sum("n").over(Window.partitionBy(*batch, "field"))
    return counts.withColumn("n_objects", objects).withColumn("n_held", held).where("field is not null")


def new_types(df: DataFrame, shard: str, batch: str, text: str) -> DataFrame:
    """(shard, batch, path, kind, n, n_held, n_objects, path_is_new): alternatives, however rare, that the shard's previous batch doesn't hold at that path.

    The previous batch is the one before it with readable records; the first has none. path_is_new: that batch doesn't hold the path at all.
    """
    counts = written(type_counts(df.where(F.col(shard).isNotNull() & F.col(batch).isNotNull()), [shard, batch], text, True), "paths")
    # a batch of empty records has no path, but is a batch
    batches = counts.where("field is null").select(shard, batch, F.col("n").alias("n_objects"), F.lag(batch).over(Window.partitionBy(shard).orderBy(batch)).alias("before"))
    types = counts.where("field is not null").withColumn("n_held", F.sum("n").over(Window.partitionBy(shard, batch, "field")))
    now = types.join(batches.where("before is not null"), [shard, batch])
    old = types.select(F.col(shard), F.col(batch).alias("before"), "field", "kind")
    held = old.select(shard, "before", "field").distinct().withColumn("held", F.lit(True))
    fresh = now.join(old, [shard, "before", "field", "kind"], "left_anti").join(held, [shard, "before", "field"], "left")
    return fresh.select(shard, batch, F.col("field").alias("path"), "kind", "n", "n_held", "n_objects", F.col("held").isNull().alias("path_is_new"))


def batch_schemas(types: DataFrame, batch: list[str]) -> DataFrame:
    """(batch..., field, kind): fields that a batch has, with the commonest type of the non-null values.

    Ties of types go to the name that comes first; kind is null if all values are null.
    """
    return types.where(F.col("n_held") * SHARE >= F.col("n_objects")).groupBy(*batch, "field").agg(
        F.min_by("kind", F.when(F.col("kind") != "null", F.struct(-F.col("n"), "kind"))).alias("kind")
    )


def _compared(df: DataFrame, shard: str, batch: str, record: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(types, differences of schemas to the batch before, renames (shard, batch, gone, come))."""
    df = df.where(F.col(shard).isNotNull() & F.col(batch).isNotNull())
    types = written(union_types(df, [shard, batch], text), "types")
    schemas = batch_schemas(types, [shard, batch])
    batches = types.select(shard, batch).distinct()
    over = Window.partitionBy(shard).orderBy(batch)
    batches = batches.select(shard, batch, F.lag(batch).over(over).alias("before"), F.lead(batch).over(over).alias("after"))
    near = schemas.join(batches, [shard, batch])
    now = near.where("before is not null").select(shard, F.col(batch).alias("batch"), F.col("before"), "field", F.lit(True).alias("now"), F.lit(False).alias("was"), F.col("kind").alias("new"), F.lit(None).cast("string").alias("old"))
    was = near.where("after is not null").select(shard, F.col("after").alias("batch"), F.col(batch).alias("before"), "field", F.lit(False).alias("now"), F.lit(True).alias("was"), F.lit(None).cast("string").alias("new"), F.col("kind").alias("old"))
    diff = now.unionByName(was).groupBy(shard, "batch", "before", "field").agg(*[F.max(c).alias(c) for c in ("now", "was", "new", "old")])
    diff = diff.where("now <> was or new <> old")
    gone = diff.where("was and not now").select(shard, "batch", "before", F.col("field").alias("gone"))
    come = diff.where("now and not was").select(shard, "batch", F.col("field").alias("come"))
    candidates = written(gone.join(come, [shard, "batch"]), "candidates")
    # values of the candidate fields alone, in the two batches of each change; texts are gone through once for both
    sides = candidates.select(shard, "batch", "gone", "come", F.explode(F.array(
        F.struct(F.col("before").alias("b__"), F.col("gone").alias("field"), F.lit(0).alias("side")),
        F.struct(F.col("batch").alias("b__"), F.col("come").alias("field"), F.lit(1).alias("side")))).alias("x")).select(shard, "batch", "gone", "come", "x.*")
    cell = F.xxhash64("kind", "value")
    held = fields(df.where(F.col(record).isNotNull()).select(F.col(shard), F.col(batch).alias("b__"), F.col(record).alias("id"), text), [shard, "b__", "id"], text)
    sided = written(held.where("field is not null").join(sides, [shard, "b__", "field"]).select(shard, "batch", "gone", "come", "side", "id", cell.alias("cell"), (F.col("kind") != "null").alias("solid")), "cells")
    change = [shard, "batch", "gone", "come", "id"]
    left = sided.where("side = 0").select(*change, F.col("cell").alias("a"), "solid")
    pairs = left.join(sided.where("side = 1").select(*change, F.col("cell").alias("b")), change)
    same = F.col("a") == F.col("b")
    agreed = pairs.groupBy(shard, "batch", "gone", "come").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_same"), F.count_if(same & F.col("solid")).alias("n_solid"))
    agreed = agreed.where("2 * n_same > n and n_solid > 0")
    for one, other in (("come", "gone"), ("gone", "come")):
        best = Window.partitionBy(shard, "batch", one).orderBy(F.desc("n_same"), other)
        agreed = agreed.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
    return types, diff, agreed.select(shard, "batch", "gone", "come")


def changes(df: DataFrame, shard: str, batch: str, record: str, text: str) -> DataFrame:
    """(shard, batch, field_name, change_kind): renamed, added, removed and retyped fields against the shard's previous batch.

    The previous batch is the one before it with readable records; the first has none. Renamed: the field that goes and the one
    that comes have equal JSON types and texts in more than half of the record pairs that both batches hold
    of the same record id, at least one of them not null; of several candidates the one with most equal pairs, then the first by name. Rows with
    null shard or batch form no batch; a null record id is in no other batch.
    """
    _, diff, agreed = _compared(df, shard, batch, record, text)
    renamed = agreed.select(shard, "batch", F.explode(F.array(F.struct(F.col("gone").alias("field"), F.lit(None).cast("string").alias("renamed")), F.struct(F.col("come").alias("field"), F.lit("renamed").alias("renamed")))).alias("x")).select(shard, "batch", "x.*", F.lit(True).alias("part"))
    out = diff.join(renamed, [shard, "batch", "field"], "left")
    kind = F.when(F.col("part"), F.col("renamed")).when(~F.col("was"), "added").when(~F.col("now"), "removed").otherwise("retyped")
    return out.select(shard, F.col("batch").alias(batch), F.col("field").alias("field_name"), kind.alias("change_kind")).where("change_kind is not null")


def canonical_names(df: DataFrame, shard: str, batch: str, record: str, text: str) -> DataFrame:
    """(field, name): one name for all the names that renames tie together, in whatever shard: the one held most often, ties by alphabet."""
    types, _, renames = _compared(df, shard, batch, record, text)
    names = written(types.groupBy("field").agg(F.sum("n").alias("n")).select(F.lit(0).cast("bigint").alias("g"), F.xxhash64("field").alias("v"), "field", "n"), "names")
    edges = renames.select(F.lit(0).cast("bigint").alias("g"), F.xxhash64("gone").alias("u"), F.xxhash64("come").alias("v")).distinct()
    labels = components(names, edges)
    tied = names.join(labels, ["g", "v"])
    best = tied.groupBy("label").agg(F.min_by("field", F.struct(-F.col("n"), "field")).alias("name"))
    return tied.join(best, "label").select("field", "name")


def consistent_table(df: DataFrame, ids: list[str], shard: str, batch: str, record: str, text: str) -> DataFrame:
    """typed_table of the fields and of all values in them, with `name`, one for a field through all its renames; its own name where no batch knows it.

    path is the value's path under that name, as in per_size[].itrs; at is where it stands in the record, as in per_size[1].itrs.
    """
    rows = _typed(inner_fields(df, ids, text), [*ids, "field", "rest", "place"]).join(canonical_names(df, shard, batch, record, text), "field", "left")
    rows = rows.withColumn("name", F.coalesce("name", "field"))
    return rows.withColumn("path", F.concat(_in_path(F.col("name")), "rest")).withColumn("at", F.concat(_in_path(F.col("field")), "place")).drop("rest", "place")


def typed_table(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """One consistent long table: (ids..., field, kind, as_integer, as_number, as_boolean, as_text, as_json).

    A value stands in the branch of its own type; as_text is its canonical conversion, equal for 12, 12.0 and "12".
    Whole numbers beyond BIGINT stand in as_number alone.
    """
    return _typed(fields(df, ids, text).where("field is not null"), [*ids, "field"])


def _typed(found: DataFrame, columns: list[str]) -> DataFrame:
    number = F.expr("try_cast(value AS DOUBLE)")
    plain = F.col("value").rlike(r"^-?(0|[1-9][0-9]{0,17})(\.0+)?$")
    canonical = F.when(F.col("kind") == "null", None).when(plain, F.regexp_replace("value", r"\.0+$", "")).otherwise(F.col("value"))
    return found.select(
        *columns, "kind",
        F.when(F.col("kind") == "integer", F.expr("try_cast(value AS BIGINT)")).alias("as_integer"),
        F.when(F.col("kind").isin("integer", "number"), number).alias("as_number"),
        F.when(F.col("kind") == "boolean", F.col("value") == "true").alias("as_boolean"),
        canonical.alias("as_text"),
        F.when(F.col("kind").isin("object", "array"), F.col("value")).alias("as_json"),
    )
