"""Keyed tables (key, value): lookups, upserts, group-by with declared identities, scatter and ordered selections.

A key that has no row is absent; `domain` (key) brings absent keys in with a combiner's identity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan import u24
from loomspan.u24 import INF, MASK, wrap

#: Combiners with the value of a key that nothing reached; `set` and `push` go by pos.
IDENTITY = {"add": 0, "or": 0, "max": 0, "set": 0, "inc": 0, "set1": 0, "dec": 0, "min": INF, "xor": 0, "and": MASK, "mul": 1}
#: Parts that a key's product is made of first.
PARTS = 256


def combiner(name: str) -> Column:
    value, pos = F.col("value"), F.col("pos")
    return {
        "add": lambda: wrap(F.sum(value)), "or": lambda: F.call_function("bit_or", value), "max": lambda: F.max(value), "min": lambda: F.min(value),
        "set": lambda: F.max_by(value, pos), "inc": lambda: F.count(F.lit(1)), "set1": lambda: F.max(F.lit(1)), "dec": lambda: wrap(-F.count(F.lit(1))),
        "xor": lambda: F.call_function("bit_xor", value), "and": lambda: F.call_function("bit_and", value),
    }[name]()


def constant(n: DataFrame, value: int) -> DataFrame:
    return n.select("key", F.lit(value).cast("bigint").alias("value"))


def keys(spark, n: int, base: int = 0) -> DataFrame:  # noqa: ANN001
    """(key, value) with value base + key for keys 0 .. n - 1."""
    return spark.range(n).select(F.col("id").alias("key"), (F.col("id") + base).alias("value"))


def lookup(rows: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """rows with value_<column> of each column's key, null where the key is absent; nothing else changes."""
    for c in columns:
        rows = rows.join(values.select(F.col("key").alias(c), F.col("value").alias(f"value_{c}")), c, "left")
    return rows


def reduce_by_key(rows: DataFrame, combine: str, domain: DataFrame | None = None) -> DataFrame:
    """(key, value) of rows (key, value, pos); absent keys of domain have the combiner's identity."""
    found = _products(rows) if combine == "mul" else rows.groupBy("key").agg(combiner(combine).cast("bigint").alias("value"))
    if domain is None:
        return found
    return domain.select("key").join(found, "key", "left").select("key", F.coalesce("value", F.lit(IDENTITY[combine]).cast("bigint")).alias("value"))


def _products(rows: DataFrame) -> DataFrame:
    """(key, value): wrapping product of each key's values, in PARTS parts first, and equal values of a part as a power, so that a hot key is no task's alone."""
    counts = rows.where("value is not null").groupBy("key", F.pmod(F.xxhash64("value"), F.lit(PARTS)).alias("part"), "value").agg(F.count(F.lit(1)).alias("n"))
    power = u24.powmod(wrap(F.col("value")), F.col("n"), F.lit(MASK + 1))
    times = lambda c: F.aggregate(F.collect_list(c), F.lit(1).cast("bigint"), u24.mul)
    parts = counts.withColumn("value", power).groupBy("key", "part").agg(times("value").alias("value"))
    return parts.groupBy("key").agg(times("value").alias("value"))


def upsert(state: DataFrame, delta: DataFrame, combine: str) -> DataFrame:
    """state (key, value) with delta (key, value, pos) worked in; state comes before all of delta."""
    if combine in ("inc", "dec", "set1"):
        old = {"inc": 1, "dec": -1, "set1": 0}[combine]
        n = delta.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        both = state.join(n, "key", "full")
        new = F.when(F.col("n").isNull(), F.col("value")).otherwise(F.lit(1).cast("bigint")) if combine == "set1" else wrap(F.coalesce("value", F.lit(0)) + old * F.coalesce("n", F.lit(0)))
        return both.select("key", new.alias("value"))
    before = state.select("key", "value", F.lit(-1).cast("bigint").alias("pos"))
    return reduce_by_key(before.unionByName(delta.select("key", "value", "pos")), combine)


def push(rows: DataFrame) -> DataFrame:
    """(key, values): values of each key, newest first; a list holds a whole key."""
    return rows.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value")), asc=False), lambda x: x["value"]).alias("values"))


def scatter(rows: DataFrame, target: Callable[[Column], Column], combine: str, domain: DataFrame | None = None) -> DataFrame:
    """Each row's value sent to another key."""
    return reduce_by_key(rows.withColumn("key", target(F.col("key"))), combine, domain)


def zipped(one: DataFrame, other: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    both = one.select("key", F.col("value").alias("a__")).join(other.select("key", F.col("value").alias("b__")), "key")
    return both.select("key", f(F.col("a__"), F.col("b__")).alias("value"))


def selected(table: DataFrame, predicate: Callable[[Column], Column], emit: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(pos, key, value) of the rows that fit, by key, with emit(key, value) in place of value if given. Places are found by ranges of keys: ranges are counted, then numbered on."""
    fit = table.where(predicate(F.col("value"))).withColumn("range__", F.shiftright("key", 16))
    base = fit.groupBy("range__").agg(F.count(F.lit(1)).alias("n__"))
    base = base.withColumn("b__", F.coalesce(F.sum("n__").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n__")
    place = F.row_number().over(Window.partitionBy("range__").orderBy("key")) - 1
    return fit.withColumn("r__", place).join(base, "range__").select((F.col("b__") + F.col("r__")).cast("bigint").alias("pos"), "key", (emit(F.col("key"), F.col("value")) if emit else F.col("value")).alias("value"))


def folded_back(rows: DataFrame, group: str, zero: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """(group, value): an accumulator taken through each group's values from the largest key to the smallest."""
    lists = rows.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("key", "value")), asc=False), lambda x: x["value"]).alias("xs"))
    return lists.select(group, F.aggregate("xs", zero, step).alias("value"))


def occurrences(rows: DataFrame, classes: list[str], order: list[str], out: str = "occ") -> DataFrame:
    """How many earlier rows of the same class there are."""
    return rows.withColumn(out, (F.row_number().over(Window.partitionBy(*classes).orderBy(*order)) - 1).cast("bigint"))


def applied(state: DataFrame, delta: DataFrame, act: Callable[[Column, Column], Column], empty: int = 0) -> DataFrame:
    """state (key, value) after act(value, p) of one's own for each row of delta (key, value, pos) in order; keys that state lacks begin with empty. A key's rows are one list."""
    lists = delta.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("ps"))
    both = state.join(lists, "key", "full")
    first = F.coalesce("value", F.lit(empty).cast("bigint"))
    return both.select("key", F.when(F.col("ps").isNull(), F.col("value")).otherwise(F.aggregate("ps", first, act)).alias("value"))


def peeked(state: DataFrame, asked: DataFrame, empty: int = 0) -> tuple[DataFrame, DataFrame]:
    """(state as it is, asked (key, reply) with the value at its key, `empty` where there is none)."""
    got = asked.join(state.select("key", "value"), "key", "left")
    return state, got.select("key", "reply", F.coalesce("value", F.lit(empty).cast("bigint")).alias("value"))


def delivered(values: DataFrame, requests: DataFrame, keep: bool = False) -> DataFrame:
    """(reply, value): each request (key, reply) gets the value at its key; requests of absent keys get none.

    keep: values come along, as rows with a null reply. One join, however many ask the same key.
    """
    got = requests.join(values, "key").select("key", "reply", "value")
    if not keep:
        return got.select("reply", "value")
    return got.unionByName(values.select("key", F.lit(None).cast(requests.schema["reply"].dataType).alias("reply"), "value"))


def mapreduce(table: DataFrame, leaf: Callable[[Column, Column], tuple[Column, Column]], combine: str) -> tuple[DataFrame, DataFrame]:
    """(the table with new values, the combined results (value)): leaf(key, value) gives each key's new value and result, in one pass each."""
    new, result = leaf(F.col("key"), F.col("value"))
    out = table.select(F.lit(0).cast("bigint").alias("key"), result.alias("value"), F.col("key").alias("pos"))
    return table.select("key", new.alias("value")), reduce_by_key(out, combine).select("value")


def broadcast_update(tables: DataFrame, key: Column | int, act: Callable[[Column], Column], empty: int = 0) -> DataFrame:
    """Every table (t, key, value) after the same change at the same key; a table that lacks it gets it from empty."""
    at = F.lit(key).cast("bigint") if isinstance(key, int) else key
    lacking = tables.groupBy("t").agg(F.bool_or(F.col("key") == at).alias("there")).where("not there").select("t", at.alias("key"), act(F.lit(empty).cast("bigint")).alias("value"))
    return tables.withColumn("value", F.when(F.col("key") == at, act(F.col("value"))).otherwise(F.col("value"))).unionByName(lacking)
