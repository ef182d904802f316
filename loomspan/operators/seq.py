"""Operators on ordered sequences in row form (seq_id, pos, v), positions from 0 without gaps.

All sequences of a table go through one plan. Scans work in blocks of BLOCK positions: totals of blocks are scanned first
and added to scans within blocks, so that even one huge sequence is spread over tasks. A sequence without
rows doesn't exist in row form; `every` brings in the ids that must come out all the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.u24 import INF, wrap

#: Positions that one task scans at a time.
BLOCK = 1 << 16


def _by_block() -> Window:
    return Window.partitionBy("seq_id", "block").orderBy("pos")


def _blocks(df: DataFrame) -> DataFrame:
    return df.withColumn("block", F.shiftright("pos", 16))


def scan(df: DataFrame, value: Column, kind: str, out: str = "v") -> DataFrame:
    """Running sum, max, min or xor of value, the own row included. Null values count as absent."""
    aggregate = {"sum": F.sum, "max": F.max, "min": F.min, "xor": lambda c: F.call_function("bit_xor", c)}[kind]
    rows = _blocks(df.withColumn("x__", value))
    whole = rows.groupBy("seq_id", "block").agg(aggregate("x__").alias("t__"))
    earlier = Window.partitionBy("seq_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select("seq_id", "block", aggregate("t__").over(earlier).alias("b__")).where("b__ is not null")  # few: none for a sequence of one block
    own = aggregate("x__").over(_by_block().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("o__", own).join(base, ["seq_id", "block"], "left")
    o, b = F.col("o__"), F.col("b__")
    both = {"sum": o + b, "max": F.greatest(o, b), "min": F.least(o, b), "xor": o.bitwiseXOR(b)}[kind]
    return rows.withColumn(out, F.when(b.isNull(), o).when(o.isNull(), b).otherwise(both)).drop("x__", "o__", "b__", "block")


def neighbour(df: DataFrame, column: str, out: str, step: int) -> DataFrame:
    """Value one row before (step -1) or after (step 1), null at the sequence's end.

    A block's edge row is sent to the next block as well, so that no block has to see another.
    """
    rows = _blocks(df).withColumn("own__", F.lit(True))
    edge = F.col("pos").bitwiseAND(F.lit(BLOCK - 1)) == (BLOCK - 1 if step < 0 else 0)
    sent = rows.where(edge).withColumn("block", F.col("block") - step).withColumn("own__", F.lit(False))
    take = F.lag(column) if step < 0 else F.lead(column)
    return rows.unionByName(sent).withColumn(out, take.over(_by_block())).where("own__").drop("own__", "block")


def dense(df: DataFrame) -> DataFrame:
    """Positions from 0 again after rows are gone, order kept."""
    return scan(df, F.lit(1).cast("bigint"), "sum", "n__").withColumn("pos", F.col("n__") - 1).drop("n__")


def placed(df: DataFrame, bin_: Column, *order: Column | str) -> DataFrame:
    """Positions from 0 by order, of which bin_ must be a coarser form: bins are counted first and only a bin's rows are sorted."""
    rows = df.withColumn("bin__", bin_)
    base = rows.groupBy("seq_id", "bin__").agg(F.count(F.lit(1)).alias("n__"))
    earlier = Window.partitionBy("seq_id").orderBy("bin__").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("seq_id", "bin__", F.coalesce(F.sum("n__").over(earlier), F.lit(0)).alias("b__"))
    within = F.row_number().over(Window.partitionBy("seq_id", "bin__").orderBy(*order)) - 1
    rows = rows.withColumn("r__", within).join(base, ["seq_id", "bin__"])
    return rows.withColumn("pos", (F.col("b__") + F.col("r__")).cast("bigint")).drop("bin__", "r__", "b__")


def ordered(df: DataFrame, *keys: Column) -> DataFrame:
    """Rows in a new order: positions by keys, ties by the old position."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("seq_id").orderBy(*keys, "pos")).cast("bigint") - 1)


def sort(df: DataFrame, descending: bool = False) -> DataFrame:
    """By value. Values of 24 bits fall into 4096 bins by their high bits; bins are counted first and only a bin's rows are sorted."""
    sign = -1 if descending else 1
    rows = df.withColumn("bin__", F.shiftright("v", 12) * sign)
    base = rows.groupBy("seq_id", "bin__").agg(F.count(F.lit(1)).alias("n__"))
    base = base.withColumn("b__", F.coalesce(F.sum("n__").over(Window.partitionBy("seq_id").orderBy("bin__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n__")
    within = Window.partitionBy("seq_id", "bin__").orderBy(F.col("v") * sign, "pos")
    return rows.withColumn("r__", F.row_number().over(within)).join(base, ["seq_id", "bin__"]).withColumn("pos", (F.col("b__") + F.col("r__") - 1).cast("bigint")).drop("bin__", "r__", "b__")


# --- stages: (seq_id, pos, v) -> (seq_id, pos, v) ----------------------------------------------------


def mapped(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn("v", f(F.col("v")))


def kept(df: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    return dense(df.where(predicate(F.col("v"))))


def take(df: DataFrame, k: Column | int) -> DataFrame:
    return df.where(F.col("pos") < k)


def drop(df: DataFrame, k: Column | int) -> DataFrame:
    return df.where(F.col("pos") >= k).withColumn("pos", F.col("pos") - k)


def reverse(df: DataFrame) -> DataFrame:
    size = df.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n__"))
    return df.join(size, "seq_id").withColumn("pos", F.col("n__") - 1 - F.col("pos")).drop("n__")


def append(x: DataFrame, y: DataFrame) -> DataFrame:
    size = x.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n__"))
    behind = y.join(size, "seq_id", "left").withColumn("pos", F.col("pos") + F.coalesce("n__", F.lit(0))).drop("n__")
    return x.unionByName(behind)


def zipped(x: DataFrame, y: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairwise by position, as long as the shorter one."""
    both = x.select("seq_id", "pos", F.col("v").alias("a__")).join(y.select("seq_id", "pos", F.col("v").alias("b__")), ["seq_id", "pos"])
    return both.select("seq_id", "pos", f(F.col("a__"), F.col("b__")).alias("v"))


def dedup_runs(df: DataFrame) -> DataFrame:
    """One row for each run of equal values."""
    return dense(neighbour(df, "v", "p__", -1).where("p__ is null or p__ <> v").drop("p__"))


def diff(df: DataFrame) -> DataFrame:
    """Next value minus this one, wrapping; one shorter."""
    return neighbour(df, "v", "n__", 1).where("n__ is not null").withColumn("v", wrap(F.col("n__") - F.col("v"))).drop("n__")


def running(df: DataFrame, kind: str) -> DataFrame:
    out = scan(df, F.col("v"), kind)
    return out.withColumn("v", wrap(F.col("v"))) if kind == "sum" else out


def distinct_sorted(df: DataFrame) -> DataFrame:
    return sort(df.select("seq_id", "v").distinct().withColumn("pos", F.col("v")))


def merge(*dfs: DataFrame) -> DataFrame:
    """Sorted sequences into one."""
    whole = dfs[0].withColumn("pos", F.col("pos") * len(dfs))
    for i, df in enumerate(dfs[1:], 1):
        whole = whole.unionByName(df.withColumn("pos", F.col("pos") * len(dfs) + i))
    return sort(whole)


def union(x: DataFrame, y: DataFrame) -> DataFrame:
    return distinct_sorted(x.unionByName(y))


def intersect(x: DataFrame, y: DataFrame) -> DataFrame:
    return sort(x.select("seq_id", "v").intersect(y.select("seq_id", "v")).withColumn("pos", F.col("v")))


def runs(df: DataFrame) -> DataFrame:
    """(seq_id, pos, v, n): value and length of each run."""
    first = neighbour(df, "v", "p__", -1).withColumn("new__", (F.col("p__").isNull() | (F.col("p__") != F.col("v"))).cast("bigint"))
    numbered = scan(first, F.col("new__"), "sum", "run__")
    return numbered.groupBy("seq_id", "run__").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n")).select("seq_id", (F.col("run__") - 1).alias("pos"), "v", "n")


def group_counts(df: DataFrame, buckets: int) -> DataFrame:
    """Counts of the values 0 .. buckets - 1, zeros included: (seq_id, pos, v)."""
    ids = df.select("seq_id").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))))
    counts = df.where(F.col("v").between(0, buckets - 1)).groupBy("seq_id", F.col("v").alias("pos")).agg(F.count(F.lit(1)).alias("n__"))
    return ids.join(counts, ["seq_id", "pos"], "left").select("seq_id", "pos", F.coalesce("n__", F.lit(0)).alias("v"))


# --- reducers: (seq_id, pos, v) -> (seq_id, value) ---------------------------------------------------


def reducers() -> dict[str, tuple[Column, int]]:
    """Aggregate and value for an empty sequence of each plain reducer; pos tells the order, so partial aggregates may meet in any order."""
    v, pos = F.col("v"), F.col("pos")
    return {
        "sum": (wrap(F.sum(v)), 0),
        "xor": (F.call_function("bit_xor", v), 0),
        "count": (F.count(v), 0),
        "max": (F.max(v), 0),
        "min": (F.min(v), INF),
        "first": (F.min_by(v, pos), 0),
        "last": (F.max_by(v, pos), 0),
        "argmax": (F.max_by(pos, F.struct(v, -pos)), 0),
        "argmin": (F.min_by(pos, F.struct(v, pos)), 0),
        "count_even": (F.count_if(v % 2 == 0), 0),
        "distinct_count": (F.count_distinct(v), 0),
    }


def reduced(df: DataFrame, value: Column, empty: int | None = None, every: DataFrame | None = None, out: str = "value") -> DataFrame:
    """value aggregated of each sequence; `every` (seq_id) adds the empty ones with `empty`."""
    got = df.groupBy("seq_id").agg(value.alias(out))
    if every is not None:
        got = every.select("seq_id").join(got, "seq_id", "left")
    return got.withColumn(out, F.coalesce(F.col(out), F.lit(empty)).cast("bigint")) if empty is not None else got


def reduce(df: DataFrame, name: str, every: DataFrame | None = None) -> DataFrame:
    value, empty = reducers()[name]
    return reduced(df, value, empty, every)


def index_of(df: DataFrame, predicate: Column, kind: str, every: DataFrame | None = None) -> DataFrame:
    """First, last or wrapped sum of the positions where predicate holds; INF for none (sum: 0)."""
    at = F.when(predicate, F.col("pos"))
    value = {"first": F.min(at), "last": F.max(at), "sum": wrap(F.sum(at))}[kind]
    return reduced(df, value, 0 if kind == "sum" else INF, every)


def count_above_first(df: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """How many values are above the sequence's first one."""
    first = df.where("pos = 0").select("seq_id", F.col("v").alias("f__"))
    return reduced(df.join(first, "seq_id"), F.count_if(F.col("v") > F.col("f__")), 0, every)


def kth(df: DataFrame, k: Column | int, descending: bool = False, every: DataFrame | None = None, empty: int = 0) -> DataFrame:
    """k-th value from 0 in order; `empty` out of range."""
    return reduced(sort(df, descending), F.max(F.when(F.col("pos") == k, F.col("v"))), empty, every)


def median(df: DataFrame) -> DataFrame:
    """Upper median."""
    size = df.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n__"))
    return reduced(sort(df).join(size, "seq_id"), F.max(F.when(F.col("pos") == F.expr("n__ div 2"), F.col("v"))), 0)


def mode(df: DataFrame) -> DataFrame:
    """Most frequent value, ties to the smallest."""
    counts = df.groupBy("seq_id", "v").agg(F.count(F.lit(1)).alias("n__"))
    return counts.groupBy("seq_id").agg(F.max_by("v", F.struct("n__", -F.col("v"))).alias("value"))


def closest(df: DataFrame, x: Column) -> DataFrame:
    """Value nearest to x, ties to the smaller."""
    return reduced(df, F.min_by("v", F.struct(F.abs(F.col("v") - x), "v")), 0)


def longest_run(df: DataFrame) -> DataFrame:
    return runs(df).groupBy("seq_id").agg(F.max("n").alias("value"))


def is_sorted(df: DataFrame) -> DataFrame:
    return reduced(neighbour(df, "v", "p__", -1), F.min(F.coalesce((F.col("p__") <= F.col("v")).cast("bigint"), F.lit(1))), 1)


def inversions(df: DataFrame) -> DataFrame:
    """Pairs that are out of order, by levels of merging bits: for each of the 24 bits, pairs whose values first differ there.

    A pair (earlier, later) is out of order when it agrees above a bit and the earlier one has the bit; so for each bit
    the later zeros behind each one are counted by a running sum in the group of equal higher bits. No pair is built.
    """
    bits = df.withColumn("bit__", F.explode(F.sequence(F.lit(0), F.lit(23))))
    bits = bits.select("pos", F.struct("seq_id", "bit__", F.expr("shiftright(v, bit__ + 1)").alias("high__")).alias("seq_id"), F.expr("shiftright(v, bit__) & 1").alias("one__"))
    ones = scan(bits, F.col("one__"), "sum", "ones__")  # in blocks of positions, so that the top bit's group, which is the sequence, is spread
    return reduced(ones.withColumn("seq_id", F.col("seq_id.seq_id")), F.sum(F.when(F.col("one__") == 0, F.col("ones__")).otherwise(0)), 0)


def argmax_first(df: DataFrame) -> DataFrame:
    """(seq_id, value, pos): the largest value and the first place where it stands."""
    return df.groupBy("seq_id").agg(F.max(F.struct("v", (-F.col("pos")).alias("p"))).alias("m")).select("seq_id", F.col("m.v").alias("value"), (-F.col("m.p")).alias("pos"))


def at(df: DataFrame, k: Column | int, empty: int = 0, every: DataFrame | None = None) -> DataFrame:
    """(seq_id, value): the value at place k, `empty` out of range."""
    return reduced(df, F.max(F.when(F.col("pos") == k, F.col("v"))), empty, every)


def take_first(df: DataFrame, k: Column | int) -> tuple[DataFrame, DataFrame]:
    """(the first k, how many are left over as (seq_id, value))."""
    left = reduced(df, F.count_if(F.col("pos") >= k), 0)
    return take(df, k), left


def walk(df: DataFrame, start: Column, step: Callable[[Column, Column], Column], fin: Callable[[Column], Column] | None = None) -> DataFrame:
    """(seq_id, value): a state of any type taken along a sequence by step(state, element), then fin(state). No law is asked of it, so a sequence is one row."""
    return arrays(df).select("seq_id", F.aggregate("xs", start, step, *([fin] if fin else [])).alias("value"))


# --- array form: one sequence in a row --------------------------------------------------------------


def arrays(df: DataFrame, column: str = "v", out: str = "xs") -> DataFrame:
    """(seq_id, xs): for kernels that need a sequence whole; such sequences must fit a task."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", column)))
    return df.groupBy("seq_id").agg(F.transform(pairs, lambda p: p[column]).alias(out))


def rows(df: DataFrame, column: str = "xs") -> DataFrame:
    return df.select("seq_id", F.posexplode(column).alias("pos", "v")).withColumn("pos", F.col("pos").cast("bigint"))


BASE = 4096


def _carried(digits: Column) -> Column:
    """Digit sums to little-endian digits below BASE without leading zeros."""
    state = F.struct(F.lit(0).cast("bigint").alias("c"), F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("d"))

    def step(s: Column, x: Column) -> Column:
        t = x + s["c"]
        return F.struct(F.shiftright(t, 12).alias("c"), F.concat(s["d"], F.array(t.bitwiseAND(F.lit(BASE - 1)))).alias("d"))

    padded = F.concat(digits, F.expr("CAST(array_repeat(0L, 4) AS ARRAY<BIGINT>)"))
    return trimmed(F.aggregate(padded, state, step, lambda s: s["d"]))


def trimmed(digits: Column) -> Column:
    """Without zeros at the end."""
    places = F.transform(digits, lambda x, i: F.when(x != 0, i + 1).otherwise(0))
    return F.slice(digits, F.lit(1), F.coalesce(F.array_max(places), F.lit(0)))


def bignum_add(a: Column, b: Column) -> Column:
    """Little-endian digits to the base 4096; zero is the empty list."""
    return _carried(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))))


def bignum_mul_small(a: Column, k: Column) -> Column:
    return _carried(F.transform(a, lambda x: x * k))


def bignum_mul(a: Column, b: Column) -> Column:
    """Sums of digit products by place, then carries."""
    places = F.size(a) + F.size(b)
    sums = F.transform(F.sequence(F.lit(0), F.greatest(places - 1, F.lit(0))), lambda p: F.aggregate(
        F.transform(a, lambda x, i: F.when((p - i >= 0) & (p - i < F.size(b)), x * F.coalesce(F.get(b, p - i), F.lit(0))).otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"), lambda s, x: s + x))
    return _carried(sums)


def lis(df: DataFrame) -> DataFrame:
    """Length of the longest strictly increasing subsequence, by the least last values of subsequences of each length."""
    from bisect import bisect_left

    import pyarrow as pa

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            out = []
            for xs in batch.column("xs").to_pylist():
                tails: list[int] = []
                for x in xs:
                    at = bisect_left(tails, x)
                    tails[at : at + 1] = [x]
                out.append(len(tails))
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array(out, pa.int64())], names=["seq_id", "value"])

    return arrays(df).mapInArrow(run, "seq_id bigint, value bigint")
