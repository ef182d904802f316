"""Files in and out: many small files, JSON lines with interned ids, digests of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.u24 import wrap


def small_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(file_id, file_path, modified_at, n_bytes, content BINARY) of files on disk; Spark packs many into a task. file_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
    return files.select(F.xxhash64("path").alias("file_id"), F.col("path").alias("file_path"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("n_bytes"), "content")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines, gzip or plain, read with a given schema; a line that isn't JSON gives a row of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def interned(rows: DataFrame, columns: list[str], order: str, out: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows with <column>_id, (name, id)): numbers for names by first appearance (order, then column).

    Places are found in ranges of the first appearance's rank, so that no task numbers all names.
    """
    names = None
    for i, c in enumerate(columns):
        part = rows.select(F.col(c).alias("name"), F.struct(F.col(order).alias("o"), F.lit(i).alias("i")).alias("at"))
        names = part if names is None else names.unionByName(part)
    first = names.where("name is not null").groupBy("name").agg(F.min("at").alias("at"))
    first = first.withColumn("range__", F.shiftright(F.col("at.o").cast("bigint"), 16))
    base = first.groupBy("range__").agg(F.count(F.lit(1)).alias("n__"))
    base = base.withColumn("b__", F.coalesce(F.sum("n__").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n__")
    place = F.row_number().over(Window.partitionBy("range__").orderBy("at", "name")) - 1
    ids = first.withColumn("r__", place).join(base, "range__").select("name", (F.col("b__") + F.col("r__")).cast("bigint").alias(out))
    for c in columns:
        rows = rows.join(ids.select(F.col("name").alias(c), F.col(out).alias(f"{c}_{out}")), c, "left")
    return rows, ids


def digest(df: DataFrame, order: str, value: str) -> DataFrame:
    """(low, high): two wrapping polynomial hashes (31 and 131) of a whole column in order; equal results have equal digests.

    Each value counts the base to the number of values behind it, so that partial sums may meet in any order. order is a dense position.
    """
    size = df.agg(F.count(F.lit(1)).alias("n__"))
    behind = F.col("n__") - 1 - F.col(order)

    def power(base: int):  # noqa: ANN202
        pair = lambda r, s: F.struct(r.alias("r"), s.alias("s"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(47)), pair(F.lit(1).cast("bigint"), F.lit(base).cast("bigint")), lambda a, i: pair(F.when(F.call_function("shiftright", behind, i).bitwiseAND(F.lit(1)) == 1, wrap(a["r"] * a["s"])).otherwise(a["r"]), wrap(a["s"] * a["s"])))["r"]

    rows = df.crossJoin(F.broadcast(size))
    return rows.agg(*[F.coalesce(wrap(F.sum(wrap(power(b) * wrap(F.col(value))))), F.lit(0)).alias(n) for n, b in (("low", 31), ("high", 131))])


def append_json(df: DataFrame, path: str) -> None:
    """Rows appended as JSON lines."""
    df.write.mode("append").json(path)


def cluster_slice(canon: DataFrame, n: int, first: DataFrame | None = None, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """(by..., v, canonical, id): whole clusters of about n nodes in all, those of `first` (canonical) before others, with ids 0 .. by a seeded order.

    Clusters are taken while their running size stays within n; the order is a hash, so it is the same each time.
    by: columns within which v and canonical are told apart, such as the case.
    """
    by = by or []
    cluster = [*by, "canonical"]
    size = canon.groupBy(*cluster).agg(F.count(F.lit(1)).alias("n__"))
    ahead = first.select(*cluster).distinct().withColumn("ahead__", F.lit(0)) if first is not None else None
    size = size.join(ahead, cluster, "left").fillna(1, ["ahead__"]) if ahead is not None else size.withColumn("ahead__", F.lit(1))
    size = size.withColumn("key__", F.xxhash64(*cluster, F.lit(seed))).withColumn("bin__", F.shiftright("key__", 52))
    sums = size.groupBy("ahead__", "bin__").agg(F.sum("n__").alias("s__"))
    sums = sums.select("ahead__", "bin__", F.coalesce(F.sum("s__").over(Window.orderBy("ahead__", "bin__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b__"))
    within = Window.partitionBy("ahead__", "bin__").orderBy("key__", *cluster).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = size.withColumn("upto__", F.sum("n__").over(within)).join(sums, ["ahead__", "bin__"]).where(F.col("b__") + F.col("upto__") <= n)
    rows = canon.join(taken.select(*cluster, (F.col("b__") + F.col("upto__") - F.col("n__")).alias("from__")), cluster)
    return rows.select(*by, "v", "canonical", (F.col("from__") + F.row_number().over(Window.partitionBy(*cluster).orderBy(F.xxhash64("v", F.lit(seed)), "v")) - 1).cast("bigint").alias("id"))
