"""Top N items within every group by a mergeable bounded heap."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn
from pyspark.sql.classic.column import _to_java_column
from pyspark.sql.classic.dataframe import DataFrame as ClassicDataFrame
from pyspark.sql.utils import is_remote


def has_heap(df: DataFrame) -> bool:
    """Whether the session runs in this process's JVM, where Catalyst's bounded-heap aggregate can be asked for; over a connection to a server it can't."""
    return not is_remote() and isinstance(df, ClassicDataFrame)


def _bounded_heap(df: DataFrame, value: Column, n: int) -> Column:
    """Catalyst's aggregate that keeps the n least values in a bounded heap."""
    jvm = df.sparkSession._jvm
    parts = jvm.PythonUtils.toSeq([_to_java_column(x) for x in (value, F.lit(n), F.lit(True))])
    return ClassicColumn(getattr(getattr(jvm.org.apache.spark.sql, "Column$"), "MODULE$").internalFn("collect_top_k", parts))


def top_n(df: DataFrame, group: str, order: list[Column], item: str, n: int, rank: str = "rank_no", heap: bool | None = None) -> DataFrame:
    """(group, rank, item): in each group the n rows that come first by order and then by item, both ascending.

    Each task keeps a heap of n rows a group before the shuffle, heaps are merged behind it, so that a group of
    any size costs n rows a task. item must be unique where ties are to be told apart; repeated rows take places of
    their own. Rows with a null in order or item take no part; a null group is a group. An empty table gives none.

    heap: None takes the heap wherever has_heap(df) holds and says in the log where it doesn't; True insists on it; False asks for the
    planner's own limit a group (the same rows, by sorting before and behind the shuffle).
    """
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    rows = df.select(F.col(group).alias("g"), *keys, F.col(item).alias("item")).dropna(subset=[*[f"k{i}" for i in range(len(keys))], "item"])
    if heap is None and not (heap := has_heap(df)):
        logging.getLogger(__name__).warning("top_n: no heap aggregate in this session, rows are ranked by a window")
    if not heap:
        place = F.row_number().over(Window.partitionBy("g").orderBy(*[f"k{i}" for i in range(len(keys))], "item"))
        best = rows.withColumn("place", place).where(F.col("place") <= n)
        return best.select(F.col("g").alias(group), F.col("place").cast("int").alias(rank), F.col("item").alias(item))
    value = F.struct(*[f"k{i}" for i in range(len(keys))], "item")
    best = rows.groupBy("g").agg(_bounded_heap(rows, value, n).alias("best")).select("g", F.posexplode("best").alias("place", "x"))
    return best.select(F.col("g").alias(group), (F.col("place") + 1).cast("int").alias(rank), F.col("x.item").alias(item))


def latest_rows(df: DataFrame, key: str, order: list[str], keep: list[Column]) -> DataFrame:
    """(key, keep...): of each key the row that is last in order (nulls come first). Rows with null key take no part."""
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("x"))
    return picked.select(key, "x.*")
