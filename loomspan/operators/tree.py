"""Binary trees as rows (t, path, v): path has 0 for each step left and 2 for each step right, "" at the root.

All orders are orders of path: pre-order path itself, in-order path + "1", post-order path + "3". An empty tree has no rows;
`every` (t) brings such trees in where a contract gives them a value. A path is as long as its node is deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.u24 import INF, wrap


def depth() -> Column:
    return F.length("path").cast("bigint")


def listed(nodes: DataFrame, order: str) -> DataFrame:
    """(t, pos, v) in order pre, in, post or level."""
    end = {"pre": "", "in": "1", "post": "3", "level": ""}[order]
    keys = [*([depth()] if order == "level" else []), F.concat("path", F.lit(end))]
    return nodes.select("t", (F.row_number().over(Window.partitionBy("t").orderBy(*keys)) - 1).cast("bigint").alias("pos"), "v")


def facts(nodes: DataFrame) -> DataFrame:
    """(t, size, height, least, greatest)."""
    return nodes.groupBy("t").agg(F.count(F.lit(1)).alias("size"), (F.max(depth()) + 1).alias("height"), F.min("v").alias("least"), F.max("v").alias("greatest"))


def at_depth(nodes: DataFrame, d: Column) -> DataFrame:
    return nodes.groupBy("t").agg(F.count_if(depth() == d).alias("value"))


def mirrored(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("path", F.translate("path", "02", "20"))


def added(nodes: DataFrame, k: Column) -> DataFrame:
    return nodes.withColumn("v", wrap(F.col("v") + k))


def inner_paths(nodes: DataFrame) -> DataFrame:
    """(t, path) of nodes with a child."""
    return nodes.where(F.length("path") > 0).select("t", F.expr("left(path, length(path) - 1)").alias("path")).distinct()


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(inner_paths(nodes), ["t", "path"], "left_anti")


def path_sums(nodes: DataFrame) -> DataFrame:
    """(t, pos, v): wrapped sums from the root to each node without children, from left to right."""
    steps = leaves(nodes).select("t", F.col("path").alias("leaf"), F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    on_path = steps.select("t", "leaf", F.expr("left(leaf, n)").alias("path")).join(nodes, ["t", "path"])
    sums = on_path.groupBy("t", "leaf").agg(wrap(F.sum("v")).alias("v"))
    return sums.select("t", (F.row_number().over(Window.partitionBy("t").orderBy("leaf")) - 1).cast("bigint").alias("pos"), "v")


def max_path_sum(nodes: DataFrame) -> DataFrame:
    return path_sums(nodes).groupBy("t").agg(F.max("v").alias("value"))


def diameter(nodes: DataFrame) -> DataFrame:
    """Largest sum of the heights of a node's two subtrees."""
    above = nodes.where(F.length("path") > 0).select("t", "path", F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("n"))
    reach = above.select("t", F.expr("left(path, n)").alias("top"), F.expr("substring(path, n + 1, 1)").alias("side"), (F.length("path") - F.col("n")).alias("h"))
    sides = reach.groupBy("t", "top", "side").agg(F.max("h").alias("h")).groupBy("t", "top").agg(F.sum("h").alias("value"))
    return nodes.where("path = ''").select("t").join(sides.groupBy("t").agg(F.max("value").alias("value")), "t", "left").select("t", F.coalesce("value", F.lit(0)).alias("value"))


def fold_hash(nodes: DataFrame) -> DataFrame:
    """2 f(left) + 3 v + 5 f(right) + 1, wrapping, 0 for no tree: a node counts 3 v + 1 times 2 for each step left and 5 for each right on its way."""
    factor = F.aggregate(F.split("path", ""), F.lit(1).cast("bigint"), lambda a, x: wrap(a * F.when(x == "0", 2).when(x == "2", 5).otherwise(1)))
    return nodes.groupBy("t").agg(wrap(F.sum(wrap(factor * wrap(F.col("v") * 3 + 1)))).alias("value"))


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """Both trees laid over each other; where both have a node the values add up."""
    both = one.select("t", "path", F.col("v").alias("a")).join(other.select("t", "path", F.col("v").alias("b")), ["t", "path"], "full")
    return both.select("t", "path", wrap(F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("v"))


# --- search trees ------------------------------------------------------------------------------------


def inserted(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """With k of asked (t, k) as a new node; a value that is there stays alone.

    The place is right of the next smaller value if that has no right child, else left of the next larger one.
    """
    near = asked.join(nodes, "t", "left").groupBy("t", "k").agg(F.max_by(F.struct("path", "v"), F.when(F.col("v") < F.col("k"), F.col("v"))).alias("low"), F.min_by(F.struct("path", "v"), F.when(F.col("v") > F.col("k"), F.col("v"))).alias("high"), F.bool_or(F.col("v") == F.col("k")).alias("there"))
    near = near.where(~F.coalesce("there", F.lit(False)))
    taken = nodes.select("t", F.col("path").alias("right"), F.lit(True).alias("taken"))
    spot = near.withColumn("right", F.concat("low.path", F.lit("2"))).join(taken, ["t", "right"], "left")
    path = F.when(F.col("low").isNull() & F.col("high").isNull(), F.lit("")).when(F.col("low").isNotNull() & F.col("taken").isNull(), F.col("right")).otherwise(F.concat("high.path", F.lit("0")))
    return nodes.unionByName(spot.select("t", path.alias("path"), F.col("k").alias("v")))


def without_least(nodes: DataFrame) -> DataFrame:
    """The leftmost node gives its place to its right subtree."""
    least = nodes.where(F.translate("path", "0", "") == "").groupBy("t").agg(F.max("path").alias("least"))
    rows = nodes.join(least, "t").where("path <> least")
    under = F.col("path").startswith(F.concat("least", F.lit("2")))
    return rows.select("t", F.when(under, F.concat("least", F.expr("substring(path, length(least) + 2)"))).otherwise(F.col("path")).alias("path"), "v")


def from_sorted(rows: DataFrame) -> DataFrame:
    """(t, path, v) of a balanced tree over (t, pos, v) ascending without gaps: the lower middle is the root, and so on in both halves.

    Each row finds its path from its place and the length alone, in as many steps as the tree is deep.
    """
    size = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    start = F.struct(F.lit(0).cast("bigint").alias("lo"), F.col("n").alias("hi"), F.lit("").alias("path"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        mid = s["lo"] + F.call_function("div", s["hi"] - s["lo"] - 1, F.lit(2))
        left, here = F.col("pos") < mid, s["done"] | (F.col("pos") == mid)
        path = F.when(here, s["path"]).when(left, F.concat(s["path"], F.lit("0"))).otherwise(F.concat(s["path"], F.lit("2")))
        return F.struct(F.when(here | left, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(~here & left, mid).otherwise(s["hi"]).alias("hi"), path.alias("path"), here.alias("done"))

    return rows.join(size, "t").select("t", F.aggregate(F.sequence(F.lit(1), F.length(F.bin("n"))), start, step)["path"].alias("path"), "v")


def kth(nodes: DataFrame, k: Column) -> DataFrame:
    """k-th smallest value from 0; INF out of range."""
    return listed(nodes, "in").groupBy("t").agg(F.coalesce(F.max(F.when(F.col("pos") == k, F.col("v"))), F.lit(INF)).alias("value"))


def lca(nodes: DataFrame, low: Column, high: Column) -> DataFrame:
    """Lowest common ancestor of two values of a search tree: the highest node between them."""
    return nodes.where(F.col("v").between(F.least(low, high), F.greatest(low, high))).groupBy("t").agg(F.min_by("v", F.length("path")).alias("value"))


def pruned(nodes: DataFrame, d: int) -> DataFrame:
    """Without what lies deeper than d."""
    return nodes.where(F.length("path") <= d)
