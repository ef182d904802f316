"""Streams of candidate pairs: staging that gives a pair once, and clusters kept current batch by batch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspan.operators import recon
from loomspan.operators.fixpoint import components


def staged_once(stream: DataFrame, keys: list[str], event_time: str, late: str = "1 day") -> DataFrame:
    """Each key's first row within the watermark; repeats that come later than `late` after it are new again. NTZ times count as UTC."""
    return stream.withColumn("event__", F.col(event_time).cast("timestamp")).withWatermark("event__", late).dropDuplicatesWithinWatermark(keys).drop("event__")


def windowed_counts(stream: DataFrame, event_time: str, key: str, length: str, late: str) -> DataFrame:
    """(start, end, key, n) of tumbling windows, closed when the watermark has passed them."""
    rows = stream.withColumn("event__", F.col(event_time).cast("timestamp")).withWatermark("event__", late)
    counts = rows.groupBy(F.window("event__", length).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def keep_clusters(stream: DataFrame, folder: str, tau: int) -> StreamingQuery:
    """Keeps folder/clusters-N (g, v, canonical) equal to what a rebuild from all accepted pairs (g, u, v, score) would give.

    A batch's pairs join the clusters they touch: old labels stand as edges, so that only nodes of touched clusters are labelled
    again. Versions are numbered by batch; a batch that runs again writes the same version again.
    """

    def work(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        pairs = recon.accepted(batch, tau).select("g", "u", "v")
        new = pairs.select("g", "v").union(pairs.select("g", F.col("u").alias("v"))).distinct()
        old = clusters(spark, folder, n - 1)
        if old is None:
            out = components(new, pairs, largest=True).withColumnRenamed("label", "canonical")
        else:
            touched = old.join(new, ["g", "v"], "left_semi").select("g", "canonical").distinct()
            moved = old.join(touched, ["g", "canonical"], "left_semi")
            nodes = moved.select("g", "v").union(new).distinct()
            edges = pairs.unionByName(moved.select("g", F.col("canonical").alias("u"), "v"))
            again = components(nodes, edges, largest=True).withColumnRenamed("label", "canonical")
            out = old.join(touched, ["g", "canonical"], "left_anti").select("g", "v", "canonical").unionByName(again)
        out.write.mode("overwrite").parquet(os.path.join(folder, f"clusters-{n}"))

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", os.path.join(folder, "checkpoint")).trigger(availableNow=True).start()


def clusters(spark: SparkSession, folder: str, n: int) -> DataFrame | None:
    """Clusters as of batch n; None before the first."""
    return spark.read.parquet(os.path.join(folder, f"clusters-{n}")) if n >= 0 else None
