"""Mixing sources to target weights.

Weighted sampling without replacement by exponential keys: a document's key is -ln(u) / weight with u from a hash of
its id, so that any task that runs again draws the same. Within a source documents are taken in order of their
keys until the tokens run out; whole epochs of the source come first, the rest is a prefix of that order.
The prefix sums need no task to hold a source: keys fall into bins by their logarithm, BINS to each doubling, bins are
summed first and only a bin's rows are sorted. A weight only shifts an exponential key's logarithm, so that whatever the
weights no bin is expected to hold more than ln 2 / (e BINS) of a source, 0.025 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.overlap import source_name

#: Bins to a doubling of the key. Keys of 53-bit draws and weights of 0.1 to 1 span at most 62 doublings, which bounds the table of bin sums.
BINS = 1024


def quality(n_chars: Column, n_tokens: Column) -> Column:
    """Weight of a document in 0.1 .. 1: characters a token, against 4; text that splits into many small tokens (keys, minified code, foreign bytes) weighs less."""
    return F.least(F.greatest(n_chars / n_tokens / 4, F.lit(0.1)), F.lit(1.0))


def exponential_key(ident: Column, weight: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(ident, F.lit(seed)), 11) + 1) / float(1 << 53)
    return -F.log(u) / weight


def ordered(documents: DataFrame, seed: int = 0, bins: int = BINS) -> DataFrame:
    """(doc_id, source, n_tokens, before): tokens of the same source that come before a document in the order of keys.

    documents: doc_id, source (named), n_tokens, weight. Rows without source or tokens, or with a weight that is null or not above 0, take no part; equal keys go by doc_id, repeated ids by size.
    """
    rows = documents.where((F.col("n_tokens") > 0) & F.col("source").isNotNull() & (F.col("weight") > 0))
    rows = rows.select("doc_id", "source", "n_tokens", "weight", exponential_key(F.col("doc_id"), F.col("weight"), seed).alias("key"))
    lowest = F.lit(-(1 << 30))  # a draw of exactly 1 has key 0 and no logarithm
    rows = rows.withColumn("bin", F.coalesce(F.floor(F.log2("key") * bins).cast("int"), lowest)).drop("weight")
    sums = rows.groupBy("source", "bin").agg(F.sum("n_tokens").alias("in_bin"))
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bin", F.coalesce(F.sum("in_bin").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("n_tokens").over(within)).join(sums, ["source", "bin"])
    return placed.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("before"))


def plan(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, wanted, available, granted, epochs, rest): tokens that each mix takes of each source.

    wanted is the target's share of the mix's size, and that the mix's share of all tokens, documents without source
    included; granted is what max_repeats epochs of the source allow of it; a shortfall isn't moved to other sources, whose
    shares are targets of their own. A source without documents grants 0. Targets with a null share or source are left out.
    """
    totals = documents.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    everything = documents.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))
    wanted = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats", "total_share").dropna()
    wanted = wanted.crossJoin(F.broadcast(everything)).withColumn("wanted", F.floor(F.col("target_share") * F.col("total_share") * F.col("all_tokens")))
    full = wanted.join(totals.where("source is not null"), "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    full = full.withColumn("granted", F.least("wanted", F.floor(F.col("max_repeats") * F.col("available"))))
    epochs = F.when(F.col("available") > 0, F.expr("granted div available")).otherwise(F.lit(0)).cast("bigint")
    full = full.withColumn("epochs", epochs).withColumn("rest", F.col("granted") - F.col("epochs") * F.col("available"))
    return full.select("mix_name", "source", "target_share", "wanted", "available", "granted", "epochs", "rest")


def mixed(documents: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, repeats): how often each mix uses each document (those with 0 are left out).

    Every document of a source is used epochs times, and once more while the tokens so far stay within the rest, so
    that a source never exceeds its target nor max_repeats and misses it by less than one document.
    """
    rows = ordered(documents, seed).join(plan(documents, targets), "source")
    repeats = F.col("epochs") + (F.col("before") + F.col("n_tokens") <= F.col("rest")).cast("bigint")
    return rows.select("mix_name", "source", "doc_id", "n_tokens", repeats.alias("repeats")).where("repeats > 0")


def shares(documents: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(mix_name, source, target_share, wanted, available, granted, epochs, n_docs, n_tokens, actual_share): what came out, also for sources that gave nothing."""
    used = mixed(documents, targets, seed).groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"))
    full = plan(documents, targets).join(used, ["mix_name", "source"], "left").fillna(0, ["n_docs", "n_tokens"])
    whole = F.sum("n_tokens").over(Window.partitionBy("mix_name"))
    return full.select("mix_name", "source", "target_share", "wanted", "available", "granted", "epochs", "n_docs", "n_tokens", F.when(whole > 0, F.col("n_tokens") / whole).otherwise(0.0).alias("actual_share"))
