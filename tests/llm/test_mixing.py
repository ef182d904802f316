import math

import pytest
from pyspark.sql import functions as F

from loomspan.llm import mixing

DOCS = "doc_id bigint, source string, n_tokens bigint, weight double, repeats int"
MIX = "mix_name string, source string, target_share double, max_repeats double, total_share double"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], DOCS)


def test_prefix_sums_against_a_plain_sort(spark):
    rows = [(i, "a" if i % 3 else "b", 1 + i % 17, 0.1 + (i % 10) / 11) for i in range(3000)]
    df = docs(spark, rows)
    keys = {r.doc_id: r.key for r in df.select("doc_id", mixing.exponential_key(F.col("doc_id"), F.col("weight"), 5).alias("key")).collect()}
    for bins in (1, 7, 1024):
        got = {r.doc_id: r.before for r in mixing.ordered(df, 5, bins).collect()}
        for source in "ab":
            total = 0
            for i, s, n, _ in sorted((r for r in rows if r[1] == source), key=lambda r: (keys[r[0]], r[0])):
                assert got[i] == total
                total += n


def test_epochs_and_limits(spark):
    df = docs(spark, [(i, "big", 10, 1.0) for i in range(100)] + [(200 + i, "small", 10, 1.0) for i in range(5)] + [(300, None, 1000, 1.0), (301, "big", 0, 1.0)])
    mixes = spark.createDataFrame([("m", " BIG ", 0.5, 1.0, 0.5), ("m", "small", 0.25, 2.5, 0.5), ("m", "none", 0.25, 9.0, 0.5), ("m", None, 0.1, 1.0, 0.5)], MIX)
    plan = {r.source: r for r in mixing.plan(df, mixes).collect()}
    assert (plan["big"].wanted, plan["big"].granted, plan["big"].epochs) == (512, 512, 0)
    assert (plan["small"].wanted, plan["small"].granted, plan["small"].epochs, plan["small"].rest) == (256, 125, 2, 25)
    assert (plan["none"].available, plan["none"].granted) == (0, 0)
    out = mixing.mixed(df, mixes).collect()
    small = [r.repeats for r in out if r.source == "small"]
    assert sorted(small) == [2, 2, 2, 3, 3] and sum(r.n_tokens for r in out if r.source == "big") == 510
    shares = {r.source: r for r in mixing.shares(df, mixes).collect()}
    assert shares["small"].n_tokens == 120 and shares["none"].n_docs == 0
    assert math.isclose(sum(r.actual_share for r in shares.values()), 1)


def test_weights_count(spark):
    """With replacement-free weighted draws, heavy documents come first in proportion."""
    df = docs(spark, [(i, "a", 1, 1.0 if i % 2 else 0.25) for i in range(20_000)])
    early = mixing.ordered(df).where("before < 2000").select((F.col("doc_id") % 2).alias("heavy")).groupBy().agg(F.avg("heavy")).first()[0]
    assert abs(early - 0.8) < 0.05


def test_same_draw_again(spark):
    df = docs(spark, [(i, "a", 1 + i % 7, 1.0) for i in range(500)])
    mixes = spark.createDataFrame([("m", "a", 1.0, 1.0, 0.3)], MIX)
    one, two = (sorted(r.doc_id for r in mixing.mixed(df.repartition(n), mixes).collect()) for n in (1, 7))
    assert one == two and one != sorted(r.doc_id for r in mixing.mixed(df, mixes, seed=1).collect())


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(None, "a", 5, 0.0)]])
def test_nothing_to_draw(spark, rows):
    mixes = spark.createDataFrame([("m", "a", 1.0, 1.0, 0.3)], MIX)
    assert mixing.mixed(docs(spark, rows), mixes).collect() == []
    (share,) = mixing.shares(docs(spark, rows), mixes).collect()
    assert share.n_tokens == 0 and share.actual_share == 0
    assert mixing.mixed(docs(spark, rows), mixes.limit(0)).collect() == []


@pytest.mark.parametrize("weight", [0.1, 0.125, 0.5, 1.0])
def test_no_bin_holds_much_of_a_source(spark, weight):
    """Whatever the weights, a source's largest bin holds about 0.025 % of it."""
    n = 200_000
    keys = spark.range(n).select(mixing.exponential_key(F.col("id"), F.lit(weight), 0).alias("key"))
    most = keys.groupBy(F.floor(F.log2("key") * mixing.BINS)).count().agg(F.max("count")).first()[0]
    assert most < n * 0.00025 * 2
