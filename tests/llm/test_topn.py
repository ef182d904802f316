import datetime as dt

from pyspark.sql import functions as F

from loomspan.llm import topn
from loomspan.llm.queries import best_attempts

SCHEMA = "row_id bigint, attempt_id bigint, pid string, status string, itrs_median_big bigint, depth_median_big bigint, loaded_at timestamp_ntz, rank_no string"


def at(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(minutes=n)


def best(spark, rows, n=2):
    return sorted(map(tuple, best_attempts(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), n).collect()), key=str)


def test_order_and_ties(spark):
    rows = [(1, 11, "a", "\tPASS \n", 5, 9, at(0)), (2, 12, "a", "pass", 5, 8, at(0)), (3, 10, "a", "pass", 5, 8, at(0)), (4, 13, "a", "pass", 4, 99, at(0)), (5, 14, "b", "fail", 1, 1, at(0))]
    assert best(spark, rows, 4) == [("a", 1, 13), ("a", 2, 10), ("a", 3, 12), ("a", 4, 11)]


def test_latest_row_counts(spark):
    rows = [(1, 1, "a", "pass", 1, 1, at(0)), (2, 1, "a", "fail", 1, 1, at(5)), (3, 2, "a", "pass", 9, 9, at(1)), (4, 2, "a", "pass", 2, 2, at(2)), (4, 2, "a", "pass", 2, 2, at(2)), (5, 3, "a", "pass", 3, 3, None), (6, 3, "b", "pass", 3, 3, at(0))]
    assert best(spark, rows) == [("a", 1, 2), ("b", 1, 3)]


def test_nulls_and_unmeasured(spark):
    rows = [(1, 1, None, "pass", 1, 1, at(0)), (2, 2, "a", None, 1, 1, at(0)), (3, 3, "a", "pass", None, 1, at(0)), (4, 4, "a", "pass", 1, None, at(0)), (5, 5, "a", "pass", 1, 16777215, at(0)), (6, None, "a", "pass", 1, 1, at(0)), (None, 7, "", "pass", 1, 1, at(0))]
    assert best(spark, rows) == [("", 1, 7)]
    assert best(spark, []) == []


def test_hot_group_and_both_plans(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 1000)).alias("g"), ((F.col("id") * 7919) % 5003).alias("s"), "id")
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.s, r.id)):
        want.setdefault(r.g, []).append(r.id)
    want = sorted((g, i + 1, x) for g, xs in want.items() for i, x in enumerate(xs[:5]))
    assert topn.has_heap(df)
    for heap in (None, True, False):
        best = topn.top_n(df, "g", [F.col("s")], "id", 5, heap=heap)
        assert ("collect_top_k" in best._jdf.queryExecution().toString()) == (heap is not False)
        assert sorted(map(tuple, best.collect())) == want


def test_asked_task_ids_alone(spark):
    rows = [(i, i, p, "pass", 5, 9, at(0), "x") for i, p in enumerate(["a", "b", "A", None])] + [(9, 1, "a", "pass", 1, 1, at(1), "x")]
    asked = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "pid string, rank_no int")
    got = best_attempts(spark.createDataFrame(rows, SCHEMA), 5, asked)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1), ("a", 2, 0)]


def test_repeated_rows_and_null_group(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 1, 1), ("a", None, 2), ("a", 1, None)], "g string, s int, id int")
    assert sorted(map(tuple, topn.top_n(df, "g", [F.col("s")], "id", 5).collect())) == [(None, 1, 1), (None, 2, 1)]
