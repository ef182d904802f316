"""Matching queries that answer for all rows, against plain versions on made tables and SQL on the small ones."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def put(spark, folder, candidates, must_not_link=()):
    spark.createDataFrame(candidates, "case_id bigint, pos bigint, u bigint, v bigint, score bigint").write.parquet(f"{folder}/candidates.parquet")
    spark.createDataFrame(list(must_not_link), "case_id bigint, a bigint, b bigint").write.parquet(f"{folder}/must_not_link.parquet")
    spark.createDataFrame([], "case_id bigint, node bigint, attr_no bigint, attr_value bigint").write.parquet(f"{folder}/node_attributes.parquet")


def answers(spark, name, folder):
    return sorted(map(tuple, entry.queries()[name](spark, str(folder)).collect()))


def test_all_groups_of_six(spark, tmp_path):
    scores = [100, 950, None, 950, 0, 1, 10, 20, 899, 5, 5, 5, 900, None, 1000]
    put(spark, tmp_path, [(4, i, 0, 1, s) for i, s in enumerate(scores)])
    assert answers(spark, "t5_decide_singleton_all", tmp_path) == [(4, 0, 1), (4, 1, 6), (4, 2, 2)]


def test_lookups_for_every_node(spark, tmp_path):
    # clusters at 600: {0, 1, 2}, {3, 4}, {5}; at 800: {0, 1}, {3, 4}
    put(spark, tmp_path, [(7, 0, 0, 1, 900), (7, 1, 1, 2, 700), (7, 2, 4, 3, 900), (7, 3, 2, 3, 100), (7, 4, 5, 0, None)])
    clusters = [{0, 1, 2}, {3, 4}, {5}]
    assert answers(spark, "t5_cluster_members_of_all", tmp_path) == sorted((7, x, v) for c in clusters for x in c for v in c)
    assert answers(spark, "t5_rewrite_neighbours_all", tmp_path) == [(7, 2, 4), (7, 2, 5), (7, 4, 2), (7, 5, 2)]
    assert answers(spark, "recon_emit_new_all", tmp_path) == [(7, 0, 2), (7, 1, 2)]  # even ids too; 3 -> 4 is known


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", ["t5_decide_singleton_all", "t5_cluster_members_of_all", "t5_rewrite_neighbours_all", "recon_emit_new_all"])
def test_against_sql(spark, name):
    import duckdb

    query = entry.queries()[name](spark, SMALL)
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    assert sorted(map(tuple, query.collect())) == sorted(con.execute(f"select {', '.join(query.columns)} from ({entry.oracle_sql()[name]})").fetchall())
