import json
import os

import pytest

import __spark_entry__ as entry
from loomspan.operators.nested import LINKS, METRIC_OBJECTS, METRICS, NAMES, NODES, SEEDS, every_object, every_value, flatten_nested
from loomspan.plans.nested_files import P1_METRICS_SQL, P1_VERDICTS_SQL

SMALL = "/root/testdata/sf0.001"
SEED = (
    '{"4": {"size": 7, "seeds": {"0": {"status": "p\\u00e4ss", "cex": {"why": "w"}}, "1": {"status": null, "cex": [null, {"why": "x"}, {}]}}}, "k": {"seeds": null}, "8": 5}'
)
LISTED = '[{"kfac": 16, "seeds": [{"seed": "3", "cex": []}, 7, {"status": "fail", "cex": {"why": "\\"q\\""}}]}, {}, null]'


def rows(spark, data, schema, *rest):
    return sorted(map(tuple, flatten_nested(spark.createDataFrame(data, schema), *rest).collect()), key=str)


def test_both_forms_and_links(spark):
    got = rows(spark, [(1, SEED), (2, LISTED)], "rec_id bigint, seeds string", ["rec_id"], "seeds", SEEDS, LINKS, ["status", "why"])
    assert got == sorted([
        (1, "width", 4, -1, -1, None, None), (1, "width", -1, -1, -1, None, None),
        (1, "verdict", 4, 0, -1, "päss", None), (1, "verdict", 4, 1, -1, None, None),
        (1, "cex", 4, 0, 0, None, "w"), (1, "cex", 4, 1, 1, None, "x"), (1, "cex", 4, 1, 2, None, None),
        (2, "width", 16, -1, -1, None, None), (2, "width", -1, -1, -1, None, None),
        (2, "verdict", 16, 3, -1, None, None), (2, "verdict", 16, -1, -1, "fail", None), (2, "cex", 16, -1, 0, None, '"q"'),
    ], key=str)


def test_nulls_repeats_and_clashing_columns(spark):
    data = [(None, SEED[:-1], "c", 1), (5, None, None, None), (5, "", "c", 1), (6, '{"x": [{"size": 1}], "y": [2, {"size": 2}]}', "c", 1), (6, '{"x": [{"size": 1}]}', "c", 1), (6, '{"x": [{"size": 1}]}', "c", 1), (7, '[[{"size": 3}]]', "c", 1)]
    got = rows(spark, data, "row_id bigint, metrics string, child string, item_no int", ["row_id"], "metrics", METRICS, LINKS, ["size"])
    assert got == [(6, "item", -1, -1, 0, "1")] * 3 + [(6, "item", -1, -1, 1, "2")]


def test_null_ids_and_empty_table(spark):
    assert rows(spark, [(None, '{"x": [{}]}')], "row_id bigint, metrics string", ["row_id"], "metrics", METRICS, LINKS) == [(None, "item", -1, -1, 0)]
    assert rows(spark, [], "row_id bigint, metrics string", ["row_id"], "metrics", METRICS, LINKS) == []


def test_long_text(spark):
    text = '{"x": [' + ",".join('{"size": %d}' % i for i in range(40_000)) + "]}"
    got = flatten_nested(spark.createDataFrame([(1, text)], "row_id bigint, metrics string"), ["row_id"], "metrics", METRICS, LINKS)
    assert got.count() == 40_000


def test_all_fields_of_verdicts_and_counterexamples(spark):
    text = '{"4": {"size": 7, "seeds": {"0": {"status": "fail", "metrics": {"a": [1]}, "cex": {"why": "w", "input": [1, "x"], "expected": {"b": 2}, "got": null}}, "1": {"metrics": "{\\"a\\": 1}", "cex": [{"got": 3}]}}}}'
    got = rows(spark, [(1, text)], "rec_id bigint, seeds string", ["rec_id"], "seeds", SEEDS, LINKS, ["metrics", "input", "expected", "got"])
    assert got == sorted([
        (1, "width", 4, -1, -1, None, None, None, None),
        (1, "verdict", 4, 0, -1, '{"a": [1]}', None, None, None), (1, "verdict", 4, 1, -1, '{"a": 1}', None, None, None),
        (1, "cex", 4, 0, 0, None, '[1, "x"]', '{"b": 2}', None), (1, "cex", 4, 1, 0, None, None, None, "3"),
    ], key=str)


def test_objects_that_are_fields(spark):
    data = [(1, '{"ms_total": {"v": 12, "unit": "ms"}, "x": 5, "p\\u00e4": [{"size": 1}, 2, {}], "e": {}, "n": [[{"size": 3}]]}'), (2, '[{"v": 1}]'), (3, '{"a": {"v": 1}')]
    got = rows(spark, data, "row_id bigint, metrics string", ["row_id"], "metrics", METRIC_OBJECTS, LINKS, ["size", "v", "unit"], ["field"])
    assert got == sorted([
        (1, "field", -1, -1, -1, "ms_total", None, "12", "ms"), (1, "field", -1, -1, -1, "e", None, None, None),
        (1, "item", -1, -1, 0, "pä", "1", None, None), (1, "item", -1, -1, 2, "pä", None, None, None),
    ], key=str)


def test_rows_find_their_outer_rows_whatever_the_names(spark):
    """Names that are no numbers, equal names and list items without a name: node and parent still tell them apart."""
    texts = [
        '{"2x": {"size": 1, "seeds": {"a": {"cex": {"why": "1"}}}}, "4x": {"size": 2, "seeds": {"a": {"cex": [{"why": "2"}, {"why": "3"}]}}}, "4x": {"seeds": {"b": {}}}}',
        '[{"seeds": [{"cex": {"why": "4"}}, {"seed": "s", "cex": {"why": "5"}}]}, {"seeds": {"7": {"cex": {"why": "6"}}}}]',
        '{"8": {"se\\u0065ds": {"\\u0031": {"st\\u0061tus": "ok"}}}}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "rec_id bigint, seeds string")
    got = flatten_nested(df, ["rec_id"], "seeds", SEEDS, LINKS, ["why", "status"], NAMES, nodes=True).collect()
    at = {(r.rec_id, r.node): r for r in got}
    assert len(at) == len(got)  # a node is a row's own
    for r in got:
        if r.child == "width":
            assert r.parent == (0 if r.rec_id != 1 else -1)
            continue
        outer = at[(r.rec_id, r.parent)]
        assert outer.child == {"verdict": "width", "cex": "verdict"}[r.child] and outer.kfac_name == r.kfac_name
    path = lambda r: (r.why, r.kfac_name, r.seed_name)
    assert sorted(map(path, (r for r in got if r.child == "cex")), key=str) == sorted([("1", "2x", "a"), ("2", "4x", "a"), ("3", "4x", "a"), ("4", None, None), ("5", None, "s"), ("6", None, "7")], key=str)
    assert [(r.kfac, r.seed_no, r.status) for r in got if r.rec_id == 2 and r.child == "verdict"] == [(8, 1, "ok")]


def test_every_object_and_value_against_a_parser(spark):
    import random

    r = random.Random(4)

    def make(depth):
        kind = r.choice("oaskn" if depth else "skn")
        if kind == "o":
            return {r.choice(["a", "b c", "é", "x1", 'q"']): make(depth - 1) for _ in range(r.randint(0, 3))}
        if kind == "a":
            return [make(depth - 1) for _ in range(r.randint(0, 3))]
        return r.choice([1, 2.5, "t\n", "", None, True, "\u00e4"])

    data = [make(5) for _ in range(200)]
    texts = [json.dumps(x, ensure_ascii=bool(i % 2)) for i, x in enumerate(data)]
    objects, values = [], []

    def walk(i, x, path, inside, parent, item, count):
        if isinstance(x, dict):
            node, count[0] = count[0], count[0] + 1
            objects.append((i, node, parent, path, item))
            for k, v in x.items():
                step = "." + (k if k.isascii() and k.replace("_", "").isalnum() else f'"{k}"')
                walk(i, v, path + step, step, node, -1, count)
        elif isinstance(x, list):
            for n, v in enumerate(x):
                walk(i, v, f"{path}[{n}]", f"{inside}[{n}]", parent, n, count)
        else:
            values.append((i, parent, inside, None if x is None else x if isinstance(x, str) else json.dumps(x)))

    for i, x in enumerate(data):
        walk(i, x, "", "", -1, -1, [0])
    rows = [*enumerate(texts), (900, None), (901, ""), (902, '{"a": '), (903, '{"a": "\\ud800"}')]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "id bigint, text string, node int, path string")
    assert sorted(map(tuple, every_object(df.where("id < 903"), ["id"], "text").collect())) == sorted(objects)
    got = every_value(df, ["id"], "text").collect()
    assert sorted([(v.id, v.node, v.name, v.value) for v in got if v.id < 900], key=str) == sorted(values, key=str)
    assert [(v.name, v.value) for v in got if v.id == 903] == [(".a", "\\ud800")]  # half a surrogate pair stays as written
    assert every_object(df.limit(0), ["id"], "text").collect() == [] == every_value(df.limit(0), ["id"], "text").collect()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize(("name", "sql"), [("p1_verdicts", P1_VERDICTS_SQL), ("p1_metrics", P1_METRICS_SQL)])
def test_fields_against_sql(spark, name, sql):
    """Field by field; duckdb writes inner JSON without blanks, so texts are compared as JSON values."""
    import duckdb

    query = entry.queries()[name](spark, SMALL).drop(*NODES)
    con = duckdb.connect()
    for p in ("results", "state"):
        con.execute(f"create view {p} as select * from '{SMALL}/{p}.parquet'")
    want = con.execute(f"select {', '.join(query.columns)} from ({sql})").fetchall()
    value = lambda x: json.dumps(json.loads(x), sort_keys=True) if isinstance(x, str) and x[:1] in ("{", "[") else x
    plain = lambda found: sorted((tuple(map(value, r)) for r in found), key=str)
    assert plain(map(tuple, query.collect())) == plain(want)
