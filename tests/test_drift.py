import json

from loomspan.operators import drift

SCHEMA = "shard int, batch_no int, attempt_id bigint, metrics string, kind string"


def changes(spark, rows):
    df = spark.createDataFrame([(*r[:3], json.dumps(r[3]) if isinstance(r[3], dict) else r[3], "k") for r in rows], SCHEMA)
    return sorted(map(tuple, drift.changes(df, "shard", "batch_no", "attempt_id", "metrics").collect()))


def test_added_removed_retyped(spark):
    rows = [(0, 0, i, {"a": 1, "b": 2}) for i in range(5)] + [(0, 1, 9 + i, {"a": 1.0, "c": None}) for i in range(5)]
    assert changes(spark, rows) == [(0, 1, "a", "retyped"), (0, 1, "b", "removed"), (0, 1, "c", "added")]


def test_renamed_needs_equal_values(spark):
    one = [(0, 0, 1, {"a": 1, "z": 5}), (0, 0, 2, {"a": 2, "z": 6})]
    assert changes(spark, [*one, (0, 1, 1, {"b": 1, "z": 5}), (0, 1, 3, {"b": 7, "z": 6})]) == [(0, 1, "b", "renamed")]
    assert changes(spark, [*one, (0, 1, 1, {"b": 2, "z": 5})]) == [(0, 1, "a", "removed"), (0, 1, "b", "added")]
    assert changes(spark, [*one, (0, 1, 1, {"b": 1.0, "z": 5})]) == [(0, 1, "a", "removed"), (0, 1, "b", "added")]
    assert changes(spark, [(0, 0, 1, {"a": None}), (0, 1, 1, {"b": None})]) == [(0, 1, "a", "removed"), (0, 1, "b", "added")]


def test_a_fifth_and_gaps(spark):
    rows = [(1, 3, i, {"a": 1} | ({"b": 1} if i == 0 else {})) for i in range(5)] + [(1, 7, 50 + i, {"a": 1} | ({"b": 1} if i == 0 else {})) for i in range(6)]
    assert changes(spark, rows) == [(1, 7, "b", "removed")]


def test_dirt(spark):
    rows = [(0, 0, 1, {"a": 1}), (0, 1, 1, None), (0, 1, 2, "{cut"), (0, 1, 2, "[1]"), (0, 2, None, {"a": "x"}), (None, 2, 1, {"q": 1}), (0, None, 1, {"q": 1})]
    assert changes(spark, rows) == [(0, 2, "a", "retyped")]
    assert changes(spark, []) == []


def test_ties_and_repeats(spark):
    rows = [(0, 0, 1, {"a": 1}), (0, 0, 1, {"a": 1}), (0, 1, 5, {"a": "x"}), (0, 1, 6, {"a": 1})]
    assert changes(spark, rows) == []  # integer comes before string


def test_typed_table(spark):
    df = spark.createDataFrame([(1, '{"a": 12, "b": 12.0, "c": "12", "d": null, "e": true, "f": [1], "g": 99999999999999999999, "h": ""}', 5)], "row_id bigint, metrics string, field int")
    got = {r.field: (r.kind, r.as_integer, r.as_number, r.as_boolean, r.as_text, r.as_json) for r in drift.typed_table(df, ["row_id"], "metrics").collect()}
    assert got["a"] == ("integer", 12, 12.0, None, "12", None)
    assert got["b"] == ("number", None, 12.0, None, "12", None)
    assert got["c"] == ("string", None, None, None, "12", None)
    assert got["d"] == ("null", None, None, None, None, None)
    assert got["e"] == ("boolean", None, None, True, "true", None)
    assert got["f"] == ("array", None, None, None, "[1]", "[1]")
    assert got["g"][:3] == ("integer", None, 1e20)
    assert got["h"] == ("string", None, None, None, "", None)


def test_one_name_through_renames(spark):
    rows = [(0, 0, i, {"a": i + 1, "z": 1}) for i in range(4)] + [(0, 1, i, {"b": i + 1, "z": 1}) for i in range(3)] + [(0, 2, i, {"c": i + 1, "z": 1}) for i in range(3)]
    rows += [(1, 0, 9, {"d": 1}), (1, 1, 9, {"c": 1}), (None, 1, 9, {"q": 1})]
    df = spark.createDataFrame([(*r[:3], json.dumps(r[3]), "k") for r in rows], SCHEMA)
    names = {r.field: r["name"] for r in drift.canonical_names(df, "shard", "batch_no", "attempt_id", "metrics").collect()}
    assert names == {"a": "a", "b": "a", "c": "a", "d": "a", "z": "z"}
    out = drift.consistent_table(df, ["attempt_id"], "shard", "batch_no", "attempt_id", "metrics").collect()
    assert len(out) == 23 and sum(r["name"] == "a" for r in out) == 12
    assert drift.consistent_table(df.limit(0), ["attempt_id"], "shard", "batch_no", "attempt_id", "metrics").collect() == []


def test_values_at_any_depth(spark):
    rows = [(0, 0, 1, {"ms": 12, "z": 1}), (0, 0, 2, {"ms": 3, "z": 1}), (0, 1, 1, {"t": 12, "z": {"v": 12, "unit": "ms"}}), (0, 1, 2, {"t": 3, "z": [{"a.b": 1.0}, [2, "x"]]})]
    df = spark.createDataFrame([(*r[:3], json.dumps(r[3]), "k") for r in rows], SCHEMA)
    out = drift.consistent_table(df, ["attempt_id", "batch_no"], "shard", "batch_no", "attempt_id", "metrics").where("batch_no = 1").collect()
    assert sorted((r.attempt_id, r["at"], r.path, r.kind, r.as_text) for r in out) == [
        (1, "t", "ms", "integer", "12"), (1, "z", "z", "object", '{"v": 12, "unit": "ms"}'), (1, "z.unit", "z.unit", "string", "ms"), (1, "z.v", "z.v", "integer", "12"),
        (2, "t", "ms", "integer", "3"), (2, "z", "z", "array", '[{"a.b": 1.0}, [2, "x"]]'), (2, "z[0]", "z[]", "object", '{"a.b": 1.0}'), (2, 'z[0]."a.b"', 'z[]."a.b"', "number", "1"),
        (2, "z[1]", "z[]", "array", '[2, "x"]'), (2, "z[1][0]", "z[][]", "integer", "2"), (2, "z[1][1]", "z[][]", "string", "x"),
    ]


def test_rare_alternatives_are_reported_when_new(spark):
    rows = [(0, 0, i, {"a": 1, "l": [{"x": 1}]}) for i in range(9)] + [(0, 2, i, {"a": 1, "l": [{"x": 1}, {"x": "?"}]}) for i in range(8)]
    rows += [(0, 2, 20, {"a": {"v": 1}}), (0, 3, 1, {}), (0, 4, 1, {"a": 1}), (0, 1, 1, "{cut"), (None, 5, 1, {"q": 1})]
    df = spark.createDataFrame([(*r[:3], json.dumps(r[3]) if isinstance(r[3], dict) else r[3], "k") for r in rows], SCHEMA)
    got = sorted(map(tuple, drift.new_types(df, "shard", "batch_no", "metrics").collect()))
    assert got == [
        (0, 2, "a", "object", 1, 9, 9, False), (0, 2, "a.v", "integer", 1, 1, 9, True), (0, 2, "l[].x", "string", 8, 16, 9, False),
        (0, 4, "a", "integer", 1, 1, 1, True),
    ]
    assert drift.new_types(df.limit(0), "shard", "batch_no", "metrics").collect() == []
