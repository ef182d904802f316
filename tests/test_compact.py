import datetime as dt
import json

import pytest
import zstandard

from loomspan.operators import compact as C

SCHEMA = "file_id bigint, file_path string, modified_at timestamp_ntz, content string"


def at(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(minutes=n)


def record(run, *status, **more):
    return json.dumps({"pid": 'a"}{', "run_id": run, "attempts": [{"kind": "k", "status": s} for s in status], **more})


def files(spark, *contents):
    return spark.createDataFrame([(i, f"f{i}", at(i), c) for i, c in enumerate(contents)], SCHEMA)


def attempts(spark, *contents):
    return sorted(map(tuple, C.consolidated_attempts(C.compact(files(spark, *contents))).collect()))


def test_round_trip(spark):
    contents = [None, "", "\n", "a", "a\n", "﻿{}", "é" * 5, "x" * 3_000_000, "a"]
    back = C.unpack(C.compact(files(spark, *contents), 1000)).collect()
    assert sorted((r.file_id, None if r.content is None else r.content.decode()) for r in back) == list(enumerate(contents))
    assert sorted(r.modified_at for r in back) == [at(i) for i in range(len(contents))]


def test_records_in_any_layout(spark):
    cut = record(7, "x", "y")[:-12]
    got = attempts(
        spark,
        record(1, "pass", "fail"),
        json.dumps(json.loads(record(2, "pass")), indent=1),
        "[" + record(3, "a") + ", " + record(4, "b") + ", " + cut,
        record(5, "a") + "\n" + cut + "\n" + record(6, "b") + "\n\n",
        "﻿" + record(8, "c"),
        cut[: cut.index('"pid"') + 9] + "\n" + json.dumps(json.loads(record(9, "d")), indent=2),
        "attempts: see state.json", "null", "{}", "[]", None, "",
    )
    assert got == [(1, 1, "pass"), (1, 2, "fail"), (2, 1, "pass"), (3, 1, "a"), (4, 1, "b"), (5, 1, "a"), (6, 1, "b"), (8, 1, "c"), (9, 1, "d")]


def test_latest_record_counts(spark):
    got = attempts(spark, record(1, "old"), record(2, "one"), record(1, "new", "newer"), record(2), record(1, "cut")[:-1], record(1, "older")[:-1])
    assert got == [(1, 1, "new"), (1, 2, "newer")]


def test_ties_nulls_and_odd_fields(spark):
    same = spark.createDataFrame([(1, "a", at(0), record(1, "a")), (2, "b", at(0), record(1, "b")), (2, "b", at(0), record(1, "b")), (3, "c", None, record(2, None))], SCHEMA)
    assert sorted(map(tuple, C.consolidated_attempts(C.compact(same)).collect()), key=str) == [(1, 1, "b"), (2, 1, None)]
    got = attempts(spark, '{"run_id": null, "attempts": [{"status": "a"}]}', '{"run_id": 3, "attempts": null}', '{"run_id": 4, "attempts": [{}, 5, {"status": "\\u00e9"}], "old": {"run_id": 9, "attempts": [{"status": "z"}]}}')
    assert got == [(4, 1, None), (4, 2, "é")]


def test_empty_table(spark):
    assert attempts(spark) == []


def test_damage_is_noticed(spark):
    frame = zstandard.ZstdCompressor(write_content_size=True).compress(b"abc")
    assert C.open_frame(frame, 3, C.checksum(b"abc")) == b"abc"
    with pytest.raises(ValueError):
        C.open_frame(frame, 3, C.checksum(b"abd"))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        C.concat_frames([frame[:-2]])
    assert zstandard.ZstdDecompressor().stream_reader(C.concat_frames([frame, frame]), read_across_frames=True).read() == b"abcabc"


def test_export(spark, tmp_path):
    out = C.export(C.compact(files(spark, "a", "b\n", "c")), str(tmp_path / "packs")).collect()
    assert sum(r.n_files for r in out) == 3
    raw = b"".join(zstandard.ZstdDecompressor().stream_reader((tmp_path / "packs" / p).read_bytes(), read_across_frames=True).read() for p in sorted(x.name for x in (tmp_path / "packs").iterdir()))
    assert sorted(raw.split()) == [b"a", b"b", b"c"]


def test_packs_with_a_destination(spark, tmp_path):
    where = str(tmp_path / "packs")
    C.compact(files(spark, "a\n", "", None), folder=where)
    assert sorted(r.content for r in C.unpack(spark.read.parquet(where)).collect() if r.content is not None) == [b"", b"a\n"]
