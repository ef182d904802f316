"""The structural index against a plain parser, on random texts whole and broken."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from loomspan.operators import json_index as J


def value(r, depth=0):
    k = r.random()
    if depth > 3 or k < 0.35:
        return r.choice([1, -3, 0, 2.5, 1e30, None, True, False, "", "a", 'x"y', "\\", "\\\\", "é\n{[,:", "{}", "日本"])
    if k < 0.7:
        return {r.choice(["a", "b", 'c"', "d\\", "é", ""]) + str(i): value(r, depth + 1) for i in range(r.randint(0, 4))}
    return [value(r, depth + 1) for _ in range(r.randint(0, 4))]


def damage(s, r):
    k, i = r.random(), r.randint(0, len(s))
    if k < 0.5:
        return s
    if k < 0.7:
        return s[:i]
    return s[:i] + r.choice(list('{}[]:,"\\ \n\t01-.eEtn\x01')) + s[i:] if k < 0.85 else s[:i] + s[i + 1 :]


def readable(s):
    def no(_):
        raise ValueError

    try:
        json.loads(s, parse_constant=no)
        return True
    except ValueError:
        return False


def rebuilt(t, i):
    inner = np.flatnonzero((t.container == i) & t.is_value)
    if t.kind[i] == J.OBJ:
        return {json.loads(bytes(t.data[t.start[t.key[k]] : t.end[t.key[k]]])): rebuilt(t, k) for k in inner}
    if t.kind[i] == J.ARR:
        assert list(t.item[inner]) == list(range(len(inner)))
        return [rebuilt(t, k) for k in inner]
    return json.loads(bytes(t.data[t.start[i] : t.end[i]]))


@pytest.mark.parametrize("seed", range(8))
def test_index_is_the_parser(seed):
    r = random.Random(seed)
    for _ in range(30):
        texts = [None if r.random() < 0.03 else damage(json.dumps(value(r), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])), r) for _ in range(r.randint(0, 40))]
        t = J.index(pa.array(texts, pa.string()))
        for i, s in enumerate(texts):
            assert t.valid[i] == (s is not None and readable(s)), s
            if t.valid[i]:
                (top,) = np.flatnonzero((t.doc == i) & t.is_value & (t.container < 0))
                assert rebuilt(t, top) == json.loads(s)


def test_long_and_deep():
    texts = ["[" * 3000 + "]" * 3000, '"' + "x" * 1_000_000 + '"', "[" + ",".join(map(str, range(50_000))) + "]", "", " \n"]
    assert list(J.index(pa.array(texts)).valid) == [True, True, True, False, False]


def test_types_and_integers():
    t = J.index(pa.array(['{"a": 12, "b": 12.0, "c": "12", "d": null, "e": true, "f": [1], "g": {}, "h": -7}']))
    at = np.flatnonzero(t.is_value & (t.container == 0))
    assert list(J.type_names(t, at)) == ["integer", "number", "string", "null", "boolean", "array", "object", "integer"]
    assert list(J.span_integer(t.data, *J.inner_spans(t, at)))[:3] == [12, -1, 12]
    assert J.span_integer(t.data, *J.inner_spans(t, at))[7] == -7
