"""Deeply nested JSON texts into related flat tables.

The structural index (json_index) gives spans and containers of a whole batch; a path description picks
the objects and each comes out as a row that names its record and the outer objects it lies in: by numbers where
names are numbers, by the names as texts, and by the outer row's own number `node`, which no form of the names can blur.
every_object takes no description and gives all objects at any depth, with their paths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import json_index as J
from loomspan.sources.tables import map_arrow


@dataclass(frozen=True)
class Each:
    """Members of an object, or items of a list. column gets the member's name, or the item's field, as a whole number; named gets the same as text."""

    column: str
    field: str
    named: str = ""


@dataclass(frozen=True)
class Field:
    """The member of that name."""

    name: str


@dataclass(frozen=True)
class Items:
    """Items of a list with their place from 0 in column; a lone object has place 0 if lone is set. anywhere: of every list that is a member, whose name comes in named."""

    column: str
    lone: bool = False
    anywhere: bool = False
    named: str = ""


@dataclass(frozen=True)
class Members:
    """Members of an object. named gets the member's name as text."""

    named: str


@dataclass(frozen=True)
class Child:
    """A flat table: the objects that the steps lead to from the record's own value, and fields to give as text."""

    name: str
    steps: tuple
    fields: tuple[str, ...] = ()


ROW, OUTER = "row__", "outer__"
#: Columns of an object's own number in its record, objects counted from 0 in the order of the text, and of the outer row's; -1 for none.
NODES = ["node", "parent"]


def _named(t: J.Tokens, at: np.ndarray, name: str) -> np.ndarray:
    key = t.key[at]
    return at[(key >= 0) & J.span_equals(t.data, t.start[key] + 1, t.end[key] - 1, name)]


def _members(t: J.Tokens, values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of the containers, and the place in `of` of the container of each."""
    place = np.full(len(t.kind), -1, np.int64)
    place[of] = np.arange(len(of))
    owner = place[t.container[values]] if len(values) else np.zeros(0, np.int64)
    found = owner >= 0
    return values[found], owner[found]


def _select(t: J.Tokens, values: np.ndarray, child: Child, columns: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    at = np.flatnonzero(t.is_value & (t.container < 0) & t.valid[t.doc]) if len(t.kind) else np.zeros(0, np.int64)
    # ROW: the object that the last step into members or items led to; OUTER: the one before it
    links = {c: np.full(len(at), -1, np.int64) for c in columns} | {ROW: at, OUTER: np.full(len(at), -1, np.int64)}
    for step in child.steps:
        inner, owner = _members(t, values, at)
        if isinstance(step, Field):
            keep = np.isin(inner, _named(t, inner, step.name))
            inner, owner = inner[keep], owner[keep]
            links = {c: v[owner] for c, v in links.items()}
        elif isinstance(step, Each):
            keep = t.kind[inner] == J.OBJ
            inner, owner = inner[keep], owner[keep]
            links = {c: v[owner] for c, v in links.items()}
            key = t.key[inner]
            number = np.full(len(inner), -1, np.int64)
            by_name = np.flatnonzero(key >= 0)
            number[by_name] = J.span_integer(t.data, t.start[key[by_name]] + 1, t.end[key[by_name]] - 1)
            fields, of = _members(t, values, inner)
            own = np.isin(fields, _named(t, fields, step.field)) & (key[of] < 0)
            number[of[own]] = J.span_integer(t.data, *J.inner_spans(t, fields[own]))
            links[step.column] = number
            if step.named:
                token = key.copy()
                token[of[own]] = fields[own]
                links[step.named] = token
        elif isinstance(step, Members):
            keep = (t.kind[inner] == J.OBJ) & (t.key[inner] >= 0)
            inner, owner = inner[keep], owner[keep]
            links = {c: v[owner] for c, v in links.items()} | {step.named: t.key[inner]}
        else:
            if step.anywhere:
                named = (t.kind[inner] == J.ARR) & (t.key[inner] >= 0)
                lists, list_owner = inner[named], owner[named]
                inner, second = _members(t, values, lists)
                owner, lone = list_owner[second], np.zeros(0, np.int64)
            else:
                keep = t.kind[at[owner]] == J.ARR
                inner, owner = inner[keep], owner[keep]
                lone = np.flatnonzero(t.kind[at] == J.OBJ) if step.lone else np.zeros(0, np.int64)
            keep = t.kind[inner] == J.OBJ
            inner, owner = inner[keep], owner[keep]
            links = {c: np.concatenate([v[owner], v[lone]]) for c, v in links.items()}
            links[step.column] = np.concatenate([t.item[inner], np.zeros(len(lone), np.int64)])
            if step.anywhere and step.named:
                links[step.named] = t.key[t.container[inner]]
            inner = np.concatenate([inner, at[lone]])
        if not isinstance(step, Field):
            links |= {OUTER: links[ROW], ROW: inner}
        at = inner
    keep = t.kind[at] == J.OBJ
    return at[keep], {c: v[keep] for c, v in links.items()}


def texts(t: J.Tokens, at: np.ndarray) -> list[str | None]:
    """Values as text: strings decoded, null as None, all else as written. Escapes are rare and decoded alone."""
    out = J.gather(t.data, *J.inner_spans(t, at)).to_pylist()
    kinds = t.kind[at]
    null = (kinds == J.SCALAR) & (t.data[t.start[at]] == ord("n"))
    return [None if z else J.decoded(s) if k == J.STRING and "\\" in s else s for s, k, z in zip(out, kinds, null)]


def _numbers(t: J.Tokens, at: np.ndarray) -> np.ndarray:
    """Place of each object among its record's objects, -1 for what is no object."""
    objects = np.cumsum(t.kind == J.OBJ)
    first = np.searchsorted(t.doc, t.doc[np.maximum(at, 0)]) if len(at) else at
    before = np.concatenate([[0], objects])[first]
    return np.where((at >= 0) & (t.kind[np.maximum(at, 0)] == J.OBJ), objects[np.maximum(at, 0)] - 1 - before, -1) if len(at) else at


def flatten_nested(df: DataFrame, ids: list[str], text: str, children: list[Child], links: list[str], fields: list[str] | None = None, named: list[str] | None = None, nodes: bool = False) -> DataFrame:
    """Rows (ids..., child, links..., named..., fields...) of the objects that each child's steps lead to; with nodes also node and parent behind the links.

    A link that doesn't apply is -1, and null if it is one of named, which are texts. A text that is null or not one complete JSON text gives no rows, repeated
    rows count by themselves, a name that an object has twice gives a row for each, a field that is missing or
    null is null. Other columns of df are left out and may have any name. No shuffle: one pass over the input.
    """
    fields, named, numbers = fields or [], named or [], NODES if nodes else []
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ids] + ["child string"] + [f"`{c}` bigint" for c in [*links, *numbers]] + [f"`{c}` string" for c in [*named, *fields]])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        t = J.index(batch.column("__text"))
        values = np.flatnonzero(t.is_value & t.valid[t.doc] & (t.container >= 0)) if len(t.kind) else np.zeros(0, np.int64)
        parts = []
        for child in children:
            at, link = _select(t, values, child, [*links, *named])
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, link = at[order], {c: v[order] for c, v in link.items()}
            rows = pa.array(t.doc[at])
            columns = [batch.column(c).take(rows) for c in ids] + [pa.array([child.name]).take(pa.array(np.zeros(len(at), np.int64)))]
            columns += [pa.array(link[c]) for c in links]
            if nodes:
                columns += [pa.array(_numbers(t, at)), pa.array(_numbers(t, link[OUTER]))]
            for c in named:
                value = np.full(len(at), None, object)
                value[link[c] >= 0] = texts(t, link[c][link[c] >= 0])
                columns.append(pa.array(value, pa.string()))
            for name in fields:
                if name not in child.fields:
                    columns.append(pa.nulls(len(at), pa.string()))
                    continue
                inner, owner = _members(t, values, at)
                keep = np.isin(inner, _named(t, inner, name))
                value = np.full(len(at), None, object)
                value[owner[keep]] = texts(t, inner[keep])
                columns.append(pa.array(value, pa.string()))
            parts.append(pa.RecordBatch.from_arrays(columns, names=[*ids, "child", *links, *numbers, *named, *fields]))
        return pa.concat_batches(parts) if parts else None

    return map_arrow(df.select(*ids, F.col(text).alias("__text")), "__text", one, schema)


def _descend(t: J.Tokens) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """(tokens of all values, the nearest object around each or -1, paths within that object, and where whole paths are kept: containers and theirs)."""
    at = np.flatnonzero(t.is_value & (t.container < 0) & t.valid[t.doc]) if len(t.kind) else np.zeros(0, np.int64)
    values = np.flatnonzero(t.is_value & t.valid[t.doc] & (t.container >= 0)) if len(t.kind) else at
    around, inside, whole = np.full(len(at), -1, np.int64), pa.array([""] * len(at), pa.string()), pa.array([""] * len(at), pa.string())
    levels = [(at, around, inside, whole)]
    while len(at):
        inner, owner = _members(t, values, at)
        key = t.key[inner]
        of = np.maximum(key, 0)
        name = J.quoted(J.names(t.data, np.where(key >= 0, t.start[of] + 1, 0), np.where(key >= 0, t.end[of] - 1, 0)))
        item = pc.binary_join_element_wise("[", pa.array(t.item[inner]).cast(pa.string()), "]", "")
        step = pc.if_else(pa.array(key >= 0), pc.binary_join_element_wise(".", name, ""), item)
        by = pa.array(owner)
        fresh = t.kind[at][owner] == J.OBJ
        around = np.where(fresh, at[owner], around[owner])
        inside = pc.binary_join_element_wise(pc.if_else(pa.array(fresh), "", inside.take(by)), step, "")
        whole = pc.binary_join_element_wise(whole.take(by), step, "")
        at = inner
        levels.append((at, around, inside, whole))
    order = np.argsort(np.concatenate([x[0] for x in levels]), kind="stable")
    pick = lambda i: np.concatenate([x[i] for x in levels])[order]
    text = lambda i: pa.concat_arrays([x[i] for x in levels]).take(pa.array(order))
    return pick(0), pick(1), text(2), t.item, text(3)


def every_object(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids..., node, parent, path, item_no): all objects of each record at any depth, in lists of lists too.

    node counts a record's objects from 0, parent is that of the nearest object around, -1 for none; path reads .a[1].b, a name with other
    signs than letters, digits and _ of ASCII in quotes; item_no is the place in a list, -1 for a member. Texts that are null or
    not one complete JSON text give no rows; repeated rows and ids count by themselves. One pass, no shuffle.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        t = J.index(batch.column("__text"))
        at, around, _, item, whole = _descend(t)
        keep = np.flatnonzero(t.kind[at] == J.OBJ) if len(at) else at
        at, around = at[keep], around[keep]
        rows = pa.array(t.doc[at] if len(at) else at)
        columns = [batch.column(c).take(rows) for c in ids] + [pa.array(_numbers(t, at)), pa.array(_numbers(t, around)), whole.take(pa.array(keep))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.where(t.key[at] >= 0, -1, item[at]) if len(at) else at)], names=[*ids, *NODES, "path", "item_no"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ids] + ["node bigint, parent bigint, path string, item_no bigint"])
    return map_arrow(df.select(*ids, F.col(text).alias("__text")), "__text", one, schema)


def every_value(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids..., node, name, kind, value): all bare values of each record, with the node of the nearest object around (-1 for none) and the path from there.

    The other half of every_object: both joined by (ids, node) hold all that the texts hold. Strings are decoded; a null value has kind null. An empty list has no row.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        t = J.index(batch.column("__text"))
        at, around, inside, _, _ = _descend(t)
        keep = np.flatnonzero((t.kind[at] == J.STRING) | (t.kind[at] == J.SCALAR)) if len(at) else at
        at, around = at[keep], around[keep]
        if not len(at):
            return None
        names, codes = np.unique(J.type_names(t, at), return_inverse=True)
        columns = [batch.column(c).take(pa.array(t.doc[at])) for c in ids] + [pa.array(_numbers(t, around)), inside.take(pa.array(keep))]
        columns += [pa.array(names.tolist(), pa.string()).take(pa.array(codes)), pa.array(texts(t, at), pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*ids, "node", "name", "kind", "value"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ids] + ["node bigint, name string, kind string, value string"])
    return map_arrow(df.select(*ids, F.col(text).alias("__text")), "__text", one, schema)


#: Paths of an evaluation line's seeds and of a submission's metrics.
SEEDS = [
    Child("width", (Each("kfac", "kfac", "kfac_name"),), ("size", "pass")),
    Child("verdict", (Each("kfac", "kfac", "kfac_name"), Field("seeds"), Each("seed_no", "seed", "seed_name")), ("status", "reason", "metrics")),
    Child("cex", (Each("kfac", "kfac", "kfac_name"), Field("seeds"), Each("seed_no", "seed", "seed_name"), Field("cex"), Items("item_no", lone=True)), ("why", "kind", "size", "input", "expected", "got")),
]
METRICS = [Child("item", (Items("item_no", anywhere=True),), ("size", "itrs", "depth"))]
#: The same with the field's name, and the objects that are fields themselves.
METRIC_OBJECTS = [
    Child("item", (Items("item_no", anywhere=True, named="field"),), ("size", "itrs", "depth")),
    Child("field", (Members("field"),), ("v", "unit")),
]
LINKS = ["kfac", "seed_no", "item_no"]
#: The first two as texts, whatever they are.
NAMES = ["kfac_name", "seed_name"]
