"""Iteration to a fixpoint over DataFrames.

A round is a plan; ROUNDS of them are run as one job and written to the shared folder, which cuts lineage and
survives lost executors. The loop ends when a written state has no fresh row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import written
from loomspan.u24 import wrap

#: Rounds planned into one job.
ROUNDS = 3
#: Edges that a task works on at once.
CHUNK = 1 << 19
#: Larger than any value of a path.
NONE = np.iinfo(np.int64).max


class NoFixpoint(RuntimeError):
    """The limit of rounds was reached."""


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int | None = None, rounds: int = ROUNDS, quick: bool = False) -> DataFrame:
    """state with a boolean column `fresh`, stepped until no row is fresh. Raises NoFixpoint beyond limit rounds, if there is one.

    quick: the first job has one round alone, where most likely nothing changes.
    """
    done = 0
    if quick:
        state, done = step(state), 1
    state = written(state, "state")
    while not state.where("fresh").isEmpty():
        if limit is not None and done >= limit:
            raise NoFixpoint(f"still changing after {done} rounds")
        now = rounds if limit is None else min(rounds, limit - done)
        for _ in range(now):
            state = step(state)
        done += now
        state = written(state, "state")
    return state.drop("fresh")


def improve(state: DataFrame, offers: DataFrame, keys: list[str], value: str, least: bool = True) -> DataFrame:
    """Best of state and offers for each key; fresh where an offer is better than what was there, or new."""
    best = F.min if least else F.max
    both = state.select(*keys, value, F.col(value).alias("old")).unionByName(offers.select(*keys, value, F.lit(None).cast(state.schema[value].dataType).alias("old")))
    merged = both.groupBy(*keys).agg(best(value).alias(value), best("old").alias("old"))
    return merged.select(*keys, value, (F.col("old").isNull() | (F.col(value) != F.col("old"))).alias("fresh"))


#: How a path's value d grows over an edge of weight w, for Spark and for numpy.
GROWTH = {
    "sum": (lambda d, w: d + w, np.add),
    "most": (lambda d, w: F.greatest(d, w), np.maximum),
    "same": (lambda d, w: d, lambda d, w: d),
}


def relax(edges: DataFrame, sources: DataFrame, extend: str | Callable[[Column, Column], Column], least: bool = True, most: int | None = None) -> DataFrame:
    """(g, s, v, d): best value over all paths from each source (g, s, d) along edges (g, u, v, w).

    extend(d, w), or what GROWTH names, is a path's value over one edge more and must not better it; values above `most` are pruned inside the
    loop. Each source's own vertex has its given d. Values that GROWTH names are worked out for whole graphs by tasks, as long as
    a graph has at most CHUNK edges and sources; larger ones, and other values, go through rounds of joins.
    """
    if not isinstance(extend, str) or not least:
        return _by_joins(edges, sources, GROWTH[extend][0] if isinstance(extend, str) else extend, least, most)
    size = edges.select("g").unionByName(sources.select("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    large = written(size.where(F.col("n") > CHUNK).select("g"), "large")
    if large.isEmpty():
        return _by_graph(edges, sources, extend, most)
    small = _by_graph(edges.join(large, "g", "left_anti"), sources.join(large, "g", "left_anti"), extend, most)
    return small.unionByName(_by_joins(edges.join(large, "g", "left_semi"), sources.join(large, "g", "left_semi"), GROWTH[extend][0], True, most))


def _by_joins(edges: DataFrame, sources: DataFrame, extend: Callable[[Column, Column], Column], least: bool, most: int | None) -> DataFrame:
    def step(state: DataFrame) -> DataFrame:
        ahead = state.where("fresh").select("g", "s", F.col("v").alias("u"), "d").join(edges, ["g", "u"])
        offers = ahead.select("g", "s", "v", extend(F.col("d"), F.col("w")).alias("d"))
        if most is not None:
            offers = offers.where(F.col("d") <= most)
        return improve(state, offers, ["g", "s", "v"], "d", least)

    start = sources.select("g", "s", F.col("s").alias("v"), F.col("d"), F.lit(True).alias("fresh"))
    return fixpoint(start, step)


def _by_graph(edges: DataFrame, sources: DataFrame, extend: str, most: int | None) -> DataFrame:
    """relax for graphs that fit a task: graphs side by side as one, the sources of equal number in their graphs at once."""
    grow = GROWTH[extend][1]
    kind = {f.name: f.dataType.simpleString() for f in edges.schema.fields}["g"]

    def one(table: pa.Table) -> pa.RecordBatch:
        g = table.column("g").combine_chunks().dictionary_encode()
        g, graph = g.dictionary, g.indices.to_numpy().astype(np.int64)
        a, b, w = (table.column(c).to_numpy() for c in ("u", "v", "w"))
        edge = table.column("edge").to_numpy(zero_copy_only=False)
        node = _nodes(np.concatenate([graph, graph[edge]]), np.concatenate([a, b[edge]]))
        of_graph, name, at = node
        a, b = at[: len(graph)], at[len(graph) :]
        order = np.argsort(a[edge], kind="stable")
        tail, head, weight = a[edge][order], b[order], w[edge][order]
        first = np.searchsorted(tail, np.arange(len(name) + 1))
        src, given, by = a[~edge], w[~edge], graph[~edge]
        rank = np.argsort(by, kind="stable")
        layer = np.empty(len(src), np.int64)
        layer[rank] = np.arange(len(src)) - np.searchsorted(by[rank], by[rank])
        out: list[tuple] = []
        best = np.full(len(name), NONE)
        for i in range(layer.max(initial=-1) + 1):
            here = np.flatnonzero(layer == i)
            best[src[here]] = given[here]
            front, reached = src[here], [src[here]]
            while len(front):
                count = first[front + 1] - first[front]
                arcs = np.repeat(first[front] - np.cumsum(count) + count, count) + np.arange(count.sum())
                value, to = grow(np.repeat(best[front], count), weight[arcs]), head[arcs]
                good = value < best[to]
                if most is not None:
                    good &= value <= most
                value, to = value[good], to[good]
                np.minimum.at(best, to, value)
                front = np.unique(to)
                reached.append(front)
            found = np.unique(np.concatenate(reached))
            source = np.zeros(len(g), np.int64)
            source[by[here]] = name[src[here]]
            out.append((of_graph[found], source[of_graph[found]], name[found], best[found]))
            best[found] = NONE
        at, s, v, d = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        return pa.RecordBatch.from_arrays([g.take(pa.array(at)), pa.array(s), pa.array(v), pa.array(d)], names=["g", "s", "v", "d"])

    def run(batches):  # noqa: ANN001, ANN202
        """Whole graphs, as many as make a chunk."""
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                if rows < CHUNK:
                    held.append(batch)
                    rows += batch.num_rows
                    break
                last = held[-1].column("g")[-1]  # the chunk is full: take the rest of its last graph and close it
                same = np.flatnonzero(~pc.equal(batch.column("g"), last).to_numpy(zero_copy_only=False))
                cut = int(same[0]) if len(same) else batch.num_rows
                held.append(batch.slice(0, cut))
                batch = batch.slice(cut)
                if batch.num_rows:
                    yield one(pa.Table.from_batches(held))
                    held, rows = [], 0
        if held:
            yield one(pa.Table.from_batches(held))

    arcs = edges.select("g", F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"), F.col("w").cast("bigint").alias("w"), F.lit(True).alias("edge"))
    starts = sources.groupBy("g", F.col("s").cast("bigint").alias("u")).agg(F.min("d").cast("bigint").alias("w"))
    starts = starts.select("g", "u", F.col("u").alias("v"), "w", F.lit(False).alias("edge"))
    rows = arcs.unionByName(starts).where("g is not null").repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(run, f"`g` {kind}, s bigint, v bigint, d bigint")


def pointer_jump(pointers: DataFrame, rounds: int) -> DataFrame:
    """(g, v, p): each pointer followed 2 ** rounds times."""
    for _ in range(rounds):
        onward = pointers.select("g", F.col("v").alias("p"), F.col("p").alias("q"))
        pointers = pointers.join(onward, ["g", "p"]).select("g", "v", F.col("q").alias("p"))
    return pointers


def resolve(pointers: DataFrame, limit: int = 64) -> tuple[DataFrame, DataFrame]:
    """((g, v, root), (g, v) that never reach a root): pointer doubling until nothing moves.

    A chain of n pointers takes log2 n doublings; a pointer that still doesn't rest after as many doublings as
    there are bits in the number of pointers is caught in a cycle.
    """
    own = pointers.select("g", F.col("v").alias("p"), (F.col("p") == F.col("v")).alias("rests"))  # a doubled pointer can also end at itself on a cycle
    size = pointers.count()
    doublings, done = max(size, 1).bit_length() + 1, 0
    while done < min(doublings, limit):
        step = min(3, doublings - done)
        pointers, done = written(pointer_jump(pointers, step), "pointers"), done + step
    state = pointers.join(own, ["g", "p"])
    return state.where("rests").select("g", "v", F.col("p").alias("root")), state.where("not rests").select("g", "v")


# --- graphs in a task ---------------------------------------------------------------------------------


def _nodes(g: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(graph and id of each different node, ascending; which of them each pair is)."""
    order = np.lexsort((v, g))
    new = np.ones(len(g), bool)
    new[1:] = (np.diff(g[order]) != 0) | (np.diff(v[order]) != 0)
    at = np.empty(len(g), np.int64)
    at[order] = np.cumsum(new) - 1
    return g[order][new], v[order][new], at


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is connected with by the pairs: roots hook to smaller ones, paths are cut short, until no pair joins two roots."""
    parent = np.arange(n)
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(parent, b, a)
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def by_chunks(edges: DataFrame, columns: list[str], kernel: Callable[..., list[np.ndarray]], names: list[str]) -> DataFrame:
    """kernel over chunks of about CHUNK edges, given as arrays column by column; its arrays become the columns names, with the chunk's number.

    Edges come together by g; a partition that grows too large is split, and a chunk may hold several graphs or part of one.
    """

    def run(batches):  # noqa: ANN001, ANN202
        task, n, held, rows = TaskContext.get().partitionId() << 32, 0, [], 0

        def chunk() -> pa.RecordBatch:
            out = kernel(*[np.concatenate([b.column(c).to_numpy() for b in held]) for c in columns])
            number = np.full(len(out[0]), task + n, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64, copy=False)) for x in (*out, number)], names=[*names, "chunk"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= CHUNK:
                yield chunk()
                n, held, rows = n + 1, [], 0
        if held:
            yield chunk()

    rows = edges.select(*[F.col(c).cast("bigint").alias(c) for c in columns]).dropna()
    return rows.hint("rebalance", "g").mapInArrow(run, ", ".join(f"{c} bigint" for c in [*names, "chunk"]))


def contracted(edges: DataFrame) -> DataFrame:
    """(g, u, v, chunk): edges with the same components, at most one for each vertex of a chunk: each vertex v to the least one, u, that the chunk's edges join it with.

    A graph of any size costs bounded memory. A graph within a chunk is done with; chunks of a larger one are joined by the loop that follows.
    """

    def forest(g: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        graph, name, at = _nodes(np.concatenate([g, g]), np.concatenate([u, v]))
        root = _joined(len(name), at[: len(g)], at[len(g) :])
        inner = np.flatnonzero(root != np.arange(len(name)))
        return [graph[inner], name[root[inner]], name[inner]]

    return by_chunks(edges.where("u <> v"), ["g", "u", "v"], forest, ["g", "u", "v"])


def in_chunks(rows: DataFrame) -> DataFrame:
    """(g): graphs of rows (g, chunk) that more than one chunk holds a part of, written."""
    return written(rows.groupBy("g").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select("g"), "large")


def components(vertices: DataFrame, edges: DataFrame, largest: bool = False) -> DataFrame:
    """(g, v, label): the least (or largest) id of each vertex's connected component; edges (g, u, v) count both ways.

    Edges are contracted by chunks first. Then labels pass along what is left and through the labels themselves, so that
    paths shorten by half each round.
    """
    stars = written(contracted(edges), "stars")
    large = in_chunks(stars)
    labelled = lambda v, e: v.select("g", "v").join(e.select("g", "v", F.col("u").alias("to")), ["g", "v"], "left").select("g", "v", F.coalesce("to", "v").alias("label"))
    if large.isEmpty():
        found = labelled(vertices, stars)
    else:
        done = labelled(vertices.join(large, "g", "left_anti"), stars.join(large, "g", "left_anti"))
        found = done.unionByName(_by_labels(vertices.join(large, "g", "left_semi"), stars.join(large, "g", "left_semi").select("g", "u", "v")))
    if not largest:
        return found
    top = found.groupBy("g", "label").agg(F.max("v").alias("top"))
    return found.join(top, ["g", "label"]).select("g", "v", F.col("top").alias("label"))


def _by_labels(vertices: DataFrame, stars: DataFrame) -> DataFrame:
    """components of graphs that several chunks hold parts of."""
    both = stars.unionByName(stars.select("g", F.col("v").alias("u"), F.col("u").alias("v")))

    def step(state: DataFrame) -> DataFrame:
        seen = state.select("g", F.col("v").alias("u"), F.col("label"))
        offers = both.join(seen, ["g", "u"]).select("g", "v", "label", F.lit(None).cast("bigint").alias("old"))
        merged = state.select("g", "v", "label", F.col("label").alias("old")).unionByName(offers).groupBy("g", "v").agg(F.min("label").alias("hook"), F.min("old").alias("old")).where("old is not null")
        onward = merged.select("g", F.col("v").alias("hook"), F.col("hook").alias("next"))
        return merged.join(onward, ["g", "hook"]).select("g", "v", F.col("next").alias("label"), (F.col("next") != F.col("old")).alias("fresh"))

    least = stars.groupBy("g", "v").agg(F.min("u").alias("to"))
    start = vertices.select("g", "v").join(least, ["g", "v"], "left").select("g", "v", F.coalesce("to", "v").alias("label"), F.lit(True).alias("fresh"))
    return fixpoint(start, step, quick=True)


# --- messages -----------------------------------------------------------------------------------------

#: Combiners of messages that meet at a vertex.
COMBINE = {"min": F.min, "max": F.max, "or": lambda c: F.call_function("bit_or", c), "add": lambda c: wrap(F.sum(c))}


def frontier(
    state: DataFrame, edges: DataFrame, inbox: DataFrame, act: Callable[[Column, Column], tuple[Column, Column, Column]],
    message: Callable[[Column, Column], Column], combine: str | Callable[[Column], Column], rounds: int | None = None,
) -> DataFrame:
    """(g, v, d): state after messages have gone along edges (g, u, v, w) until none is sent, or for so many rounds.

    inbox (g, v, c) are the first messages. A vertex with a message acts: act(d, c) gives its new state, whether it sends, and what m it
    sends; message(m, w) goes along each of its edges, and what meets at a vertex is combined before the next round: min, max, or, add
    (wrapping), or an aggregate of one's own. A vertex without a message rests, so that waves cost what they touch. Messages to
    vertices that state doesn't hold are lost.
    """
    merge = COMBINE[combine] if isinstance(combine, str) else combine
    done = 0
    while (rounds is None or done < rounds) and not inbox.isEmpty():
        acted = act(F.col("d"), F.col("c"))
        met = written(state.join(inbox, ["g", "v"]).select("g", "v", *[x.alias(n) for x, n in zip(acted, ("d", "sends", "m"))]), "acted")
        sent = met.where("sends").select("g", F.col("v").alias("u"), "m").join(edges, ["g", "u"])
        inbox = written(sent.groupBy("g", "v").agg(merge(message(F.col("m"), F.col("w"))).alias("c")), "inbox")
        new = met.select("g", "v", F.col("d").alias("d2"), F.lit(True).alias("acted"))
        state = state.join(new, ["g", "v"], "left").select("g", "v", F.when(F.col("acted"), F.col("d2")).otherwise(F.col("d")).alias("d"))
        state, done = written(state, "state"), done + 1
    return state
