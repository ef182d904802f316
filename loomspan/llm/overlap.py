"""Same or nearly same records across splits.

Records are canonicalised (case, punctuation, white space, comments, order of definitions) and hashed; equal
records are joined by that hash. Nearly same ones share one of their rarest names or numbers: with at least
SIMILARITY of the larger record's tokens in common, the rarest tokens of both, as many as may differ and one
more, must meet, whatever order is used. So hashes of those are joined and each meeting is checked exactly.

Two hashes of 128 bits stand for a record: `whole` for its names and numbers with their counts, in which nearness is
told and by which copies fall into one class, and `exact` for the canonical text, in which equality is told.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.tokenize import distinct_words
from loomspan.session import written
from loomspan.sources.tables import map_arrow

#: Share of the larger record's names and numbers that both must hold.
SIMILARITY = 0.8
#: Places of the table of token counts (1 MB, whatever the corpus); it sets the order in which tokens are tried.
SKETCH = 1 << 17
#: Pairs that one task joins of a hot key.
PAIRS_A_TASK = 1 << 20

_FENCE = re.compile(r"```[^\n]*\n(.*?)(?:```|\Z)", re.S)
#: Records of a batch stand in one string, this sign between them.
_BETWEEN = "\x1e"
_COMMENT = re.compile(r"//[^\n\x1e]*|/\*[^\x1e]*?(?:\*/|(?=\x1e))|#[^\n\x1e]*")


def net_text(content: str | None) -> str:
    """The net in a text: what is inside code fences, or else all from the first definition on."""
    if not content:
        return ""
    blocks = _FENCE.findall(content)
    return "\n".join(blocks) if blocks else content[content.find("@") :] if "@" in content else ""


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _word_signs() -> np.ndarray:
    """Which code points names and numbers are made of."""
    return np.array([c == 95 or chr(c).isalnum() for c in range(0x110000)])


def token_spans(nets: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, end, row, definition) of the names and numbers of all nets, in lower case and without comments.

    definition: whether the token begins one, as the name in @name = ... does.
    """
    body = _COMMENT.sub(" ", _BETWEEN.join(n.replace(_BETWEEN, " ") for n in nets).lower() + _BETWEEN)
    data = np.frombuffer(body.encode("utf-8", "surrogatepass"), np.uint8)
    if body.isascii():
        signs, lead = _word_signs()[data], None
    else:
        code = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
        signs, lead = _word_signs()[code], np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    edge = np.flatnonzero(np.diff(signs, prepend=False, append=False))
    edge = edge if lead is None else lead[edge]
    begin, end = edge[::2], edge[1::2]
    row = np.searchsorted(np.flatnonzero(data == ord(_BETWEEN)), begin)
    named = (begin > 0) & (data[np.maximum(begin - 1, 0)] == ord("@"))
    solid = np.flatnonzero((data != 32) & (data != 10) & (data != 9) & (data != 13))
    ahead = solid[np.minimum(np.searchsorted(solid, end), len(solid) - 1)] if len(solid) else end
    return data, begin, end, row, named & (data[np.minimum(ahead, len(data) - 1)] == ord("="))


def _summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, np.uint64)


def _firsts(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.diff(groups, prepend=-1)) if len(groups) else groups


def _key(low: np.ndarray, high: np.ndarray) -> pa.Array:
    both = np.ascontiguousarray(np.stack([low, high], 1)).view(np.uint8)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(low), [None, pa.py_buffer(both)]).cast(pa.binary())


def _signatures(nets: list[str]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Rows with tokens, and their columns whole, exact, n, tokens (hashes ascending) and times."""
    data, begin, end, row, opens = token_spans(nets)
    words, which = distinct_words(data, begin, end)
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    low, high = raw[:, 0], raw[:, 1]
    rows = row[_firsts(row)]
    # names and numbers with their counts: a sum of mixed values, whatever their order
    each, count = np.unique(row * max(len(words), 1) + which, return_counts=True)
    of, token = each // max(len(words), 1), each % max(len(words), 1)
    by_hash = np.lexsort((low[token], of))
    token, count = token[by_hash], count[by_hash]
    times, first = count.astype(np.uint64), _firsts(of)
    whole = [_summed(_mix(h[token] + times * np.uint64(k)), first) for h, k in ((low, 0x632BE59BD9B4E019), (high, 0x8CB92BA72F3D8DD7))]
    # the canonical text: tokens with their places, definition by definition, these in any order
    start = opens.copy()
    start[_firsts(row)] = True
    part = np.cumsum(start)
    place = (np.arange(len(row)) - np.flatnonzero(start)[part - 1]).astype(np.uint64) if len(row) else times
    parts = _firsts(part)
    exact = [
        _summed(_mix(_summed(_mix(h[which] ^ _mix(place + np.uint64(k))), parts)), _firsts(row[parts])) for h, k in ((low, 1), (high, 1 << 40))
    ]
    offsets = pa.array(np.append(first, len(of)).astype(np.int32))
    return rows, {
        "whole": _key(*whole), "exact": _key(*exact), "n": pa.array(np.diff(np.append(_firsts(row), len(row))).astype(np.int32)),
        "tokens": pa.ListArray.from_arrays(offsets, pa.array(low[token].view(np.int64))), "times": pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32))),
    }


SIGNATURE = "whole binary, exact binary, n int, tokens array<bigint>, times array<int>"


def signatures(df: DataFrame, ids: list[str], content: str) -> DataFrame:
    """(ids..., whole, exact, n, tokens, times): canonical form of each record. Null, blank and tokenless content gives no row."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, columns = _signatures([net_text(t) for t in batch.column("__text").to_pylist()])
        if not len(rows):
            return None
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ids], *columns.values()], names=[*ids, *columns])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ids] + [SIGNATURE])
    return map_arrow(df.select(*ids, F.col(content).alias("__text")), "__text", one, schema)


def _ragged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Items of all lists and the row of each."""
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _occurrences(tokens: pa.Array, times: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each occurrence of each token of a batch, as a hash of its own, (token, 0), (token, 1), ..., and the row it is of."""
    token, row = _ragged(tokens)
    count = times.flatten().to_numpy()
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return _mix(np.repeat(token.view(np.uint64), count) + nth.astype(np.uint64) * np.uint64(1_000_003)), np.repeat(row, count)


def _counts(records: DataFrame) -> np.ndarray:
    """How many records hold a token occurrence, by SKETCH places of its hash: a table of fixed size, summed by task first."""
    sketch = SKETCH

    def run(batches):  # noqa: ANN001, ANN202
        total = np.zeros(sketch, np.int64)
        for batch in batches:
            each, _ = _occurrences(batch.column("tokens"), batch.column("times"))
            total += np.bincount((each % np.uint64(sketch)).astype(np.int64), minlength=sketch)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total[place])], names=["place", "n"])

    found = records.select("tokens", "times").mapInArrow(run, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(sketch, np.int64)
    total[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return total


RARE = "whole binary, n int, is_train boolean, meet bigint, at int, often boolean"


def _rarest(records: DataFrame, similarity: float) -> DataFrame:
    """(whole, n, is_train, meet, at, often): hashes of each record's rarest token occurrences, as many as may differ and one more, with their place in that order.

    An occurrence that no other record holds meets nothing and is left out; copies in one batch come out once. often: so many
    records hold it that its pairs have to be counted.
    """
    counts = records.sparkSession.sparkContext.broadcast(_counts(records))
    sketch, many = SKETCH, int(2 * PAIRS_A_TASK**0.5)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            if not batch.num_rows:
                continue
            each, row = _occurrences(batch.column("tokens"), batch.column("times"))
            held = counts.value[(each % np.uint64(sketch)).astype(np.int64)]
            size = np.bincount(row, minlength=batch.num_rows)
            take = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
            order = np.lexsort((each, held, row))
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            keys = pa.chunked_array([batch.column("whole")]).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            kind = keys * 2 + batch.column("is_train").to_numpy(zero_copy_only=False)
            new = np.zeros(batch.num_rows, bool)
            new[np.unique(kind, return_index=True)[1]] = True
            good = (place < take[row]) & (held[order] > 1) & new[row]  # row is ascending, so it is the same in this order
            picked, at = order[good], place[good]
            of = pa.array(row[picked])
            columns = [batch.column(c).take(of) for c in ("whole", "n", "is_train")]
            columns += [pa.array(each[picked].view(np.int64)), pa.array(at.astype(np.int32)), pa.array(held[picked] > many)]
            yield pa.RecordBatch.from_arrays(columns, names=["whole", "n", "is_train", "meet", "at", "often"])

    return records.select("whole", "n", "is_train", "tokens", "times").mapInArrow(run, RARE)


def _checked(pairs: DataFrame, similarity: float) -> DataFrame:
    """Of (a, b, na, nb, ta, ca, tb, cb) those whose tokens t with counts c have enough in common."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            (one, row), (other, row2) = _ragged(batch.column("ta")), _ragged(batch.column("tb"))
            count = np.concatenate([batch.column("ca").flatten().to_numpy(), batch.column("cb").flatten().to_numpy()])
            token, rows = np.concatenate([one, other]), np.concatenate([row, row2])
            order = np.lexsort((token, rows))
            token, rows, count = token[order], rows[order], count[order]
            twin = np.flatnonzero((token[1:] == token[:-1]) & (rows[1:] == rows[:-1]))  # a side has a token once
            common = np.bincount(rows[twin], np.minimum(count[twin], count[twin + 1]), batch.num_rows)
            most = np.maximum(batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(common >= similarity * most - 1e-9))

    return pairs.select("a", "b", "na", "nb", "ta", "ca", "tb", "cb").mapInArrow(run, "a binary, b binary")


def overlaps(records: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): classes of records that overlap across splits, by `whole` of one with evaluation and one with training records.

    records: written signatures with is_train and a unique uid. Exact: every pair of classes that shares the given part of the larger one's
    tokens comes out. A token that many classes try is split over tasks by its counted pairs.
    """
    one = records.groupBy("whole").agg(F.bool_or(~F.col("is_train")).alias("in_eval"), F.bool_or("is_train").alias("in_train"))
    same = one.where("in_eval and in_train").select(F.col("whole").alias("a"), F.col("whole").alias("b"))
    rare = written(_rarest(records, similarity), "rare")
    of = rare.where("often").groupBy("meet").agg(F.count_if(~F.col("is_train")).alias("e"), F.count_if("is_train").alias("t"))
    hot = of.withColumn("salts", F.ceil(F.col("e") * F.col("t") / PAIRS_A_TASK).cast("int")).where("salts > 1")
    rare = rare.join(written(hot.select("meet", "salts"), "hot"), "meet", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    every, one_of = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)), F.pmod(F.xxhash64("whole"), "salts").cast("int")
    sides = []
    for kind, id_, n, at, salt in ((~F.col("is_train"), "a", "na", "pa", every), (F.col("is_train"), "b", "nb", "pb", one_of)):
        side = rare.where(kind).select("meet", F.col("whole").alias(id_), F.col("n").alias(n), F.col("at").alias(at), salt.alias("salt"))
        sides.append(side.repartition("meet", "salt").dropDuplicates())  # copies of other batches go where they have to come anyway
    left, right = sides
    # at the first token that two records share, no more can be in common than the shorter rest of the two
    enough = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= similarity * F.greatest("na", "nb") - 1e-9
    met = left.join(right, ["meet", "salt"]).where(enough & (F.col("a") != F.col("b"))).select("a", "b", "na", "nb").distinct()
    met = written(met, "met")
    asked = met.select(F.col("a").alias("whole")).union(met.select("b")).distinct()
    first = written(records.select("whole", "uid").join(asked, "whole").groupBy("whole").agg(F.min("uid").alias("uid")), "first")
    form = written(records.select("uid", "whole", "tokens", "times").join(first.select("uid"), "uid", "left_semi").drop("uid"), "forms")
    met = met.join(form.select(F.col("whole").alias("a"), F.col("tokens").alias("ta"), F.col("times").alias("ca")), "a")
    met = met.join(form.select(F.col("whole").alias("b"), F.col("tokens").alias("tb"), F.col("times").alias("cb")), "b")
    return _checked(met, similarity).union(same)


# --- task ids -----------------------------------------------------------------------------------------


def task_id(pid: Column) -> Column:
    """One form for a task id: the last part of a path without its ending, lower case, words joined by _, no leading zeros in numbers."""
    name = F.regexp_replace(F.regexp_extract(F.trim(pid), r"([^/\\]*)$", 1), r"(?i)\.(hvm|json|jsonl|txt)$", "")
    words = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_")
    return F.nullif(F.regexp_replace(F.btrim(words, F.lit("_")), r"(^|_)0+(?=[0-9])", "$1"), F.lit(""))


def task_hash(pid: Column) -> Column:
    """128 bits of the task id's form; null where there is none."""
    return F.unhex(F.md5(task_id(pid)))


#: Blanks that don't count around a name.
BLANKS = " \t\r\n\u00a0\u3000"


def plain_name(name: Column) -> Column:
    """A name without surrounding blanks, in lower case."""
    return F.lower(F.btrim(name, F.lit(BLANKS)))


def split_name(split: Column) -> Column:
    return plain_name(split)


def source_name(source: Column) -> Column:
    """A source's name; null for none and for a blank one."""
    return F.nullif(plain_name(source), F.lit(""))


def _is_eval() -> Column:
    return split_name(F.col("split")).isin("valid", "test")


def _is_train() -> Column:
    return split_name(F.col("split")) == "train"


def _tasks(sft: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evaluation rows of results and training rows of sft, each with the hash of its task id (task)."""
    sides = (results.where(_is_eval()), sft.where(_is_train()))
    return tuple(s.withColumn("task", task_hash(F.col("pid"))).where("task is not null") for s in sides)


# --- pairs of rows ------------------------------------------------------------------------------------


def paired(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """left and right, which have no other column in common, joined by key; sizes (key, n_left, n_right) tells how many rows each side has of it.

    A key with more than PAIRS_A_TASK pairs is split over tasks: right's rows by chance of a hash, left's repeated for each part.
    """
    salts = F.ceil(F.col("n_left") * F.col("n_right") / PAIRS_A_TASK).cast("int").alias("salts")
    hot = written(sizes.select(key, salts).where("salts > 1"), "hot")
    salts = F.coalesce("salts", F.lit(1))
    here = F.pmod(F.xxhash64(*right.columns), salts).cast("int")
    left = left.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    right = right.join(hot, key, "left").withColumn("salt", here).drop("salts")
    return left.join(right, [key, "salt"]).drop("salt")


def _sizes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return count(left, "n_left").join(count(right, "n_right"), key)


def task_pairs(sft: DataFrame, results: DataFrame) -> DataFrame:
    """(eval_id, train_id): evaluation rows of results and training rows of sft with the same task id, joined by its hash."""
    left, right = _tasks(sft, results)
    left, right = left.select("task", F.col("rec_id").alias("eval_id")), right.select("task", F.col("rec_id").alias("train_id"))
    return paired(left, right, "task", _sizes(left, right, "task")).select("eval_id", "train_id")


def net_records(sft: DataFrame) -> DataFrame:
    """(uid, rec_id, is_train, split, source, signature...) of the records of the three splits that hold a net, written."""
    known = sft.where(_is_eval() | _is_train())
    known = known.select("rec_id", _is_train().alias("is_train"), split_name(F.col("split")).alias("split"), source_name(F.col("source")).alias("source"), "content")
    rows = signatures(known, ["rec_id", "is_train", "split", "source"], "content")
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "signatures")


def net_pairs(records: DataFrame, near: DataFrame) -> DataFrame:
    """(eval_id, train_id) of the rows of net_records whose classes are paired in near (a, b).

    Rows follow their pairs of classes on the evaluation side first, which makes no more rows than come out; how many pairs
    meet at a training class is known from the counts of both, and large ones are split.
    """
    count = records.groupBy("whole").agg(F.count_if(~F.col("is_train")).alias("n_eval"), F.count_if("is_train").alias("n_train"))
    sizes = near.join(count.select(F.col("whole").alias("a"), "n_eval"), "a").join(count.select(F.col("whole").alias("b"), "n_train"), "b")
    sizes = sizes.groupBy("b").agg(F.sum("n_eval").alias("n_left"), F.first("n_train").alias("n_right"))
    left = near.join(records.where("not is_train").select(F.col("whole").alias("a"), F.col("rec_id").alias("eval_id")), "a").select("b", "eval_id")
    right = records.where("is_train").select(F.col("whole").alias("b"), F.col("rec_id").alias("train_id"))
    return paired(left, right, "b", sizes).select("eval_id", "train_id")


def cross_split(sft: DataFrame, results: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(eval_id, train_id, sort): overlaps of evaluation splits with training.

    sort 'net': two sft records (rec_id, split, source, content) with the same or nearly the same net. sort 'task': an evaluation row of
    results (rec_id, split, pid) and a training row of sft with the same task id. Splits count whatever their case and blanks; rows of
    other or null splits, of null or blank content (sort net) or pid (sort task) take no part. Repeated rec_ids are
    kept apart as rows and come out once each pair of rows. Empty tables give no pairs; other columns may have any name.
    """
    records = net_records(sft)
    near = written(overlaps(records, similarity), "near")
    return net_pairs(records, near).withColumn("sort", F.lit("net")).unionByName(task_pairs(sft, results).withColumn("sort", F.lit("task")))


# --- report -------------------------------------------------------------------------------------------


def _counted(evals: DataFrame, trains: DataFrame, pairs: DataFrame) -> DataFrame:
    """(split, source, n_eval, n_train, n_pairs) from evals (a, split, n), trains (b, source, n) and pairs (a, b): groups are counted, rows never paired."""
    met = pairs.join(evals.withColumnRenamed("n", "e"), "a").join(trains.withColumnRenamed("n", "t"), "b")
    met = met.select("a", "b", "split", "source", "e", "t")
    whole = met.groupBy("split", "source").agg(F.sum(F.col("e") * F.col("t")).alias("n_pairs"))
    out = whole
    for side, rows in (("a", "e"), ("b", "t")):
        of = met.groupBy("split", "source", side).agg(F.first(rows).alias("n")).groupBy(F.col("split").alias("s"), F.col("source").alias("c"))
        of = of.agg(F.sum("n").alias("n_eval" if side == "a" else "n_train"))
        out = out.join(of, F.col("split").eqNullSafe(F.col("s")) & F.col("source").eqNullSafe(F.col("c"))).drop("s", "c")
    return out.select("split", "source", "n_eval", "n_train", "n_pairs")


def report(sft: DataFrame, results: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(sort, split, source, n_eval, n_train, n_pairs): how many evaluation rows overlap how many training rows, by split and by source of the training row.

    sort 'equal': nets with equal canonical text; 'net': all that are the same or nearly the same, equal ones included;
    'task': equal task ids. Counts come from groups of equal hashes, so that no pair of rows is made. A source counts without blanks and case, a blank one is null.
    """
    records = net_records(sft)
    near = written(overlaps(records, similarity), "near")
    tasks = _tasks(sft, results)
    rows = lambda df, key: df.select(F.col(key).alias("k"), "split", "source")
    results_, sft_ = (t.withColumn("split", split_name(F.col("split"))) for t in tasks)
    sft_ = sft_.withColumn("source", source_name(F.col("source")))
    parts = {
        "net": (rows(records.where("not is_train"), "whole"), rows(records.where("is_train"), "whole"), near),
        "equal": (rows(records.where("not is_train"), "exact"), rows(records.where("is_train"), "exact"), None),
        "task": (results_.select(F.col("task").alias("k"), "split"), rows(sft_, "task"), None),
    }
    out = None
    for sort, (left, right, pairs) in parts.items():
        evals = written(left.groupBy(F.col("k").alias("a"), "split").agg(F.count(F.lit(1)).alias("n")), "evals")
        trains = written(right.groupBy(F.col("k").alias("b"), "source").agg(F.count(F.lit(1)).alias("n")), "trains")
        if pairs is None:
            pairs = evals.select("a").distinct().join(trains.select(F.col("b").alias("a")).distinct(), "a").select("a", F.col("a").alias("b"))
        part = _counted(evals, trains, pairs).select(F.lit(sort).alias("sort"), "split", "source", "n_eval", "n_train", "n_pairs")
        out = part if out is None else out.unionByName(part)
    return out
