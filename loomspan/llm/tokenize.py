"""Encoding of a corpus with a public byte-level BPE vocabulary.

Texts are cut into words for a whole batch at once: character classes, bitmaps of word starts, spans. The distinct
words of a batch run through a lexicon: a minimal acyclic transducer (words share prefixes and suffixes, arcs
add up to a word's number, the number gives its ids) that lies in a file and is memory-mapped. Words it
doesn't hold are merged exactly by rank, many at once.

A text that is null or empty has the empty list of ids. Strings that resemble special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.json_index import text_buffers
from loomspan.session import shared_dir, written
from loomspan.sources.tables import pieces

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
#: Entries of a worker's memory of merged words; beyond it the memory starts anew.
MEMORY = 200_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """File of a public vocabulary; folder, or LOOMSPAN_TOKENIZERS, or /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("LOOMSPAN_TOKENIZERS", "/opt/tokenizers"), name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


# --- words -----------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point by its general category; white space is the 25 code points with that property."""
    import unicodedata

    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = DIGIT
    for first, last in ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[first : last + 1] = SPACE
    return table


def word_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte range of each word of all texts, in order.

    A word is an English contraction's ending, or a run of letters, digits or other signs with one blank
    before it, or white space up to the last character before such a run.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = bool((data > 127).any())
    if wide:
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.searchsorted(lead, starts[ends > starts])
    else:
        lead, code, first = None, data, starts[ends > starts]
    n = len(code)
    kind = _classes()[code]
    fresh = np.zeros(n + 1, bool)  # a text begins here; the end of all counts as one
    fresh[first] = True
    fresh[n] = True
    start = np.empty(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[n] = True
    start |= fresh
    blank = kind == SPACE
    before_solid = np.zeros(n, bool)
    before_solid[:-1] = blank[:-1] & ~blank[1:] & ~fresh[1:n]
    at = np.flatnonzero(before_solid)
    start[at] = True
    start[at[code[at] == 32] + 1] = False
    quote = np.flatnonzero((code == 39) & start[:n])
    quote = quote[~fresh[quote + 1]]
    if len(quote):
        one = code[quote + 1]
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        has_two = ~fresh[np.minimum(quote + 2, n)]
        two = np.where(has_two, code[np.minimum(quote + 2, n - 1)], 0)
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 3] = True
    place = np.flatnonzero(start)
    byte = lead[place[:-1]] if wide else place[:-1]
    return byte, np.append(byte[1:], len(data))


def distinct_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct words of the spans, which of them each span is). Up to 7 bytes a word is one number, with its length in the eighth byte."""
    size = end - begin
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))
    short = size <= 7
    which = np.empty(len(begin), np.int64)
    mask = np.array([(1 << (8 * k)) - 1 for k in range(8)], np.uint64)
    few = size[short]
    key = (eight[begin[short]] & mask[few]) | (few.astype(np.uint64) << np.uint64(56))
    code, unique = pd.factorize(key)
    which[short] = code
    raw = np.ascontiguousarray(unique.astype("<u8")).tobytes()
    distinct = [raw[8 * i : 8 * i + raw[8 * i + 7]] for i in range(len(unique))]
    long = np.flatnonzero(~short)
    if len(long):
        body, place = data.tobytes(), {}
        which[long] = [place.setdefault(body[a:b], len(distinct) + len(place)) for a, b in zip(begin[long].tolist(), end[long].tolist())]
        distinct += list(place)
    return distinct, which


# --- merges ----------------------------------------------------------------------------------------


class Merges:
    """Byte pair merges of many words at once, always the pair of lowest rank, from the left."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.none = np.int64(1) << 40

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, offsets)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done_symbol, done_word = [], []
        rank = np.full(len(symbol), self.none)
        if len(symbol) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self._rank(symbol[:-1], symbol[1:]), self.none)
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, len(word)))
            least = np.repeat(least, lengths)
            over = least == self.none
            if over.any():
                done_symbol.append(symbol[over]), done_word.append(word[over])
                keep = ~over
                symbol, word, rank, least = symbol[keep], word[keep], rank[keep], least[keep]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == least)
            new = np.ones(len(hit), bool)
            new[1:] = np.diff(hit) != 1
            run = np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]  # of overlapping pairs each second one
            symbol[hit] = least[hit]
            gone = np.zeros(len(symbol), bool)
            gone[hit + 1] = True
            touched = np.zeros(len(symbol), bool)
            touched[hit] = True
            touched[np.maximum(hit - 1, 0)] = True
            symbol, word, rank, touched = symbol[~gone], word[~gone], rank[~gone], touched[~gone]
            at = np.flatnonzero(touched)
            nxt = np.minimum(at + 1, len(symbol) - 1)
            ok = (at + 1 < len(symbol)) & (word[nxt] == word[at])
            rank[at] = np.where(ok, self._rank(symbol[at], symbol[nxt]), self.none)
        if not done_symbol:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])


# --- lexicon ---------------------------------------------------------------------------------------


def build_lexicon(words: list[bytes], merges: Merges) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer of the words. Words are added in order; what can't change any more is shared at once.

    State s has bits[s] (256 bits: its arcs' bytes), base[s] (place of its first arc, for each 64 bits) and final[s]; an arc
    has target and skip, the number of words that come before by way of smaller arcs. The skips of a word's arcs add up to its number.
    """
    words = sorted(set(words) - {b""})
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]
    previous = b""

    def settle(down_to: int) -> None:
        for depth in range(len(previous), down_to, -1):
            state, byte = path[depth], previous[depth - 1]
            key = (final[state], *arcs[state].items())
            known = register.setdefault(key, state)
            if known != state:
                arcs[path[depth - 1]][byte] = known
        del path[down_to + 1 :]

    for word in words:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        settle(common)
        for byte in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        previous = word
    settle(0)
    # number the states that are left, and count the words below each
    number, order, stack = {0: 0}, [], [(0, iter(arcs[0].values()))]
    while stack:  # children before parents
        state, rest = stack[-1]
        for child in rest:
            if child not in number:
                number[child] = len(number)
                stack.append((child, iter(arcs[child].values())))
                break
        else:
            order.append(state)
            stack.pop()
    below = {}
    for state in order:
        below[state] = final[state] + sum(below[c] for c in arcs[state].values())
    states = sorted(number, key=number.get)
    bits = np.zeros((len(states), 4), np.uint64)
    base = np.zeros((len(states), 4), np.int32)
    target, skip = [], []
    for s, state in enumerate(states):
        before, block = int(final[state]), 0
        base[s, 0] = len(target)
        for byte in sorted(arcs[state]):
            while block < byte >> 6:
                block += 1
                base[s, block] = len(target)
            bits[s, byte >> 6] |= np.uint64(1 << (byte & 63))
            target.append(number[arcs[state][byte]])
            skip.append(before)
            before += below[arcs[state][byte]]
        base[s, block + 1 :] = len(target)
    ids, offsets = merges(words)
    return {
        "bits": bits.ravel(), "base": base.ravel(), "target": np.array(target, np.int32), "skip": np.array(skip, np.int32),
        "final": np.array([final[s] for s in states], np.uint8), "ids": ids, "offsets": offsets.astype(np.int32),
    }


def save_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    top = json.dumps(head).encode()
    first = -(-(8 + len(top)) // 64) * 64
    out = bytearray(first + at)
    out[:8] = len(top).to_bytes(8, "little")
    out[8 : 8 + len(top)] = top
    for name, a in arrays.items():
        place = first + head[name][2]
        out[place : place + a.nbytes] = a.tobytes()
    return bytes(out)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    whole = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(whole[:8].tobytes(), "little")
    first = -(-(8 + size) // 64) * 64
    return {name: np.ndarray(n, kind, whole.data, first + at) for name, (kind, n, at) in json.loads(whole[8 : 8 + size].tobytes()).items()}


class Lexicon:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 for those it doesn't hold."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive = np.arange(len(words))
        for i in range(int(size.max(initial=0))):
            alive = alive[size[alive] > i]
            if not len(alive):
                break
            byte = data[start[alive] + i]
            word = state[alive] * 4 + (byte >> 6)
            bits, bit = self.bits[word], np.uint64(1) << (byte & 63).astype(np.uint64)
            there = (bits & bit) != 0
            state[alive[~there]] = -1
            alive, word, bits, bit = alive[there], word[there], bits[there], bit[there]
            arc = self.base[word] + np.bitwise_count(bits & (bit - np.uint64(1)))
            number[alive] += self.skip[arc]
            state[alive] = self.target[arc]
        good = (state >= 0) & (size > 0)
        good[good] = self.final[state[good]] > 0
        return np.where(good, number, -1)


# --- encoder ---------------------------------------------------------------------------------------


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places start[i] .. start[i] + count[i] - 1, all in a row."""
    first = np.cumsum(count) - count
    return np.arange(count.sum()) + np.repeat(start - first, count)


class Encoder:
    def __init__(self, lexicon: Lexicon, merges: Merges):
        self.lexicon, self.merges, self.known = lexicon, merges, {}

    def _unseen(self, words: list[bytes]) -> list[np.ndarray]:
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) + len(new) > MEMORY:
                self.known, new = {}, words
            ids, offsets = self.merges(new)
            self.known.update(zip(new, np.split(ids, offsets[1:-1])))
        return [self.known[w] for w in words]

    def _distinct(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all, start of each, number of each) of distinct words."""
        number = self.lexicon.numbers(words)
        start, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        held = np.flatnonzero(number >= 0)
        offsets, ids = self.lexicon.offsets, self.lexicon.ids
        start[held] = offsets[number[held]]
        count[held] = offsets[number[held] + 1] - start[held]
        rest = np.flatnonzero(number < 0)
        if len(rest):
            more = self._unseen([words[i] for i in rest])
            count[rest] = np.fromiter(map(len, more), np.int64, len(more))
            start[rest] = len(ids) + np.cumsum(count[rest]) - count[rest]
            ids = np.concatenate([ids, *more])
        return ids, start, count

    def words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of distinct words, start and number of each, and which of them each span is)."""
        distinct, which = distinct_words(data, begin, end)
        return *self._distinct(distinct), which

    def encode(self, column: pa.Array, only_count: bool = False) -> pa.Array:
        """List of ids of each text, or how many."""
        data, starts, ends = text_buffers(column)
        begin, end = word_spans(data, starts, ends)
        if not len(begin):
            none = np.zeros(len(starts), np.int64)
            return pa.array(none) if only_count else pa.ListArray.from_arrays(pa.array(np.zeros(len(starts) + 1, np.int32)), pa.array([], pa.int32()))
        ids, start, count, which = self.words(data, begin, end)
        total = np.concatenate([[0], np.cumsum(count[which])])
        at = total[np.searchsorted(begin, starts)]
        to = total[np.searchsorted(begin, ends)]
        if only_count:
            return pa.array(to - at)
        flat = ids[_ragged(start[which], count[which])]
        return pa.ListArray.from_arrays(pa.array(np.append(at, total[-1]).astype(np.int32)), pa.array(flat.astype(np.int32, copy=False)))


@lru_cache(maxsize=2)
def _worker_encoder(lexicon_file: str, vocabulary: str) -> Encoder:
    return Encoder(Lexicon(map_arrays(lexicon_file)), Merges(read_ranks(vocabulary)))


_SHIPPED: dict[tuple, tuple[str, str]] = {}


def ship(spark: SparkSession, vocabulary: str, words: list[bytes] | None = None) -> tuple[str, str]:
    """Compiles the lexicon, writes it and the vocabulary to the shared folder and has Spark bring both to every executor.

    The lexicon holds the vocabulary's own entries, which its makers found frequent, and `words`, a corpus's own.
    Whatever words are held, the ids are the same. Gives the two files' names.
    """
    key = (spark.sparkContext.applicationId, vocabulary, None if words is None else hash(tuple(sorted(words))))
    if key not in _SHIPPED:
        ranks = read_ranks(vocabulary)
        with open(vocabulary, "rb") as f:
            files = {"lexicon": save_arrays(build_lexicon([*ranks, *(words or [])], Merges(ranks))), "vocabulary": f.read()}
        names = []
        jvm = spark._jvm
        for name, body in files.items():
            names.append(f"{name}-{uuid.uuid4().hex}")
            target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{names[-1]}")
            out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
            out.write(body)
            out.close()
            spark.sparkContext.addFile(target.toString())
        _SHIPPED[key] = tuple(names)
    return _SHIPPED[key]


#: Most words that a corpus's lexicon holds; bounds what the driver gets and what every executor maps.
LEXICON_WORDS = 1 << 16
#: Longest word that is counted, in bytes; longer ones are merged each time.
LONGEST = 64


def frequent_words(df: DataFrame, text: str, most: int = LEXICON_WORDS) -> list[bytes]:
    """The commonest words of all texts, at most `most`, counted over the whole table.

    Words are counted within each piece first. A table of counts by size, at most 256 rows, tells from which count on they
    are few enough; words of one count stand or fall together, and words met once are never taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, starts, ends = text_buffers(batch.column("text"))
            begin, end = word_spans(data, starts, ends)
            keep = end - begin <= LONGEST
            if keep.any():
                words, which = distinct_words(data, begin[keep], end[keep])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.bincount(which, minlength=len(words)))], names=["word", "n"])

    counts = df.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = written(counts.withColumn("size", F.floor(F.log2("n") * 4).cast("int")), "words")
    left, from_size = most, None
    for size, n in sorted(((r["size"], r["count"]) for r in counts.groupBy("size").count().collect()), reverse=True):
        if n > left:
            break
        left, from_size = left - n, size
    if from_size is None:
        return []
    return [bytes(w) for w in counts.where(F.col("size") >= from_size).select("word").toArrow().column("word").to_pylist()]


def _encoded(df: DataFrame, ids: list[str], text: str, vocabulary: str | None, only_count: bool, out: str, words: list[bytes] | None) -> DataFrame:
    lexicon, ranks = ship(df.sparkSession, vocabulary or vocabulary_path(), words)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(SparkFiles.get(lexicon), SparkFiles.get(ranks))
        for batch in pieces(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ids], encoder.encode(batch.column("__text"), only_count)], names=[*ids, out])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ids] + [f"`{out}` {'bigint' if only_count else 'array<int>'}"])
    return df.select(*ids, F.col(text).alias("__text")).mapInArrow(run, schema)


def encode(df: DataFrame, ids: list[str], text: str, vocabulary: str | None = None, words: list[bytes] | None = None) -> DataFrame:
    """(ids..., ids ARRAY<INT>): token ids of each text; the empty list for empty and null texts. One pass, no shuffle."""
    return _encoded(df, ids, text, vocabulary, False, "ids", words)


def count_tokens(df: DataFrame, ids: list[str], text: str, vocabulary: str | None = None) -> DataFrame:
    """(ids..., n_tokens): number of token ids of each text, 0 for empty and null ones."""
    return _encoded(df, ids, text, vocabulary, True, "n_tokens", None)
