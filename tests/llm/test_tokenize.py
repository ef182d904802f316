import random

import numpy as np
import pyarrow as pa
import pytest

from loomspan.llm import tokenize as T

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    return T.read_ranks(T.vocabulary_path())


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def merges(ranks):
    return T.Merges(ranks)


@pytest.fixture(scope="module")
def lexicon(ranks, merges, tmp_path_factory):
    path = tmp_path_factory.mktemp("lexicon") / "words"
    path.write_bytes(T.save_arrays(T.build_lexicon(list(ranks), merges)))
    return T.Lexicon(T.map_arrays(str(path)))


ALPHABET = list("abs tdmrelv'' \n\t\x0b\x1c\x00  XY09_.,!=-é日— 　²Ⅷ​🚦") + ["'s", "'ll", "'re", "'ve", "  ", "don't", "<|endoftext|>", "====", "wrapChannel", "x" * 30, "\r\n", "{}", "0" * 12]


def test_ids_are_the_public_ones(lexicon, merges, encoding):
    r, encoder = random.Random(5), T.Encoder(lexicon, merges)
    for _ in range(120):
        texts = [None if r.random() < 0.05 else "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(40)]
        assert encoder.encode(pa.array(texts, pa.string())).to_pylist() == [encoding.encode_ordinary(t) if t else [] for t in texts]


def test_memory_may_run_over(lexicon, merges, encoding, monkeypatch):
    monkeypatch.setattr(T, "MEMORY", 3)
    encoder, texts = T.Encoder(lexicon, merges), [f"qzx{i}w fjq{i}" for i in range(50)]
    for _ in range(2):
        assert encoder.encode(pa.array(texts)).to_pylist() == [encoding.encode_ordinary(t) for t in texts]


def test_transducer(ranks, merges, lexicon):
    words = sorted(ranks)
    assert (lexicon.numbers(words) == np.arange(len(words))).all()
    assert (lexicon.numbers([b"", b"qqqzzz", words[5] + b"\x00\xff\xfe", b"\xff\xff\xff\xff"]) == -1).all()
    few = T.Lexicon(T.build_lexicon([b"tap", b"taps", b"top", b"tops", b"", b"tap"], merges))
    assert list(few.numbers([b"tap", b"taps", b"top", b"tops", b"to", b"t"])) == [0, 1, 2, 3, -1, -1]
    assert len(few.final) == 5  # shared prefixes and suffixes: t, a|o, p, s


def test_any_lexicon_gives_the_same(merges, lexicon, encoding):
    text = ["the quick brown fox' don't wrapChannel59 ===== \n\n  x"]
    for words in ([], [b" quick", b"the", b" brown fox", b"zzz"], [b"don", b"'t"]):
        own = T.Encoder(T.Lexicon(T.build_lexicon(words, merges)), merges) if words else T.Encoder(T.Lexicon(T.build_lexicon([b"~"], merges)), merges)
        assert own.encode(pa.array(text)).to_pylist() == [encoding.encode_ordinary(text[0])]


def test_in_spark(spark, encoding):
    texts = [None, "", " ", "\n", "a", "a", "x" * 300_000, "<|endoftext|>", "é日" * 2000]
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    want = [encoding.encode_ordinary(t) if t else [] for t in texts]
    assert [r.ids for r in T.encode(df, ["doc_id"], "text").orderBy("doc_id").collect()] == want
    assert [r.n_tokens for r in T.count_tokens(df, ["doc_id"], "text").orderBy("doc_id").collect()] == [len(x) for x in want]
    assert T.encode(df.limit(0), ["doc_id"], "text").collect() == []


def test_frequent_words(spark, encoding):
    texts = ["a b b c c c don't"] * 3 + [None, "", "rare", "x" * 100, "x" * 100] + [f"word{i} word{i}" for i in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = set(T.frequent_words(df, "text"))
    assert {b" c", b" b", b"a", b" don", b"'t"} <= found and b"rare" not in found and b"x" * 100 not in found
    few = T.frequent_words(df, "text", 3)
    assert len(few) <= 3 and b" c" in few
    assert T.frequent_words(df.limit(0), "text") == []
    got = T.encode(df, ["doc_id"], "text", words=few).orderBy("doc_id").collect()
    assert [r.ids for r in got] == [encoding.encode_ordinary(t) if t else [] for t in texts]
