import itertools
import unicodedata

import pytest

from loomspan.llm import overlap
from loomspan.llm import skeleton as S

ALIKE = [
    ("hello", "ｈｅｌｌｏ"), ("a b", "a b"), ("a b", "a　b"), ("café", unicodedata.normalize("NFD", "café")), ("ab", "a​b"), ("ab", "﻿ab­"),
    ("scope", "ѕсоре"), ("TOP", "ΤΟΡ"), ("nu", "nս"), ("A", "𝐀"), ("ガ", "ｶﾞ"), ("ガ", "ガ"), ("x=1;", "ｘ＝１；"), ("", "‍"), ("ë", "ё"),
]
ALIKE += [("i", "ı"), ("i", "ɩ"), ("cosvwz", "ᴄᴏꜱᴠᴡᴢ"), ("o", "σ"), ("o", "ס"), ("o", "ه"), ("y", "ყ"), ("O", "𐐄"), ("o", "𐐬"), ("hU", "ᏂᏌ"), ("xX", "ꭓꞳ"), ("w", "ѡ"), ("csv", "ꮯꮪꮩ"), ("oc", "ⲟⲥ")]
DIFFERENT = [("cafe", "café"), ("m2", "m²"), ("l", "1"), ("O", "0"), ("a b", "a  b"), ("a\n", "a\r\n"), ("a", "A"), ("I", "l"), ("rn", "m"), ("a ", "a"), ("-", "—"), ("đ", "d"), ("ß", "β"), ("a\tb", "a b"), ("-", "‐"), ("'", "’"), ("m", "ᴍ")]


@pytest.mark.parametrize("a, b", ALIKE)
def test_looks_the_same(a, b):
    assert S.skeleton(a) == S.skeleton(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_looks_different(a, b):
    assert S.skeleton(a) != S.skeleton(b)


def test_a_skeleton_is_its_own_and_ascii_stays():
    text = "".join(map(chr, range(128)))
    assert S.skeleton(text) == text
    for c in (chr(x) for x in range(0x80, 0x30000) if not 0xD800 <= x < 0xE000):
        assert S.skeleton(S.skeleton(c)) == S.skeleton(c)


def pairs(spark, texts):
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id bigint, text string, look string")
    return sorted(map(tuple, S.look_alike_pairs(df, "doc_id", "text").collect()))


def test_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PAIRS_A_TASK", 3)
    texts = [None, "", *itertools.chain(*ALIKE), *itertools.chain(*DIFFERENT), "scope", "scope", "ѕсоре", None, "x" * 200_000, "ｘ" + "x" * 199_999]
    want = sorted((i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if a is not None and b is not None and a != b and S.skeleton(a) == S.skeleton(b))
    assert pairs(spark, texts) == want
    assert pairs(spark, []) == []


def test_forms_and_groups(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "a​b"), (3, None), (4, "ab"), (5, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, S.skeletons(df, "doc_id", "text").collect()), key=str) == [(1, "ab"), (2, "ab"), (3, None), (4, "ab"), (5, "")]
    assert sorted(map(tuple, S.groups(df, "doc_id", "text").collect())) == [(1, 1, 3, 2), (2, 1, 3, 2), (4, 1, 3, 2), (5, 5, 1, 1)]


def test_many_spellings_of_one_text(spark, monkeypatch):
    """Marks without width make spellings at will: one look with many classes, some of many rows."""
    monkeypatch.setattr(overlap, "PAIRS_A_TASK", 10)
    texts = ["key" + "\u200b" * (i % 14) for i in range(70)] + ["key"] * 20
    want = sorted((i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if a != b)
    assert pairs(spark, texts) == want


def test_a_public_table_adds_letters(tmp_path):
    file = tmp_path / "confusables.txt"
    file.write_text("# x\n0448 ;\t0077 ;\tMA\t# sh\n2019 ;\t0027 ;\tMA\n05D3 ; 0301 0302 ; MA\n")
    assert S.read_confusables(str(file)) == {"ш": "w"}
    assert S.prototypes(str(file))[ord("ш")] == "w" and ord("ш") not in S.prototypes()
