"""One form for texts that look the same (confusables skeleton).

Decompose, replace every character by its prototype, decompose again. Prototypes come from rules (full-width, half-width
and font variants by their compatibility decomposition, unusual blanks, characters without width, small letters drawn
as small capitals) and from tables of letters of other scripts that look like Latin ones. A table in the form of
Unicode's public confusables.txt can be given beside them. Plain ASCII is its own skeleton and never leaves the JVM.

Only letters are folded: hyphens, dashes and quotation marks of other shapes are visible and stay as they are.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.overlap import paired
from loomspan.session import written

# Letters that look like Latin letters, by script, and those Latin letters.
LOOK_ALIKES = (
    ("агеорпсухѡіѕјһҽԁԛԝӏѵүь", "areopncyxwisjhedqwlvyb"),  # Cyrillic, small
    ("АВЕЅІЈКМНОРСТУХѴԚԜҮԌӀЬ", "ABESIJKMHOPCTYXVQWYGIb"),  # Cyrillic, capital
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϜ", "ABEZHIKMNOPTYXCJF"),  # Greek, capital
    ("αγινορσυϲϳ", "ayivopoucj"),  # Greek, small
    ("սօհոյցզաղռգՕՏՍԼ", "uohnjgqwnnqOSUL"),  # Armenian
    ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏳᏴᏂᏌ", "DRTiYAJEWMHYGZbRWSVSLCPKGBhU"),  # Cherokee, capital
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ⲂⲌⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⳐⲣ", "BZHIKMNOPCTYXLp"),  # Coptic
    ("וחטןס", "lnvlo"),  # Hebrew
    ("اهہەھ", "loooo"),  # Arabic
    ("ყჿ", "yo"),  # Georgian
    ("𐐄𐐕𐐛𐐠", "OCLS"),  # Deseret, capital
    ("\u0251\u0261\u0131\u0269\u028b\u026f\uab53\ua7b3", "agiivwxX"),  # phonetic and rare Latin
)
#: Latin capitals that their small letters only reduce in size; other scripts' small letters do the same.
SAME_SHAPE = "COSUVWXZ"
# Ranges of characters that have no width, by their property of being ignorable.
NO_WIDTH = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3),
    (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
_SHAPES = ("<wide>", "<narrow>", "<font>", "<noBreak>")
_SMALL_CAPITAL = "LATIN LETTER SMALL CAPITAL "


def read_confusables(path: str) -> dict[str, str]:
    """Letters of a file in the form of Unicode's confusables.txt that stand for one Latin letter of ASCII."""
    found = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = [p.split() for p in line.split("#")[0].split(";")]
            if len(parts) >= 2 and len(parts[0]) == len(parts[1]) == 1:
                old, new = (chr(int(p[0], 16)) for p in parts[:2])
                if new.isascii() and new.isalpha() and old.isalpha() and not old.isascii():
                    found[old] = new
    return found


@lru_cache(maxsize=4)
def prototypes(confusables: str | None = None) -> dict[int, str]:
    """Prototype of each code point that isn't its own. confusables: a file that adds letters, by default LOOMSPAN_CONFUSABLES; all executors must see it."""
    confusables = confusables or os.environ.get("LOOMSPAN_CONFUSABLES")
    table: dict[int, str] = {}
    alike = dict(read_confusables(confusables)) if confusables else {}
    for letters, latin in LOOK_ALIKES:
        alike.update(zip(letters, latin, strict=True))
    for c in range(0x80, 0x110000):
        sign = chr(c)
        shape, kind = unicodedata.decomposition(sign), unicodedata.category(sign)
        if shape.startswith(_SHAPES) or shape.startswith("<compat>") and kind in ("Lu", "Ll", "Lt", "Nl"):
            table[c] = unicodedata.normalize("NFKD", sign)
        elif kind == "Zs":
            table[c] = " "
        elif kind == "Ll":
            name = unicodedata.name(sign, "")
            capital = name.removeprefix(_SMALL_CAPITAL) if name.startswith(_SMALL_CAPITAL) else alike.get(sign.upper(), "")
            drawn_small = name.startswith((_SMALL_CAPITAL, "CHEROKEE", "COPTIC", "DESERET"))
            if drawn_small and len(capital) == 1 and capital in SAME_SHAPE:
                table[c] = capital.lower()
    table.update((ord(a), b) for a, b in alike.items())
    for first, last in NO_WIDTH:
        table.update(dict.fromkeys(range(first, last + 1), ""))
    for c, to in table.items():  # what a rule gives may have a prototype of its own
        table[c] = "".join(table.get(ord(x), x) for x in to)
    return table


def skeleton(text: str) -> str:
    """The form that all texts looking like this one share. Case, ASCII, accents and raised digits stay as they are."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes()))


def _foreign(text: str):  # noqa: ANN202
    """The text where it isn't plain ASCII, else null."""
    return F.when(F.col(text).rlike(r"[^\x00-\x7F]"), F.col(text))


def skeletons(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, skeleton): the consistent form of each text, null for null. One pass, no shuffle; only texts that aren't ASCII go through Python."""

    @F.arrow_udf("string")
    def form(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else skeleton(t) for t in column.to_pylist()], pa.string())

    rows = df.select(ident, F.col(text).alias("__text")).select(ident, "__text", _foreign("__text").alias("__wide"))
    return rows.select(ident, F.coalesce(form("__wide"), F.col("__text")).alias("skeleton"))


def signatures(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, look, body): 128-bit hashes of each text's skeleton and of the text itself; null texts give no row. One scan; only texts that aren't ASCII go through Python."""

    @F.arrow_udf("binary")
    def look(column: pa.Array) -> pa.Array:
        texts = (None if t is None else skeleton(t).encode("utf-8", "surrogatepass") for t in column.to_pylist())
        return pa.array([None if t is None else hashlib.md5(t).digest() for t in texts], pa.binary())

    rows = df.select(ident, F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    rows = rows.select(ident, F.unhex(F.md5("__text")).alias("body"), _foreign("__text").alias("__wide"))
    return rows.select(ident, F.coalesce(look("__wide"), F.col("body")).alias("look"), "body")


def look_alike_pairs(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(a, b), a < b: rows whose texts look the same and aren't the same string.

    Copies of one text fall into one class first. Only looks with several classes go on; rows follow the pairs of classes on
    one side and then on the other, each step split over tasks by its counted pairs, so that no task holds a group. Null texts take part in no
    pair; the empty text looks like one of characters without width alone. Repeated ids are rows of their own; empty tables give no pairs.
    """
    rows = written(signatures(df, ident, text), "signatures")
    classes = rows.groupBy("look", "body").agg(F.count(F.lit(1)).alias("n"))
    looks = written(classes.groupBy("look").agg(F.sum("n").alias("n_left"), F.count(F.lit(1)).alias("n_right")).where("n_right > 1"), "looks")
    classes = written(classes.join(looks.select("look"), "look", "left_semi"), "classes")
    members = written(rows.join(looks.select("look"), "look", "left_semi"), "members")
    left = members.select("look", F.col("body").alias("x"), F.col(ident).alias("id_x"))
    left = paired(left, classes.select("look", F.col("body").alias("y"), F.col("n").alias("n_y")), "look", looks).where("x < y")
    # to a class y come rows of the smaller bodies of its look, so no more than the look has
    sizes = classes.join(looks.select("look", "n_left"), "look").select(F.col("body").alias("y"), "n_left", F.col("n").alias("n_right"))
    found = paired(left.select("y", "id_x"), members.select(F.col("body").alias("y"), F.col(ident).alias("id_y")), "y", sizes)
    return found.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))


def groups(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, group_id, n_rows, n_texts): for each row the least id of those that look the same, how many look so, and in how many strings."""
    rows = signatures(df, ident, text)
    each = rows.groupBy("look", "body").agg(F.min(ident).alias("least"), F.count(F.lit(1)).alias("n"))
    by_look = each.groupBy("look").agg(F.min("least").alias("group_id"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_texts"))
    return rows.select(ident, "look").join(by_look, "look").select(ident, "group_id", "n_rows", "n_texts")
