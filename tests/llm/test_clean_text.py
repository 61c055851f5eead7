import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tellstone.llm import cleantext as C
from tellstone.llm.lookalikes import same_reading


def by_hand(text):
    """The consistent form, a character at a time."""
    for sign, letters in C.ligatures().items():
        text = text.replace(sign, letters)
    source, target = C.translate_map()
    table = dict(zip(source, target))
    out = "".join("" if c in source[len(target) :] else table.get(c, c) for c in text)
    return unicodedata.normalize("NFC", out)


def test_against_unicode_data(spark):
    """Letters with at most one accent, wide, look-alike, decomposed or with something invisible in between."""
    rng = random.Random(2)
    letters, marks = "aeghstuABHKSＡｈАаѕΒṣ", [chr(c) for c in range(0x300, 0x330) if c != 0x313]
    between = ["", "", "\u200b", "\u00ad", "\ufeff"]
    others = " \u00a0\u2007\u3000-\u2011．［]#₂𒀭\u2060"
    piece = lambda: rng.choice(letters) + (rng.choice(between) + rng.choice(marks) if rng.random() < 0.3 else "") if rng.random() < 0.7 else rng.choice(others)
    texts = ["".join(piece() for _ in range(rng.randrange(25))) for _ in range(3000)] + ["", "š" * 9000]
    texts += ["".join(rng.choice("aesuṣé") + "".join(rng.choice("\u0323\u0301\u0331\u030c\u0304") for _ in range(rng.randrange(4))) for _ in range(6)) for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", C.clean_text(F.col("t")).alias("c"))
    got = {r["i"]: r["c"] for r in df.collect()}
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != by_hand(t)] == [] and got[len(texts)] is None


def test_look_alikes_of_other_scripts(spark):
    """Every look-alike has the skeleton of its Latin letter in the confusables of the Unicode standard."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeleton = checker.getSkeleton
    assert [c for c, latin in C.LOOK_ALIKES.items() if skeleton(c) != skeleton(latin)] == ["Ԛ", "Һ", "ӏ"]  # which have another there, or none
    pairs = [("νρυ", "vpu"), ("ӏɑﬁⅠⅣ", "laﬁIIV".replace("ﬁ", "fi")), ("ᎪꓐB", "ABB"), ("a\u3164b\u2800c\U000e0061d\ufe0fe\U000e0100f", "ab cdef"), ("x²𝐀", "x²𝐀"), ("ıα", "ıα")]
    rows = spark.createDataFrame(pairs, "t string, want string").select(C.clean_text(F.col("t")).alias("c"), "want").collect()
    assert [r["c"] for r in rows] == [r["want"] for r in rows]


def test_words_and_signs(spark):
    df = spark.createDataFrame([("[we-qu]-ḫa! x <PI₂>.LI ...",), ("",), (None,), ("[...] x",)], "t string")
    rows = df.select(C.words(C.clean_text(F.col("t"))).alias("w"), C.signs(C.clean_text(F.col("t"))).alias("s")).collect()
    assert rows[0]["w"] == ["we-qu-ḫa", "x", "pi₂.li", "..."] and rows[0]["s"] == ["we", "qu", "ḫa", "pi2", "li"]
    assert rows[1]["w"] == [] and rows[2]["w"] is None and rows[3]["s"] == []


TEXT = "we-qu-ḫa a b c d e f šg"


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "rec string, text string, canonical string, _key string, _block int")
    return sorted(tuple(r) for r in same_reading(df).collect())


def test_same_reading(spark):
    other = unicodedata.normalize("NFD", TEXT)
    rows = [("a:1", TEXT), ("a:1", TEXT), ("a:2", other), ("b:1", TEXT.replace(" ", " ")), ("b:2", TEXT.upper()), ("b:3", "short text"), ("b:4", "short text"), ("b:5", None), ("b:6", ""), ("b:7", TEXT.replace("š", "s")), ("b:8", TEXT + "!"), ("b:9", TEXT)]
    got = found(spark, rows)
    assert got == [("a:1", "a:2"), ("a:1", "b:1"), ("a:2", "b:1"), ("a:2", "b:9"), ("b:1", "b:9")]
    assert found(spark, []) == []


def test_canonical(spark):
    rows = [("1", TEXT), ("2", unicodedata.normalize("NFD", TEXT)), ("3", None), ("4", ""), ("5", "ｘ"), ("5", "ｘ")]
    got = {r["rec"]: r["canonical"] for r in C.canonical_classes(spark.createDataFrame(rows, "rec string, text string")).collect()}
    assert got == {"1": TEXT, "2": TEXT, "3": None, "4": "", "5": "x"}


@pytest.mark.parametrize("pair", [("K", "K"), ("é", "é"), ("a b", "a b"), ("a-b", "a‑b"), ("ab", "a​b"), ("SA", "ЅА")])
def test_forms(spark, pair):
    a, b = (r[0] for r in spark.createDataFrame([(p,) for p in pair], "t string").select(C.clean_text(F.col("t"))).collect())
    assert a == b
