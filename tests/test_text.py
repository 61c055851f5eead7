import hashlib
import re

from pyspark.sql import functions as F

from tellstone.functions import text as X


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_golden_hashes(spark):
    cases = [("𒀭 𒂗 𒆤 𒀀 𒈾 𒈗 𒂊", "AI: ", "e3c2faae1300e3de"), ("n.n.b.", "Zie Oxford website", "a157725c50f3c3a2"), ("𒀭 𒊹", "AI: ", "75400392a6ae8077")]
    for cuneiform, transliteration, want in cases:
        made = X.content_hash(X.spaced_text(F.col("a")), X.spaced_text(F.col("b")))
        assert one(spark, made, a=cuneiform, b=transliteration) == want


def test_spaced_text(spark):
    assert one(spark, X.spaced_text(F.col("a")), a="abc") == "a b c"
    assert one(spark, X.spaced_text(F.col("a")), a=None) == ""
    assert one(spark, X.printable_text(F.col("a")), a=" a\x07b ") == "ab"


def by_hand(t):
    """The token rules, step by step."""
    t = re.sub(r"#.*$", "", re.sub(r"^[&#@]\s*", "", t or ""), flags=re.MULTILINE)
    out = []
    for piece in (p for part in t.split() for p in part.split(".") if p):
        piece = re.sub(r"[()\[\]{}]", "", re.sub(r"\d+$", "", piece))
        for d in ("d", "giš", "ki", "uru"):
            piece = piece.replace(d, "")
        if piece and not piece.isdigit():
            out.append(piece.upper())
    return out


def test_sign_tokens(spark):
    texts = ["& lugal.kalam an5 # note\ndumu giš.ki [a2] 12 {d}en-lil2", "", None, "d ki", "a" * 5000, "x₂ ₂ (12) e₂.gal", "#only", "ṭen-na WAZ.NAB"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.sign_tokens(F.col("t")).alias("w"))
    assert {r["i"]: r["w"] for r in df.collect()} == {i: by_hand(t) for i, t in enumerate(texts)}


def test_classes(spark):
    assert one(spark, X.language_of(F.col("a"), F.col("b")), a=None, b="šumma lu") == "Akkadian"
    assert one(spark, X.language_of(F.col("a"), F.col("b")), a="", b="xyz") == "Unknown"
    assert one(spark, X.period_of(F.col("a"), F.col("b")), a="CDLI", b="Ur III text") == "Ur III / Sumerian"
    assert one(spark, X.genre_of(F.col("a"), F.col("b")), a="Letter", b=None) == "Administrative"
    assert one(spark, X.myth_labels(F.col("a")), a=None) == ["uncategorized"]
    assert one(spark, X.myth_labels(F.col("a")), a="The FLOOD, the snake") == ["flood", "immortality"]
    assert one(spark, X.motif_groups(F.col("a")), a="zzz") == ["Onbekend/Thema niet gedetecteerd"]


def test_overlaps_and_ngrams(spark):
    assert one(spark, X.ngrams(X.words(F.col("a")), 3), a="a b") == []
    assert one(spark, X.ngrams(X.words(F.col("a")), 2), a="a b c") == ["a b", "b c"]
    assert one(spark, X.share_of(X.words(F.col("a")), X.words(F.col("b")), "max"), a="a b b", b="b c d") == 1 / 3
    assert one(spark, X.share_of(X.words(F.col("a")), X.words(F.col("b")), "min"), a="a b", b="b c d") == 1 / 2
    assert one(spark, X.share_of(X.words(F.col("a")), X.words(F.col("b"))), a=None, b="b") == 0


def test_ids(spark):
    assert one(spark, X.tablet_id_of(F.col("a")), a="images/CDLI-P000123.jpg") == "CDLI-P000123"
    assert one(spark, X.tablet_id_of(F.col("a")), a="photo_P42.png") == "CDLI-P42"
    assert one(spark, X.tablet_id_of(F.col("a")), a="mine.png") == "USER-mine"
    assert one(spark, X.short_md5("FM-", F.col("a"), F.col("b")), a="x", b=None) == "FM-" + hashlib.md5(b"x").hexdigest()[:12]
    assert one(spark, X.canonical_pair(F.col("a"), F.col("b")), a="KI", b="AN") == "AN.KI"
