"""Text in one consistent form: the same reading is the same string.

Everything here is a column expression that runs inside the JVM. ``clean_sql`` gives
the same form for an SQL engine that has ``translate`` and ``nfc_normalize``.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellstone.session import Scratch

# Letters of other scripts that look like Latin ones, and the Latin ones (after the confusables of the Unicode standard, without letters
# that only resemble each other, as α and a or ı and i).
_SCRIPTS = (
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"), ("νορυϲϳ", "vopucj"),  # Greek
    ("АВЕЅІЈКМНОРСТХԚԜҺӀѴҮԌ", "ABESIJKMHOPCTXQWHIVYG"), ("аеорсухѕіјԁԛԝһӏѵү", "aeopcyxsijdqwhlvy"),  # Cyrillic
    ("ՍՏՕ", "USO"), ("հոսցօզ", "hnugoq"),  # Armenian
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᎩᏃ", "ABCDEGHJKLMPRSTVWYZ"),  # Cherokee
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ɑɡ", "ag"),  # Latin letters of phonetic script
)
LOOK_ALIKES = {c: latin for others, ours in _SCRIPTS for c, latin in zip(others, ours, strict=True)}
# Characters without a mark on the page that are no format characters (fillers, vowels and selectors), as first and last of their ranges.
UNSEEN = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
# Hyphens and the minus sign that look like the ordinary hyphen.
HYPHENS = "‐‑‒−﹣"
#: Ranges of characters that are mapped to themselves; text of nothing else is left as it is.
PLAIN = r"\x20-\x7e\u00c0-\u024f\u1e00-\u1eff\u2080-\u2089"
# Editorial marks that words and signs leave out.
MARKS = "[]()<>#?!"


@lru_cache(maxsize=1)
def translate_map() -> tuple[str, str]:
    """Arguments of ``translate``: characters to replace, then those to delete.

    By rule, over all planes: full-width forms by their offset, every blank (Zs, and the Braille blank) to the blank, every
    invisible format character (Cf) and filler to nothing, and characters that
    are canonically the same as an ASCII one, or a Roman numeral of one letter, to that. Forms that look different stay apart, as
    superscripts and mathematical alphabets do.
    """
    pairs = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | LOOK_ALIKES | dict.fromkeys(HYPHENS, "-") | {"\u2800": " "}
    gone = [chr(c) for first, last in UNSEEN for c in range(first, last + 1)]
    for c in (*range(0x20000), *range(0xE0000, 0xE1000)):
        kind = unicodedata.category(chr(c))
        same = unicodedata.normalize("NFD", chr(c))
        if c > 0x7E and len(same) == 1 and same < "\x7f":
            pairs[chr(c)] = same
        elif kind == "Nl" and len(joined := _spelled(c)) == 1:
            pairs[chr(c)] = joined
        elif kind == "Zs" and c != 0x20:
            pairs[chr(c)] = " "
        elif kind == "Cf" and not 0x600 <= c <= 0x8E2 and chr(c) not in gone and not 0x11000 <= c < 0x14000:  # signs of Arabic, Kaithi and hieroglyphs that are seen
            gone.append(chr(c))
    return "".join(pairs) + "".join(gone), "".join(pairs.values())


def _spelled(c: int) -> str:
    """Letters of ASCII that a character is made of by compatibility, without a change of form; else nothing."""
    parts = unicodedata.decomposition(chr(c)).split()
    text = "".join(chr(int(x, 16)) for x in parts[1:]) if parts[:1] == ["<compat>"] else ""
    return text if text.isascii() and text.isalpha() else ""


@lru_cache(maxsize=1)
def ligatures() -> dict[str, str]:
    """Ligatures and Roman numerals of several letters, which look like these letters."""
    return {chr(c): text for c in (*range(0xFB00, 0xFB07), *range(0x2160, 0x2180)) if len(text := _spelled(c)) > 1}


@lru_cache(maxsize=1)
def compositions() -> list[tuple[str, str]]:
    """Letters followed by accents, in any order that means the same, and the one composed character."""
    out = {}
    for c in range(0xC0, 0x2000):
        apart = unicodedata.normalize("NFD", chr(c))
        if len(apart) > 1 and unicodedata.normalize("NFC", apart) == chr(c):
            for marks in itertools.permutations(apart[1:]):
                if unicodedata.normalize("NFC", spelled := apart[0] + "".join(marks)) == chr(c):
                    out[spelled] = chr(c)
            if len(apart) == 3:  # its first accent may already be composed
                for first, last in ((apart[1], apart[2]), (apart[2], apart[1])):
                    if len(half := unicodedata.normalize("NFC", apart[0] + first)) == 1 and unicodedata.normalize("NFC", half + last) == chr(c):
                        out[half + last] = chr(c)
    return sorted(out.items())


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where plain columns would compute it at each mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mapped_text(text: Column) -> Column:
    """Text with look-alikes, widths, blanks and hyphens replaced and nothing invisible; accents as stored."""
    source, target = translate_map()
    joined = text
    for sign, letters in ligatures().items():
        joined = F.replace(joined, F.lit(sign), F.lit(letters))
    joined = F.when(text.rlike(f"[{''.join(ligatures())}]"), joined).otherwise(text)
    return F.when(text.rlike(f"[^{PLAIN}]"), F.translate(joined, source, target)).otherwise(text)


@lru_cache(maxsize=1)
def _pairs_and_classes() -> tuple[dict[str, str], dict[str, str], str, str]:
    """A letter and one accent with the composed character; composed characters with their parts; all accents, and characters in the order of their classes."""
    apart = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2000) if unicodedata.normalize("NFC", chr(c)) == chr(c)}
    apart = {c: parts for c, parts in apart.items() if len(parts) > 1}
    pairs = {a + b: c for c in apart for a, b in [(unicodedata.normalize("NFC", apart[c][:-1]), apart[c][-1])] if len(a) == 1}
    marks = "".join(chr(c) for c in range(0x300, 0x2100) if unicodedata.combining(chr(c)))
    return pairs, apart, marks, "".join(chr(0x100 + unicodedata.combining(c)) for c in marks)


def _composed_letter(piece: Column) -> Column:
    """A letter with any accents in canonical order, and composed as far as it can be: each accent with the letter, unless one of its class stands between."""
    pairs, apart, marks, classes = _pairs_and_classes()
    table = lambda d: F.map_from_arrays(F.array(*map(F.lit, d)), F.array(*map(F.lit, d.values())))
    first = F.substring(piece, 1, 1)
    spelled = F.concat(F.coalesce(F.try_element_at(table(apart), first), first), F.substring(piece, F.lit(2), F.length(piece)))
    of = lambda c: F.translate(c, marks, classes)
    accents = F.transform(F.split(F.substring(spelled, F.lit(2), F.length(spelled)), "", -1), lambda c, i: F.struct(of(c).alias("class"), i.alias("i"), c.alias("c")))
    begin = F.struct(F.substring(spelled, 1, 1).alias("base"), F.lit("").alias("rest"), F.lit("").alias("last"))

    def add(now: Column, x: Column) -> Column:
        joined = F.when(now["last"] != x["class"], F.try_element_at(table(pairs), F.concat(now["base"], x["c"])))
        kept = F.struct(now["base"].alias("base"), F.concat(now["rest"], x["c"]).alias("rest"), x["class"].alias("last"))
        return F.when(joined.isNull(), kept).otherwise(F.struct(joined.alias("base"), now["rest"].alias("rest"), now["last"].alias("last")))

    return F.aggregate(F.array_sort(F.filter(accents, lambda x: x["c"] != "")), begin, add, lambda x: F.concat(x["base"], x["rest"]))


def composed_text(text: Column) -> Column:
    """Text with accents composed and in canonical order; only text that has separate accents is taken apart."""
    table = F.map_from_arrays(*[F.array(*[F.lit(pair[i]) for pair in compositions()]) for i in (0, 1)])
    letters = F.regexp_extract_all(text, F.lit(r"(?s)\P{M}\p{M}*|\p{M}+"), F.lit(0))
    whole = lambda g: F.when(F.length(g) > 1, F.coalesce(F.try_element_at(table, g), _composed_letter(g))).otherwise(g)
    return F.when(text.rlike(r"\p{M}"), F.array_join(F.transform(letters, whole), "")).otherwise(text)


def clean_text(text: Column) -> Column:
    """The consistent form. Null stays null, text of nothing but invisible characters becomes empty."""
    return _with(mapped_text(text), composed_text)


def bare_text(clean: Column) -> Column:
    """Clean text without editorial marks, in lower case."""
    return F.lower(F.translate(clean, MARKS, ""))


def words(clean: Column) -> Column:
    """Words of clean text; null for null, empty for text of nothing but blanks and marks."""
    return F.filter(F.split(bare_text(clean), " ", -1), lambda w: w != "")


def signs(clean: Column) -> Column:
    """Signs of clean text in order, with repetitions; null for null."""
    plain = F.translate(bare_text(clean), "₀₁₂₃₄₅₆₇₈₉", "0123456789")
    return F.filter(F.split(plain, r"[ .\-]", -1), lambda s: (s != "") & (s != "x"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean_sql(column: str) -> str:
    """The consistent form of a column in SQL."""
    source, target = translate_map()
    for sign, letters in ligatures().items():
        column = f"replace({column}, '{sign}', '{letters}')"
    return f"nfc_normalize(translate({column}, {_quoted(source)}, {_quoted(target)}))"


def words_sql(clean: str) -> str:
    return f"list_filter(string_split(lower(translate({clean}, '{MARKS}', '')), ' '), lambda w: w <> '')"


def signs_sql(clean: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower(translate({clean}, '{MARKS}', '')), '₀₁₂₃₄₅₆₇₈₉', '0123456789'), '[ .-]'), lambda s: s <> '' and s <> 'x')"


def _blocked(records: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Records with ``_mapped`` and ``_block``, and the blocks that hold different stored texts.

    A block is a hash of the ASCII characters that no accent follows. Texts that are equal under
    the collation agree in these, so classes never reach across blocks.
    """
    rows = records.drop("canonical", "_key").withColumn("_mapped", mapped_text(F.col(text)))
    rows = rows.withColumn("_block", F.xxhash64(F.regexp_replace("_mapped", r"[^\x20-\x7e]|[\x20-\x7e](?=\p{M})", "")))
    stored = F.xxhash64(F.col(text))
    mixed = rows.where(F.col(text).isNotNull()).groupBy("_block").agg(F.min(stored).alias("low"), F.max(stored).alias("high")).where("low <> high").select("_block")
    return rows, mixed


def varied_classes(records: DataFrame, text: str = "text") -> DataFrame:
    """Records whose class holds different stored texts, with ``canonical``.

    Look-alikes are mapped first. Only blocks that hold different stored texts go on, so that
    most texts are neither sorted nor sent. Their mapped texts are grouped under the
    accent-sensitive and case-sensitive Unicode collation, which holds composed and separate
    accents to be equal; the canonical member of a class is its smallest mapped text in binary
    order, with accents composed, and is joined back to all its records. Null texts have no class. Other
    columns stay, but one named ``canonical`` is replaced.
    """
    rows, mixed = _blocked(records, text)
    rows = Scratch(records.sparkSession, "classes").write(rows.where(F.col(text).isNotNull()).join(mixed, "_block", "left_semi"))
    key = F.collate(F.col("_mapped"), "UNICODE")
    classes = rows.groupBy(key.alias("_key")).agg(F.min("_mapped").alias("_member"), F.min(text).alias("_low"), F.max(text).alias("_high")).where("_low <> _high")
    classes = classes.select("_key", composed_text(F.col("_member")).alias("canonical"))
    return rows.withColumn("_key", key).join(classes, "_key").drop("_key", "_mapped", "_block")


def canonical_classes(records: DataFrame, text: str = "text", key: str = "rec") -> DataFrame:
    """Every record's ``key`` with ``canonical``: one string for all texts that read the same.

    Classes are those of ``varied_classes``; any other text is its own canonical member, mapped and
    with accents composed. Null text keeps a null canonical, empty text is a text like any other.
    A record that comes again with the same key counts once.
    """
    rows, _ = _blocked(records, text)
    found = varied_classes(records.select(key, text), text).groupBy(key).agg(F.min("canonical").alias("_canonical"))
    own = rows.groupBy(key).agg(F.min(composed_text(F.col("_mapped"))).alias("_own"))
    return own.join(found, key, "left").select(key, F.coalesce("_canonical", "_own").alias("canonical"))
