"""Text functions: cleaning, hashing, classifying and tokenising, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tellstone.constants import GENRES, LANGUAGES, MOTIF_GROUPS, MYTH_LABELS, NO_LABEL, NO_MOTIF_GROUP, PERIOD_MARKERS


def spaced_text(text: Column) -> Column:
    """Printable characters with a blank between each two, trimmed: the form that legacy ids are hashed from.

    Null gives empty text.
    """
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "", -1), lambda c: (c >= " ") | c.isin("\t", "\n", "\r"))
    return F.regexp_replace(F.array_join(F.filter(kept, lambda c: c != ""), " "), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def printable_text(text: Column) -> Column:
    """Text without control characters, trimmed; null gives empty text."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def content_hash(*fields: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the fields put together; null counts as empty."""
    return F.sha2(F.concat(*[F.coalesce(f, F.lit("")) for f in fields]), 256).substr(1, 16)


def short_md5(prefix: str, *fields: Column) -> Column:
    """An id made of a prefix and the first 12 hex digits of an MD5."""
    return F.concat(F.lit(prefix), F.md5(F.concat(*[F.coalesce(f, F.lit("")) for f in fields])).substr(1, 12))


def contains_any(text: Column, markers: Iterable[str]) -> Column:
    """Whether text holds any of the markers anywhere."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in dict.fromkeys(markers)])


def first_class(text: Column, classes: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The first class one of whose markers is in the lower-cased text; null text counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(contains_any(low, markers), name) for name, markers in classes], F.lit(otherwise))


def language_of(cuneiform: Column, transliteration: Column) -> Column:
    return first_class(F.concat(F.coalesce(cuneiform, F.lit("")), F.lit(" "), F.coalesce(transliteration, F.lit(""))), LANGUAGES, "Unknown")


def period_of(source: Column, title: Column) -> Column:
    return first_class(F.concat(F.coalesce(source, F.lit("")), F.lit(" "), F.coalesce(title, F.lit(""))), PERIOD_MARKERS, "Uncertain")


def genre_of(title: Column, transliteration: Column) -> Column:
    return first_class(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(transliteration, F.lit(""))), GENRES, "Unknown")


def _all_classes(text: Column, classes: dict[str, list[str]], otherwise: str) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(contains_any(low, [m.lower() for m in markers]), name) for name, markers in classes.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit(otherwise))).otherwise(found)


def myth_labels(text: Column) -> Column:
    """Every label with a marker in the text, in fixed order, or the one for none."""
    return _all_classes(text, MYTH_LABELS, NO_LABEL)


def motif_groups(text: Column) -> Column:
    """Every motif group with a key word in the text, in fixed order, or the one for none."""
    return _all_classes(text, MOTIF_GROUPS, NO_MOTIF_GROUP)


def _without(tokens: Column, part: str) -> Column:
    return F.transform(tokens, lambda x: F.replace(x, F.lit(part), F.lit("")))


def sign_tokens(transliteration: Column) -> Column:
    """Sign tokens in upper case, in order, by the rules of the sign statistics.

    One leading line mark and comments go; what is left is split at white space and stops. Of each
    token trailing digits, brackets and the determinatives d, giš, ki and uru go, wherever they
    stand; tokens of nothing or only digits are dropped. Null and empty text gives an empty array.
    """
    t = F.regexp_replace(F.coalesce(transliteration, F.lit("")), r"^[&#@]\s*", "")
    t = F.regexp_replace(t, r"(?m)#.*$", "")
    t = F.transform(F.split(t, r"[\s\p{Z}.]+", -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"\p{Nd}+$", ""), r"[()\[\]{}]", ""))
    for determinative in ("d", "giš", "ki", "uru"):
        t = _without(t, determinative)
    return F.transform(F.filter(t, lambda x: (x != "") & ~x.rlike(r"^[\p{Nd}\p{No}]+$")), F.upper)


def words(text: Column) -> Column:
    """Pieces between white space; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+", -1), lambda w: w != "")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where plain columns would compute it at each mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, each joined by a blank; empty for fewer than n."""

    def runs(t: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1)))
        return F.when(F.size(t) >= n, F.transform(places, lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return once(tokens, runs)


def share_of(a: Column, b: Column, by: str = "max") -> Column:
    """Common different members over the larger (``max``) or smaller (``min``) number of different members; 0 if either is empty."""

    def share(s: Column) -> Column:
        sizes = F.size(s["a"]), F.size(s["b"])
        of = (F.greatest if by == "max" else F.least)(*sizes)
        return F.when(F.least(*sizes) > 0, F.size(F.array_intersect(s["a"], s["b"])) / of).otherwise(F.lit(0.0))

    return once(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), share)


def tablet_id_of(path: Column) -> Column:
    """Tablet id in a file name: one that begins with CDLI-, else the first P number, else the user's own name."""
    stem = F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    number = F.nullif(F.regexp_extract(stem, r"P\d+", 0), F.lit(""))
    return F.when(stem.startswith("CDLI-"), stem).otherwise(F.coalesce(F.concat(F.lit("CDLI-"), number), F.concat(F.lit("USER-"), stem)))


def canonical_pair(a: Column, b: Column) -> Column:
    """Two signs in order, joined by a stop."""
    return F.concat_ws(".", F.least(a, b), F.greatest(a, b))
