"""Texts of several tables as one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(*columns: str) -> Column:
    """Columns with a blank between each two, trimmed; null counts as empty but keeps its blank."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    return F.trim(F.concat(*[x for p in parts for x in (F.lit(" "), p)][1:]))


def entry_texts(tablets: DataFrame, myths: DataFrame, catalog: DataFrame) -> DataFrame:
    """entry_id, entry_type, text: transliteration, second text and title of all entries that have a transliteration."""
    kinds = ((tablets, "tablet", "cuneiform"), (myths, "myth_text", "translation"), (catalog, "corpus_catalog", "translation"))
    out = None
    for rows, kind, second in kinds:
        part = rows.where("transliteration <> ''").select(F.col("id").cast("string").alias("entry_id"), F.lit(kind).alias("entry_type"), _joined("transliteration", second, "title").alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def transliterations(tablets: DataFrame, myths: DataFrame, catalog: DataFrame) -> DataFrame:
    """source, transliteration of all entries that have one; without a source the table's name stands for it."""
    kinds = ((tablets, "source", "tablets"), (myths, "corpus_source", "myth_texts"), (catalog, "source_corpus", "corpus_catalog"))
    out = None
    for rows, source, name in kinds:
        part = rows.where("transliteration <> ''").select(F.coalesce(F.col(source), F.lit(name)).alias("source"), "transliteration")
        out = part if out is None else out.unionByName(part)
    return out
