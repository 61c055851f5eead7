"""Problem 2: records that read the same but are stored in different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.llm.cleantext import canonical_classes, clean_sql, varied_classes, words, words_sql
from tellstone.sources.tables import read_table

TABLES = ("tablets", "corpus_catalog", "myth_texts")
LEAST_WORDS = 8


def transliterations(spark: SparkSession, folder: str, *tables: str) -> DataFrame:
    """Rows ``rec`` (``table:id``) and ``text`` of the named tables; rows that come again are still there."""
    out = None
    for t in tables:
        part = read_table(spark, folder, t, "id", "transliteration").select(
            F.concat_ws(":", F.lit(t), F.col("id").cast("string")).alias("rec"), F.col("transliteration").alias("text")
        )
        out = part if out is None else out.unionByName(part)
    return out


def same_reading(records: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Pairs rec_a < rec_b of records with the same canonical text but different stored text.

    Only classes that hold different stored texts go on; in these every record is
    reduced to a hash of its class and one of its stored text before it meets the
    others, and pairs of equal stored texts never arise from copies of one record.
    Texts of fewer than ``least_words`` words and null texts are left out; a record that comes
    again counts once. An empty input gives an empty result.
    """
    classes = varied_classes(records)
    members = (
        classes.where(F.size(words(F.col("canonical"))) >= least_words)
        .select("rec", F.sha2(F.col("canonical"), 256).substr(1, 32).alias("class"), F.xxhash64("text").alias("form"))
        .distinct()
    )
    a, b = (members.select(F.col("class"), F.col("rec").alias(f"rec_{x}"), F.col("form").alias(f"form_{x}")) for x in "ab")
    return a.join(b, "class").where("rec_a < rec_b and form_a <> form_b").select("rec_a", "rec_b").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_reading(transliterations(spark, folder, *TABLES))


def p2_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its canonical text."""
    return canonical_classes(transliterations(spark, folder, *TABLES))


_RECORDS = " union all ".join(f"select '{t}:' || cast(id as varchar) as rec, transliteration as text from {t}" for t in TABLES)

QUERIES = {"p2_found": p2_found, "p2_canonical": p2_canonical}
SQL = {
    "p2_found": f"""
with r as (select distinct rec, text, {clean_sql('text')} as canonical from ({_RECORDS}) where text is not null),
m as (select * from r where len({words_sql('canonical')}) >= {LEAST_WORDS})
select distinct a.rec as rec_a, b.rec as rec_b from m a join m b on a.canonical = b.canonical and a.rec < b.rec and a.text <> b.text
""",
    "p2_canonical": f"select rec, min({clean_sql('text')}) as canonical from ({_RECORDS}) group by rec",
}
