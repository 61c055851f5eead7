"""Queries over the catalogue, the tablets and their signs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.functions.text import content_hash
from tellstone.functions.times import utc_time
from tellstone.operators import catalog as C
from tellstone.sources.tables import catalog, detections, myths, read_table, tablets

_T = "(select distinct on (id) * from tablets order by id, created_at desc)"
_M = "(select distinct on (id) * from myth_texts order by id, created_at desc)"
_C = "(select distinct on (id) * from corpus_catalog order by id)"
_S = "(select distinct on (id) * from cuneiform_signs order by id)"
_LIST = ("id", "source", "title", "language", "period", "genre")


def tablet_list(spark: SparkSession, folder: str) -> DataFrame:
    return tablets(spark, folder, *_LIST[1:]).orderBy("id")


def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "corpus_catalog").where("corpus_id = 'cdli-main' and object_id = 'P000007' and source_corpus = 'CDLI'")
    return rows.select("id", "corpus_id", "object_id", "title", "period").distinct()


def faceted_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalog(spark, folder, "title", "transliteration", "translation", "source_corpus", "period", "provenance", "accession_date")
    found = C.search(rows, "letter", source_corpus="CDLI", period=["OB", "NA", "URIII"], like={"provenance": "tell"})
    return C.page(found, 100, 5, F.desc(utc_time(F.col("accession_date"))), F.col("id")).select("id", "title", "period")


def search_bracketed(spark: SparkSession, folder: str) -> DataFrame:
    rows = tablets(spark, folder, "title", "transliteration", "p_number", "period")
    return C.search(rows, "12", ("title", "transliteration", "p_number"), period=["OB", "NA"]).select("id", "period")


def search_unbracketed(spark: SparkSession, folder: str) -> DataFrame:
    rows = tablets(spark, folder, "title", "transliteration", "p_number", "period")
    return C.search_loosely(rows, "12", "title", "transliteration", "p_number", period=["OB", "NA"]).select("id", "period")


def any_column_search(spark: SparkSession, folder: str) -> DataFrame:
    return C.any_column_contains(tablets(spark, folder, "title", "language", "period", "p_number"), "hymn|P0000[12]").select("id")


def sign_search(spark: SparkSession, folder: str) -> DataFrame:
    signs = detections(spark, folder, "tablet_id", "sign_type", "confidence").where(F.col("sign_type").isin("wedge", "vertical") & (F.col("confidence") >= 0.6))
    periods = tablets(spark, folder, "period").withColumnRenamed("id", "tablet_id")
    return signs.join(periods, "tablet_id", "left").where(F.col("period").isin("OB", "NA")).select("id", "tablet_id", "sign_type", "period")


def signs_with_period(spark: SparkSession, folder: str) -> DataFrame:
    signs = detections(spark, folder, "tablet_id", "sign_type")
    joined = signs.join(tablets(spark, folder, "period").withColumnRenamed("id", "tablet_id"), "tablet_id", "left")
    return joined.groupBy("period", "sign_type").agg(F.count(F.lit(1)).alias("n"))


def short_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = tablets(spark, folder, "cuneiform").where("length(cuneiform) < 200 and cuneiform <> ''")
    return rows.select("id", F.length("cuneiform").alias("n_chars")).orderBy("n_chars", "id").limit(3)


def facet_stats(spark: SparkSession, folder: str) -> DataFrame:
    return C.facet_counts(catalog(spark, folder, "source_corpus", "period", "genre", "provenance", "language"), "source_corpus", "period", "genre", "provenance", "language", top=20)


def overview(spark: SparkSession, folder: str) -> DataFrame:
    t = tablets(spark, folder, "language", "genre").select(F.lit("tablets").alias("kind"), "language", "genre")
    c = catalog(spark, folder, "language", "genre").select(F.lit("corpus_catalog").alias("kind"), "language", "genre")
    m = myths(spark, folder, "language").select(F.lit("myth_texts").alias("kind"), "language", F.lit(None).cast("string").alias("genre"))
    return t.unionByName(c).unionByName(m).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("language").alias("n_languages"), F.countDistinct("genre").alias("n_genres"))


def without_embedding(spark: SparkSession, folder: str) -> DataFrame:
    with_one = read_table(spark, folder, "prebaked_embeddings", "entry_id").where("entry_id is not null").distinct()
    return catalog(spark, folder, "title").select("id").join(with_one, F.col("id") == F.col("entry_id"), "left_anti")


def embedding_coverage(spark: SparkSession, folder: str) -> DataFrame:
    with_one = read_table(spark, folder, "prebaked_embeddings", "entry_id", "entry_type").where("entry_type = 'corpus_catalog' and entry_id is not null")
    marks = with_one.groupBy("entry_id").agg(F.lit(True).alias("covered"))
    joined = catalog(spark, folder, "source_corpus").join(marks, F.col("id") == F.col("entry_id"), "left")
    grouped = joined.groupBy("source_corpus").agg(F.count(F.lit(1)).alias("n"), F.count_if("covered").alias("n_covered"))
    return grouped.withColumn("percent", F.round(F.col("n_covered") * 100.0 / F.greatest("n", F.lit(1)), 4))


def embedding_dims(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "prebaked_embeddings", "embedding_type", "embedding_dim").groupBy("embedding_type", "embedding_dim").agg(F.count(F.lit(1)).alias("n"))


def sign_type_totals(spark: SparkSession, folder: str) -> DataFrame:
    kinds = ("wedge", "vertical", "horizontal", "angled", "complex")
    counts = [F.count_if(F.col("sign_type") == k).alias(f"n_{k}") for k in kinds]
    rows = detections(spark, folder, "tablet_id", "sign_type", "confidence")
    return rows.groupBy("tablet_id").agg(F.count(F.lit(1)).alias("total_signs"), *counts, F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("avg_confidence"))


def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    rows = tablets(spark, folder, "myth_labels").select(F.explode("myth_labels").alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def catalog_batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = C.batches(catalog(spark, folder, "corpus_id", "object_id"), 1000, "corpus_id", "object_id", "id")
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id"), F.max("id").alias("largest_id"))


def metadata_values(spark: SparkSession, folder: str) -> DataFrame:
    v = F.try_parse_json("metadata_json")
    return catalog(spark, folder, "metadata_json").select("id", F.try_variant_get(v, "$.lot", "bigint").alias("lot"), F.try_variant_get(v, "$.columns", "bigint").alias("n_columns"))


def stale_hashes(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalog(spark, folder, "title", "transliteration", "translation", "content_hash")
    made = content_hash(F.col("title"), F.col("transliteration"), F.col("translation"))
    return rows.select("id", made.alias("made_hash"), F.when(F.col("content_hash").isNull(), "missing").when(F.col("content_hash") == made, "fresh").otherwise("stale").alias("state"))


def first_of_content(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalog(spark, folder, "transliteration").where("transliteration is not null and transliteration <> ''").select("id", content_hash(F.col("transliteration")).alias("hash"))
    return rows.groupBy("hash").agg(F.min("id").alias("id"))


def upserted_matches(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "join_match", "tablet_a", "tablet_b", "join_confidence").where("tablet_a <> '' and tablet_b <> '' and join_confidence is not null and not isnan(join_confidence)")
    pairs = rows.select(F.least("tablet_a", "tablet_b").alias("a"), F.greatest("tablet_a", "tablet_b").alias("b"), "join_confidence")
    low, high = pairs.where("join_confidence < 0.5"), pairs.where("join_confidence >= 0.5")
    return C.last_wins(low, high, ["a", "b"], "join_confidence")


def accession_months(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalog(spark, folder, "accession_date", "source_corpus")
    return rows.groupBy(F.date_format(utc_time(F.col("accession_date")), "yyyy-MM").alias("month"), "source_corpus").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    tablet_list, point_lookup, faceted_search, search_bracketed, search_unbracketed, any_column_search, sign_search, signs_with_period, short_texts, facet_stats, overview,
    without_embedding, embedding_coverage, embedding_dims, sign_type_totals, label_distribution, catalog_batches, metadata_values, stale_hashes, first_of_content, upserted_matches, accession_months,
)}

_HASH = "left(sha256(coalesce(title, '') || coalesce(transliteration, '') || coalesce(translation, '')), 16)"
_ACCESSION = "cast(case when length(accession_date) > 19 then accession_date else accession_date || '+00:00' end as timestamptz)"
SQL = {
    "tablet_list": f"select id, source, title, language, period, genre from {_T} order by id",
    "point_lookup": "select distinct id, corpus_id, object_id, title, period from corpus_catalog where corpus_id = 'cdli-main' and object_id = 'P000007' and source_corpus = 'CDLI'",
    "faceted_search": f"""
select id, title, period from {_C}
where (title ilike '%letter%' or transliteration ilike '%letter%' or translation ilike '%letter%') and source_corpus = 'CDLI' and period in ('OB', 'NA', 'URIII') and provenance ilike '%tell%'
order by {_ACCESSION} desc nulls last, id limit 100 offset 5""",
    "search_bracketed": f"select id, period from {_T} where (title ilike '%12%' or transliteration ilike '%12%' or p_number ilike '%12%') and period in ('OB', 'NA')",
    "search_unbracketed": f"select id, period from {_T} where title ilike '%12%' or transliteration ilike '%12%' or (p_number ilike '%12%' and period in ('OB', 'NA'))",
    "any_column_search": f"select id from {_T} where regexp_matches(concat_ws(chr(10), id, title, language, period, p_number), '(?i)hymn|P0000[12]')",
    "sign_search": f"""
select s.id, s.tablet_id, s.sign_type, t.period from {_S} s left join {_T} t on t.id = s.tablet_id
where s.sign_type in ('wedge', 'vertical') and s.confidence >= 0.6 and t.period in ('OB', 'NA')""",
    "signs_with_period": f"select t.period, s.sign_type, count(*) as n from {_S} s left join {_T} t on t.id = s.tablet_id group by all",
    "short_texts": f"select id, cast(length(cuneiform) as integer) as n_chars from {_T} where length(cuneiform) < 200 and cuneiform <> '' order by 2, 1 limit 3",
    "facet_stats": f"""
with f as (
  select 'source_corpus' as facet, source_corpus as value from {_C} union all select 'period', period from {_C} union all select 'genre', genre from {_C}
  union all select 'provenance', provenance from {_C} union all select 'language', language from {_C}),
n as (select facet, value, count(*) as n from f where value is not null group by all)
select facet, value, n from n qualify row_number() over (partition by facet order by n desc, value) <= 20""",
    "overview": f"""
select 'tablets' as kind, count(*) as n, count(distinct language) as n_languages, count(distinct genre) as n_genres from {_T}
union all select 'corpus_catalog', count(*), count(distinct language), count(distinct genre) from {_C}
union all select 'myth_texts', count(*), count(distinct language), 0 from {_M}""",
    "without_embedding": f"select id from {_C} c where not exists (select 1 from prebaked_embeddings e where e.entry_id = c.id)",
    "embedding_coverage": f"""
select source_corpus, count(*) as n, count(e.entry_id) as n_covered, round(count(e.entry_id) * 100.0 / greatest(count(*), 1), 4) as percent
from {_C} c left join (select distinct entry_id from prebaked_embeddings where entry_type = 'corpus_catalog') e on e.entry_id = c.id group by source_corpus""",
    "embedding_dims": "select embedding_type, embedding_dim, count(*) as n from prebaked_embeddings group by all",
    "sign_type_totals": f"""
select tablet_id, count(*) as total_signs, """ + ", ".join(f"count(*) filter (sign_type = '{k}') as n_{k}" for k in ("wedge", "vertical", "horizontal", "angled", "complex")) + f""",
round(coalesce(avg(confidence), 0), 6) as avg_confidence from {_S} group by tablet_id""",
    "label_distribution": f"select label, count(*) as n from (select unnest(myth_labels) as label from {_T}) group by label",
    "catalog_batches": f"""
with r as (select id, (row_number() over (order by corpus_id nulls first, object_id nulls first, id) - 1) // 1000 as batch from {_C})
select batch, count(*) as n, min(id) as least_id, max(id) as largest_id from r group by batch""",
    "metadata_values": f"select id, cast(metadata_json ->> '$.lot' as bigint) as lot, cast(metadata_json ->> '$.columns' as bigint) as n_columns from {_C}",
    "stale_hashes": f"select id, {_HASH} as made_hash, case when content_hash is null then 'missing' when content_hash = {_HASH} then 'fresh' else 'stale' end as state from {_C}",
    "first_of_content": f"select left(sha256(transliteration), 16) as hash, min(id) as id from {_C} where transliteration <> '' group by 1",
    "upserted_matches": """
select least(tablet_a, tablet_b) as a, greatest(tablet_a, tablet_b) as b, max(join_confidence) as join_confidence from join_match
where tablet_a <> '' and tablet_b <> '' and join_confidence is not null and not isnan(join_confidence) group by 1, 2""",
    "accession_months": f"select strftime({_ACCESSION} at time zone 'UTC', '%Y-%m') as month, source_corpus, count(*) as n from {_C} group by all",
}
