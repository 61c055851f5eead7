"""Queries over single records: filters, previews, ids, labels and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tellstone.constants import COMPOUNDS, MOTIF_GROUPS, NO_MOTIF_GROUP
from tellstone.functions import text as X
from tellstone.operators import catalog as C
from tellstone.operators import motifs as M
from tellstone.plans.motifs import SQL as MOTIF_SQL
from tellstone.plans.motifs import motif_texts
from tellstone.plans.readings import SQL as READING_SQL
from tellstone.plans.readings import all_tokens
from tellstone.sinks import exports
from tellstone.sources.tables import catalog, detections, myths, read_table, tablets

_T = "(select distinct on (id) * from tablets order by id, created_at desc)"
_M = "(select distinct on (id) * from myth_texts order by id, created_at desc)"
_C = "(select distinct on (id) * from corpus_catalog order by id)"
_S = "(select distinct on (id) * from cuneiform_signs order by id)"
PREFIXES = ("CDLI-", "USER-", "LEGACY-")


def prefixed_tablets(spark: SparkSession, folder: str) -> DataFrame:
    """Tablets whose id has a known prefix, by prefix; the filter reaches the scan."""
    known = [F.col("id").startswith(p) for p in PREFIXES]
    rows = read_table(spark, folder, "tablets", "id").where(known[0] | known[1] | known[2]).distinct()
    return rows.groupBy(F.concat(F.substring_index("id", "-", 1), F.lit("-")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def texts_without_motifs(spark: SparkSession, folder: str) -> DataFrame:
    """Myth texts that no motif was found in."""
    texts = motif_texts(spark, folder)
    return texts.select("text_id").join(M.motif_matches(texts), "text_id", "left_anti")


def previews(spark: SparkSession, folder: str) -> DataFrame:
    """The first 200, 100 and 40 characters of transliteration, title and genre."""
    rows = tablets(spark, folder, "transliteration", "title", "genre")
    return rows.select("id", *[F.substring(c, 1, n).alias(c) for c, n in (("transliteration", 200), ("title", 100), ("genre", 40))])


def card_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers for an overview of the detected signs."""
    return detections(spark, folder, "tablet_id", "sign_type", "confidence").agg(
        F.count(F.lit(1)).alias("n_signs"), F.countDistinct("tablet_id").alias("n_tablets"), F.countDistinct("sign_type").alias("n_types"), F.round(F.avg("confidence"), 6).alias("mean_confidence")
    )


def sign_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over all tablets: tablets with signs, signs, and the most on one tablet."""
    per = detections(spark, folder, "tablet_id").groupBy("tablet_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count("tablet_id").alias("n_tablets"), F.sum("n").alias("n_signs"), F.max("n").alias("most"))


def tablet_motif_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Motif groups of the title and transliteration of each tablet."""
    rows = tablets(spark, folder, "title", "transliteration")
    return rows.select("id", F.array_join(X.motif_groups(F.concat_ws(" ", "title", "transliteration")), "|").alias("groups"))


def image_tablets(spark: SparkSession, folder: str) -> DataFrame:
    """Tablet ids in the names of the image files, with the number of signs of each image."""
    rows = detections(spark, folder, "image_path").where("image_path is not null")
    return rows.groupBy("image_path").agg(F.count(F.lit(1)).alias("n")).select("image_path", X.tablet_id_of(F.col("image_path")).alias("tablet_id"), "n")


def short_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids made of hashes: an MD5 of id and text, a prefixed short one, and the catalogue's."""
    rows = catalog(spark, folder, "title", "transliteration", "translation")
    text = F.coalesce("transliteration", F.lit(""))
    return rows.select(
        "id", F.md5(F.concat(F.col("id").cast("string"), text)).alias("text_md5"), X.short_md5("CLUSTER-", text).alias("short_md5"), X.content_hash(F.col("title"), F.col("transliteration"), F.col("translation")).alias("content_hash")
    )


def first_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of even id that are inserted after those of odd id, where the first of a content hash wins."""
    rows = catalog(spark, folder, "transliteration").where("transliteration <> ''").select("id", X.content_hash(F.col("transliteration")).alias("hash"))
    return C.first_wins(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["hash"], ["id"]).select("hash", "id")


def updated_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of the catalogue after one update: OB texts without a language get one."""
    rows = C.set_values(catalog(spark, folder, "period", "language"), (F.col("period") == "OB") & F.col("language").isNull(), language="akk")
    return rows.groupBy("period", "language").agg(F.count(F.lit(1)).alias("n"))


def catalog_json_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON lines of the catalogue, read back: titles and whether nulls were written."""
    lines = exports.jsonl(catalog(spark, folder, "title", "period"))
    return lines.select(F.get_json_object("value", "$.id").cast("bigint").alias("id"), F.get_json_object("value", "$.title").alias("title"), F.contains("value", F.lit('"period":null')).alias("period_is_null"))


def knowledge_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The known signs as JSON documents, read back: readings and numbers."""
    rows = exports.jsonl(read_table(spark, folder, "prebaked_sign_knowledge", "sign_id", "borger_number", "sumerian_readings", "corpus_frequency"))
    get = lambda path: F.get_json_object("value", f"$.{path}")
    return rows.select(get("sign_id").alias("sign_id"), get("borger_number").alias("borger_number"), get("sumerian_readings[0]").alias("first_reading"), get("corpus_frequency").cast("int").alias("corpus_frequency"))


def top_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty most frequent runs of two and of three sign tokens."""
    rows = all_tokens(spark, folder)
    sized = lambda n: F.transform(X.ngrams(F.col("tokens"), n), lambda g: F.struct(F.lit(n).alias("size"), g.alias("ngram")))
    runs = F.concat(sized(2), sized(3))
    counts = rows.select(F.explode(runs).alias("g")).groupBy("g.size", "g.ngram").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("size").orderBy(F.desc("n"), "ngram"))
    return counts.withColumn("place", place).where("place <= 20")


def compound_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """How often each known compound stands as a run of sign tokens."""
    rows = all_tokens(spark, folder).select(F.concat(F.lit("."), F.array_join("tokens", "."), F.lit(".")).alias("t"))
    counts = rows.agg(*[F.count_if(F.contains("t", F.lit(f".{c}."))).alias(f"c{i}") for i, c in enumerate(COMPOUNDS)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("composite"), F.col(f"c{i}").alias("n_records")) for i, c in enumerate(COMPOUNDS)])).alias("x")).select("x.*")


QUERIES = {f.__name__: f for f in (
    prefixed_tablets, texts_without_motifs, previews, card_metrics, sign_totals, tablet_motif_groups, image_tablets, short_ids, first_entries, updated_entries, catalog_json_keys, knowledge_documents,
    top_ngrams, compound_tokens,
)}


def _held(text: str, markers: list[str]) -> str:
    return " or ".join("contains(" + text + ", '" + m.lower().replace("'", "''") + "')" for m in dict.fromkeys(markers))


_MOTIFS = MOTIF_SQL["motif_presence"].rsplit("select text_id", 1)[0]
_TOKENS = READING_SQL["token_frequencies"].rsplit(" select token", 1)[0]
_GROUPED = "list_filter([" + ", ".join(f"case when {_held('t', markers)} then '{name}' end" for name, markers in MOTIF_GROUPS.items()) + "], lambda x: x is not null)"
_RUN = lambda n: f"list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
SQL = {
    "prefixed_tablets": "select regexp_extract(id, '^[A-Z]+-') as prefix, count(distinct id) as n from tablets where id like 'CDLI-%' or id like 'USER-%' or id like 'LEGACY-%' group by 1",
    "texts_without_motifs": _MOTIFS + "select text_id from t where text_id not in (select text_id from m)",
    "previews": f"select id, left(transliteration, 200) as transliteration, left(title, 100) as title, left(genre, 40) as genre from {_T}",
    "card_metrics": f"select count(*) as n_signs, count(distinct tablet_id) as n_tablets, count(distinct sign_type) as n_types, round(avg(confidence), 6) as mean_confidence from {_S}",
    "sign_totals": f"with p as (select tablet_id, count(*) as n from {_S} group by 1) select count(tablet_id) as n_tablets, sum(n)::bigint as n_signs, max(n) as most from p",
    "tablet_motif_groups": f"select id, case when len({_GROUPED}) = 0 then '{NO_MOTIF_GROUP}' else array_to_string({_GROUPED}, '|') end as groups from (select id, lower(concat_ws(' ', title, transliteration)) as t from {_T})",
    "image_tablets": f"""
with p as (select image_path, regexp_replace(regexp_extract(image_path, '([^/\\\\]*)$', 1), '\\.[^./\\\\]*$', '') as stem, count(*) as n from {_S} where image_path is not null group by all)
select image_path, case when stem like 'CDLI-%' then stem when regexp_matches(stem, 'P\\d+') then 'CDLI-' || regexp_extract(stem, 'P\\d+') else 'USER-' || stem end as tablet_id, n from p""",
    "short_ids": f"""
select id, md5(id::varchar || coalesce(transliteration, '')) as text_md5, 'CLUSTER-' || left(md5(coalesce(transliteration, '')), 12) as short_md5,
  left(sha256(coalesce(title, '') || coalesce(transliteration, '') || coalesce(translation, '')), 16) as content_hash from {_C}""",
    "first_entries": f"with h as (select id, left(sha256(transliteration), 16) as hash from {_C} where transliteration <> '') select hash, min(id) as id from h where id % 2 = 0 and hash not in (select hash from h where id % 2 = 1) group by 1",
    "updated_entries": f"select period, case when period = 'OB' and language is null then 'akk' else language end as language, count(*) as n from {_C} group by 1, 2",
    "catalog_json_keys": f"select id, title, period is null as period_is_null from {_C}",
    "knowledge_documents": "select sign_id, borger_number, sumerian_readings[1] as first_reading, corpus_frequency from prebaked_sign_knowledge",
    "top_ngrams": f"""{_TOKENS}, g as (select 2 as size, unnest({_RUN(2)}) as ngram from r union all select 3, unnest({_RUN(3)}) from r), c as (select size, ngram, count(*) as n from g group by all)
select size, ngram, n, cast(row_number() over (partition by size order by c.n desc, ngram) as integer) as place from c qualify place <= 20""",
    "compound_tokens": _TOKENS + ", s as (select '.' || array_to_string(w, '.') || '.' as s from r) " + " union all ".join(f"select '{c}' as composite, count(*) filter (contains(s, '.{c}.')) as n_records from s" for c in COMPOUNDS),
}
