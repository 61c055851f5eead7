"""Queries over signs in context, classes and labels of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.constants import COMPOUNDS, GENRES, LANGUAGES, MYTH_LABELS, NO_LABEL, PERIOD_MARKERS, RULE_TEMPLATES
from tellstone.functions import text as X
from tellstone.operators import readings as R
from tellstone.session import Scratch
from tellstone.sinks import exports
from tellstone.sources.tables import catalog, myths, read_table, tablets
from tellstone.sources.unions import entry_texts, transliterations

_T = "(select distinct on (id) * from tablets order by id, created_at desc)"
_M = "(select distinct on (id) * from myth_texts order by id, created_at desc)"
_C = "(select distinct on (id) * from corpus_catalog order by id)"
CONTEXT = ["EN", "WE-QU-ḪA"]


def all_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = transliterations(tablets(spark, folder, "source", "transliteration"), myths(spark, folder, "corpus_source", "transliteration"), catalog(spark, folder, "source_corpus", "transliteration"))
    return rows.select(X.sign_tokens(F.col("transliteration")).alias("tokens"))


def written_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The same, written once for queries that count them more than once."""
    return Scratch(spark, "tokens").write(all_tokens(spark, folder))


def classified_tablets(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    rows = tablets(spark, folder, "source", "title", "cuneiform", "transliteration")
    return rows.select("id", X.language_of(c("cuneiform"), c("transliteration")).alias("language"), X.period_of(c("source"), c("title")).alias("period"), X.genre_of(c("title"), c("transliteration")).alias("genre"))


def tablet_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = tablets(spark, folder, "title", "transliteration")
    labels = X.myth_labels(F.concat_ws(" ", "title", "transliteration"))
    return rows.select("id", F.array_join(labels, "|").alias("labels"))


def content_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = tablets(spark, folder, "cuneiform", "transliteration")
    return rows.select("id", X.content_hash(X.spaced_text(F.col("cuneiform")), F.col("transliteration")).alias("hash"))


def text_union_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = entry_texts(tablets(spark, folder, "cuneiform", "title", "transliteration"), myths(spark, folder, "title", "transliteration", "translation"), catalog(spark, folder, "title", "transliteration", "translation"))
    return rows.groupBy("entry_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


def transliteration_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = transliterations(tablets(spark, folder, "source", "transliteration"), myths(spark, folder, "corpus_source", "transliteration"), catalog(spark, folder, "source_corpus", "transliteration"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def token_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return R.token_totals(all_tokens(spark, folder))


def sign_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    return R.window_pairs(all_tokens(spark, folder), 3)


def context_rules(spark: SparkSession, folder: str) -> DataFrame:
    return R.context_rules(written_tokens(spark, folder))


def sign_catalog(spark: SparkSession, folder: str) -> DataFrame:
    made = R.sign_catalog(read_table(spark, folder, "prebaked_sign_knowledge"), R.token_totals(all_tokens(spark, folder)))
    return made.select("sign_id", "unicode", "corpus_frequency", "frequency_rank", F.array_join("sumerian", "|").alias("sumerian"), "observed")


def sign_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = written_tokens(spark, folder)
    made = R.sign_catalog(read_table(spark, folder, "prebaked_sign_knowledge"), R.token_totals(rows))
    return exports.sign_documents(made, R.context_rules(rows))


def compound_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = tablets(spark, folder, "transliteration").select(F.upper(F.coalesce("transliteration", F.lit(""))).alias("t"))
    counts = rows.agg(*[F.count_if(F.contains("t", F.lit(c))).alias(f"c{i}") for i, c in enumerate(COMPOUNDS)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("composite"), F.col(f"c{i}").alias("n_records")) for i, c in enumerate(COMPOUNDS)])).alias("x")).select("x.*")


def sign_rules(spark: SparkSession, folder: str) -> DataFrame:
    return R.rules_of_signs(read_table(spark, folder, "prebaked_sign_knowledge", "sign_id")).select("sign_id", "pattern", "priority")


def sign_readings(spark: SparkSession, folder: str) -> DataFrame:
    rows = written_tokens(spark, folder)
    return R.reading_posteriors(read_table(spark, folder, "prebaked_sign_knowledge"), R.token_totals(rows), R.window_pairs(rows, 3), CONTEXT)


def sign_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = myths(spark, folder, "transliteration").select("id", X.sign_tokens(F.col("transliteration")).alias("tokens"))
    return R.context_windows(rows, "id")


QUERIES = {f.__name__: f for f in (
    classified_tablets, tablet_labels, content_ids, text_union_counts, transliteration_counts, token_frequencies, sign_cooccurrence, context_rules, sign_catalog, sign_documents, compound_records,
    sign_rules, sign_readings, sign_windows,
)}


def _case(text: str, classes: list, otherwise: str) -> str:
    q = lambda s: s.replace("'", "''")
    whens = " ".join(f"when {' or '.join(f'contains({text}, {chr(39)}{q(m)}{chr(39)})' for m in markers)} then '{name}'" for name, markers in classes)
    return f"case {whens} else '{otherwise}' end"


def _low(*columns: str) -> str:
    return "lower(" + " || ' ' || ".join(f"coalesce({c}, '')" for c in columns) + ")"


def _tokens(column: str) -> str:
    t = f"regexp_replace(regexp_replace(coalesce({column}, ''), '^[&#@]\\s*', ''), '(?m)#.*$', '', 'g')"
    t = f"list_transform(string_split_regex({t}, '[\\s\\p{{Z}}.]+'), lambda x: regexp_replace(regexp_replace(x, '\\p{{Nd}}+$', ''), '[()\\[\\]{{}}]', '', 'g'))"
    t = f"list_transform({t}, lambda x: replace(replace(replace(replace(x, 'd', ''), 'giš', ''), 'ki', ''), 'uru', ''))"
    return f"list_transform(list_filter({t}, lambda x: x <> '' and not regexp_full_match(x, '[\\p{{Nd}}\\p{{No}}]+')), lambda x: upper(x))"


_LABELS = "list_filter([" + ", ".join(f"case when {' or '.join(f'contains(t, {chr(39)}{m}{chr(39)})' for m in markers)} then '{name}' end" for name, markers in MYTH_LABELS.items()) + "], lambda x: x is not null)"
_ALL = f"""
r as (
  select 't' || id as id, {_tokens('transliteration')} as w from {_T} where transliteration <> ''
  union all select 'm' || id, {_tokens('transliteration')} from {_M} where transliteration <> ''
  union all select 'c' || id, {_tokens('transliteration')} from {_C} where transliteration <> ''),
k as (select id, unnest(w) as token, generate_subscripts(w, 1) as pos from r),
n as (select token, count(*) as n from k group by token),
p as (select a.token, b.token as context, count(*) as n from k a join k b on a.id = b.id and b.pos between a.pos - 3 and a.pos + 3 and a.pos <> b.pos group by all)
"""
_RULES = ", ".join("('" + p.replace("'", "''") + f"', {k})" for p, _, _, k in RULE_TEMPLATES)
SQL = {
    "classified_tablets": f"select id, {_case(_low('cuneiform', 'transliteration'), LANGUAGES, 'Unknown')} as language, {_case(_low('source', 'title'), PERIOD_MARKERS, 'Uncertain')} as period, {_case(_low('title', 'transliteration'), GENRES, 'Unknown')} as genre from {_T}",
    "tablet_labels": f"select id, case when len({_LABELS}) = 0 then '{NO_LABEL}' else array_to_string({_LABELS}, '|') end as labels from (select id, lower(concat_ws(' ', title, transliteration)) as t from {_T})",
    "content_ids": f"""
select id, left(sha256(trim(array_to_string(list_filter(string_split(coalesce(cuneiform, ''), ''), lambda c: c >= ' '), ' ')) || coalesce(transliteration, '')), 16) as hash from {_T}""",
    "text_union_counts": f"""
with u as (
  select 'tablet' as entry_type, trim(transliteration || ' ' || coalesce(cuneiform, '') || ' ' || coalesce(title, '')) as text from {_T} where transliteration <> ''
  union all select 'myth_text', trim(transliteration || ' ' || coalesce(translation, '') || ' ' || coalesce(title, '')) from {_M} where transliteration <> ''
  union all select 'corpus_catalog', trim(transliteration || ' ' || coalesce(translation, '') || ' ' || coalesce(title, '')) from {_C} where transliteration <> '')
select entry_type, count(*) as n, cast(sum(length(text)) as bigint) as n_chars from u group by 1""",
    "transliteration_counts": f"""
with u as (select coalesce(source, 'tablets') as source from {_T} where transliteration <> '' union all select coalesce(corpus_source, 'myth_texts') from {_M} where transliteration <> ''
  union all select coalesce(source_corpus, 'corpus_catalog') from {_C} where transliteration <> '')
select source, count(*) as n from u group by 1""",
    "token_frequencies": f"with {_ALL} select token, n, rank() over (order by n desc) as freq_rank from n",
    "sign_cooccurrence": f"with {_ALL} select token, context, n from p",
    "context_rules": f"""with {_ALL},
q as (select p.token, p.context, p.n / n.n as probability from p join n on n.token = p.token where p.n / n.n > 0.01)
select token, context, least(token, context) || '.' || greatest(token, context) as pattern, round(probability, 4) as probability, cast(row_number() over (partition by token order by q.probability desc, context) as integer) as place
from q qualify place <= 10""",
    "sign_catalog": f"""with {_ALL},
t as (select token, n, rank() over (order by n desc) as freq_rank from n)
select coalesce(s.sign_id, t.token) as sign_id, s.unicode, coalesce(t.n, 0) as corpus_frequency, coalesce(t.freq_rank, 999) as frequency_rank,
  case when len(s.sumerian_readings) > 0 then array_to_string(s.sumerian_readings, '|') else lower(coalesce(s.sign_id, t.token)) end as sumerian, t.n is not null as observed
from prebaked_sign_knowledge s full join t on t.token = s.sign_id""",
    "compound_records": " union all ".join(f"select '{c}' as composite, count(*) as n_records from {_T} where contains(upper(transliteration), '{c}')" for c in COMPOUNDS),
    "sign_rules": f"select sign_id, pattern, priority from prebaked_sign_knowledge, (values {_RULES}) r(pattern, priority) where contains(pattern, sign_id)",
    "sign_readings": f"""with {_ALL},
e as (select distinct sign_id, unnest(list_concat(list_concat(list_transform(sumerian_readings, lambda r: 'SUM:' || r), list_transform(akkadian_readings, lambda r: 'AKK:' || r)), list_transform(logographic_values, lambda r: 'LOG:' || r))) as reading from prebaked_sign_knowledge),
f as (select sign_id, reading, upper(regexp_replace(split_part(reading, ':', 2), '[0-9₀-₉]+$', '')) as token from e),
v as (select count(*) as v from n),
g as (select sign_id, reading, exp((""" + " + ".join(f"ln((coalesce((select n from p where p.token = f.token and p.context = '{c}'), 0) + 0.1) / (coalesce(n.n, 0) + 0.1 * v.v))" for c in CONTEXT) + f""") / {len(CONTEXT)}) as w
  from f left join n on n.token = f.token, v),
h as (select sign_id, reading, w / sum(w) over (partition by sign_id) as posterior from g)
select sign_id, reading, round(posterior, 6) as posterior, cast(row_number() over (partition by sign_id order by round(h.posterior, 9) desc, reading) as integer) as place from h qualify place <= 5""",
    "sign_windows": f"""
with r as (select id, {_tokens('transliteration')} as w from {_M}), k as (select id, w, unnest(w) as token, generate_subscripts(w, 1) as i from r)
select id, cast(i - 1 as integer) as pos, token, array_to_string(w[greatest(i - 2, 1):i + 2], ' ') as window, array_to_string(list_concat(w[greatest(i - 5, 1):i - 1], w[i + 1:i + 5]), ' ') as context from k""",
}
