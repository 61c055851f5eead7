"""Queries over the state of the data, corrections and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.operators import corrections, quality
from tellstone.operators.quality import Check
from tellstone.sinks import exports
from tellstone.sources.tables import catalog, read_table, tablets

_T = "(select distinct on (id) * from tablets order by id, created_at desc)"


def quality_checks(spark: SparkSession, folder: str) -> DataFrame:
    t, c, e, k, s = (read_table(spark, folder, n) for n in ("tablets", "corpus_catalog", "prebaked_embeddings", "prebaked_sign_knowledge", "cuneiform_signs"))
    keys = t.select(F.col("id").alias("tablet_id"), F.lit(True).alias("known")).distinct()
    refs = s.where("tablet_id <> ''").select("tablet_id").join(keys, "tablet_id", "left")
    share = lambda condition: F.count_if(condition) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))
    return quality.run_checks([
        Check("tablets", t, F.count(F.lit(1)), 1, 1, at_least=True),
        Check("repeated tablets", t, F.count(F.lit(1)) - F.countDistinct("id"), 0, 1_000_000),
        Check("tablets without transliteration, percent", t, share(F.coalesce("transliteration", F.lit("")) == ""), 5, 50),
        Check("signs of unknown tablets, percent", refs, share(F.col("known").isNull()), 0, 20),
        Check("vectors of wrong length", e, F.count_if(F.size("embedding") != F.col("embedding_dim")), 0, 1_000_000),
        Check("vectors missing", e, F.count_if(F.col("embedding").isNull()), 0, 1_000_000),
        Check("signs known", k, F.count(F.lit(1)), 50, 10, at_least=True),
        Check("signs with unicode, percent", k, share(F.col("unicode") != ""), 80, 50, at_least=True),
        Check("signs with number, percent", k, share(F.col("borger_number") != ""), 50, 20, at_least=True),
        Check("required sources", c, F.countDistinct(F.when(F.col("source_corpus").isin("CDLI", "ORACC", "ETCSL"), F.col("source_corpus"))), 3, 1, at_least=True),
    ])


def quality_status(spark: SparkSession, folder: str) -> DataFrame:
    return quality.overall(quality_checks(spark, folder))


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """The event table read as corrections: a purchase submits, a click approves, an error rejects."""
    rows = read_table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    action = F.when(F.col("event_type") == "purchase", "submit").when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "error", "reject")
    return corrections.events(rows, correction_id=F.col("user_id"), action=action, at=F.col("ts"), seq=F.col("event_id"), sign_id=F.try_variant_get(F.try_parse_json("props"), "$.k", "string"), confidence=F.col("value"))


def correction_states(spark: SparkSession, folder: str) -> DataFrame:
    return corrections.states(_log(spark, folder)).select("correction_id", "sign_id", "confidence", "state", "n_events")


def correction_stats(spark: SparkSession, folder: str) -> DataFrame:
    return corrections.stats(corrections.states(_log(spark, folder)))


def atf_export(spark: SparkSession, folder: str) -> DataFrame:
    return exports.atf_lines(tablets(spark, folder, "title", "transliteration", "language"))


def atf_entries(spark: SparkSession, folder: str) -> DataFrame:
    return exports.atf_entries(catalog(spark, folder, "source_corpus", "object_id", "period", "provenance", "genre", "transliteration", "translation"))


def jsonld_export(spark: SparkSession, folder: str) -> DataFrame:
    return exports.jsonld_nodes(tablets(spark, folder, "source", "title", "cuneiform", "transliteration", "language", "period", "genre", "myth_labels"))


def deposition_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = exports.deposition(tablets(spark, folder, "language", "genre"))
    return rows.select(*[F.get_json_object("value", f"$.{c}").cast("bigint").alias(c) for c in ("records", "languages", "genres")])


def event_props(spark: SparkSession, folder: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return read_table(spark, folder, "events", "event_type", "props").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("largest"))


QUERIES = {f.__name__: f for f in (quality_checks, quality_status, correction_states, correction_stats, atf_export, atf_entries, jsonld_export, deposition_totals, event_props)}

_CHECKS = """
c(name, value, warn, fail, least) as (
  select 'tablets', count(*)::double, 1, 1, true from tablets
  union all select 'repeated tablets', count(*) - count(distinct id), 0, 1000000, false from tablets
  union all select 'tablets without transliteration, percent', count(*) filter (coalesce(transliteration, '') = '') * 100.0 / greatest(count(*), 1), 5, 50, false from tablets
  union all select 'signs of unknown tablets, percent', count(*) filter (t.id is null) * 100.0 / greatest(count(*), 1), 0, 20, false from cuneiform_signs s left join (select distinct id from tablets) t on t.id = s.tablet_id where s.tablet_id <> ''
  union all select 'vectors of wrong length', count(*) filter (len(embedding) <> embedding_dim), 0, 1000000, false from prebaked_embeddings
  union all select 'vectors missing', count(*) filter (embedding is null), 0, 1000000, false from prebaked_embeddings
  union all select 'signs known', count(*), 50, 10, true from prebaked_sign_knowledge
  union all select 'signs with unicode, percent', count(*) filter (unicode <> '') * 100.0 / greatest(count(*), 1), 80, 50, true from prebaked_sign_knowledge
  union all select 'signs with number, percent', count(*) filter (borger_number <> '') * 100.0 / greatest(count(*), 1), 50, 20, true from prebaked_sign_knowledge
  union all select 'required sources', count(distinct source_corpus) filter (source_corpus in ('CDLI', 'ORACC', 'ETCSL')), 3, 1, true from corpus_catalog),
k as (select name as "check", round(value, 4) as value, case when (least and round(value, 4) < fail) or (not least and round(value, 4) > fail) then 'fail' when (least and round(value, 4) < warn) or (not least and round(value, 4) > warn) then 'warn' else 'pass' end as status from c)
"""
_STATES = """
l as (select cast(user_id as varchar) as correction_id, ts, event_id, event_type, value, props from events where event_type in ('purchase', 'click', 'error')),
s as (select correction_id, arg_max(cast(props ->> '$.k' as varchar), (ts, event_id)) filter (event_type = 'purchase') as sign_id, arg_max(value, (ts, event_id)) filter (event_type = 'purchase') as confidence,
  case arg_max(event_type, (ts, event_id)) when 'purchase' then 'pending' when 'click' then 'applied' else 'rejected' end as state, count(*) as n_events from l group by 1)
"""
SQL = {
    "quality_checks": f"with {_CHECKS} select * from k",
    "quality_status": f"with {_CHECKS} select case when count(*) filter (status = 'fail') > 0 then 'fail' when count(*) filter (status = 'warn') > 0 then 'warn' else 'pass' end as status, count(*) filter (status = 'pass') as n_pass, count(*) filter (status = 'warn') as n_warn, count(*) filter (status = 'fail') as n_fail from k",
    "correction_states": f"with {_STATES} select correction_id, sign_id, confidence, state, n_events from s",
    "correction_stats": f"with {_STATES} select count(*) as total, count(*) filter (state = 'pending') as pending, count(*) filter (state = 'applied') as applied, count(*) filter (state = 'rejected') as rejected from s",
    "atf_export": f"""
with t as (select id, title, language, string_split(transliteration, '. ') as p from {_T} where transliteration <> ''),
n as (select id, list_concat(['&P' || id || ' = ' || coalesce(title, ''), '@tablet ' || id, '@language ' || lower(coalesce(language, 'unknown')), '@script cuneiform'],
  list_concat(list_filter(list_transform(range(1, len(p) + 1), lambda i: case when trim(p[i]) <> '' then i || '. ' || trim(p[i]) end), lambda x: x is not null), [''])) as v from t)
select id, cast(generate_subscripts(v, 1) - 1 as integer) as line_no, unnest(v) as value from n""",
    "deposition_totals": f"select count(*) as records, count(distinct language) as languages, count(distinct genre) as genres from {_T}",
    "event_props": "select event_type, count(cast(props ->> '$.k' as bigint)) as n, sum(cast(props ->> '$.k' as bigint))::bigint as total, max(cast(props ->> '$.k' as bigint)) as largest from events group by 1",
}
