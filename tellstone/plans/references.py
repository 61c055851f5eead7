"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.functions.times import utc_time
from tellstone.operators.references import Child, Parent, missing_by_period, missing_references
from tellstone.sources.tables import read_table


def _missing(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    parents = [
        Parent("tablets", read_table(spark, folder, "tablets"), c("id"), c("created_at")),
        Parent("corpus_catalog", read_table(spark, folder, "corpus_catalog"), c("id"), utc_time(c("accession_date"))),
    ]
    children = [
        Child("cuneiform_signs", "tablets", read_table(spark, folder, "cuneiform_signs"), c("id"), c("tablet_id"), c("detected_at")),
        Child("spijkerschrift_visueel", "tablets", read_table(spark, folder, "spijkerschrift_visueel"), c("id"), c("tablet_id"), c("created_at")),
        Child("prebaked_embeddings", "corpus_catalog", read_table(spark, folder, "prebaked_embeddings"), c("id"), c("entry_id"), c("created_at")),
    ]
    return missing_references(parents, children)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _missing(spark, folder).select("ref_table", "ref_id")


def p4_by_period(spark: SparkSession, folder: str) -> DataFrame:
    return missing_by_period(_missing(spark, folder))


_REFS = """
with parents as (
  select 'tablets' as parent, id as k, min(created_at) as first_at from tablets group by id
  union all
  select 'corpus_catalog', cast(id as varchar),
         min(cast(case when length(accession_date) > 19 then accession_date else accession_date || '+00:00' end as timestamptz))
  from corpus_catalog group by id),
refs as (
  select distinct 'cuneiform_signs' as ref_table, id as ref_id, 'tablets' as parent, tablet_id as k, detected_at as seen_at from cuneiform_signs
  union select distinct 'spijkerschrift_visueel', id, 'tablets', tablet_id, created_at from spijkerschrift_visueel
  union select distinct 'prebaked_embeddings', cast(id as varchar), 'corpus_catalog', cast(entry_id as varchar), created_at from prebaked_embeddings),
found as (
  select r.ref_table, r.ref_id, r.seen_at, case when p.k is null then 'orphan' else 'late' end as reason
  from refs r left join parents p on p.parent = r.parent and p.k = r.k
  where r.k is not null and r.k <> '' and (p.k is null or p.first_at > r.seen_at))
"""

QUERIES = {"p4_found": p4_found, "p4_by_period": p4_by_period}
SQL = {
    "p4_found": _REFS + "select distinct ref_table, ref_id from found",
    "p4_by_period": _REFS + "select ref_table, strftime(seen_at at time zone 'UTC', '%Y-%m') as month, reason, count(*) as n_refs from found group by all",
}
