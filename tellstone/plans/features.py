"""Queries over weighted terms, distances and visual words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.operators import features as E
from tellstone.plans.motifs import SQL as MOTIF_SQL
from tellstone.plans.motifs import motif_distances
from tellstone.session import spread
from tellstone.sources.tables import latest_by_id, myths, read_table

_M = "(select distinct on (id) * from myth_texts order by id, created_at desc)"


def term_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest myth texts, by weighted words and word pairs, of those whose number is divisible by 20."""
    docs = spread(myths(spark, folder, "text"), "id").select("id", E.word_terms(F.col("text"), 2).alias("terms"))
    weights = E.weighted_terms(docs)
    queries = weights.where(F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint") % 20 == 0)
    return E.nearest_by_terms(queries, weights, 3).withColumn("similarity", F.round("similarity", 6))


def distance_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and spread of the distances between all texts, the closest profiles, and how many pairs are furthest apart."""
    rows = motif_distances(spark, folder)
    d, w = F.col("hybrid_distance"), F.col("n_pairs")
    named = F.when(F.col("profile_1").isNotNull(), F.concat_ws("/", "profile_1", "profile_2"))
    at = rows.groupBy("hybrid_distance").agg(F.sum(w).alias("n_pairs"), F.min(named).alias("pair"))
    mean = F.sum(w * d) / F.sum(w)
    return at.agg(
        F.sum(w).alias("n"), F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.sum(w * d * d) / F.sum(w) - mean * mean, F.lit(0.0))), 5).alias("spread"),
        F.min_by("pair", d).alias("closest"), F.max(d).alias("furthest_distance"), F.max_by("n_pairs", d).alias("n_furthest"),
    )


def visual_word_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of 256 visual words, each vector of an image in four descriptors."""
    rows = latest_by_id(read_table(spark, folder, "spijkerschrift_visueel"), "id", "created_at", "visual_embedding").where("size(visual_embedding) >= 8")
    part = F.floor(F.size("visual_embedding") / 4).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("visual_embedding", i * part + 1, part))
    descriptors = rows.select(F.col("id").alias("image_id"), F.explode(pieces).alias("descriptor"))
    return E.visual_words(descriptors).withColumn("share", F.round("share", 6))


QUERIES = {f.__name__: f for f in (term_neighbours, distance_findings, visual_word_shares)}
SQL = {
    "term_neighbours": f"""
with w as (select id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') as w from {_M}),
t as (select id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) as term from w),
c as (select id, term, count(*) as c from t group by all), d as (select term, count(*) as df from c group by term), n as (select count(*) as n from w),
r as (select id, term, (1 + ln(c)) * (ln((1.0 + n) / (1 + df)) + 1) as x from c join d using (term), n),
l as (select id, sqrt(sum(x * x)) as l from r group by id), v as (select id, term, x / l as x from r join l using (id)),
s as (select a.id, b.id as neighbour, round(sum(a.x * b.x), 9) as s from v a join v b on a.term = b.term and a.id <> b.id where try_cast(regexp_extract(a.id, '(\\d+)$', 1) as bigint) % 20 = 0 group by 1, 2)
select id, neighbour, round(s, 6) as similarity, cast(row_number() over (partition by id order by s desc, neighbour) as integer) as place from s qualify place <= 3""",
    "distance_findings": f"""
with x as ({MOTIF_SQL['motif_distances']}), p as (select *, profile_1 || '/' || profile_2 as pair from x), f as (select max(hybrid_distance) as f from p)
select sum(n_pairs)::bigint as n, round(sum(n_pairs * hybrid_distance) / sum(n_pairs), 6) as mean,
  round(sqrt(sum(n_pairs * hybrid_distance * hybrid_distance) / sum(n_pairs) - (sum(n_pairs * hybrid_distance) / sum(n_pairs)) ** 2), 5) as spread,
  arg_min(pair, (hybrid_distance, pair)) as closest, max(f) as furthest_distance, (sum(n_pairs) filter (hybrid_distance = f))::bigint as n_furthest from p, f""",
}
