"""Queries over the motifs of myth texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tellstone.constants import MOTIFS, PERIODS, UNKNOWN_PERIOD
from tellstone.operators import motifs as M
from tellstone.operators import phylogeny as P
from tellstone.session import Scratch
from tellstone.sources.tables import myths

_M = "(select distinct on (id) * from myth_texts order by id, created_at desc)"


def motif_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = myths(spark, folder, "text", "transliteration", "translation", "period", "language")
    return rows.select(F.col("id").alias("text_id"), M.full_text("text", "transliteration", "translation").alias("full"), "period", "language")


def _place() -> Column:
    """Place of the period in the fixed order; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in PERIODS]), F.col("period")), F.lit(0)) - 1, F.lit(UNKNOWN_PERIOD))


def motif_presence(spark: SparkSession, folder: str) -> DataFrame:
    return M.motif_matches(motif_texts(spark, folder)).select("text_id", "motif_id", F.round("confidence", 6).alias("confidence"))


def motif_counts_by_language(spark: SparkSession, folder: str) -> DataFrame:
    texts = motif_texts(spark, folder)
    return M.motif_matches(texts).join(texts.select("text_id", "language"), "text_id").groupBy("language", "archetype", "motif_id").agg(F.count(F.lit(1)).alias("n_texts"))


def motif_instances(spark: SparkSession, folder: str) -> DataFrame:
    return M.motif_instances(motif_texts(spark, folder))


def archetype_prevalence(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each archetype among the motif texts of a period, and its earliest and latest period."""
    texts = motif_texts(spark, folder)
    per = M.motif_matches(texts).join(texts.select("text_id", "period"), "text_id").groupBy("archetype", "period").agg(F.count(F.lit(1)).alias("n")).withColumn("place", _place())
    of_period, of_type = W.partitionBy("period"), W.partitionBy("archetype")
    return per.select(
        "archetype", "period", "n", F.round(F.col("n") / F.greatest(F.lit(1), F.sum("n").over(of_period)), 6).alias("share"),
        F.min_by("period", "place").over(of_type).alias("earliest"), F.max_by("period", "place").over(of_type).alias("latest"),
    ).where("period is not null")


def _profiled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles, members, and texts; matches are made and written once, or each use would search all texts again."""
    texts = motif_texts(spark, folder)
    matches = Scratch(spark, "motifs").write(M.motif_matches(texts))
    profiles, members = M.motif_profiles(matches, texts)
    return profiles, members, texts


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    profiles, members, texts = _profiled(spark, folder)
    earliest = members.join(texts.select("text_id", "period"), "text_id").groupBy("profile").agg(F.min_by("period", F.struct(_place(), "period")).alias("period"))
    return Scratch(spark, "profiles").write(profiles.join(earliest, "profile"))


def _named(profiles: DataFrame, members: DataFrame) -> DataFrame:
    """Profiles, each named by the smallest text that has it."""
    names = members.groupBy("profile").agg(F.min("text_id").alias("name"))
    return profiles.join(names, "profile").select(F.col("name").alias("profile"), "entries", "n_texts")


def motif_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Distances of all pairs of texts, by their profiles, each named by the smallest text that has it."""
    profiles, members, _ = _profiled(spark, folder)
    return M.profile_distances(Scratch(spark, "named").write(_named(profiles, members)))


def profile_members(spark: SparkSession, folder: str) -> DataFrame:
    """The leaf of the tree that each text stands at: the profile, named by its smallest text, and how many texts share it."""
    _, members, _ = _profiled(spark, folder)
    leaves = members.groupBy("profile").agg(F.min("text_id").alias("leaf"), F.count(F.lit(1)).alias("n_texts"))
    return members.join(leaves, "profile").select("text_id", "leaf", "n_texts")


def language_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Mean hybrid distance of the pairs of texts of each language."""
    profiles, members, texts = _profiled(spark, folder)
    named = Scratch(spark, "named").write(_named(profiles, members).withColumn("n_texts", F.lit(2)))  # two, for the row within a profile
    close = M.profile_distances(named).where("profile_1 is not null").select("profile_1", "profile_2", (1 - F.col("hybrid_distance")).alias("close"))
    names = members.groupBy("profile").agg(F.min("text_id").alias("name"))
    counts = Scratch(spark, "counts").write(members.join(names, "profile").join(texts.select("text_id", "language"), "text_id").groupBy("language", "name").agg(F.count(F.lit(1)).alias("n")))
    a, b = (counts.select("language", F.col("name").alias(f"profile_{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    pairs = F.when(F.col("profile_1") == F.col("profile_2"), F.col("n1") * (F.col("n1") - 1) / 2).otherwise(F.col("n1") * F.col("n2"))
    met = close.join(a, "profile_1").join(b.withColumnRenamed("language", "l2"), "profile_2").where(F.col("language").eqNullSafe(F.col("l2")))
    sums = met.groupBy("language").agg(F.sum(pairs * F.col("close")).alias("close")).select(F.struct("language").alias("k"), "close")
    totals = counts.groupBy("language").agg(F.sum("n").alias("n")).where("n > 1").select("language", F.struct("language").alias("k"), F.floor(F.col("n") * (F.col("n") - 1) / 2).alias("n_pairs"))
    joined = totals.join(sums, totals["k"].eqNullSafe(sums["k"]), "left")
    return joined.select("language", "n_pairs", F.round(1 - F.coalesce("close", F.lit(0.0)) / F.col("n_pairs"), 5).alias("mean_distance"))


def phylogeny(spark: SparkSession, folder: str) -> DataFrame:
    return P.tree_of_profiles(_profiles(spark, folder)).withColumn("motifs", F.array_join("motifs", "|"))


def phylogeny_support(spark: SparkSession, folder: str) -> DataFrame:
    return P.bootstrap_support(_profiles(spark, folder))


def motif_migrations(spark: SparkSession, folder: str) -> DataFrame:
    """Gains and losses along the tree, with the archetype of each motif."""
    tree = Scratch(spark, "tree").write(P.tree_of_profiles(_profiles(spark, folder)))
    archetypes = F.create_map(*[F.lit(x) for m, a, _ in MOTIFS for x in (m, a)])
    return P.migrations(tree).withColumn("archetype", F.try_element_at(archetypes, F.col("motif_id")))


QUERIES = {f.__name__: f for f in (motif_presence, motif_counts_by_language, motif_instances, archetype_prevalence, motif_distances, profile_members, language_distances, phylogeny, phylogeny_support, motif_migrations)}


def _lengths(pattern: str) -> str:
    """SQL list of match lengths; a pattern with word boundaries is split into the word, looked up among tokens, and the rest."""
    if r"\b" not in pattern:
        return f"list_transform(regexp_extract_all(f, '(?i){pattern}', 0), lambda x: length(x))"
    _, word, rest = pattern.split(r"\b")
    return f"list_concat(case when list_contains(string_split_regex(f, '[^\\p{{L}}\\p{{N}}_]+'), '{word}') then [{len(word)}] else [] end, list_transform(regexp_extract_all(f, '(?i){rest[1:]}', 0), lambda x: length(x)))"


_FOUND = f"""
t as (select id as text_id, period, language, lower(coalesce(text, '') || ' ' || coalesce(transliteration, '') || ' ' || coalesce(translation, '')) as f from {_M}),
x as ({" union all ".join(f"select text_id, period, language, '{m}' as motif_id, '{a}' as archetype, {_lengths(p)} as l from t" for m, a, p in MOTIFS)}),
m as (select text_id, period, language, motif_id, archetype, round(0.7 + 0.3 * least(1.0, list_max(l) / 20.0), 6) as confidence from x where len(l) > 0)
"""
_PLACE = "coalesce(list_position([" + ", ".join(f"'{p}'" for p in PERIODS) + f"], period) - 1, {UNKNOWN_PERIOD})"
# all pairs of texts with their distances
_PAIRS = """
v as (select t.text_id, coalesce(list_sort(list({'motif_id': motif_id, 'confidence': confidence}) filter (motif_id is not null)), [])::varchar as v, coalesce(sqrt(sum(confidence * confidence)), 0) as norm, count(*) filter (confidence > 0.5) as size
  from t left join m using (text_id) group by 1),
e as (select *, min(text_id) over (partition by v) as profile from v),
o as (select a.text_id as t1, b.text_id as t2, sum(a.confidence * b.confidence) as dot, count(*) filter (a.confidence > 0.5 and b.confidence > 0.5) as n from m a join m b on a.motif_id = b.motif_id and a.text_id < b.text_id group by all),
g as (select a.text_id as t1, b.text_id as t2, least(a.profile, b.profile) as p1, greatest(a.profile, b.profile) as p2, coalesce(n, 0) as n_shared, a.size + b.size - coalesce(n, 0) as u,
  case when a.norm = 0 or b.norm = 0 then 1 when a.profile = b.profile then 0 else 1 - coalesce(dot, 0) / (a.norm * b.norm) end as c from e a join e b on a.text_id < b.text_id left join o on o.t1 = a.text_id and o.t2 = b.text_id),
d as (select *, case when u = 0 or p1 = p2 then 0 else 1 - n_shared / u end as j, 0.6 * c + 0.4 * case when u = 0 or p1 = p2 then 0 else 1 - n_shared / u end as h from g)"""
SQL = {
    "motif_presence": f"with {_FOUND} select text_id, motif_id, confidence from m",
    "motif_counts_by_language": f"with {_FOUND} select language, archetype, motif_id, count(*) as n_texts from m group by all",
    "archetype_prevalence": f"""with {_FOUND},
p as (select archetype, period, count(*) as n, {_PLACE} as place from m group by archetype, period)
select archetype, period, n, round(n / greatest(1, sum(n) over (partition by period)), 6) as share,
  arg_min(period, place) over (partition by archetype) as earliest, arg_max(period, place) over (partition by archetype) as latest
from p qualify period is not null""",
    "motif_distances": f"""with {_FOUND}, {_PAIRS}
select case when p1 = p2 or n_shared > 0 then p1 end as profile_1, case when p1 = p2 or n_shared > 0 then p2 end as profile_2, n_shared, round(c, 6) as cosine_distance, round(j, 6) as jaccard_distance, round(h, 6) as hybrid_distance, count(*) as n_pairs
from d group by all""",
    "profile_members": f"with {_FOUND}, {_PAIRS} select text_id, profile as leaf, count(*) over (partition by profile) as n_texts from e",
    "language_distances": f"with {_FOUND}, {_PAIRS} select t.language, count(*) as n_pairs, round(avg(h), 5) as mean_distance from d join t on t.text_id = d.t1 join t u on u.text_id = d.t2 where t.language is not distinct from u.language group by 1",
}
