"""Queries over joins of fragments, vectors, shapes and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.functions import vectors as V
from tellstone.operators import similarity as S
from tellstone.operators.boxes import suppressed
from tellstone.sources.tables import detections, latest_by_id, read_table, tablets

_T = "(select distinct on (id) * from tablets order by id, created_at desc)"
_V = "(select distinct on (id) * from spijkerschrift_visueel order by id, created_at desc)"


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Unordered pairs of join_match whose fragments both have a transliteration."""
    rows = read_table(spark, folder, "join_match", "tablet_a", "tablet_b").where("tablet_a <> '' and tablet_b <> '' and tablet_a <> tablet_b")
    pairs = rows.select(F.least("tablet_a", "tablet_b").alias("a"), F.greatest("tablet_a", "tablet_b").alias("b")).distinct()
    texts = tablets(spark, folder, "transliteration").where("transliteration <> ''")
    ta, tb = (texts.select(F.col("id").alias(x), F.col("transliteration").alias(f"text_{x}")) for x in "ab")
    return pairs.join(ta, "a").join(tb, "b")


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).where("vec is not null")
    return S.exact_nearest(rows.where("id % 20 = 0"), rows, 10).select("id", "neighbour", F.round("similarity", 6).alias("similarity"), "place")


def text_continuity(spark: SparkSession, folder: str) -> DataFrame:
    shares = ("words_max", "words_min", "bigrams_max", "bigrams_min")
    return S.text_overlaps(_pairs(spark, folder), "text_a", "text_b").select("a", "b", *[F.round(c, 6).alias(c) for c in shares])


def ngram_alignments(spark: SparkSession, folder: str) -> DataFrame:
    return S.ngram_alignment(_pairs(spark, folder), ["a", "b"], "text_a", "text_b").withColumn("ngram_alignment", F.round("ngram_alignment", 6))


def best_joins(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "join_match")
    score = V.join_confidence(F.col("fracture_complementarity"), F.col("text_continuity"), F.col("ngram_alignment"))
    return S.ranked_joins(rows, F.round(score, 9)).withColumn("score", F.round("score", 6))


def gap_fillers(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.filled_gaps(_pairs(spark, folder), ["a", "b"], "text_a", "text_b")
    return rows.groupBy("a", "b", "source").agg(F.count(F.lit(1)).alias("n"))


def label_edges(spark: SparkSession, folder: str) -> DataFrame:
    return S.label_graph(tablets(spark, folder, "myth_labels").withColumnRenamed("myth_labels", "labels"))


def semantic_edges(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "join_match", "tablet_a", "tablet_b", "join_confidence").where("tablet_a <> '' and tablet_b <> '' and tablet_a <> tablet_b and not isnan(join_confidence)")
    edges = rows.groupBy(F.least("tablet_a", "tablet_b").alias("a"), F.greatest("tablet_a", "tablet_b").alias("b")).agg(F.max("join_confidence").alias("similarity"))
    return S.labelled_edges(edges, tablets(spark, folder, "myth_labels").withColumnRenamed("myth_labels", "labels"))


def match_graph(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "join_match").where("tablet_a <> '' and tablet_b <> '' and join_confidence >= 0.65 and not isnan(join_confidence)")
    return S.graph_stats(rows, "tablet_a", "tablet_b")


def fracture_matches(spark: SparkSession, folder: str) -> DataFrame:
    shapes = latest_by_id(read_table(spark, folder, "spijkerschrift_visueel"), "tablet_id", "created_at", "fracture_angles").where("tablet_id <> ''")
    none = F.array().cast("array<double>")
    profile = lambda x: shapes.select(F.col("tablet_id").alias(x), F.transform("fracture_angles", lambda a: a / 180).alias(f"curv_{x}"), F.col("fracture_angles").alias(f"ang_{x}"), none.alias(f"len_{x}"))
    rows = read_table(spark, folder, "join_match", "tablet_a", "tablet_b").where("tablet_a <> tablet_b").select(F.least("tablet_a", "tablet_b").alias("a"), F.greatest("tablet_a", "tablet_b").alias("b")).distinct()
    return S.fracture_scores(rows.join(profile("a"), "a").join(profile("b"), "b"), ["a", "b"]).withColumn("fracture", F.round("fracture", 6))


def shape_scalars(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_by_id(read_table(spark, folder, "spijkerschrift_visueel"), "id", "created_at", "contour", "bbox_w", "bbox_h")
    area, perimeter = V.contour_area(F.col("contour")), V.contour_perimeter(F.col("contour"))
    aspect, extent = F.try_divide(F.col("bbox_w"), F.col("bbox_h")), F.try_divide(area, F.col("bbox_w") * F.col("bbox_h"))
    return rows.select("id", *[F.round(c, 6).alias(n) for n, c in (("area", area), ("perimeter", perimeter), ("circularity", V.circularity(area, perimeter)), ("aspect_ratio", aspect), ("extent", extent))])


def component_types(spark: SparkSession, folder: str) -> DataFrame:
    rows = detections(spark, folder, "bbox_w", "bbox_h").withColumn("area", F.col("bbox_w") * F.col("bbox_h") * 0.4)
    args = [F.col(c) for c in ("area", "bbox_w", "bbox_h")]
    return rows.select("id", V.component_type(*args).alias("component_type"), F.round(V.component_confidence(*args), 6).alias("confidence"))


def kept_signs(spark: SparkSession, folder: str) -> DataFrame:
    rows = detections(spark, folder, "tablet_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "confidence")
    boxes = rows.select(F.col("tablet_id").alias("image"), "id", *[F.col(f"bbox_{c}").alias(c) for c in "xywh"], "confidence")
    return suppressed(boxes).select("id", "image", "confidence")


QUERIES = {f.__name__: f for f in (
    vector_topk, text_continuity, ngram_alignments, best_joins, gap_fillers, label_edges, semantic_edges, match_graph, fracture_matches, shape_scalars, component_types, kept_signs,
)}

_PAIRS = f"""
p as (select distinct least(tablet_a, tablet_b) as a, greatest(tablet_a, tablet_b) as b from join_match where tablet_a <> '' and tablet_b <> '' and tablet_a <> tablet_b),
x as (select a, b, t.transliteration as ta, u.transliteration as tb from p join {_T} t on t.id = a join {_T} u on u.id = b where t.transliteration <> '' and u.transliteration <> '')
"""
_WORDS = lambda c: f"list_filter(string_split_regex({c}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')"
_GRAMS = lambda w, n: f"list_transform(range(1, greatest(len({w}) - {n - 2}, 1)), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"
_SHARE = lambda x, y, f: f"case when least(len(list_distinct({x})), len(list_distinct({y}))) > 0 then len(list_intersect(list_distinct({x}), list_distinct({y}))) / {f}(len(list_distinct({x})), len(list_distinct({y}))) else 0 end"
_NEXT = "contour[case when i = len(contour) then 1 else i + 1 end]"
_KIND = "case when aspect between 0.3 and 3.0 and extent > 0.3 then case when area < 800 then 'wedge' else 'complex' end when aspect < 0.3 and bbox_h > 30 then 'vertical' when aspect > 3.0 and bbox_w > 30 then 'horizontal' else 'angled' end"
_IOU = "(greatest(least(b.x + b.w, o.x + o.w) - greatest(b.x, o.x), 0)::double * greatest(least(b.y + b.h, o.y + o.h) - greatest(b.y, o.y), 0))"
SQL = {
    "kept_signs": f"""
with recursive s as (select distinct on (id) nullif(tablet_id, '') as image, id, bbox_x as x, bbox_y as y, bbox_w as w, bbox_h as h, confidence from cuneiform_signs order by id),
u as (select * from s where x is not null and y is not null and w is not null and h is not null and confidence is not null),
o as (select *, row_number() over (partition by image order by confidence desc, id) as k from u where image is not null),
r as (select image, k, [{{'id': id, 'x': x, 'y': y, 'w': w, 'h': h, 'confidence': confidence}}] as kept from o where k = 1
  union all select o.image, o.k, case when len(list_filter(r.kept, lambda b: {_IOU} > 0.3 * (b.w::double * b.h + o.w::double * o.h - {_IOU}))) = 0
    then list_append(r.kept, {{'id': o.id, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h, 'confidence': o.confidence}}) else r.kept end from r join o on o.image = r.image and o.k = r.k + 1),
l as (select image, arg_max(kept, k) as kept from r group by image),
b as (select image, unnest(kept) as b from l)
select b.id, image, b.confidence from b union all select id, image, confidence from u where image is null""",
    "vector_topk": """
with v as (select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null),
s as (select a.vec_id as id, b.vec_id as neighbour, round(list_cosine_similarity(a.e, b.e), 9) as s from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select id, neighbour, round(s, 6) as similarity, cast(row_number() over (partition by id order by s desc, neighbour) as integer) as place from s qualify place <= 10""",
    "text_continuity": f"""with {_PAIRS},
w as (select a, b, {_WORDS('lower(ta)')} as wa, {_WORDS('lower(tb)')} as wb from x), g as (select *, {_GRAMS('wa', 2)} as ga, {_GRAMS('wb', 2)} as gb from w)
select a, b, round({_SHARE('wa', 'wb', 'greatest')}, 6) as words_max, round({_SHARE('wa', 'wb', 'least')}, 6) as words_min,
  round({_SHARE('ga', 'gb', 'greatest')}, 6) as bigrams_max, round({_SHARE('ga', 'gb', 'least')}, 6) as bigrams_min from g""",
    "ngram_alignments": f"""with {_PAIRS},
w as (select a, b, {_WORDS('ta')} as wa, {_WORDS('tb')} as wb from x), g as (select a, b, {_GRAMS('wa', 3)} as ga, {_GRAMS('wb', 3)} as gb from w),
k as (select a, b, unnest(ga) as gram, generate_subscripts(ga, 1) as i from g), l as (select a, b, unnest(gb) as gram, generate_subscripts(gb, 1) as j from g),
n as (select a, b, sum(1.0 / (1.0 + 0.5 * abs(i - j))) as near from k join l using (a, b, gram) group by a, b)
select g.a, g.b, round(case when least(len(ga), len(gb)) > 0 then least(1.0, 0.6 * len(list_intersect(list_distinct(ga), list_distinct(gb))) / least(len(list_distinct(ga)), len(list_distinct(gb)))
  + 0.4 * coalesce(near, 0) / (greatest(len(ga), len(gb)) / 2)) else 0 end, 6) as ngram_alignment from g left join n on n.a = g.a and n.b = g.b""",
    "best_joins": """
with s as (select least(tablet_a, tablet_b) as a, greatest(tablet_a, tablet_b) as b, round(0.3 * coalesce(fracture_complementarity, 0) + 0.5 * coalesce(text_continuity, 0) + 0.2 * coalesce(ngram_alignment, 0), 9) as score
  from join_match where tablet_a <> '' and tablet_b <> '' and tablet_a <> tablet_b),
p as (select a, b, max(score) as score from s where not isnan(score) group by a, b), e as (select a as tablet_id, b as partner, score from p union all select b, a, score from p)
select tablet_id, partner, round(score, 6) as score, cast(row_number() over (partition by tablet_id order by e.score desc, partner) as integer) as place from e qualify place <= 3""",
    "gap_fillers": f"""with {_PAIRS},
w as (select a, b, {_WORDS('ta')} as wa, {_WORDS('tb')} as wb from x),
y as (select a, b, list_transform(case when len(wa) > len(wb) then wb else wa end, lambda v: lower(v)) as s, case when len(wa) > len(wb) then wa else wb end as m from w where len(wa) > 0 and len(wb) > 0),
z as (select a, b, s, lower(unnest(m)) as word, generate_subscripts(m, 1) as i from y)
select a, b, case when list_contains(s[greatest(i - 2, 1):i + 2], word) then 'fragment_context' when list_contains(s, word) then 'fragment_corpus' else 'gap_fill' end as source, count(*) as n from z group by all""",
    "label_edges": f"""
with s as (select distinct list_sort(list_distinct(myth_labels)) as l from {_T} where len(myth_labels) > 0), k as (select array_to_string(l, '|') as name, unnest(l) as label from s)
select a.name as set_1, b.name as set_2, count(*) as n_shared, round(0.5::double + 0.1 * (count(*) - 1), 6) as weight from k a join k b on a.label = b.label and a.name < b.name group by 1, 2""",
    "semantic_edges": f"""
with p as (select least(tablet_a, tablet_b) as a, greatest(tablet_a, tablet_b) as b, max(join_confidence) as s from join_match
  where tablet_a <> '' and tablet_b <> '' and tablet_a <> tablet_b and not isnan(join_confidence) group by 1, 2),
x as (select a, b, s, coalesce(len(list_intersect(list_distinct(t.myth_labels), list_distinct(u.myth_labels))), 0) as k from p left join {_T} t on t.id = a left join {_T} u on u.id = b where s >= 0.65)
select a, b, round(s + 0.1::double * k, 6) as weight, case when k > 0 then 'semantic+motif' else 'semantic' end as type from x""",
    "match_graph": """
with p as (select distinct least(tablet_a, tablet_b) as a, greatest(tablet_a, tablet_b) as b from join_match where tablet_a <> '' and tablet_b <> '' and tablet_a <> tablet_b and join_confidence >= 0.65 and not isnan(join_confidence)),
n as (select count(*) as n_nodes from (select a from p union select b from p)), m as (select count(*) as n_edges from p)
select n_nodes, n_edges, round(case when n_nodes > 1 then 2.0 * n_edges / (n_nodes * (n_nodes - 1)) else 0 end, 9) as density from n, m""",
    "shape_scalars": f"""
with r as (select id, bbox_w, bbox_h, contour, range(1, len(contour) + 1) as k from {_V}),
s as (select id, bbox_w, bbox_h, abs(coalesce(list_sum(list_transform(k, lambda i: cast(contour[i].x as double) * {_NEXT}.y - cast({_NEXT}.x as double) * contour[i].y)), 0)) / 2 as area,
  coalesce(list_sum(list_transform(k, lambda i: sqrt(pow(contour[i].x - {_NEXT}.x, 2) + pow(contour[i].y - {_NEXT}.y, 2)))), 0) as perimeter from r)
select id, round(area, 6) as area, round(perimeter, 6) as perimeter, round(case when perimeter > 0 then 4 * pi() * area / (perimeter * perimeter) else 0 end, 6) as circularity,
  round(bbox_w / nullif(bbox_h, 0), 6) as aspect_ratio, round(area / nullif(bbox_w * bbox_h, 0), 6) as extent from s""",
    "component_types": f"""
with r as (select distinct on (id) id, bbox_w, bbox_h, bbox_w * bbox_h * 0.4::double as area, case when bbox_h > 0 then bbox_w / bbox_h else 1 end as aspect from cuneiform_signs order by id),
s as (select *, case when bbox_w * bbox_h > 0 then area / (bbox_w * bbox_h) else 0 end as extent from r), k as (select *, {_KIND} as component_type from s)
select id, component_type, round(least(0.95::double, 0.5::double + case when area between 200 and 2000 then 0.2 when area between 100 and 4000 then 0.1 else 0 end
  + case when component_type = 'wedge' and aspect between 0.5 and 2.0 then 0.2 when component_type = 'vertical' and aspect < 0.5 then 0.2 when component_type = 'horizontal' and aspect > 2.0 then 0.2
    when component_type = 'complex' and area > 500 then 0.1 else 0 end), 6) as confidence from k""",
}
