"""Queries over joins of fragments, groups of them, and vectors of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.functions import vectors as V
from tellstone.operators import features as E
from tellstone.operators import groups as G
from tellstone.operators import joinsearch as J
from tellstone.operators import similarity as S
from tellstone.session import spread
from tellstone.sources.tables import catalog, detections, latest_by_id, myths, read_table, tablets

_T = "(select distinct on (id) * from tablets order by id, created_at desc)"
_M = "(select distinct on (id) * from myth_texts order by id, created_at desc)"
_S = "(select distinct on (id) * from cuneiform_signs order by id)"
_V = "(select distinct on (id) * from spijkerschrift_visueel order by id, created_at desc)"
_C = "(select distinct on (id) * from corpus_catalog order by id)"


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "join_match").where("tablet_a <> '' and tablet_b <> '' and join_confidence >= 0.65 and not isnan(join_confidence)")


def match_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of fragments that sure matches hold together, with their number."""
    return G.group_sizes(G.linked_groups(_links(spark, folder), "tablet_a", "tablet_b"))


def match_components(spark: SparkSession, folder: str) -> DataFrame:
    """Number of groups, the largest of them, and its size."""
    return match_groups(spark, folder).agg(F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest"))


def _numbered(column: str):
    return F.regexp_extract(column, r"(\d+)$", 1).try_cast("bigint")


def _searched(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The tablets whose number is divisible by 20, and all tablets."""
    texts = spread(tablets(spark, folder, "transliteration"), "id").select("id", F.col("transliteration").alias("text"))
    return texts.where(_numbered("id") % 20 == 0), texts


def join_search(spark: SparkSession, folder: str) -> DataFrame:
    """The three best partners of every tablet whose number is divisible by 20, among all tablets."""
    found = J.join_search(*_searched(spark, folder))
    return found.select("id", "partner", *[F.round(c, 6).alias(c) for c in ("words", "bigrams", "score")], "place")


def best_reconstructions(spark: SparkSession, folder: str) -> DataFrame:
    """Each unordered pair of the join search once, best first by place."""
    return J.best_pairs(*_searched(spark, folder), 5)


def nearest_of_shortest(spark: SparkSession, folder: str) -> DataFrame:
    """For the three shortest myth texts the nearest other text."""
    texts = myths(spark, folder, "transliteration").where("transliteration <> ''").select("id", F.col("transliteration").alias("text"))
    short = texts.orderBy(F.length("text"), "id").limit(3)
    return J.join_search(short, texts, 1, "max").select("id", "partner", F.round("score", 6).alias("score"))


def close_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Of the five nearest vectors those with a similarity above 0.3, for every vector whose id is divisible by 20."""
    rows = read_table(spark, folder, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).where("vec is not null")
    return S.exact_nearest(rows.where("id % 20 = 0"), rows, 5).where("similarity > 0.3").select("id", "neighbour", F.round("similarity", 6).alias("similarity"), "place")


def blended_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The two halves of each vector: their cosine, that of their blend with the first, and the length of the blend."""
    rows = read_table(spark, folder, "embeddings", "vec_id", "embedding").where("embedding is not null")
    half = F.floor(F.size("embedding") / 2).cast("int")
    rows = rows.select("vec_id", F.slice("embedding", F.lit(1), half).alias("a"), F.slice("embedding", half + 1, half).alias("b"))
    rows = rows.withColumn("c", V.blend(F.col("a"), F.col("b")))
    return rows.select("vec_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"), F.round(V.cosine(F.col("a"), F.col("c")), 6).alias("blended"), F.round(V.norm(F.col("c")), 6).alias("length"))


def mean_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the vectors of each label, a row a coordinate."""
    rows = read_table(spark, folder, "embeddings", "label", "embedding").select("label", F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def index_group(spark: SparkSession, folder: str) -> DataFrame:
    """The embedding type that an index is made of: the one with the most vectors, of equal ones the first by name."""
    counts = read_table(spark, folder, "prebaked_embeddings", "embedding_type").groupBy("embedding_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("embedding_type", F.struct(-F.col("n"), "embedding_type")).alias("embedding_type"), F.max("n").alias("n"))


def entries_with_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue entries with their vectors (inner), by type."""
    vectors = read_table(spark, folder, "prebaked_embeddings", "entry_id", "embedding_type", "embedding").where("embedding is not null")
    counts = vectors.groupBy("entry_id", "embedding_type").agg(F.count(F.lit(1)).alias("n_vectors"))
    return catalog(spark, folder, "title").join(counts, F.col("id") == F.col("entry_id")).select("id", "title", "embedding_type", "n_vectors")


def entries_and_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every catalogue entry with the number of its vectors, 0 for none (left)."""
    counts = read_table(spark, folder, "prebaked_embeddings", "entry_id").where("entry_id is not null").groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"))
    return catalog(spark, folder, "title").join(counts, F.col("id") == F.col("entry_id"), "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_vectors"))


def box_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Intersection over union of each sign's box and the next of its tablet, by index and id."""
    rows = detections(spark, folder, "tablet_id", "sign_index", "bbox_x", "bbox_y", "bbox_w", "bbox_h").where("tablet_id <> '' and sign_index is not null")
    keyed = rows.groupBy("tablet_id", "sign_index").agg(F.min_by(F.struct("id", *[f"bbox_{c}" for c in "xywh"]), "id").alias("s"))
    after = keyed.select("tablet_id", (F.col("sign_index") - 1).alias("sign_index"), F.col("s").alias("t"))
    both = keyed.join(after, ["tablet_id", "sign_index"])
    boxes = [F.col(f"{x}.bbox_{c}") for x in "st" for c in "xywh"]
    return both.select(F.col("s.id").alias("id"), F.col("t.id").alias("next_id"), F.round(V.iou(*boxes), 6).alias("iou"))


def contour_types(spark: SparkSession, folder: str) -> DataFrame:
    """Component type and confidence of the photographed shapes, by the area of their contours."""
    rows = latest_by_id(read_table(spark, folder, "spijkerschrift_visueel"), "id", "created_at", "area", "bbox_w", "bbox_h")
    args = [F.col(c) for c in ("area", "bbox_w", "bbox_h")]
    return rows.where("area is not null").select("id", V.component_type(*args).alias("component_type"), F.round(V.component_confidence(*args), 6).alias("confidence"))


def corner_angle_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Corners of each contour, and the sum of their angles in degrees."""
    rows = latest_by_id(read_table(spark, folder, "spijkerschrift_visueel"), "id", "created_at", "contour").where("size(contour) >= 3")
    angles = V.corner_angles(F.col("contour"))
    return rows.select("id", F.size(angles).alias("n"), F.round(F.aggregate(angles, F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


def char_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest myth texts of each by weighted runs of one to three characters."""
    docs = E.char_counts(spread(myths(spark, folder, "text"), "id"), 3)
    return E.nearest_by_counts(docs, None, 3).withColumn("similarity", F.round("similarity", 6))


QUERIES = {f.__name__: f for f in (
    match_groups, match_components, join_search, best_reconstructions, nearest_of_shortest, close_neighbours, blended_vectors, mean_vectors, index_group, entries_with_vectors, entries_and_vectors,
    box_overlaps, contour_types, corner_angle_totals, char_neighbours,
)}

_GROUPS = """
with recursive l as (select tablet_a as a, tablet_b as b from join_match where tablet_a <> '' and tablet_b <> '' and tablet_a <> tablet_b and join_confidence >= 0.65 and not isnan(join_confidence)),
e as (select a, b from l union select b, a from l),
r(id, other) as (select a, a from e union select r.id, e.b from r join e on e.a = r.other),
g as (select id, min(other) as group_id from r group by id)
"""
_WORDS = "list_filter(string_split_regex(lower(coalesce({}, '')), '[\\s\\p{{Z}}]+'), lambda w: w <> '')"


def _search(queries: str, texts: str, by: str, weights: tuple[float, float]) -> str:
    """Common words and word pairs of all pairs of a query and a text, by their lists."""
    sets = "list_distinct(w) as w, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b"
    share = lambda x: f"case when least(len(q.{x}), len(r.{x})) > 0 then len(list_intersect(q.{x}, r.{x})) / {by}(len(q.{x}), len(r.{x})) else 0.0 end"
    return f"""
x as (select id, {sets} from (select id, {_WORDS.format('text')} as w from ({texts}))), q as (select x.* from x semi join ({queries}) using (id)),
p as (select q.id, r.id as partner, {share('w')} as words, {share('b')} as bigrams from q join x r on q.id <> r.id where len(list_intersect(q.w, r.w)) > 0),
s as (select *, round({weights[0]} * words + {weights[1]} * bigrams, 9) as score from p),
j as (select *, cast(row_number() over (partition by id order by s.score desc, partner) as integer) as place from s)"""


_TEXTS = f"select id, transliteration as text from {_T} where transliteration is not null"
_JOINS = _search(f"select id from ({_TEXTS}) where try_cast(regexp_extract(id, '(\\d+)$', 1) as bigint) % 20 = 0", _TEXTS, "least", (0.6, 0.4))
_MYTHS = f"select id, transliteration as text from {_M} where transliteration <> ''"
_HALVES = "select vec_id, cast(embedding[1:len(embedding)//2] as double[]) as a, cast(embedding[len(embedding)//2+1:2*(len(embedding)//2)] as double[]) as b from embeddings where embedding is not null"
_UNIT = "list_transform({0}, lambda x: x / sqrt(list_sum(list_transform({0}, lambda y: y * y))))"
_CHARS = "list_transform(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> ''), lambda w: ' ' || w || ' ')"
SQL = {
    "match_groups": _GROUPS + "select group_id, count(*) as n from g group by 1",
    "match_components": _GROUPS + ", n as (select group_id, count(*) as n from g group by 1) select count(*) as n_groups, max(n) as largest from n",
    "join_search": f"with {_JOINS} select id, partner, round(words, 6) as words, round(bigrams, 6) as bigrams, round(score, 6) as score, place from j where place <= 3",
    "best_reconstructions": f"with {_JOINS} select least(id, partner) as a, greatest(id, partner) as b, round(max(round(score, 6)), 6) as score from j where place <= 3 group by 1, 2 order by 3 desc, 1, 2 limit 5",
    "nearest_of_shortest": f"with {_search(f'select id from ({_MYTHS}) order by length(text), id limit 3', _MYTHS, 'greatest', (0.5, 0.5))} select id, partner, round(score, 6) as score from j where place = 1",
    "close_neighbours": """
with v as (select vec_id as id, cast(embedding as double[]) as e from embeddings where embedding is not null),
s as (select a.id, b.id as neighbour, round(list_cosine_similarity(a.e, b.e), 9) as s from v a join v b on a.id <> b.id where a.id % 20 = 0),
p as (select *, cast(row_number() over (partition by id order by s.s desc, neighbour) as integer) as place from s)
select id, neighbour, round(s, 6) as similarity, place from p where place <= 5 and s > 0.3""",
    "blended_vectors": f"""
with h as ({_HALVES}), u as (select vec_id, a, b, {_UNIT.format('a')} as ua, {_UNIT.format('b')} as ub from h),
m as (select vec_id, a, b, list_transform(range(1, len(a) + 1), lambda i: (ua[i] + ub[i]) / 2) as m from u), c as (select vec_id, a, b, {_UNIT.format('m')} as c from m)
select vec_id, round(list_cosine_similarity(a, b), 6) as cosine, round(list_cosine_similarity(a, c), 6) as blended, round(sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) as length from c""",
    "mean_vectors": "with x as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) select label, cast(pos as integer) as pos, round(avg(cast(x as double)), 6) as mean from x group by 1, 2",
    "index_group": "select embedding_type, count(*) as n from prebaked_embeddings group by 1 order by 2 desc, 1 limit 1",
    "entries_with_vectors": f"select c.id, c.title, e.embedding_type, count(*) as n_vectors from {_C} c join prebaked_embeddings e on e.entry_id = c.id where e.embedding is not null group by all",
    "entries_and_vectors": f"select c.id, count(e.entry_id) as n_vectors from {_C} c left join prebaked_embeddings e on e.entry_id = c.id group by 1",
    "box_overlaps": f"""
with s as (select distinct on (tablet_id, sign_index) * from {_S} where tablet_id <> '' and sign_index is not null order by tablet_id, sign_index, id),
p as (select a.id, b.id as next_id, greatest(least(a.bbox_x + a.bbox_w, b.bbox_x + b.bbox_w) - greatest(a.bbox_x, b.bbox_x), 0)::double * greatest(least(a.bbox_y + a.bbox_h, b.bbox_y + b.bbox_h) - greatest(a.bbox_y, b.bbox_y), 0) as i,
  a.bbox_w::double * a.bbox_h + b.bbox_w::double * b.bbox_h as u from s a join s b on a.tablet_id = b.tablet_id and b.sign_index = a.sign_index + 1)
select id, next_id, round(case when u - i > 0 then i / (u - i) else 0.0 end, 6) as iou from p""",
    "contour_types": f"""
with x as (select id, area, bbox_w as w, bbox_h as h, case when bbox_h > 0 then bbox_w / bbox_h else 1.0 end as a, case when bbox_w * bbox_h > 0 then area / (bbox_w * bbox_h) else 0.0 end as e from {_V} where area is not null),
k as (select *, case when a between 0.3 and 3.0 and e > 0.3 then case when area < 800 then 'wedge' else 'complex' end when a < 0.3 and h > 30 then 'vertical' when a > 3.0 and w > 30 then 'horizontal' else 'angled' end as t from x)
select id, t as component_type, round(least(0.5::double + case when area between 200 and 2000 then 0.2 when area between 100 and 4000 then 0.1 else 0 end + case when t = 'wedge' and a between 0.5 and 2.0 then 0.2 when t = 'vertical' and a < 0.5 then 0.2
  when t = 'horizontal' and a > 2.0 then 0.2 when t = 'complex' and area > 500 then 0.1 else 0 end, 0.95), 6) as confidence from k""",
    "corner_angle_totals": f"""
with c as (select id, contour as p, len(contour) as n from {_V} where len(contour) >= 3), k as (select id, n, unnest(range(1, n + 1)) as i, p from c),
v as (select id, n, p[case when i = 1 then n else i - 1 end] as a, p[i] as b, p[case when i = n then 1 else i + 1 end] as c from k),
d as (select id, n, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) * sqrt((c.x - b.x) ** 2 + (c.y - b.y) ** 2) as l, (a.x - b.x) * (c.x - b.x) + (a.y - b.y) * (c.y - b.y) as s from v)
select id, cast(n as integer) as n, round(sum(case when l > 0 then degrees(acos(greatest(-1.0, least(1.0, s / l)))) else 0 end), 3) as total from d group by id, n""",
    "char_neighbours": f"""
with w as (select id, {_CHARS} as w from {_M}), u as (select id, unnest(w) as w from w),
t as (select id, unnest(list_concat(list_concat(list_transform(range(1, length(w) + 1), lambda i: substr(w, i, 1)), list_transform(range(1, length(w)), lambda i: substr(w, i, 2))), list_transform(range(1, greatest(length(w) - 1, 1)), lambda i: substr(w, i, 3)))) as term from u),
c as (select id, term, count(*) as c from t group by all), d as (select term, count(*) as df from c group by term), n as (select count(*) as n from w),
r as (select id, term, c * (ln((1.0 + n) / (1 + df)) + 1) as x from c join d using (term), n),
l as (select id, sqrt(sum(x * x)) as l from r group by id), v as (select id, term, x / l as x from r join l using (id)),
s as (select a.id, b.id as neighbour, round(sum(a.x * b.x), 9) as s from v a join v b on a.term = b.term and a.id <> b.id group by 1, 2)
select id, neighbour, round(s, 6) as similarity, cast(row_number() over (partition by id order by s desc, neighbour) as integer) as place from s qualify place <= 3""",
}
