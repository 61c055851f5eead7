"""Similarity of fragments: exact vector search, text continuity, alignment, fracture profiles, rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tellstone.constants import EDGE_LEAST
from tellstone.functions import text as X

#: Vectors of one block of an exact search.
BLOCK = 2048


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """Rows (id, vec) as blocks of about BLOCK vectors, by a hash of the id."""
    n = rows.count()
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // BLOCK))))
    return rows.groupBy(block.alias(f"{name}_block")).agg(F.collect_list(F.struct("id", "vec")).alias(name))


def exact_nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """For each query (id, vec) the k rows of the highest cosine similarity but itself: id, neighbour, similarity, place.

    Every query meets every row, in blocks: a block of queries and one of rows are a matrix
    product in one task, which keeps k a query. Vectors must be of one length; such of length 0
    are left out. Ties go to the smaller id, on similarities rounded to 9 digits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (q_ids, q), (r_ids, r) = (_unit_block(batch.column(c)[i]) for c in ("q", "r"))
                if not len(q) or not len(r):
                    continue
                sims = np.round(q @ r.T, 9)
                sims[q_ids[:, None] == r_ids] = -2
                order = np.lexsort((np.broadcast_to(r_ids, sims.shape), -sims), axis=1)[:, :k]
                got = np.take_along_axis(sims, order, 1)
                row, col = np.nonzero(got > -2)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(r_ids[order[row, col]]), pa.array(got[row, col])], ["id", "neighbour", "similarity"])

    # a stated set of queries against all rows, block by block
    met = _blocks(queries, "q").crossJoin(_blocks(rows, "r")).mapInArrow(run, "id long, neighbour long, similarity double")
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return met.withColumn("place", place).where(F.col("place") <= k)


def _unit_block(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    rows = cell.values
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    lists = rows.field("vec")
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    lengths = np.linalg.norm(x, axis=1)
    return ids[lengths > 0], x[lengths > 0] / lengths[lengths > 0, None]


def text_overlaps(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with word and bigram shares of two texts, over the larger and over the smaller set."""
    split = pairs.withColumns({f"_w{x}": X.words(F.lower(F.col(c))) for x, c in (("a", a), ("b", b))})
    split = split.withColumns({f"_b{x}": X.ngrams(F.col(f"_w{x}"), 2) for x in "ab"})
    shares = {f"{kind}_{by}": X.share_of(F.col(f"_{k}a"), F.col(f"_{k}b"), by) for kind, k in (("words", "w"), ("bigrams", "b")) for by in ("max", "min")}
    return split.withColumns(shares).drop("_wa", "_wb", "_ba", "_bb")


def ngram_alignment(pairs: DataFrame, key: list[str], a: str, b: str, n: int = 3) -> DataFrame:
    """key, ngram_alignment of pairs of texts: 0.6 of the shared n-grams over the smaller set, and 0.4 of the
    closeness of equal ones, 1 / (1 + 0.5 distance) summed over all occurrences and divided by half the longer list; at most 1.

    Only equal n-grams of a pair meet. Texts of fewer than n words have 0. ``key`` must be unique.
    """
    grams = lambda c: X.ngrams(X.words(F.col(c)), n)
    sized = pairs.select(*key, grams(a).alias("ga"), grams(b).alias("gb"))
    occurrences = lambda c: sized.select(*key, F.posexplode(c).alias(f"at_{c}", "gram"))
    near = occurrences("ga").join(occurrences("gb"), [*key, "gram"]).groupBy(*key).agg(F.sum(1.0 / (1.0 + 0.5 * F.abs(F.col("at_ga") - F.col("at_gb")))).alias("near"))
    least = F.least(F.size(F.array_distinct("ga")), F.size(F.array_distinct("gb")))
    score = 0.6 * F.size(F.array_intersect("ga", "gb")) / least + 0.4 * F.coalesce("near", F.lit(0.0)) / (F.greatest(F.size("ga"), F.size("gb")) / 2)
    return sized.join(near, key, "left").select(*key, F.when(least > 0, F.least(score, F.lit(1.0))).otherwise(0.0).alias("ngram_alignment"))


def ranked_joins(matches: DataFrame, score: Column, most: int = 3) -> DataFrame:
    """The best partners of each fragment: each unordered pair once with its best score, seen from both ends.

    Ties go to the smaller partner. Rows without a partner, with itself or without a score are left out.
    """
    usable = matches.withColumn("score", score).where("tablet_a <> '' and tablet_b <> '' and tablet_a <> tablet_b and score is not null and not isnan(score)")
    pairs = usable.groupBy(F.least("tablet_a", "tablet_b").alias("a"), F.greatest("tablet_a", "tablet_b").alias("b")).agg(F.max("score").alias("score"))
    ends = pairs.select(F.col("a").alias("tablet_id"), F.col("b").alias("partner"), "score").unionByName(pairs.select(F.col("b").alias("tablet_id"), F.col("a").alias("partner"), "score"))
    place = F.row_number().over(W.partitionBy("tablet_id").orderBy(F.desc("score"), "partner"))
    return ends.withColumn("place", place).where(F.col("place") <= most)


def resampled(values: np.ndarray, n: int) -> np.ndarray:
    """Linear resampling to n points over the same stretch; nothing becomes zeros."""
    if len(values) == n:
        return values
    return np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(values)), values) if len(values) else np.zeros(n)


def complementarity(a: list[np.ndarray], b: list[np.ndarray], weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> tuple[float, int]:
    """Best score of two fracture profiles (curvature, angle, length) over all turns, and its turn.

    All turns are compared at once. Missing lengths count as equal. An empty profile gives 0.
    """
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0
    n = max(len(a[0]), len(b[0]), 4)
    (ca, aa, la), (cb, ab, lb) = ([resampled(x, n) if i < 2 or len(x) else np.ones(n) for i, x in enumerate(side)] for side in (a, b))
    turn = (np.arange(n)[:, None] + np.arange(n)) % n
    cb, ab, lb = cb[turn], ab[turn], lb[turn]
    close = lambda x, y: 1 - np.minimum(np.abs(x - y) / (np.maximum(x, y) + 1e-6), 1)
    curve = np.where((ca > 0.01) | (cb > 0.01), close(ca, cb), 1.0)
    angle = 1 - np.minimum(np.minimum(np.abs(aa - ab), np.abs(360 - aa - ab)) / 180, 1)
    scores = weights[0] * curve.mean(1) + weights[1] * close(la, lb).mean(1) + weights[2] * angle.mean(1)
    best = int(scores.argmax())
    return (float(scores[best]), best) if scores[best] > 0 else (0.0, 0)


def fracture_scores(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key, fracture, turn of pairs with arrays curv_a, ang_a, len_a, curv_b, ang_b, len_b; null arrays are empty."""
    columns = [f"{kind}_{side}" for side in "ab" for kind in ("curv", "ang", "len")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sides = [[np.asarray([] if v is None else v, float) for v in pdf[c]] for c in columns]
            scores = [complementarity([s[i] for s in sides[:3]], [s[i] for s in sides[3:]]) for i in range(len(pdf))]
            yield pdf[key].assign(fracture=[s for s, _ in scores], turn=[t for _, t in scores])

    types = dict(pairs.dtypes)
    return pairs.select(*key, *columns).mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in key), "fracture double", "turn int"]))


def contour_vector(x: np.ndarray, y: np.ndarray, n: int = 256) -> np.ndarray:
    """A contour as n points at equal arc length, each axis scaled to 0..1, x before y."""
    if len(x) < 2:
        return np.zeros(2 * n)
    at = np.r_[0, np.cumsum(np.hypot(np.diff(x), np.diff(y)))]
    even = np.linspace(0, at[-1], n)
    scaled = [(v - v.min()) / (v.max() - v.min() + 1e-6) for v in (np.interp(even, at, x), np.interp(even, at, y))]
    return np.concatenate(scaled)


def filled_gaps(pairs: DataFrame, key: list[str], fragment: str, match: str) -> DataFrame:
    """key, place, word, confidence, source: each word of the longer text and how the shorter one supports it.

    0.8 where the other text has the word within two places, 0.4 where it has it anywhere, else 0.2; ignoring case.
    """
    f, m = X.words(F.col(fragment)), X.words(F.col(match))
    swap = F.size(f) > F.size(m)
    both = pairs.where((F.size(f) > 0) & (F.size(m) > 0)).select(*key, F.when(swap, m).otherwise(f).alias("short"), F.when(swap, f).otherwise(m).alias("long"))
    rows = both.select(*key, F.transform("short", F.lower).alias("short"), F.posexplode("long").alias("place", "word"))
    begin = F.greatest(F.col("place") - 1, F.lit(1))
    near = F.array_contains(F.slice("short", begin, F.col("place") + 4 - begin), F.lower("word"))
    confidence = F.when(near, 0.8).when(F.array_contains("short", F.lower("word")), 0.4).otherwise(0.2)
    source = F.when(near, "fragment_context").when(F.array_contains("short", F.lower("word")), "fragment_corpus").otherwise("gap_fill")
    return rows.select(*key, "place", "word", confidence.alias("confidence"), source.alias("source"))


def label_graph(nodes: DataFrame) -> DataFrame:
    """Edges between different label sets: set_1 < set_2, the labels they share, and the weight 0.5 + 0.1 (shared - 1).

    Nodes (id, labels) with equal sets stand together, so that edges never multiply by records.
    """
    sets = nodes.select(F.array_join(F.array_sort(F.array_distinct("labels")), "|").alias("labels")).where("labels <> ''").distinct()
    long = sets.select("labels", F.explode(F.split("labels", r"\|")).alias("label"))
    a, b = (long.select(F.col("labels").alias(f"set_{i}"), "label") for i in (1, 2))
    shared = a.join(b, "label").where("set_1 < set_2").groupBy("set_1", "set_2").agg(F.count(F.lit(1)).alias("n_shared"))
    return shared.withColumn("weight", F.round(0.5 + 0.1 * (F.col("n_shared") - 1), 6))


def labelled_edges(edges: DataFrame, nodes: DataFrame, least: float = EDGE_LEAST) -> DataFrame:
    """Semantic edges (a, b, similarity) of at least ``least`` with weight and type.

    The weight is the similarity and 0.1 for each label that both ends have; with such labels the type is
    ``semantic+motif``, else ``semantic``. Ends without a node have no labels. Edges between
    records that only share labels are those between their label sets, see ``label_graph``.
    """
    strong = edges.where(F.col("similarity") >= least)
    ends = lambda x: nodes.select(F.col("id").alias(x), F.array_distinct("labels").alias(f"labels_{x}"))
    joined = strong.join(ends("a"), "a", "left").join(ends("b"), "b", "left")
    shared = F.coalesce(F.size(F.array_intersect("labels_a", "labels_b")), F.lit(0))
    shared = F.when(shared > 0, shared).otherwise(0)
    kind = F.when(shared > 0, "semantic+motif").otherwise("semantic")
    return joined.select("a", "b", F.round(F.col("similarity") + 0.1 * shared, 6).alias("weight"), kind.alias("type"))


def graph_stats(edges: DataFrame, a: str, b: str) -> DataFrame:
    """n_nodes, n_edges and density 2 m / (n (n - 1)) of an undirected graph."""
    pairs = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    n_nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().agg(F.count(F.lit(1)).alias("n_nodes"))
    n_edges = pairs.agg(F.count(F.lit(1)).alias("n_edges"))
    both = n_nodes.crossJoin(n_edges)  # one row each
    n, m = F.col("n_nodes"), F.col("n_edges")
    return both.withColumn("density", F.round(F.when(n > 1, 2.0 * m / (n * (n - 1))).otherwise(0.0), 9))
