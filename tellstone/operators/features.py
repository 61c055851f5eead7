"""Features of texts and images: weighted terms, reduced vectors, visual words, and models from outside."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tellstone.functions.text import ngrams
from tellstone.operators import blocks as B
from tellstone.session import Scratch

MOST_TERMS = 5000
#: Different terms of a corpus that are broadcast with their frequencies; more are joined by shuffle.
BROADCAST_TERMS = 200_000
#: Axes of the first bound of a product, which all pairs have, and of the second; texts, their terms at most, and terms that the axes are fitted on.
FIRST_AXES, AXES, FITTED, FITTED_LENGTH, FITTED_TERMS = 320, 512, 2048, 4096, 2048
#: What bounds may fall short by: projections are kept in half precision, which moves each by at most 1 / 2,048 of its length. Beyond this share of pairs within the bounds all pairs of a block are multiplied.
SHORT, MANY = 1e-3, 0.04
#: Blocks of queries that there should be, if not more for their size, their size at most, that of the texts, and tasks that they should make.
ASKING, LEAST, MOST, TASKS = 12, 256, 1536, 24


def word_terms(text: Column, most: int = 3) -> Column:
    """Words of two characters or more in lower case, and runs of up to ``most`` of them; null gives none."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.concat(*[ngrams(tokens, n) for n in range(1, most + 1)])


def char_terms(text: Column, most: int = 3) -> Column:
    """Runs of 1 to ``most`` characters within words that have a blank on either side."""
    padded = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+", -1), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    runs = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(padded, lambda w: F.concat(*[runs(w, n) for n in range(1, most + 1)])))


def char_counts(texts: DataFrame, most: int = 3) -> DataFrame:
    """id, terms, counts of texts (id, text): the different terms of ``char_terms``, as numbers (21 bits a character), at most 3 characters each."""
    if not 1 <= most <= 3:
        raise ValueError("a term has 1 to 3 characters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                words = batch.column("words")
                padded = [f" {w} " for w in words.flatten().to_pylist()]
                char = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
                word = np.repeat(np.arange(len(padded)), np.fromiter(map(len, padded), np.int64, len(padded)))
                row = B.places(words)[word]
                terms, rows, run_of = [char], [row], char
                for n in range(2, most + 1):
                    run_of = (run_of[: len(char) - n + 1] << 21) | char[n - 1 :]
                    whole_run = word[: len(run_of)] == word[n - 1 :]
                    terms.append(run_of[whole_run])
                    rows.append(row[: len(run_of)][whole_run])
                term, row = np.concatenate(terms), np.concatenate(rows)
                order = np.lexsort((term, row))
                term, row = term[order], row[order]
                first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (row[1:] != row[:-1])]) if len(term) else np.empty(0, np.int64)
                upto = pa.array(np.searchsorted(row[first], np.arange(batch.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(upto, pa.array(x)) for x in (term[first], np.diff(np.r_[first, len(term)]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], ["id", "terms", "counts"])

    words = F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"\s+", -1), lambda w: w != "")
    return texts.select("id", words.alias("words")).mapInArrow(run, f"id {dict(texts.dtypes)['id']}, terms array<bigint>, counts array<int>")


def nearest_by_counts(docs: DataFrame, asks: Column | None, k: int, most_broadcast: int = BROADCAST_TERMS) -> DataFrame:
    """``nearest_by_terms`` of those docs (id unique, terms, counts) that ask (None: all), weighted by their counts as by ``weighted_terms``.

    No row is made for a term of a text: each text keeps its terms as numbers of their places among all, which are
    broadcast with their weights. More terms than ``most_broadcast`` are weighted by joins.

    Only pairs whose product may be among the k largest are multiplied: on a few axes (orthonormal, fitted on some texts) a product is at most that of
    the projections and that of the lengths of what is left. Axes that fit badly leave more pairs, but never other results.
    """
    scratch = Scratch(docs.sparkSession, "counts")
    docs = scratch.write(docs)
    n = docs.count()
    everyone, asks = asks is None, F.lit(True) if asks is None else asks  # then both sides are shuffled once

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, times = np.unique(batch.column("terms").flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(times, pa.int64())], ["term", "df"])

    stats = scratch.write(docs.select("terms").mapInArrow(frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")))
    if stats.count() > most_broadcast:
        counts = docs.select("id", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("id", F.col("t.terms").alias("term"), F.col("t.counts").alias("c"))
        weights = _weighted(scratch, counts, stats, n, sublinear=False)
        return nearest_by_terms(weights.where(asks), weights, k)
    table = stats.orderBy("term").toArrow()
    known, idf = table["term"].to_numpy(), np.log((1.0 + n) / (1 + table["df"].to_numpy())) + 1
    some = docs.where((F.size("terms") <= FITTED_LENGTH) & (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) <= 1_000_003 * FITTED / max(1, n))).select("terms", "counts").limit(2 * FITTED).toArrow()
    some = some.combine_chunks().to_batches()
    axes = _axes(*_weighed(_placed(some[0], known), some[0].column("counts"), idf), some[0].num_rows) if some else (np.empty(0, np.int64), np.zeros((0, 0), np.float32))
    all_terms = docs.sparkSession.sparkContext.broadcast((known, idf, *axes))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf, slot, axes = all_terms.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                places = _placed(batch, known)
                bounds = _bounds(*_weighed(places, batch.column("counts"), idf), batch.num_rows, slot, axes)
                count = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                upto = places.offsets.to_numpy().astype(np.int64)
                lists = [(4 * upto, places.values.to_numpy()), (4 * upto, count), (np.arange(batch.num_rows + 1) * bounds.shape[1] * 2, bounds)]
                lists = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(begin), pa.py_buffer(x.tobytes())]).cast(pa.binary()) for begin, x in lists]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], ["id", "places", "counts", "bounds"])

    def side(cell: pa.Scalar) -> tuple:
        rows = B.fields(cell)
        numbers = {c: np.frombuffer(b"".join(rows[c].to_pylist()), kind) for c, kind in (("places", np.int32), ("counts", np.int32), ("bounds", np.float16))}
        upto = np.r_[0, np.cumsum(pc.binary_length(rows["places"]).to_numpy(zero_copy_only=False) // 4)].astype(np.int32)
        weights = _weighed(pa.ListArray.from_arrays(pa.array(upto), pa.array(numbers["places"])), pa.ListArray.from_arrays(pa.array(upto), pa.array(numbers["counts"])), all_terms.value[1])
        return rows["id"], weights, numbers["bounds"].reshape(len(rows["id"]), -1).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, now, q = {}, None, None  # of each block of queries the best products so far
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("q")[i].values.field("id")[0].as_py()
                if q is None or key != now:
                    now, q = key, side(batch.column("q")[i])
                    top.setdefault(key, np.full((len(q[0]), k), -1.0))
                yield _nearest_bounded(q, side(batch.column("r")[i]), top[key], len(all_terms.value[0]), k)

    rows = docs.where("id is not null").mapInArrow(numbered, f"id {dict(docs.dtypes)['id']}, places binary, counts binary, bounds binary")
    asking = docs.where("id is not null").where(asks)
    n_asking = n if everyone else asking.count()
    queries = rows if everyone else asking.mapInArrow(numbered, rows.schema)
    size = min(MOST, max(LEAST, -(-n_asking // ASKING)))
    return _first(B.met_blocks(queries, rows, size, size if everyone else MOST, (n_asking, n), TASKS), run, [dict(docs.dtypes)["id"]] * 2, k)


def _placed(batch: pa.RecordBatch, known: np.ndarray) -> pa.ListArray:
    """The places of the terms of each text among the known ones."""
    upto = np.r_[0, np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))]
    place = np.searchsorted(known, batch.column("terms").flatten().to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(place, pa.int32()))


def _weighed(places: pa.ListArray, counts: pa.ListArray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, places of terms and weights at unit length, in the order of the texts."""
    at, place = B.places(places), places.flatten().to_numpy(zero_copy_only=False)
    weight = counts.flatten().to_numpy(zero_copy_only=False) * idf[place]
    return at, place, weight / np.sqrt(np.bincount(at, weight * weight, len(places)))[at]


def _axes(at: np.ndarray, place: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place its row in the axes, or -1, and the axes that these texts lie along most: rows of terms, a column an axis, the most telling first."""
    if not len(place):
        return np.empty(0, np.int64), np.zeros((0, 0), np.float32)
    mass = np.bincount(place, weight * weight)
    terms = np.argsort(-mass, kind="stable")[:FITTED_TERMS]
    slot = np.full(len(mass), -1)
    slot[terms] = np.arange(len(terms))
    x = np.zeros((n, len(terms)), np.float32)
    use = slot[place] >= 0
    x[at[use], slot[place[use]]] = weight[use]
    axes = np.random.default_rng(1).normal(size=(len(terms), min(AXES, *x.shape)))
    for _ in range(3):
        axes = np.linalg.qr(x.T @ (x @ axes.astype(np.float32)))[0]
    along = x.astype(np.float64) @ axes
    axes = np.linalg.qr(axes @ np.linalg.eigh(along.T @ along)[1][:, ::-1].copy())[0]
    return slot, axes.astype(np.float32)


def _bounds(at: np.ndarray, place: np.ndarray, weight: np.ndarray, n: int, slot: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The projection of each text, and the lengths that the first axes and all axes leave of it."""
    of = np.where(place < len(slot), slot[np.minimum(place, len(slot) - 1)], -1) if len(slot) else np.full(len(place), -1)
    x = np.zeros((n, len(axes)), np.float32)
    x[at[of >= 0], of[of >= 0]] = weight[of >= 0]
    along = (x @ axes).astype(np.float64)
    length = np.bincount(at, weight * weight, n)
    left = [np.sqrt(np.maximum(0, length - np.einsum("nd,nd->n", y, y)) + 1e-5 * (length > 0)) * (1 + 1e-3) for y in (along[:, :FIRST_AXES], along)]
    return np.concatenate([along, np.stack(left, axis=1)], axis=1).astype(np.float16)


def _nearest_bounded(q: tuple, r: tuple, top: np.ndarray, n_terms: int, k: int) -> pa.RecordBatch:
    """``_nearest`` of blocks with bounds, apart from rows that are worse than the k best products of a query so far (top, which is brought up to date)."""
    (q_ids, own, q_bounds), (r_ids, other, r_bounds) = q, r
    d, most = q_bounds.shape[1] - 2, min(k, len(r_ids))
    a, b, c, e = (np.ascontiguousarray(x[:, at]) for at in ([*range(min(d, FIRST_AXES)), d], [*range(d), d + 1]) for x in (q_bounds, r_bounds))
    q_upto, upto = (np.searchsorted(x[0], np.arange(len(ids) + 1)) for x, ids in ((own, q_ids), (other, r_ids)))
    found = []

    def scored(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Products of pairs in the order of their queries."""
        out, some, begin = np.zeros(len(i)), max(1, min(128, 4_000_000 // max(1, n_terms))), 0
        while begin < len(i):
            end = min(int(np.searchsorted(i, i[begin] + some)), begin + 4096)
            lo, hi = q_upto[i[begin]], q_upto[i[end - 1] + 1]
            dense = np.zeros((i[end - 1] - i[begin] + 1, n_terms))
            dense[own[0][lo:hi] - i[begin], own[1][lo:hi]] = own[2][lo:hi]
            times = upto[j[begin:end] + 1] - upto[j[begin:end]]
            item = np.arange(times.sum()) + np.repeat(upto[j[begin:end]] - (np.cumsum(times) - times), times)
            product = dense.ravel()[np.repeat((i[begin:end] - i[begin]) * n_terms, times) + other[1][item]] * other[2][item]
            out[begin:end] = np.bincount(np.repeat(np.arange(end - begin), times), product, end - begin)
            begin = end
        return out

    def keep(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> None:
        order = np.lexsort((j, -B.rounded(s), i))
        i, j, s = i[order], j[order], s[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        good = (place < k) & (s > 0)
        i, j, s, place = i[good], j[good], s[good], place[good]
        new = np.full(top.shape, -1.0)
        new[i, place] = s
        top[:] = np.sort(np.concatenate([top, new], axis=1), axis=1)[:, -k:]
        found.append((i, j, s))

    bound = a @ b.T
    itself = B.codes(r_ids, q_ids)
    same = np.nonzero(itself >= 0)[0]
    bound[itself[same], same] = -2
    least = top[:, 0]
    if (least < 0).any():  # the first rows that are met
        at = np.sort(np.argpartition(-bound, most - 1, axis=1)[:, :most], axis=1)
        i, j = np.repeat(np.arange(len(q_ids)), most), at.ravel()
        trial = np.where(bound[i, j] > -2, scored(i, j), -1).reshape(len(q_ids), most)
        least = np.maximum(least, trial.min(axis=1) if most == k else -1)
    i, j = np.nonzero(bound >= np.maximum(least - SHORT, -1)[:, None].astype(np.float32))
    if len(i) <= MANY * bound.size:
        bound = np.concatenate([np.einsum("nd,nd->n", c[i[x : x + 8192]], e[j[x : x + 8192]]) for x in range(0, max(1, len(i)), 8192)])
        good = bound >= least[i] - SHORT
        i, j, bound = i[good], j[good], bound[good]
        order = np.lexsort((-bound, i))
        soon = np.zeros(len(i), bool)
        soon[order] = np.arange(len(i)) - np.searchsorted(i, i) < 2 * k  # the likely best raise what the others must reach
        keep(i[soon], j[soon], scored(i[soon], j[soon]))
        later = ~soon & (bound >= top[i, 0] - SHORT)
        keep(i[later], j[later], scored(i[later], j[later]))
    else:
        order = np.argsort(own[1], kind="stable")
        sims = B.products(tuple(x[order] for x in own), other, bound.shape)
        sims[itself[same], same] = 0
        i, j = B.best(sims, k)
        keep(i, j, sims[i, j])
    i, j, s = (np.concatenate(x) for x in zip(*found))
    good = s >= top[i, 0] - 2e-9
    return pa.RecordBatch.from_arrays([q_ids.take(pa.array(i[good])), r_ids.take(pa.array(j[good])), pa.array(s[good])], ["id", "neighbour", "similarity"])


def weighted_terms(docs: DataFrame, most_terms: int | None = None, sublinear: bool = True) -> DataFrame:
    """id, term, weight of ``docs`` (id unique, terms): tf-idf at unit length.

    tf is 1 + ln(count), or the count; idf is ln((1 + n) / (1 + df)) + 1 over the n documents, such without terms
    included. ``most_terms`` keeps the most frequent terms of the corpus, ties by term.
    """
    scratch = Scratch(docs.sparkSession, "terms")
    n = docs.count()
    counts = docs.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("c"))
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("c").alias("total"))
    if most_terms is not None:
        stats = stats.orderBy(F.desc("total"), "term").limit(most_terms)
    return _weighted(scratch, counts, scratch.write(stats.select("term", "df")), n, sublinear)


def _weighted(scratch: Scratch, counts: DataFrame, stats: DataFrame, n: int, sublinear: bool) -> DataFrame:
    """id, term, weight of the counts (id, term, c) of terms that are in stats (term, df)."""
    if stats.count() <= BROADCAST_TERMS:
        stats = F.broadcast(stats)
    tf = 1 + F.log("c") if sublinear else F.col("c").cast("double")
    raw = counts.join(stats, "term").select("id", F.struct("term", (tf * (F.log((1.0 + n) / (1 + F.col("df"))) + 1)).alias("w")).alias("t"))
    whole = raw.groupBy("id").agg(F.collect_list("t").alias("t"), F.sqrt(F.sum(F.col("t.w") * F.col("t.w"))).alias("length"))
    weights = whole.select("id", F.col("t.term").alias("terms"), F.transform("t.w", lambda w: w / F.col("length")).alias("weights"))
    return scratch.write(weights).select("id", F.explode(F.arrays_zip("terms", "weights")).alias("t")).select("id", "t.terms", "t.weights").toDF("id", "term", "weight")


def nearest_by_terms(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """id, neighbour, similarity, place: for each query the k rows with the largest product of weights, itself left out.

    Blocks of queries and rows meet as matrices of the terms of the queries; weights must be positive. Ties, on products rounded
    to 9 digits, go to the smaller id; rows without a common term are none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, r = (B.fields(batch.column(c)[i]) for c in "qr")
                known = q["terms"].flatten().unique()
                yield _nearest(q["id"], r["id"], *[(B.places(x["terms"]), B.codes(x["terms"].flatten(), known), x["weights"].flatten().to_numpy(zero_copy_only=False)) for x in (q, r)], k)

    sides = [df.where("term is not null").groupBy("id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")) for df in (queries, rows)]
    kinds = [dict(df.dtypes)["id"] for df in (queries, rows)]
    return _first(B.met_blocks(*sides), run, kinds, k)


def _first(met: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kinds: list[str], k: int) -> DataFrame:
    sims = met.mapInArrow(run, f"id {kinds[0]}, neighbour {kinds[1]}, similarity double")
    sims = sims.withColumn("similarity", F.round("similarity", 9))
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return sims.withColumn("place", place).where(F.col("place") <= k)


def _nearest(q_ids: pa.Array, r_ids: pa.Array, q: tuple, r: tuple, k: int) -> pa.RecordBatch:
    """The k nearest rows of a block for each query of a block; each side as (places, terms as numbers, weights), terms under 0 count for nothing."""
    order = np.argsort(q[1], kind="stable")
    own = tuple(x[order] for x in q)
    other = tuple(x[r[1] >= 0] for x in r)
    itself = B.codes(r_ids, q_ids)
    found = []
    for begin in range(0, len(r_ids), B.AT_ONCE):
        end = min(begin + B.AT_ONCE, len(r_ids))
        lo, hi = np.searchsorted(other[0], (begin, end))
        sims = B.products(own, (other[0][lo:hi] - begin, other[1][lo:hi], other[2][lo:hi]), (len(q_ids), end - begin))
        same = np.nonzero(itself[begin:end] >= 0)[0]
        sims[itself[begin:end][same], same] = 0
        i, j = B.best(sims, k)
        found.append((i, j + begin, sims[i, j]))
    i, j, similarity = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays([q_ids.take(pa.array(i)), r_ids.take(pa.array(j)), pa.array(similarity)], ["id", "neighbour", "similarity"])


def reduced_vectors(weights: DataFrame, dims: int) -> DataFrame:
    """id, vector: projections of weighted terms on the first singular directions, at most MOST_TERMS terms.

    Directions have no fixed sign; only products of the vectors mean anything.
    """
    terms = {r[0]: i for i, r in enumerate(weights.select("term").distinct().orderBy("term").limit(MOST_TERMS + 1).collect())}
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms; keep the most frequent ones")
    grouped = weights.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("t"))
    sparse = grouped.rdd.map(lambda r: (r["id"], Vectors.sparse(len(terms), sorted((terms[x["term"]], x["weight"]) for x in r["t"]))))  # the decomposition takes an RDD
    svd = RowMatrix(sparse.values()).computeSVD(min(dims, len(terms)))
    directions = np.asarray(svd.V.toArray())
    column = {t: directions[i].tolist() for t, i in terms.items()}

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "vector": [np.sum([np.multiply(column[x["term"]], x["weight"]) for x in t], axis=0).tolist() for t in pdf["t"]]})

    return grouped.mapInPandas(project, f"id {dict(weights.dtypes)['id']}, vector array<double>")


def visual_words(descriptors: DataFrame, k: int = 256, seed: int = 42) -> DataFrame:
    """image_id, word, share: how the descriptors (image_id, descriptor) of each image spread over k words learnt from all."""
    rows = descriptors.where("descriptor is not null").select("image_id", array_to_vector(F.transform("descriptor", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed).fit(rows)
    counts = model.transform(rows).groupBy("image_id", F.col("prediction").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("image_id", "word", (F.col("n") / F.sum("n").over(W.partitionBy("image_id"))).alias("share"))


class EmbeddingModel(Protocol):
    """Anything that turns texts into vectors."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


def embedded(texts: DataFrame, load: Callable[[], EmbeddingModel]) -> DataFrame:
    """id, embedding of texts (id, text) by a model that each Python worker loads once; null text is empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            vectors = model.encode(pdf["text"].fillna("").tolist())
            yield pd.DataFrame({"id": pdf["id"], "embedding": [np.asarray(v, np.float32).tolist() for v in vectors]})

    return texts.select("id", "text").mapInPandas(run, f"id {dict(texts.dtypes)['id']}, embedding array<float>")


def asked(texts: DataFrame, client: Callable[[], Callable[[str], str | None]] | None, prompt: str = "{text}", tries: int = 3) -> DataFrame:
    """id, answer of a service for each text; without a client there are no rows.

    ``client`` makes a function from prompt to answer in each worker. A text whose tries all fail has no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client() if client else None
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"]):
                for _ in range(tries if ask and text else 0):
                    try:
                        if (answer := ask(prompt.replace("{text}", text))) is not None:
                            rows.append((key, answer))
                        break
                    except OSError:
                        continue
            yield pd.DataFrame(rows, columns=["id", "answer"])

    return texts.select("id", "text").mapInPandas(run, f"id {dict(texts.dtypes)['id']}, answer string")
