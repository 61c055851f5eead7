"""Search for the fragments that may join a given one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tellstone.functions import text as X
from tellstone.operators import blocks as B
from tellstone.session import Scratch

#: Weights of the closeness of vectors, shared words and shared word pairs: over the smaller set (A) and the larger (B).
CONTINUITY = {"min": (0.5, 0.3, 0.2), "max": (0.6, 0.2, 0.2)}
#: Scores down to which the best pairs are looked for, one after the other, and what rounding may add to a score.
LEAST, SLACK = (1.0, 0.9, 0.0), 1e-6
#: Queries and texts of a block where few of them meet.
FEW_QUERIES, FEW_ROWS = 16_384, 16_384


def continuity(vectors: Column | None, words: Column, bigrams: Column, by: str = "min") -> Column:
    """Weighted text continuity; without vectors the other two weights make up the whole. Null scores count as 0."""
    weights = CONTINUITY[by]
    parts = [(weights[1], words), (weights[2], bigrams)] + ([(weights[0], vectors)] if vectors is not None else [])
    return sum((F.lit(w / sum(w for w, _ in parts)) * F.coalesce(s, F.lit(0.0)) for w, s in parts), F.lit(0.0))


def _sized(texts: DataFrame) -> DataFrame:
    words = X.words(F.lower(F.col("text")))
    sets = texts.where("text is not null").select("id", words.alias("words"))
    different = lambda n: F.size(F.array_distinct(X.ngrams(F.col("words"), n) if n > 1 else F.col("words")))
    return sets.select("id", "words", different(1).alias("n_w"), different(2).alias("n_b"))


def _only(side: tuple, keep: np.ndarray) -> tuple:
    """The terms of the kept places, which are numbered again."""
    to = np.cumsum(keep) - 1
    here = keep[side[0]]
    return to[side[0][here]], side[1][here], side[2][here]


def _parts(own: tuple, other: tuple, n: np.ndarray, m: np.ndarray, there: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Queries and texts that need to meet, where the common word pairs of two are at least a share of those of the one that has fewer.

    The one with fewer has at least that share of its pairs among those of the other's whole block. ``there``: queries that are among the texts, whose own row doesn't count.
    """
    times = np.bincount(other[1], minlength=own[1].max(initial=-1) + 1)
    small_q = (n > 0) & (np.bincount(own[0][times[own[1]] > there[own[0]]], minlength=len(n)) >= least * n)
    small_r = (m > 0) & (np.bincount(other[0], minlength=len(m)) >= least * m)  # of the texts' pairs only those of the queries are here
    return [(small_q, np.ones(len(m), bool)), (~small_q, small_r)]


def _met(q: dict[str, pa.Array], r: dict[str, pa.Array], k: int, by: str, least: float) -> pa.RecordBatch:
    """The k best texts of a block for each query of a block, with their numbers of common words and word pairs; such under ``least`` may be left out."""
    known = q["words"].flatten().unique()
    sides = []
    for side in (q, r):
        at, word = B.places(side["words"]), B.codes(side["words"].flatten(), known)
        pair = np.where((at[1:] == at[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0), word[:-1] * len(known) + word[1:], -1)
        sides.append(((at, word), (at[1:], pair)))
    terms = []
    for kind in (0, 1):
        different = np.unique(np.append(sides[0][kind][1], -1))
        terms.append([])
        for at, term in (sides[0][kind], sides[1][kind]):
            there = term >= 0
            at, code = at[there], np.searchsorted(different, term[there])
            fits = different[np.minimum(code, len(different) - 1)] == term[there]
            key = np.unique(at[fits] * len(different) + code[fits])
            terms[-1].append((key // len(different), key % len(different), np.ones(len(key), np.float32)))
        order = np.argsort(terms[-1][0][1], kind="stable")
        terms[-1][0] = tuple(x[order] for x in terms[-1][0])
    n, m = ([side[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("n_w", "n_b")] for side in (q, r))
    of = np.minimum if by == "min" else np.maximum
    w_w, w_b = (w / sum(CONTINUITY[by][1:]) for w in CONTINUITY[by][1:])
    share = lambda both, x, y: np.where(np.minimum(x, y) > 0, both / np.maximum(of(x, y), 1), 0)
    need = (least - SLACK - w_w) / w_b
    itself = B.codes(r["id"], q["id"])
    there = np.bincount(itself[itself >= 0], minlength=len(n[0]))
    parts = _parts(*terms[1], n[1], m[1], there, need) if need > 0 else [(np.ones(len(n[0]), bool), np.ones(len(m[0]), bool))]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]
    for some_q, some_r in parts:
        q_at, r_at = np.nonzero(some_q)[0], np.nonzero(some_r)[0]
        sides = [(_only(own, some_q), _only(other, some_r)) for own, other in terms]
        n_here, m_here = [x[q_at] for x in n], [x[r_at] for x in m]
        of_q = np.where(some_q, np.cumsum(some_q) - 1, -1)
        own_at = np.where(itself >= 0, of_q[itself], -1)[r_at]
        for begin in range(0, len(r_at) if len(q_at) else 0, B.AT_ONCE):
            end = min(begin + B.AT_ONCE, len(r_at))
            both = []
            for own, other in sides:
                lo, hi = np.searchsorted(other[0], (begin, end))
                both.append(B.products(own, (other[0][lo:hi] - begin, other[1][lo:hi], other[2][lo:hi]), (len(q_at), end - begin)))
            same = np.nonzero(own_at[begin:end] >= 0)[0]
            both[0][own_at[begin:end][same], same] = both[1][own_at[begin:end][same], same] = 0
            rough = [share(b, x.astype(np.float32)[:, None], y[begin:end].astype(np.float32)) for b, x, y in zip(both, n_here, m_here)]
            scores = np.float32(w_w) * rough[0] + np.float32(w_b) * rough[1]
            exact = lambda i, j, _: w_w * share(both[0][i, j].astype(np.float64), n_here[0][i], m_here[0][begin + j]) + w_b * share(both[1][i, j].astype(np.float64), n_here[1][i], m_here[1][begin + j])  # noqa: B023, E731
            i, j = B.best(scores, k, exact, 1e-5)
            i, j = (x[exact(i, j, None) >= least - SLACK] for x in (i, j))
            found.append((q_at[i], r_at[j + begin], both[0][i, j], both[1][i, j]))
    i, j, w, b = (np.concatenate(x) for x in zip(*found))
    columns = [q["id"].take(pa.array(i)), r["id"].take(pa.array(j)), *[pa.array(x.astype(np.int32)) for x in (n[0][i], n[1][i], m[0][j], m[1][j], w, b)]]
    return pa.RecordBatch.from_arrays(columns, ["id", "partner", "n_w", "n_b", "m_w", "m_b", "w", "b"])


def join_search(queries: DataFrame, texts: DataFrame, k: int = 3, by: str = "min", least: float = 0.0) -> DataFrame:
    """For each query (id, text) the k texts of the best continuity but itself: id, partner, words, bigrams, score, place.

    Blocks of queries and texts meet, and products of matrices count their common words and word pairs; a text that shares no word
    with a query has no row. Shares are over the smaller (``min``) or larger (``max``) set. Ties go to the smaller partner. Ids must be
    unique; empty and null texts have no rows. Only rows of a score of at least ``least`` to 6 digits come out; where that is more than
    the weight of words, only those meet whose common word pairs may be enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _met(B.fields(batch.column("q")[i]), B.fields(batch.column("r")[i]), k, by, least)

    sizes = (FEW_QUERIES, FEW_ROWS) if least > CONTINUITY[by][1] / sum(CONTINUITY[by][1:]) else (B.QUERIES, B.ROWS)
    kinds = [dict(df.dtypes)["id"] for df in (queries, texts)]
    counts = ", ".join(f"{c} int" for c in ("n_w", "n_b", "m_w", "m_b", "w", "b"))
    met = B.met_blocks(_sized(queries), _sized(texts), *sizes).mapInArrow(run, f"id {kinds[0]}, partner {kinds[1]}, {counts}")
    of = F.least if by == "min" else F.greatest
    share = lambda x: F.when(F.least(f"n_{x}", f"m_{x}") > 0, F.col(x) / of(f"n_{x}", f"m_{x}")).otherwise(0.0)
    scored = met.select("id", "partner", share("w").alias("words"), share("b").alias("bigrams"))
    scored = scored.withColumn("score", F.round(continuity(None, F.col("words"), F.col("bigrams"), by), 9))
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "partner"))
    return scored.where(F.round("score", 6) >= least).withColumn("place", place).where(F.col("place") <= k)


def best_pairs(queries: DataFrame, texts: DataFrame, n: int, k: int = 3) -> DataFrame:
    """a, b, score: the n best different pairs of the join search, either way, a < b; ties, on scores to 6 digits, by a and b.

    Whatever a query's partners below a score are, they don't change its places above it. So partners of high scores are looked for first, and lower ones only
    where those make fewer than n pairs; in the end all meet.
    """
    scratch = Scratch(queries.sparkSession, "pairs")
    for least in LEAST:
        rows = join_search(queries, texts, k, least=least)
        pairs = rows.groupBy(F.least("id", "partner").alias("a"), F.greatest("id", "partner").alias("b")).agg(F.round(F.max("score"), 6).alias("score"))
        best = scratch.write(pairs.orderBy(F.desc("score"), "a", "b").limit(n))
        if best.count() == n:
            break
    return best.orderBy(F.desc("score"), "a", "b")
