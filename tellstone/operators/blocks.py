"""Exact search of queries among rows by the terms they share: blocks of both meet as matrices, without a row for each common term."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and rows of a block, and rows of a block that are compared at once.
QUERIES, ROWS, AT_ONCE = 4096, 2048, 512
#: A term in at least this share of all pairs is a column of a dense matrix; pairs of rarer ones are listed, so many at once.
DENSE, COLUMNS, LISTED = 0.003, 512, 2_000_000


def met_blocks(queries: DataFrame, rows: DataFrame, n_queries: int = QUERIES, n_rows: int = ROWS, counted: tuple[int | None, int | None] = (None, None), tasks: int | None = None) -> DataFrame:
    """q, r: each block of queries with each block of rows; lists of structs of all their columns. Rows without id are left out. ``counted``: the numbers of both, where they are known.

    With ``tasks``, blocks of rows share tasks, in which each block of queries meets them one after another, as long as there are so many tasks.
    """
    n_q, n_r = (max(1, -(-(df.count() if number is None else number) // size)) for df, number, size in ((queries.where("id is not null"), counted[0], n_queries), (rows.where("id is not null"), counted[1], n_rows)))
    found = _blocks(rows, "r", n_r)
    return (found if tasks is None else found.coalesce(-(-tasks // n_q))).crossJoin(_blocks(queries, "q", n_q))


def _blocks(rows: DataFrame, name: str, n: int) -> DataFrame:
    rows = rows.where("id is not null")
    numbered = rows.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"), F.struct(*rows.columns).alias("row"))
    return numbered.repartition(n, "block").groupBy("block").agg(F.collect_list("row").alias("rows")).select(F.col("rows").alias(name))


def fields(cell: pa.Scalar) -> dict[str, pa.Array]:
    """The columns of a block, in the order of its ids."""
    rows = cell.values
    rows = rows.take(pc.sort_indices(rows.field("id")))
    return {f.name: rows.field(f.name) for f in rows.type}


def places(lists: pa.Array) -> np.ndarray:
    """For each item of the lists the place of its list."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def codes(terms: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each term among the known ones, or -1."""
    return pc.fill_null(pc.index_in(terms, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def products(q: tuple, r: tuple, shape: tuple[int, int]) -> np.ndarray:
    """Sums of the products of the weights of common terms, for each query and row; each side as (places, terms, weights), terms as numbers from 0. Fastest where q is in the order of its terms."""
    out = np.zeros(shape, np.result_type(q[2], r[2]))
    if not len(q[1]) or not len(r[1]):
        return out
    n = max(q[1].max(), r[1].max()) + 1
    n_q, n_r = (np.bincount(side[1], minlength=n) for side in (q, r))
    dense = n_q * n_r > DENSE * shape[0] * shape[1]
    column = np.cumsum(dense) - 1
    a, b = ([x[dense[side[1]]] for x in side] for side in (q, r))
    for begin in range(0, dense.sum(), COLUMNS):
        matrices = []
        for (at, term, weight), length in ((a, shape[0]), (b, shape[1])):
            c = column[term] - begin
            here = (c >= 0) & (c < COLUMNS)
            matrices.append(np.zeros((length, min(COLUMNS, dense.sum() - begin)), out.dtype))
            matrices[-1][at[here], c[here]] = weight[here]
        out += matrices[0] @ matrices[1].T
    rare = ~dense & (n_q > 0)
    order = np.argsort(q[1], kind="stable")
    first = np.cumsum(n_q) - n_q
    at, term, weight = (x[rare[r[1]]] for x in r)
    upto = np.cumsum(n_q[term])
    flat, begin = out.ravel(), 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + LISTED, "right")))
        t, times = term[begin:end], n_q[term[begin:end]]
        own = order[np.repeat(first[t] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        np.add.at(flat, q[0][own] * shape[1] + np.repeat(at[begin:end], times), (q[2][own] * np.repeat(weight[begin:end], times)).astype(out.dtype))
        begin = end
    return out


def best(scores: np.ndarray, k: int, exact=lambda i, j, s: s, margin: float = 2e-9) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest positive scores of each row; ties, on exact scores rounded to 9 digits, go to the smaller column."""
    most = min(k, scores.shape[1])
    least = np.partition(scores, -most, axis=1)[:, -most] if most else np.zeros(len(scores))
    i, j = np.nonzero((scores >= (least - margin)[:, None]) & (scores > 0))
    order = np.lexsort((j, -rounded(exact(i, j, scores[i, j])), i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


def rounded(x: np.ndarray) -> np.ndarray:
    """To 9 digits, as Spark rounds: halves of the decimal form go up. In units of the ninth digit."""
    at = np.asarray(x, np.float64) * 1e9
    out = np.floor(at + 0.5)
    for n in np.nonzero(np.abs(at - np.floor(at) - 0.5) < 1e-4)[0]:
        out[n] = float((Decimal(repr(float(x[n]))) * 10**9).quantize(Decimal(1), ROUND_HALF_UP))
    return out
