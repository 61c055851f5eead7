"""Problem 1: the most similar vectors of every vector."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tellstone.llm.centroids import CentroidGraph, balanced_centroids, unit
from tellstone.session import Scratch
from tellstone.sources.tables import read_table

#: The index is fitted on one vector in SAMPLE_EVERY, at least SAMPLE_LEAST and at most SAMPLE_MOST of a kind.
SAMPLE_EVERY, SAMPLE_LEAST, SAMPLE_MOST = 16, 4096, 65_536
#: Vectors of a posting list, copies at the boundary not counted.
LIST_SIZE = 512
#: Postings and queries that one task should have of one cell (lists next to each other).
CELL_POSTINGS, CELL_QUERIES = 8192, 200_000
NEIGHBOURS = 10
#: Neighbours beyond those wanted that are scored exactly.
SPARE = 4
FOUND_SIMILARITY = 0.92
#: A vector is kept in lists at most so many times as far as the nearest, and in so many; a query reads all lists within the other ratio.
POSTING_RATIO, MOST_POSTINGS, PROBE_RATIO = 1.05, 4, 1.35
_PLACED = "cell int, part int, tag tinyint, id long, vec binary, held array<int>, asked array<int>"


@dataclass(frozen=True)
class KindIndex:
    """Centroids of one kind: their lists lie in cells, and large cells are cut by the ids kept there and by those that ask."""

    graph: CentroidGraph
    cell_of: np.ndarray  # of each list
    first: int  # number of the first cell
    parts: np.ndarray  # of each cell, by kept ids
    groups: np.ndarray  # of each cell, by asking ids


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _ranges(lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _assigner(index: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows for the cells of each vector, with the lists there that keep it and those that it asks: columns id, kind, query and vec come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, KindIndex] = index.value
        for batch in batches:
            for kind in batch.column("kind").unique().to_pylist():
                if kind in kinds:
                    part = batch.filter(pa.compute.equal(batch.column("kind"), kind))
                    for at in range(0, part.num_rows, 4096):
                        yield from placed(kinds[kind], part.slice(at, 4096))

    def placed(kind: KindIndex, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = np.ascontiguousarray(_matrix(rows.column("vec"), kind.graph.centroids.shape[1]), np.float32)
        ids, asks = rows.column("id").to_numpy(), rows.column("query").to_numpy(zero_copy_only=False)
        row, to, place = kind.graph.within(unit(raw), PROBE_RATIO)
        far = _distance(unit(raw)[row], kind.graph.centroids[to])
        nearest = np.full(len(ids), np.inf)
        np.minimum.at(nearest, row, far)
        kept = (place == 0) | ((place < MOST_POSTINGS) & (far <= POSTING_RATIO * nearest[row]))
        use = kept | asks[row]
        row, to, kept = row[use], to[use], kept[use]
        cell = kind.cell_of[to]
        order = np.lexsort((to, cell, row))
        row, to, kept, cell = row[order], to[order], kept[order], cell[order]
        start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])])
        holds = np.logical_or.reduceat(kept, start)
        # a cell of p parts and g groups has p x g places: postings go to those of their part, queries to those of their group
        mixed = (ids[row[start]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        p, g = kind.parts[cell[start]], kind.groups[cell[start]]
        own_p, own_g = (mixed % p.astype(np.uint64)).astype(np.int64), (mixed // np.uint64(64) % g.astype(np.uint64)).astype(np.int64)
        again = np.repeat(np.arange(len(start)), p * g)
        at = _ranges(p * g)
        here_p, here_g = at // g[again] == own_p[again], at % g[again] == own_g[again]
        posting, asking = holds[again] & here_p, asks[row[start]][again] & here_g
        some = np.flatnonzero(posting | asking)
        again, at, posting, asking = again[some], at[some], posting[some], asking[some]
        upto = np.r_[start, len(row)]
        lists = [[], []]
        sizes = [np.zeros(len(again), np.int64), np.zeros(len(again), np.int64)]
        for i, (wanted, mask) in enumerate(((posting, kept), (asking, np.ones(len(kept), bool)))):
            length = np.where(wanted, upto[again + 1] - upto[again], 0)
            item = np.repeat(upto[again], length) + _ranges(length)
            of = np.repeat(np.arange(len(again)), length)
            ok = mask[item]
            lists[i], sizes[i] = to[item[ok]], np.bincount(of[ok], minlength=len(again))
        vectors = raw[row[start][again]]
        binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(vectors.shape[1] * 4), len(vectors), [None, pa.py_buffer(vectors.tobytes())]).cast(pa.binary())
        listed = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(v, pa.int32())) for v, n in zip(lists, sizes)]
        columns = [pa.array(kind.first + cell[start][again], pa.int32()), pa.array(at, pa.int32()), pa.array(np.where(posting, 0, 1), pa.int8()), pa.array(ids[row[start]][again]), binary, *listed]
        out = pa.RecordBatch.from_arrays(columns, ["cell", "part", "tag", "id", "vec", "held", "asked"])
        yield from (out.slice(lo, 8192) for lo in range(0, out.num_rows, 8192))

    import pyarrow.compute  # noqa: F401

    return run


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nd->n", x, y)))


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


class _Cell:
    """The postings of one place of a cell."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.id = np.concatenate([b.column("id").to_numpy() for b in batches])
        self.raw = np.concatenate([_vectors(b.column("vec")) for b in batches])
        self.unit = unit(self.raw)
        self.by_id = np.argsort(self.id)
        self.lists: dict[int, np.ndarray] = {}
        of = np.concatenate([b.column("held").flatten().to_numpy() for b in batches])
        n = np.concatenate([np.diff(b.column("held").offsets.to_numpy()) for b in batches])
        order = np.argsort(of, kind="stable")
        row = np.repeat(np.arange(len(n)), n)[order]
        for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of[order])) + 1) if len(of) else []:
            self.lists[int(of[order[part[0]]])] = row[part]
        self.numbers = np.array([*self.lists], np.int64)  # ascending
        self.units = [self.unit[held] for held in self.lists.values()]
        self.means = np.array([x.mean(axis=0) for x in self.units], np.float32).reshape(-1, self.unit.shape[1])
        self.square = np.einsum("nd,nd->n", *[self.raw.astype(np.float64)] * 2)

    def nearest(self, batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        """The k most similar postings of the lists that each row of the batch asks, scored exactly.

        A list gives a row its best ones; as soon as one has given enough, others need only give what is no worse than the last of those.
        So the list whose mean is nearest to a row comes first.
        """
        if not len(self.numbers):
            return
        asked = batch.column("asked")
        to = asked.flatten().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
        of = np.minimum(np.searchsorted(self.numbers, to), len(self.numbers) - 1)
        here = self.numbers[of] == to
        row, of = row[here], of[here]
        ids, raw = batch.column("id").to_numpy(), _vectors(batch.column("vec"))
        x = unit(raw)
        own = self.by_id[np.minimum(np.searchsorted(self.id, ids, sorter=self.by_id), len(self.id) - 1)]
        own = np.where(self.id[own] == ids, own, len(self.id))  # the place of a row among the postings
        place = np.full(len(self.id) + 1, -1)
        near = (x @ self.means.T)[row, of]
        nearest = np.full(batch.num_rows, -np.inf, np.float32)
        np.maximum.at(nearest, row, near)
        turn = of + len(self.numbers) * (near < nearest[row])
        order = np.argsort(turn, kind="stable")
        most, held_by = k + SPARE, [*self.lists.values()]
        found, worst = [], np.full(batch.num_rows, -1.5, np.float32)
        for part in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1) if len(turn) else []:
            held, y = held_by[of[part[0]]], self.units[of[part[0]]]
            place[held] = np.arange(len(held))
            for rows in np.split(row[part], range(4096, len(part), 4096)):
                sims = x[rows] @ y.T
                itself = np.flatnonzero(place[own[rows]] >= 0)
                sims[itself, place[own[rows[itself]]]] = -2
                some = sims.max(axis=1) >= worst[rows]
                if not some.all():
                    sims, rows = sims[some], rows[some]
                good = sims >= worst[rows][:, None]
                many = np.flatnonzero(np.count_nonzero(good, axis=1) > most)
                if len(many):
                    better = sims[many]
                    at = np.argpartition(-better, most - 1, axis=1)[:, :most]
                    better = np.take_along_axis(better, at, 1)
                    worst[rows[many]] = better.min(axis=1)
                    found.append((np.repeat(rows[many], most), held[at].ravel(), better.ravel()))
                    good[many] = False
                i, j = np.divmod(np.flatnonzero(good), good.shape[1])
                found.append((rows[i], held[j], sims[i, j]))
            place[held] = -1
        if not found:
            return
        q, p, s = (np.concatenate(c) for c in zip(*found))
        good = (s >= worst[q]) & (s > -2)
        q, p, s = q[good], p[good], s[good]
        order = np.argsort(q * len(self.id) + p)
        q, p, s = q[order], p[order], s[order]
        fresh = np.r_[True, (q[1:] != q[:-1]) | (p[1:] != p[:-1])][: len(q)]  # a posting may be in several lists of the cell
        q, p, s = _first(q[fresh], p[fresh], s[fresh], self.id, most)
        square, s = np.einsum("nd,nd->n", *[raw.astype(np.float64)] * 2), np.empty(len(q))
        for at in range(0, len(q), 4096):
            i, j = q[at : at + 4096], p[at : at + 4096]
            s[at : at + 4096] = np.einsum("nd,nd->n", raw[i].astype(np.float64), self.raw[j].astype(np.float64)) / np.sqrt(square[i] * self.square[j])
        q, p, s = _first(q, p, s, self.id, k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(self.id[p]), pa.array(s)], ["id", "neighbour", "similarity"])


def _first(q: np.ndarray, p: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar of each query; ties go to the smaller id."""
    order = np.lexsort((ids[p], -s, q))
    q, p, s = q[order], p[order], s[order]
    begin = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(begin, np.arange(len(q)), 0)) if len(q) else q
    return q[place < k], p[place < k], s[place < k]


def _searcher(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Searches one place of a cell after another: its postings come first and are held, queries stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, cell = None, [], None
        for whole in itertools.chain(batches, [None]):
            runs = []
            if whole is not None and whole.num_rows:
                columns = [whole.column(c).to_numpy() for c in ("cell", "part", "tag")]
                cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
                runs = [(tuple(int(c[lo]) for c in columns), whole.slice(lo, hi - lo)) for lo, hi in zip([0, *cuts], [*cuts, whole.num_rows])]
            for (c, part, tag), rows in runs or ([((-1, -1, 1), None)] if whole is None else []):
                if kept and ((c, part) != now or tag):  # the postings are complete
                    cell = _Cell(kept)
                    for b in kept:
                        yield from cell.nearest(b, k)
                    kept = []
                if (c, part) != now:
                    now, cell = (c, part), cell if (c, part) == now else None
                if tag == 0:
                    kept.append(rows)
                elif rows is not None and cell is not None:
                    yield from cell.nearest(rows, k)

    return run


def usable(vec: Column, dim: Column) -> Column:
    """Not null, as long as ``dim`` says, every number finite, and not all zero."""
    square = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vec.isNotNull() & (F.size(vec) == dim) & ~F.isnan(square) & (square > 0) & (square < float("inf"))


def _index(reps: DataFrame, counts: dict[str, int], seed: int) -> dict[str, KindIndex]:
    """The index of each kind, fitted on a bounded sample."""
    wanted = {kind: min(SAMPLE_MOST, max(SAMPLE_LEAST, n // SAMPLE_EVERY)) for kind, n in counts.items()}
    share = F.coalesce(*[F.when(F.col("kind") == kind, min(1.0, wanted[kind] / n)) for kind, n in counts.items()]) if counts else F.lit(0.0)
    hashed = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_003)) / 1_000_003
    rows = reps.where(hashed < share).select("kind", "vec").toArrow() if counts else None
    found, first = {}, 0
    for kind in sorted(counts):
        part = rows.filter(pa.compute.equal(rows.column("kind"), kind)).column("vec").combine_chunks()
        if not len(part):
            part = reps.where(F.col("kind") == kind).limit(1).select("vec").toArrow().column("vec").combine_chunks()
        if isinstance(part, pa.ChunkedArray):
            part = part.chunk(0)
        x = unit(_matrix(part, len(part[0])))[: 2 * SAMPLE_MOST]
        rng = np.random.default_rng(seed)
        centroids, sizes = balanced_centroids(x, max(8, round(LIST_SIZE * len(x) / counts[kind])), rng)
        found[kind] = _in_cells(CentroidGraph(centroids, rng), sizes * (counts[kind] / len(x)), x, counts[kind] / len(x), first)
        first += len(found[kind].parts)
    return found


def _in_cells(graph: CentroidGraph, sizes: np.ndarray, sample: np.ndarray, each: float, first: int) -> KindIndex:
    """Lists that follow each other make a cell; how many will be kept there and will ask is told from the sample, each vector of which stands for ``each``."""
    cell_of, held = np.empty(len(sizes), np.int64), []
    for i, n in enumerate(sizes):
        if not held or held[-1] + n > CELL_POSTINGS:
            held.append(0.0)
        held[-1] += n
        cell_of[i] = len(held) - 1
    few = sample[:: max(1, len(sample) // 4096)]
    row, to, _ = graph.within(few, PROBE_RATIO)
    asking = np.bincount(np.unique(row * len(held) + cell_of[to]) % len(held), minlength=len(held)) * each * len(sample) / len(few)
    parts = lambda n, most: np.maximum(1, np.ceil(np.asarray(n) / most)).astype(np.int64)
    return KindIndex(graph, cell_of, first, parts(held, 2 * CELL_POSTINGS), parts(asking, CELL_QUERIES))


def nearest_vectors(vectors: DataFrame, k: int = NEIGHBOURS, queries: Column | None = None, seed: int = 1) -> DataFrame:
    """For every query the k most similar other vectors of its kind: id, neighbour, similarity, rank.

    ``vectors`` has id (long, unique), kind (string), dim (int) and vec (array of floats). Unusable vectors
    (see ``usable``), and such without id or kind, neither ask nor are found. ``queries`` says which
    rows ask, all by default. Similarity is the cosine: lists are searched in single precision, and what is
    kept, with SPARE more, is scored again in double precision; ties go to the smaller id.

    * Posting lists: balanced clusters, fitted on a bounded sample by splitting clusters
      until they are small; every vector is indexed. A vector at a boundary is kept in all lists that are
      hardly farther than its nearest (POSTING_RATIO); a query reads all lists within a
      distance ratio (PROBE_RATIO), however many there are. Both come from one search of the centroids in memory: all are
      compared, or, of very many, a beam over their graph widens until it is past the ratio. Only centroids and their graph go to
      all tasks: at most 2 SAMPLE_MOST / 8 for a kind.
    * Lists that lie next to each other make a cell. A row goes to a cell once, with the lists of it that it is kept in and
      asks. A task holds the postings of a cell, some CELL_POSTINGS, and queries stream past them. A list or cell
      with more postings (a hot one, or all of them in a very large collection) is cut in parts, each of which meets its queries; a cell that very many ask is
      repeated for groups of them. Both numbers are told from the sample.
    * Vectors stored again are searched once; their copies share the result and are
      each other's first neighbours, of which only the first k + 1 ids are needed.

    The search is approximate: a neighbour may be missed (tests hold recall at 10 to at least 0.9).
    Fewer than k neighbours come out where a kind has fewer. Empty input gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = vectors.where(F.col("id").isNotNull() & F.col("kind").isNotNull() & usable(F.col("vec"), F.col("dim")))
    rows = rows.select("id", F.concat_ws("/", "kind", F.col("dim").cast("string")).alias("kind"), "vec", asks.alias("query"))
    light = scratch.write(rows.select("id", "kind", "query", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2")))
    same = ["kind", "h1", "h2"]
    groups = light.groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("query").alias("asked"))
    copies = scratch.write(light.join(groups.where("n > 1").select(*same, "rep", "asked"), same).select("rep", "id", "asked"))
    reps = rows.join(copies, "id", "left").where("rep is null or rep = id").select("id", "kind", F.coalesce("asked", "query").alias("query"), "vec")
    counts = {r[0]: r[1] for r in light.groupBy("kind").count().collect()}
    index = spark.sparkContext.broadcast(_index(reps, counts, seed))
    placed = reps.mapInArrow(_assigner(index), _PLACED).repartition("cell", "part").sortWithinPartitions("cell", "part", "tag")
    met = placed.mapInArrow(_searcher(k), "id long, neighbour long, similarity double")
    found = scratch.write(met.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity")))
    first = copies.withColumn("place", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("place") <= k + 1)
    heads = first.select(F.col("rep").alias("neighbour"), F.col("id").alias("copy"))
    tails = copies.select(F.col("rep").alias("id"), F.col("id").alias("member"))
    spread = found.join(heads, "neighbour", "left").select("id", F.coalesce("copy", "neighbour").alias("neighbour"), "similarity")
    spread = spread.join(tails, "id", "left").select(F.coalesce("member", "id").alias("id"), "neighbour", "similarity")
    equal = copies.select("rep", "id").join(first.select("rep", F.col("id").alias("neighbour")), "rep").where("id <> neighbour").select("id", "neighbour", F.lit(1.0).alias("similarity"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    out = spread.unionByName(equal)
    if queries is not None:
        out = out.where(queries)
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _embeddings(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "prebaked_embeddings", "id", "embedding_type", "embedding", "embedding_dim")
    return rows.select("id", F.col("embedding_type").alias("kind"), F.col("embedding").alias("vec"), F.col("embedding_dim").alias("dim"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Close pairs among the ten nearest of every vector."""
    found = nearest_vectors(_embeddings(spark, folder)).where(F.col("similarity") >= FOUND_SIMILARITY)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id is divisible by 20, against all vectors."""
    return nearest_vectors(_embeddings(spark, folder), queries=F.col("id") % 20 == 0).select("id", "neighbour", "rank", F.round("similarity", 3).alias("similarity"))


QUERIES = {"p1_found": p1_found, "p1_nearest": p1_nearest}
SQL = {
    "p1_found": """
with v as (
  select id, embedding_type as kind, embedding_dim as dim, cast(embedding as double[]) as e from prebaked_embeddings
  where embedding is not null and len(embedding) = embedding_dim and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)
select a.id as id_a, b.id as id_b from v a join v b on a.kind = b.kind and a.dim = b.dim and a.id < b.id
where list_cosine_similarity(a.e, b.e) >= 0.92
"""
}
