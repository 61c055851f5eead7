import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tellstone.llm import neighbours
from tellstone.llm.centroids import CentroidGraph, balanced_centroids, unit
from tellstone.llm.neighbours import FOUND_SIMILARITY, nearest_vectors, p1_nearest

SCHEMA = "id long, kind string, vec array<float>, dim int, rep string, list int"


def frame(spark, rows):
    return spark.createDataFrame([(i, k, None if v is None else [None if x is None else float(x) for x in v], d, "x", 0) for i, k, v, d in rows], SCHEMA)


def true_neighbours(x, i, k):
    sims = x @ x[i]
    sims[i] = -2
    return np.argsort(-sims, kind="stable")[:k]


@pytest.mark.parametrize("shape", ["clusters", "noise"])
def test_recall(spark, shape):
    rng = np.random.default_rng(1)
    n, d = 6000, 24
    x = rng.normal(size=(n, d)) if shape == "noise" else rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.5 * rng.normal(size=(n, d))
    df = frame(spark, [(i, "a", v, d) for i, v in enumerate(x)])
    got = {}
    for r in nearest_vectors(df, queries=F.col("id") % 20 == 0).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    u = unit(x)
    hits = [len(got[i] & set(true_neighbours(u, i, 10).tolist())) for i in range(0, n, 20)]
    assert np.mean(hits) / 10 >= 0.9 and all(len(v) == 10 for v in got.values()) and len(got) == 300


def test_recall_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 64)
    rng = np.random.default_rng(6)
    n, d = 6000, 64
    x = rng.normal(size=(n, d))
    got = {}
    for r in nearest_vectors(frame(spark, [(i, "a", v, d) for i, v in enumerate(x)]), queries=F.col("id") % 20 == 0).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    u = unit(x)
    hits = [len(got[i] & set(true_neighbours(u, i, 10).tolist())) for i in range(0, n, 20)]
    assert np.mean(hits) / 10 >= 0.9


def test_long_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_POSTINGS", 100)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 300)
    rng = np.random.default_rng(8)
    n, d = 4000, 16
    x = rng.normal(size=(n, d))
    x[: n // 3] = x[0] + 1e-3 * rng.normal(size=(n // 3, d))  # a third of all in one place
    got = {}
    rows = nearest_vectors(frame(spark, [(i, "a", v, d) for i, v in enumerate(x)])).collect()
    for r in rows:
        got.setdefault(r["id"], set()).add(r["neighbour"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = [len(got[i] & set(true_neighbours(u, i, 10).tolist())) for i in range(0, n, 13)]
    assert np.mean(hits) / 10 >= 0.9 and len(rows) == 10 * n
    assert all(abs(r["similarity"] - u[r["id"]] @ u[r["neighbour"]]) < 1e-6 for r in rows[:500])


def test_recall_on_the_data(spark, folder):
    rows = spark.read.parquet(f"{folder}/prebaked_embeddings.parquet").select("id", "embedding_type", "embedding", "embedding_dim").collect()
    by = {}
    for r in rows:
        v = r["embedding"]
        if v is not None and len(v) == r["embedding_dim"] and np.isfinite(v).all() and np.any(v):
            by.setdefault(r["embedding_type"], []).append((r["id"], v))
    got = {}
    for r in p1_nearest(spark, folder).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    hits = total = 0
    for vs in by.values():
        ids, u = np.array([i for i, _ in vs]), unit(np.array([v for _, v in vs]))
        for at in np.flatnonzero(ids % 20 == 0):
            want = set(ids[true_neighbours(u, at, 10)].tolist())
            hits, total = hits + len(want & got[ids[at]]), total + len(want)
    assert hits / total >= 0.9


def test_unusable_and_few(spark):
    nan = float("nan")
    rows = [(1, "a", [1, 0], 2), (2, "a", [2, 0.1], 2), (3, "a", [0, 0], 2), (4, "a", [nan, 1], 2), (5, "a", [1, 0, 0], 2), (6, "a", None, 2), (7, "b", [1, 0], 2), (8, None, [1, 0], 2), (9, "a", [1, None], 2), (10, "a", [float("inf"), 1], 2), (11, "a", [1, 0], None)]
    got = sorted((r["id"], r["neighbour"]) for r in nearest_vectors(frame(spark, rows)).collect())
    assert got == [(1, 2), (2, 1)]
    assert nearest_vectors(frame(spark, [])).count() == 0


def test_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 8))
    rows = [(i, "a", v, 8) for i, v in enumerate(x)] + [(100 + i, "a", x[0], 8) for i in range(400)] + [(900, "a", x[1] * 3, 8)]
    found = nearest_vectors(frame(spark, rows), k=10)
    by = {}
    for r in found.orderBy("id", "rank").collect():
        by.setdefault(r["id"], []).append(r["neighbour"])
    assert len(by) == 451 and all(len(v) == 10 for v in by.values())
    assert by[0] == list(range(100, 110)) and by[100] == [0, *range(101, 110)] and by[499] == [0, *range(100, 109)] and by[1][0] == 900
    some = {r["id"] for r in nearest_vectors(frame(spark, rows), k=3, queries=F.col("id") == 499).collect()}
    assert some == {499}


def test_close_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x[1500:] = x[:1500] + 0.02 * rng.normal(size=(1500, 16))
    rows = nearest_vectors(frame(spark, [(i, "a", v, 16) for i, v in enumerate(x)])).where(F.col("similarity") >= FOUND_SIMILARITY).collect()
    pairs = {tuple(sorted((r["id"], r["neighbour"]))) for r in rows}
    assert {(i, i + 1500) for i in range(1500)} <= pairs


def test_graph_finds_nearest_centroids():
    rng = np.random.default_rng(4)
    c = unit(rng.normal(size=(600, 16)))
    q = unit(rng.normal(size=(200, 16)))
    ids, sims = CentroidGraph(c, rng).search(q, 8)
    want = np.argsort(-(q @ c.T), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids.tolist(), want.tolist())]) / 8 >= 0.9
    assert (np.diff(sims, axis=1) <= 1e-6).all() and all(len(set(r)) == len(r) for r in ids.tolist())
    small = CentroidGraph(c[:1], rng).search(q, 3)[0]
    assert (small[:, 0] == 0).all() and (small[:, 1:] == -1).all()


def test_clusters_are_balanced():
    rng = np.random.default_rng(5)
    x = unit(np.concatenate([rng.normal(size=(2000, 8)), 0.05 * rng.normal(size=(1000, 8)) + 1]))
    c, _ = balanced_centroids(x, 50, rng)
    sizes = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
    assert sizes.max() <= 150 and len(c) >= 60
    c, n = balanced_centroids(np.repeat(x[:1], 500, axis=0), 50, rng)
    assert len(c) == 1 and n.tolist() == [500]


def test_a_cell_sorts_out_few_postings_of_later_lists(monkeypatch):
    rng, n, dim, k = np.random.default_rng(4), 1200, 12, 10
    vec = rng.normal(size=(n, dim)).astype(np.float32)
    held = [[i % 8] + [(i + 3) % 8] * (i % 5 == 0) for i in range(n)]  # some are in two lists
    ids = np.arange(n) * 7 + 3
    raw = pa.array([v.tobytes() for v in vec])
    rows = pa.RecordBatch.from_arrays([pa.array(ids), raw, pa.array(held, pa.list_(pa.int32())), pa.array([list(range(8))] * n, pa.list_(pa.int32()))], ["id", "vec", "held", "asked"])
    sorted_out, partition = [], np.argpartition
    monkeypatch.setattr(np, "argpartition", lambda a, *args, **more: sorted_out.append(len(a)) or partition(a, *args, **more))
    out = pa.Table.from_batches(list(neighbours._Cell([rows]).nearest(rows, k)))
    assert n <= sum(sorted_out) < 4 * n
    x = vec.astype(np.float64) / np.linalg.norm(vec.astype(np.float64), axis=1, keepdims=True)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    want = {(ids[i], ids[j]) for i in range(n) for j in np.argsort(-sims[i])[:k]}
    assert {*zip(out["id"].to_pylist(), out["neighbour"].to_pylist())} == want and out.num_rows == n * k


def test_all_centroids_within_the_ratio_are_found(monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(27, 48))
    c = unit(base[rng.integers(0, 27, 3000)] + 0.6 * rng.normal(size=(3000, 48)))
    q = unit(base[rng.integers(0, 27, 150)] + 0.9 * rng.normal(size=(150, 48)))
    far = np.sqrt(np.maximum(0, 2 - 2 * (q @ c.T)))
    want = {(i, j) for i in range(150) for j in np.flatnonzero(far[i] <= far[i].min() * np.float32(1.35))}
    graph = CentroidGraph(c, rng)
    row, ids, place = graph.within(q, 1.35)
    assert {*zip(row.tolist(), ids.tolist())} == want and len(row) == len(want) > 3000
    assert all((np.diff(far[i, ids[row == i]]) >= -1e-6).all() and (place[row == i] == np.arange((row == i).sum())).all() for i in range(150))
    monkeypatch.setattr("tellstone.llm.centroids.COMPARED", 0)  # by the graph
    row, ids, _ = graph.within(q, 1.35)
    assert len(want & {*zip(row.tolist(), ids.tolist())}) >= 0.9 * len(want)


def test_a_cell_begins_with_the_nearest_list(monkeypatch):
    rng, n, dim, k = np.random.default_rng(5), 800, 12, 5
    centre = np.linspace(rng.normal(size=dim), 3 * rng.normal(size=dim), 8)  # the lists come nearer and nearer to the rows that ask
    vec = (centre[np.arange(n) % 8] + 0.1 * rng.normal(size=(n, dim))).astype(np.float32)
    asking = (centre[7] + 0.1 * rng.normal(size=(50, dim))).astype(np.float32)
    raw = lambda x: pa.array([v.tobytes() for v in x])
    lists = lambda x: pa.array(x, pa.list_(pa.int32()))
    names = ["id", "vec", "held", "asked"]
    cell = neighbours._Cell([pa.RecordBatch.from_arrays([pa.array(np.arange(n)), raw(vec), lists([[i % 8] for i in range(n)]), lists([[]] * n)], names)])
    sorted_out, partition = [], np.argpartition
    monkeypatch.setattr(np, "argpartition", lambda a, *args, **more: sorted_out.append(len(a)) or partition(a, *args, **more))
    out = pa.Table.from_batches(list(cell.nearest(pa.RecordBatch.from_arrays([pa.array(np.arange(50) + n), raw(asking), lists([[]] * 50), lists([[*range(8), 99]] * 50)], names), k)))
    assert sum(sorted_out) == 50
    want = {(n + i, int(j)) for i in range(50) for j in np.argsort(-(unit(asking)[i] @ unit(vec).T))[:k]}
    assert {*zip(out["id"].to_pylist(), out["neighbour"].to_pylist())} == want
