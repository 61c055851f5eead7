import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellstone.functions import vectors as V
from tellstone.operators import similarity as S
from tellstone.operators.boxes import greedy_keep, suppressed


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.96) and got[1] == 0 and got[2] is None
    assert df.select(V.unit(F.col("a"))).first()[0] == [0.6, 0.8]
    assert df.select(V.norm(V.blend(F.col("a"), F.col("b")))).first()[0] == pytest.approx(1)
    assert spark.range(1).select(V.join_confidence(F.lit(1.0), F.lit(0.5), F.lit(None))).first()[0] == pytest.approx(0.55)


def test_boxes_overlap(spark):
    iou = lambda *b: spark.range(1).select(V.iou(*[F.lit(x) for x in b])).first()[0]
    assert iou(0, 0, 2, 2, 2, 0, 2, 2) == 0 and iou(0, 0, 2, 2, 0, 0, 2, 2) == 1
    assert iou(0, 0, 2, 1, 1, 0, 2, 1) == pytest.approx(1 / 3)


def test_shapes(spark):
    df = spark.createDataFrame([([(0, 0), (4, 0), (4, 3), (0, 3)],), ([],), ([(1, 1)],)], "p array<struct<x int, y int>>")
    rows = df.select(V.contour_area(F.col("p")).alias("a"), V.contour_perimeter(F.col("p")).alias("l"), V.corner_angles(F.col("p")).alias("g")).collect()
    assert (rows[0]["a"], rows[0]["l"]) == (12, 14) and rows[0]["g"] == pytest.approx([90] * 4)
    assert rows[1]["a"] == 0 and rows[2]["l"] == 0 and rows[1]["g"] == []


def test_exact_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[7] = 0
    x[11] = x[12]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in S.exact_nearest(df.where("id < 20"), df, 5).collect():
        got.setdefault(r["id"], []).append((r["place"], r["neighbour"]))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for i in [i for i in range(20) if i != 7]:
        sims = np.round(unit @ unit[i], 9)
        sims[[i, 7]] = -2
        assert [n for _, n in sorted(got[i])] == np.lexsort((np.arange(300), -sims))[:5].tolist()
    assert 7 not in got and S.exact_nearest(df.limit(0), df, 3).count() == 0


def align(a, b, n=3):
    """Every n-gram of one text against every one of the other."""
    a, b = a.split(), b.split()
    if min(len(a), len(b)) < n:
        return 0.0
    ga, gb = ([" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] for w in (a, b))
    near = sum(1 / (1 + 0.5 * abs(i - j)) for i, x in enumerate(ga) for j, y in enumerate(gb) if x == y) / (max(len(ga), len(gb)) / 2)
    return min(1.0, 0.6 * len(set(ga) & set(gb)) / min(len(set(ga)), len(set(gb))) + 0.4 * near)


def test_alignment(spark):
    cases = [("a b c d e", "a b c x d e"), ("a b", "a b"), ("a a a a a", "a a a"), ("", "a b c"), ("p q r s", "t u v w")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "k int, a string, b string")
    got = {r["k"]: r["ngram_alignment"] for r in S.ngram_alignment(df, ["k"], "a", "b").collect()}
    assert got == pytest.approx({i: align(*c) for i, c in enumerate(cases)})


def test_complementarity(spark):
    p = [np.array(v, float) for v in ([0.1, 0.5, 0.2, 0.9], [170, 180, 190, 180], [1, 2, 3, 4])]
    score, turn = S.complementarity(p, p)
    assert turn == 0 and score > 0.9
    assert S.complementarity([np.array([])] * 3, p) == (0.0, 0)
    turned = [np.roll(v, -1) for v in p]
    assert S.complementarity(turned, p)[1] == 1
    df = spark.createDataFrame([(1, [0.1, 0.5], [180.0, 180.0], None, [0.1, 0.5], [180.0, 180.0], None), (2, None, None, None, [0.1], [1.0], [1.0])], "k int, curv_a array<double>, ang_a array<double>, len_a array<double>, curv_b array<double>, ang_b array<double>, len_b array<double>")
    got = {r["k"]: r["fracture"] for r in S.fracture_scores(df, ["k"]).collect()}
    assert got[1] == pytest.approx(1.0, abs=1e-3) and got[2] == 0


def test_contour_vector():
    v = S.contour_vector(np.array([0.0, 4, 4, 0]), np.array([0.0, 0, 3, 3]))
    assert len(v) == 512 and v.min() == 0 and v.max() <= 1 and math.isclose(v[255], 0, abs_tol=1e-6)


def test_joins_and_gaps(spark):
    df = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.7), ("a", "c", 0.7), ("a", "a", 1.0), ("a", None, 1.0), ("a", "d", float("nan")), ("a", "e", 0.1), ("a", "f", 0.2)], "tablet_a string, tablet_b string, s double")
    rows = [(r["partner"], r["score"], r["place"]) for r in S.ranked_joins(df, F.col("s")).where("tablet_id = 'a'").orderBy("place").collect()]
    assert rows == [("b", 0.7, 1), ("c", 0.7, 2), ("f", 0.2, 3)]
    pairs = spark.createDataFrame([(1, "A b", "x a q b z"), (2, None, "a")], "k int, f string, m string")
    got = [(r["word"], r["confidence"]) for r in S.filled_gaps(pairs, ["k"], "f", "m").orderBy("place").collect()]
    assert got == [("x", 0.2), ("a", 0.8), ("q", 0.2), ("b", 0.8), ("z", 0.2)]


def test_suppression_equals_greedy(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i % 7 == 0 else f"img{i % 3}", f"b{i:04d}", int(x), int(y), int(w), int(h), float(np.round(c, 1))) for i, (x, y, w, h, c) in enumerate(zip(rng.integers(0, 300, 400), rng.integers(0, 300, 400), rng.integers(20, 80, 400), rng.integers(20, 80, 400), rng.random(400)))]
    df = spark.createDataFrame(rows, "image string, id string, x int, y int, w int, h int, confidence double")
    for size in (15, 2000):  # many rounds and one
        got = {r["id"] for r in suppressed(df, round_boxes=size).collect()}
        want = set()
        for image in {r[0] for r in rows}:
            part = sorted((r for r in rows if r[0] == image), key=lambda r: (-r[6], r[1]))
            keep = greedy_keep(*np.array([r[2:6] for r in part], float).T, 0.3) if image else [True] * len(part)  # of unknown images
            want |= {r[1] for r, k in zip(part, keep) if k}
        assert got == want
    assert suppressed(df.limit(0)).count() == 0
    halves = spark.createDataFrame([("i", "a", 0, 0, 10, 10, 0.9), ("i", "b", 0, 0, 10, 3, 0.8), ("i", "c", 0, 0, 10, 5, 0.7), ("i", "d", 0, 0, None, 5, 0.7)], df.schema)
    assert {r["id"] for r in suppressed(halves).collect()} == {"a", "b"}  # exactly 0.3 stays


def test_graphs(spark):
    nodes = spark.createDataFrame([("1", ["x", "y"]), ("2", ["y", "x"]), ("3", ["y"]), ("4", []), ("5", None)], "id string, labels array<string>")
    assert [tuple(r) for r in S.label_graph(nodes).collect()] == [("x|y", "y", 1, 0.5)]
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")], "a string, b string")
    assert tuple(S.graph_stats(edges, "a", "b").first()) == (3, 2, pytest.approx(2 / 3))
    assert tuple(S.graph_stats(edges.limit(0), "a", "b").first()) == (0, 0, 0.0)
